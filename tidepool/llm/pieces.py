"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

A text is cut into units where no piece can stand: between two bytes that no piece of the
vocabulary holds side by side (such as before the spaces of a word). So the lattice of a
text is that of its units, and units may be of any length. Over each unit lies a lattice of
the vocabulary's pieces (the word mark stands for a space) and of its 256 byte pieces. The
forward pass sums the weight of all segmentations up to each byte, rescaled as it goes; a
segmentation is then drawn backwards, piece by piece, with the exact posterior probabilities. Draws
come from a counter hash of (seed, doc_id, unit, step), so a row gives the same
segmentation in any run and partitioning. Decoding joins the pieces' bytes and gives the
text back byte for byte.

The forward pass runs once for each distinct unit of a slice; sampling runs for all
units of a slice in lockstep.

Edge cases: null and empty texts have no pieces; a null doc_id has a key of its own; rows
that share a doc_id and text share the segmentation; extra columns are ignored.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, slices, span_hashes, text_buffer

MODEL = os.environ.get("TIDEPOOL_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
RESCALE = 24  # bytes between two rescalings of a unit's sums
SEED = 20
BYTE_WEIGHT = math.exp(-14)
_SLOT_BITS = 20
_ONE = np.float32(1).view(np.int32)  # bits of positive numbers rise with them, up to these 30


class Vocabulary:
    """Pieces as byte strings with weights, and a hash table over them.

    The file's pieces are ranked by merge order and carry no probabilities; a piece of
    rank r weighs 1 / (r + 3), Zipf's law, raised to ``alpha``.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_piece = np.zeros(256, np.int32)
        weight, usable = [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_piece[value] = i
                self.bytes_of.append(bytes([value]))
                weight.append(BYTE_WEIGHT)
                continue
            raw = b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else model.id_to_piece(i).replace("▁", " ").encode()
            self.bytes_of.append(raw)
            weight.append((1.0 / (max(-model.get_score(i), 0.0) + 3.0)) ** alpha)
            if raw:
                usable.append(i)
        #: Pairs of bytes that stand side by side in some piece.
        self.joint = np.zeros((256, 256), bool)
        for i in usable:
            b = np.frombuffer(self.bytes_of[i], np.uint8)
            self.joint[b[:-1], b[1:]] = True
        self.weight = np.array(weight)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        ids = np.array(usable, np.int64)
        hashes = span_hashes(self.joined, self.start[ids], self.start[ids + 1])
        # Two-choice table: a piece goes to its first free slot of several; lookups compare the whole hash.
        self.table_id = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table_hash = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.lengths = sorted(set(self.length[ids].tolist()))
        self.tries = 0
        for h, i in zip(hashes.tolist(), ids.tolist(), strict=True):
            slot, step = h >> (64 - _SLOT_BITS), 0
            while self.table_id[(slot + step) % (1 << _SLOT_BITS)] >= 0:
                step += 1
            self.table_id[(slot + step) % (1 << _SLOT_BITS)] = i
            self.table_hash[(slot + step) % (1 << _SLOT_BITS)] = h
            self.tries = max(self.tries, step + 1)

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """A vocabulary from another's attributes (plain data, which is what travels to executors)."""
        new = cls.__new__(cls)
        new.__dict__.update(state)
        return new

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = np.where(self.table_hash[slot] == hashes, self.table_id[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.table_id[slot] >= 0))
        for step in range(1, self.tries):
            if not len(open_):
                break
            s = (slot[open_] + step) % (1 << _SLOT_BITS)
            hit = self.table_hash[s] == hashes[open_]
            out[open_[hit]] = self.table_id[s[hit]]
            open_ = open_[~hit & (self.table_id[s] >= 0)]
        return out


def units(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of a slice and the first unit of each row; they tile the slice."""
    n = len(data)
    begin = np.ones(n, bool)
    begin[1:] = ~vocab.joint[data[:-1], data[1:]]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)


def _by_node(ends: np.ndarray, share: np.ndarray, length: np.ndarray, longest: int, byte: np.ndarray) -> np.ndarray:
    """Order of edges by end node and falling share (in single precision), then by length, byte pieces first.

    No two edges are alike in all four, so they go into one number and a sort of any kind gives one order; sorting by
    two columns takes five times as long and is left to slices whose numbers would need more than 64 bits.
    """
    low = int(2 * longest + 1).bit_length()
    last = 2 * length + ~byte
    falling = _ONE - np.minimum(share, 1.0).astype(np.float32).view(np.int32)
    if (int(ends.max()) if len(ends) else 0) >> (64 - 30 - low):
        return np.lexsort((last, falling, ends))
    return np.argsort(ends.astype(np.uint64) << np.uint64(30 + low) | falling.astype(np.uint64) << np.uint64(low) | last.astype(np.uint64))


def lattice(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Forward filtering over distinct units.

    Returns (end node of each unit, and by lattice edge, sorted by end node and falling
    probability: piece, start node, cumulative probability; first edge of each node).
    A node is a place in a unit: unit i owns nodes base[i]..base[i] + lengths[i].
    """
    base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    total = int(lengths.sum())
    unit = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    buffer = data[np.repeat(starts, lengths) + inside]
    room = lengths[unit] - inside
    at, node = np.arange(total), base[unit] + inside
    tails, ends, piece = [node], [node + 1], [vocab.byte_piece[buffer]]  # every byte has its piece
    for n in vocab.lengths:
        s = at[room >= n]
        if not len(s):
            break
        found = vocab.find(span_hashes(buffer, s, s + n))
        ok = found >= 0
        tails.append(node[s[ok]])
        ends.append(node[s[ok]] + n)
        piece.append(found[ok])
    tails, ends, piece = np.concatenate(tails), np.concatenate(ends), np.concatenate(piece)
    alpha = np.zeros(int(base[-1] + lengths[-1] + 1) if len(base) else 0)
    alpha[base] = 1.0
    longest = int(lengths.max()) if len(lengths) else 0
    place = np.zeros(len(alpha), np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.int64)
    place[node + 1] = inside + 1
    depth = place[ends]
    order = np.argsort(depth, kind="stable")  # a radix sort for short types
    tails, ends, piece = tails[order], ends[order], piece[order]
    weight, share = vocab.weight[piece], np.zeros(len(piece))
    cuts = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=longest + 1))))
    long = np.flatnonzero(lengths > RESCALE)
    reach = np.arange(vocab.lengths[-1] + 1)
    for p in range(1, longest + 1):
        e = slice(cuts[p], cuts[p + 1])
        part = alpha[tails[e]] * weight[e]
        np.add.at(alpha, ends[e], part)
        share[e] = part / alpha[ends[e]]
        if p % RESCALE == 0:
            long = long[lengths[long] > p]
            nodes = base[long][:, None] + p - reach[reach <= p]
            alpha[nodes] /= alpha[base[long] + p][:, None]
    order = _by_node(ends, share, ends - tails, vocab.lengths[-1], piece == vocab.byte_piece[vocab.joined[vocab.start[piece]]])
    ends, tails, piece, share = ends[order], tails[order], piece[order], share[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=len(alpha)))))
    run = np.cumsum(share)
    before = np.concatenate(([0.0], run))[first[ends]]
    return base + lengths, base, piece, tails, run - before, first


def sample(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a slice in text order and the number of pieces of each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    starts, first_unit = units(vocab, data, offsets)
    ends = np.append(starts[1:], len(data))
    _, one, kind = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    end_node, base, piece, tail, upto, first = lattice(vocab, data, starts[one], (ends - starts)[one])
    row = np.repeat(np.arange(rows), np.diff(first_unit))
    number = np.arange(len(starts)) - first_unit[row]
    stream = mix64(keys[row] + mix64(number.astype(np.uint64) + np.uint64(seed << 40)))
    node, stop = end_node[kind], base[kind]
    active, step, drawn = np.arange(len(starts)), 0, []
    count = np.zeros(len(starts), np.int64)
    while len(active):
        here = node[active]
        u = (mix64(stream[active] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge, last = first[here], first[here + 1] - 1
        more = np.flatnonzero((upto[edge] <= u) & (edge < last))
        while len(more):
            edge[more] += 1
            more = more[(upto[edge[more]] <= u[more]) & (edge[more] < last[more])]
        drawn.append((active, piece[edge]))
        count[active] += 1
        node[active] = tail[edge]
        active = active[tail[edge] > stop[active]]
        step += 1
    place = np.cumsum(count) - 1
    out = np.zeros(int(count.sum()), np.int32)
    for k, (who, ids) in enumerate(drawn):
        out[place[who] - k] = ids
    return out, np.diff(np.concatenate(([0], np.cumsum(count)))[first_unit])


def decode(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that piece ids stand for."""
    length = vocab.length[ids]
    total = int(length.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return vocab.joined[np.repeat(vocab.start[ids], length) + inside]


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED) -> DataFrame:
    """doc_id, ids (sampled pieces), n_pieces, lossless (whether decoding gave the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path).__dict__)

    def run(batches):
        vocab = Vocabulary.of(shared.value)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            doc = batch.column("doc_id")
            keys = mix64(np.asarray(doc.fill_null(0), np.int64).astype(np.uint64) * np.uint64(2) + np.asarray(doc.is_null()).astype(np.uint64))
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, count = sample(vocab, part, at, keys[lo:hi], seed)
                back, ends = decode(vocab, ids), np.concatenate(([0], np.cumsum(count)))
                size = np.concatenate(([0], np.cumsum(vocab.length[ids])))[ends]
                if len(back) == len(part):
                    bad = np.concatenate(([0], np.cumsum(back != part)))
                    same = (size == at)[1:] & (size == at)[:-1] & (bad[at[1:]] == bad[at[:-1]])
                else:
                    same = np.array([np.array_equal(back[size[i] : size[i + 1]], part[at[i] : at[i + 1]]) for i in range(hi - lo)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), lists, pa.array(count, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "lossless"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decoded(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text that ``ids`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).__dict__)

    def run(batches):
        vocab = Vocabulary.of(shared.value)
        for batch in batches:
            texts = [decode(vocab, np.array(ids or [], np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
