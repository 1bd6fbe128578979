"""Packing documents into sequences of WINDOW tokens by non-negative least squares.

A document is its token ids and an end id. Whole windows of a long document are sequences
of their own; what is left of every document (less than a window) is packed:

* Combinations of a few lengths that fill a window are enumerated over BINS bins of
  length. The histogram of the lengths is a table of BINS rows; non-negative least squares
  gives how often each combination repeats. Counts are rounded down, held to what the
  histogram has, and to as many sequences as all the tokens fill.
* Documents take the places of their bin by a rank that is counted by ranges of a hash, so
  no bin is gathered into one task.
* Lengths of a bin are rounded up, so a sequence has a gap. Documents that got no place are
  laid end to end and greedily fill first the gaps, then further windows, cut where those
  end. What remains is less than a window and becomes sequences whose lengths are powers
  of two. Gaps and stream are two cuts of the same line of positions; pieces come from
  their union, by blocks of positions.

So no sequence has padding. The tokenizer drops ASCII white space and nothing in it looks
across, so a text's ids are those of its pieces between white space, and each distinct
piece is encoded once.

Edge cases: null and empty texts have only the end id; a null doc_id stays null; rows that
repeat a doc_id are packed each for themselves; an empty table gives no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, of_worker, slices, span_hashes, text_buffer, word_spans
from .store import parallelism, park

WINDOW, END = 4096, 2  # fixed values of the contract
BINS = 64
_Q = WINDOW // BINS
BLOCK = 1 << 20  # positions in one block of the line
CACHE = 1 << 19  # pieces of text a worker remembers
SLICE = 1 << 18  # bytes of text worked on at once


def _tokenizer() -> str:
    if "TIDEPOOL_WORD_TOKENIZER" in os.environ:
        return os.environ["TIDEPOOL_WORD_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; distinct pieces between white space are encoded once.

    ASCII letters go by their small ones, as the tokenizer lowers them anyway, and a full stop or
    comma between an ASCII letter and white space is a piece of its own, as it is a token group of
    its own; so there are fewer distinct pieces. A text that may hold a special token's
    string is left as it is. Pieces are known by hashes of 64 bits, at most CACHE at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.forget()

    def forget(self, most: int = 0) -> None:
        most = most or CACHE
        self.bits = most.bit_length() + 1
        self.hash, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.size, self.start, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, or -1."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.hash[slot] == hashes, self.number[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.number[slot] >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) % len(self.hash)
            hit = self.hash[slot] == hashes[open_]
            out[open_[hit]] = self.number[slot[hit]]
            more = ~hit & (self.number[slot] >= 0)
            open_, slot = open_[more], slot[more]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        lists = [f.ids for f in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        n, k = self.known, len(lists)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + k > len(self.size):
            self.size, self.start = (np.concatenate((x, np.zeros_like(x))) for x in (self.size, self.start))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + k] = size
        self.start[n : n + k] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.known += k
        own, slot = np.arange(n, n + k, dtype=np.int32), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(own):
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]] = own[free]  # of several, the last gets the slot
            held = self.number[slot] == own
            self.hash[slot[held]] = hashes[held]
            own, hashes, slot = own[~held], hashes[~held], (slot[~held] + 1) % len(self.hash)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each with its end id, and their offsets."""
        small = LOWER[data]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for row in np.unique(np.searchsorted(offsets, special, side="right") - 1):
            small[offsets[row] : offsets[row + 1]] = data[offsets[row] : offsets[row + 1]]
        starts, ends, _ = word_spans(small, offsets)
        # Full stops and commas at the end of a piece.
        last = ends - 1
        stop = ((small[last] == 46) | (small[last] == 44)) & (ends - starts > 1)
        stop &= (small[last - 1] >= 97) & (small[last - 1] <= 122)
        if len(special):
            stop &= ~np.isin(np.searchsorted(offsets, starts, side="right"), np.searchsorted(offsets, special, side="right"))
        at = np.arange(len(starts)) + np.cumsum(stop) - stop
        begin, end = np.empty(len(starts) + int(stop.sum()), np.int64), np.empty(len(starts) + int(stop.sum()), np.int64)
        begin[at], end[at] = starts, ends - stop
        begin[at[stop] + 1], end[at[stop] + 1] = last[stop], ends[stop]
        hashes = span_hashes(small, begin, end) if len(begin) else np.zeros(0, np.uint64)
        piece = self._find(hashes)
        if (piece < 0).any():
            new, one = np.unique(hashes[piece < 0], return_index=True)
            if self.known + len(new) > CACHE:
                new, one = np.unique(hashes, return_index=True)
                self.forget(max(CACHE, len(new)))
            else:
                one = np.flatnonzero(piece < 0)[one]
            raw = small.tobytes()
            self._learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            piece = self._find(hashes)
        size = self.size[piece]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        cuts = upto[np.searchsorted(begin, offsets)]
        out_at = cuts + np.arange(len(cuts))
        out = np.full(int(out_at[-1]), END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[out_at[1:] - 1] = False
        out[keep] = self.ids[np.arange(upto[-1]) + np.repeat(self.start[piece] - upto[:-1], size)]
        return out, out_at


_TOKENS = "doc_id long, n long, rest binary, rest_crc long, full_crc array<long>"


def _kind(path: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _tokens(path: str, kind: str):
    def run(batches):
        encoder = of_worker(f"packing {path}", lambda: Encoder(path))
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in slices(off, SLICE):
                ids, at = encoder.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(at)
                middle = at[1:] - n % WINDOW
                ends = list(zip(middle.tolist(), at[1:].tolist(), strict=True))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in ends]
                slim = ids.astype(kind).tobytes()
                width = np.dtype(kind).itemsize
                rest = [slim[width * a : width * b] for a, b in ends]
                full = [[zlib.crc32(raw[4 * i : 4 * (i + WINDOW)]) for i in range(a, b, WINDOW)] for a, b in zip(at[:-1].tolist(), middle.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(rest, pa.binary()), pa.array(crc, pa.int64()), pa.array(full, pa.list_(pa.int64()))], names=["doc_id", "n", "rest", "rest_crc", "full_crc"])

    return run


def combinations(bins: int = BINS, parts: int = 3) -> np.ndarray:
    """Ways to fill ``bins`` units: up to ``parts`` lengths, or two lengths repeated; a row per way, a column per length."""
    ways = set()

    def extend(chosen: tuple, left: int) -> None:
        if not left:
            ways.add(chosen)
        elif len(chosen) < parts:
            for b in range(chosen[-1] if chosen else 1, left + 1):
                extend((*chosen, b), left - b)

    extend((), bins)
    for a in range(1, bins + 1):
        for times in range(1, bins // a + 1):
            left = bins - a * times
            if not left:
                ways.add((a,) * times)
            for b in range(a + 1, left + 1):
                if left % b == 0:
                    ways.add((a,) * times + (b,) * (left // b))
    out = np.zeros((len(ways), bins), np.int64)
    for i, w in enumerate(sorted(ways, key=lambda w: (len(w), w))):
        for b in w:
            out[i, b - 1] += 1
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: columns enter by their gradient, and leave where the solution over those inside would turn negative."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[inside] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9:
            break
        inside[best] = True
        while True:
            own = np.flatnonzero(inside)
            free = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if free.min() > 0:
                x[:] = 0
                x[own] = free
                break
            low = free <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - free[low], 1e-300))
            x[own] += step * (free - x[own])
            leaves = own[low & (x[own] <= 1e-12)]
            if not len(leaves):
                leaves = own[low][:1]
            x[leaves] = 0
            inside[leaves] = False
            if not inside.any():
                break
    return x


def plan(histogram: list[int], tokens: int) -> list[tuple[list[int], int]]:
    """(how many of each bin, repeat count) of the combinations that are used.

    histogram: documents of each bin; tokens: of all of them. There are never more
    sequences than the tokens fill, so what gets no place is enough for all gaps.
    """
    total = sum(histogram)
    if not total:
        return []
    ways = combinations()
    weight = np.sqrt(np.arange(1, BINS + 1))  # a long document without a place costs more
    x = least_squares((ways * weight).T.astype(float), np.array(histogram, float) / total * weight) * total
    left, room, out = np.array(histogram, np.int64), tokens // WINDOW, []
    for i in np.argsort(-x, kind="stable"):
        times = int(min(np.floor(x[i] + 1e-6), room, *(left[ways[i] > 0] // ways[i][ways[i] > 0])))
        if times > 0:
            out.append((ways[i].tolist(), times))
            left -= ways[i] * times
            room -= times
    return out


def _ranked(slim: DataFrame, ranges: int) -> DataFrame:
    """Adds ``rank`` in the bin, ``before`` (tokens of earlier rows of the bin) and ``fulls`` (whole windows of them)."""
    slim = slim.withColumn("range", F.pmod("mark", F.lit(ranges)))
    totals = slim.groupBy("bin", "range").agg(F.count("*").alias("k"), F.sum("rest").alias("t"), F.sum("full").alias("f"))
    earlier = Window.partitionBy("bin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("bin").alias("b"), F.col("range").alias("r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ktf"])
    own = Window.partitionBy("bin", "range").orderBy("mark", "row")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    joined = slim.join(starts, (F.col("bin") == F.col("b")) & (F.col("range") == F.col("r")))
    return joined.select("row", "doc_id", "n", "rest", "full", "bin", "rest_crc", "full_crc", (F.col("k0") + F.row_number().over(own) - 1).alias("rank"), (F.col("t0") + F.sum("rest").over(upto) - F.col("rest")).alias("before"), (F.col("f0") + F.sum("full").over(upto) - F.col("full")).alias("fulls"))


def _of_bin(values: list[int], bin_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), bin_.cast("int") + 1)


def _placed(ranked: DataFrame, places: list[tuple], spark) -> DataFrame:
    """Rows with a place: sequence, its slot, ``offset`` there and whether it is the last."""
    table = spark.createDataFrame(places, "b long, lo long, hi long, base long, times long, slot long")
    held = ranked.join(F.broadcast(table), (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    held = held.withColumn("sequence_id", F.col("base") + F.floor(nth / F.col("times")).cast("long")).withColumn("slot", F.col("slot") + nth % F.col("times"))
    own = Window.partitionBy("sequence_id").orderBy("slot")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("end", F.sum("rest").over(upto)).withColumn("last", F.lead("slot").over(own).isNull())


def _gaps(placed: DataFrame) -> DataFrame:
    """(start, size, sequence_id, offset): the gaps of the placed sequences, laid end to end in the order of the sequences."""
    gaps = placed.filter(F.col("last") & (F.col("end") < WINDOW)).select("sequence_id", F.col("end").alias("offset"), (WINDOW - F.col("end")).alias("size"), F.shiftright("sequence_id", 14).alias("range"))
    totals = gaps.groupBy(F.col("range").alias("r")).agg(F.sum("size").alias("t"))
    # Ranges of 16,384 sequences: summed in a table of a row for each 64 million tokens.
    earlier = Window.partitionBy(F.lit(1)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("r", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    upto = Window.partitionBy("range").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.join(starts, F.col("range") == F.col("r")).select((F.col("t0") + F.sum("size").over(upto) - F.col("size")).alias("start"), "size", "sequence_id", "offset")


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Intervals (start, size) as events of every block of the line that they touch."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK).cast("long")
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("long"), last))
    return rows.withColumn("block", block).withColumn("pos", F.greatest("start", F.col("block") * BLOCK)).withColumn("kind", F.lit(kind))


def _overlaid(gaps: DataFrame, stream: DataFrame) -> DataFrame:
    """Pieces of the stream's documents: cut where a document or a gap ends, by blocks of the line."""
    g = _blocks(gaps, "g").select("block", "pos", "kind", F.struct(F.col("start").alias("at"), F.col("sequence_id"), F.col("offset")).alias("gap"), F.lit(None).cast("struct<at:bigint,size:bigint,row:bigint>").alias("doc"))
    d = _blocks(stream, "d").select("block", "pos", "kind", F.lit(None).cast("struct<at:bigint,sequence_id:bigint,offset:bigint>").alias("gap"), F.struct(F.col("start").alias("at"), F.col("size"), F.col("row")).alias("doc"))
    own = Window.partitionBy("block").orderBy("pos", "kind")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    events = g.unionByName(d)
    cut = events.select("pos", F.last("gap", True).over(upto).alias("gap"), F.last("doc", True).over(upto).alias("doc"), F.lead("pos", 1).over(own).alias("next"), "block")
    end = F.least(F.coalesce("next", (F.col("block") + 1) * BLOCK), F.col("doc.at") + F.col("doc.size"))
    pieces = cut.filter(F.col("doc").isNotNull() & F.col("gap").isNotNull()).withColumn("length", end - F.col("pos")).filter("length > 0")
    # A block's edge doesn't cut a piece.
    whole = pieces.groupBy("doc.row", "doc.size", "gap.sequence_id", "doc.at", F.col("gap.at").alias("g"), "gap.offset").agg(F.min("pos").alias("pos"), F.sum("length").alias("length"))
    return whole.select("row", "size", "length", (F.col("pos") - F.col("at")).alias("inside"), "sequence_id", (F.col("offset") + F.col("pos") - F.col("g")).alias("offset"))


def _cut_crc(kind: str):
    def run(batches):
        for batch in batches:
            row, inside, length = (batch.column(c).to_numpy() for c in ("row", "inside", "length"))
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), kind)[a : a + n].astype("<u4").tobytes()) for x, a, n in zip(batch.column("ids"), inside, length, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(inside), pa.array(length), pa.array(crc, pa.int64())], names=["row", "inside", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pieces (row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and the documents' tokens (row, doc_id, rest: ids after whole windows, two bytes or four each)."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = tokenizer or _tokenizer()
    kind = _kind(path)
    tokens = park(slim.mapInArrow(_tokens(path, kind), _TOKENS).withColumn("row", F.monotonically_increasing_id()), 1 << 24)
    rest = F.col("n") % WINDOW
    rows = tokens.select("row", "doc_id", "n", rest.alias("rest"), F.floor(F.col("n") / WINDOW).cast("long").alias("full"), F.ceil(rest / _Q).cast("long").alias("bin"), F.xxhash64("row").alias("mark"), "rest_crc", "full_crc")
    by_bin = {r.bin: r for r in rows.groupBy("bin").agg(F.count("*").alias("k"), F.sum("rest").alias("t"), F.sum("full").alias("f")).collect()}
    each = lambda name: [int(by_bin[b][name]) if b in by_bin else 0 for b in range(BINS + 1)]
    count, total, fulls = each("k"), sum(each("t")), each("f")
    used = plan(count[1:], total)

    places, taken, base = [], [0] * (BINS + 1), 0
    for way, times in used:
        slot = 0
        for b, k in enumerate(way, 1):
            if k:
                places.append((b, taken[b], taken[b] + k * times, base, k, slot))
                taken[b] += k * times
                slot += k
        base += times
    ranges = max(parallelism(spark), sum(count) // (1 << 18))
    ranked = park(_ranked(rows, ranges))
    placed = park(_placed(ranked, places, spark).select("row", "doc_id", "n", "rest", "full", "rest_crc", "sequence_id", "end", "last")) if places else None

    # The line: gaps, then windows, then powers of two; the rows without a place, bin by bin.
    held = {r.bin: r.t for r in ranked.filter(F.col("rank") < _of_bin(taken, F.col("bin"))).groupBy("bin").agg(F.sum("rest").alias("t")).collect()}
    left = [t - int(held.get(b, 0)) for b, t in enumerate(each("t"))]
    first = [sum(left[:b]) - int(held.get(b, 0)) for b in range(BINS + 1)]
    stream = ranked.filter((F.col("rank") >= _of_bin(taken, F.col("bin"))) & (F.col("rest") > 0)).withColumn("start", F.col("before") + _of_bin(first, F.col("bin"))).withColumnRenamed("rest", "size")
    gap = base * WINDOW - sum(held.values())
    windows, tail = divmod(sum(left) - gap, WINDOW)
    rooms = spark.range(windows).select((gap + F.col("id") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("size"), (base + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed is not None:
        rooms = rooms.unionByName(_gaps(placed))
    ids, at, small = counter(base + windows), gap + windows * WINDOW, []
    for power in range(WINDOW.bit_length() - 1, -1, -1):
        if tail >> power & 1:
            small.append((at, 1 << power, next(ids), 0))
            at += 1 << power
    if small:
        rooms = rooms.unionByName(spark.createDataFrame(small, "start long, size long, sequence_id long, offset long"))
    cut = park(_overlaid(rooms, stream.select("row", "start", "size")))

    # Rows that are cut need their ids. In each bin they come from a place of the rank's order on, so only these move.
    filled = stream.select("row", "doc_id", "n", "rest_crc", F.col("size").alias("own")).withColumnRenamed("row", "w")
    pieces = cut.join(filled, F.col("row") == F.col("w"))
    parts = cut.filter(F.col("length") < F.col("size")).select(F.col("row").alias("w"), "inside", "length")
    range_, mark = F.pmod(F.xxhash64("row"), F.lit(ranges)), F.xxhash64("row")
    edge = {r.bin: r for r in ranked.filter(F.col("rank") == _of_bin(taken, F.col("bin"))).select("bin", range_.alias("range"), mark.alias("mark")).collect()}
    from_range = [int(edge[b].range) if b in edge else ranges for b in range(BINS + 1)]
    from_mark = [int(edge[b].mark) if b in edge else 0 for b in range(BINS + 1)]
    some = tokens.select("row", F.col("rest").alias("ids"), F.ceil(rest / _Q).cast("long").alias("bin"))
    some = some.filter((range_ > _of_bin(from_range, F.col("bin"))) | ((range_ == _of_bin(from_range, F.col("bin"))) & (mark >= _of_bin(from_mark, F.col("bin")))))
    crcs = some.join(parts, F.col("row") == F.col("w")).select("row", "inside", "length", "ids").mapInArrow(_cut_crc(kind), "row long, inside long, length long, ids_crc32 long")
    crcs = crcs.select(F.col("row").alias("r"), F.col("inside").alias("i"), "ids_crc32")
    pieces = pieces.join(crcs, (F.col("row") == F.col("r")) & (F.col("inside") == F.col("i")), "left")
    pieces = pieces.select("row", "doc_id", (F.col("n") - F.col("own") + F.col("inside")).alias("start"), "length", F.coalesce("ids_crc32", "rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    if placed is not None:
        pieces = pieces.unionByName(placed.select("row", "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("end") - F.col("rest")).alias("offset")))
    begin = [next(ids)] * (BINS + 1)
    begin = [b + sum(fulls[:i]) for i, b in enumerate(begin)]
    long_ = ranked.filter(F.col("full") > 0).select("row", "doc_id", "n", "bin", "fulls", F.posexplode("full_crc").alias("k", "ids_crc32"))
    long_ = long_.select("row", "doc_id", (F.col("k") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (_of_bin(begin, F.col("bin")) + F.col("fulls") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.unionByName(long_), tokens


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    return pack(docs, tokenizer)[0].drop("row")
