"""Documents in blocks, and which of a block's fingerprints the corpus repeats.

``pack`` writes the documents once as rows of about BLOCK bytes of compressed text, so
later passes move a block as one row and name a document by (block, row).
``levels`` counts 64-bit fingerprints over the whole corpus: every block sends each of its
distinct fingerprints once, with its count, to the range of the fingerprint space that it
lies in (four bytes each, sorted), so a fingerprint that a third of all documents hold
comes once a block. A range is counted exactly in one task and answers every block with
one byte a fingerprint; the answers come back to the block by a join. Nothing is
broadcast or sent to the driver, and both shuffles grow in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices, text_buffer
from .store import parallelism, park

BLOCK = 1 << 21
NO_ID = -(1 << 63)  # stands for a null doc_id: smaller than any other
SCHEMA = "block long, docs binary, ends binary, body binary"


def _pack(batches):
    part, number = TaskContext.get().partitionId(), 0
    docs, sizes, texts, held = [], [], [], 0

    def row():
        raw = np.concatenate(texts)
        columns = [[part << 32 | number], [np.concatenate(docs).tobytes()], [np.cumsum(np.concatenate(sizes)).tobytes()], [pa.compress(raw.tobytes(), codec="zstd", asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["block", "docs", "ends", "body"])

    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        ids = batch.column("doc").to_numpy()
        for lo, hi in slices(off, BLOCK):
            if held and held + off[hi] - off[lo] > BLOCK:
                yield row()
                number += 1
                docs, sizes, texts, held = [], [], [], 0
            docs.append(ids[lo:hi])
            sizes.append(np.diff(off[lo : hi + 1]))
            texts.append(data[off[lo] : off[hi]].copy())
            held += int(off[hi] - off[lo])
    if docs:
        yield row()


def pack(docs: DataFrame) -> DataFrame:
    """The documents' ids (null as NO_ID) and texts, parked as blocks."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return park(slim.mapInArrow(_pack, SCHEMA))


def unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, text bytes, row offsets) of row ``i`` of a batch of blocks."""
    docs = np.frombuffer(batch.column("docs")[i].as_buffer(), np.int64)
    off = np.concatenate((np.zeros(1, np.int64), np.frombuffer(batch.column("ends")[i].as_buffer(), np.int64)))
    size = int(off[-1])
    raw = pa.decompress(batch.column("body")[i].as_buffer(), decompressed_size=size, codec="zstd") if size else b""
    return docs, np.frombuffer(raw, np.uint8), off


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for a count of 1, then eight levels an octave."""
    return np.where(count < 2, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 2) / 2)))).astype(np.uint8)


def levels(blocks: DataFrame, prints: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """(block, levels): what ``spread`` needs to give each fingerprint of a block its level.

    prints(data, offsets) yields arrays of fingerprints of a block; each occurrence counts.
    """
    bits = max(6, (4 * parallelism(blocks.sparkSession) - 1).bit_length())
    shift = 64 - bits - 32

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, off = unpack(batch, i)
                parts = list(prints(data, off))
                value, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64),) * 2
                cuts = np.concatenate(([0], np.searchsorted(value, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(value)]))
                some = np.flatnonzero(np.diff(cuts))
                low = ((value >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                many = np.minimum(count, 0xFFFF).astype(np.uint16)
                cut = lambda x: pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), batch.column("block")[i].as_py()), pa.int64()), cut(low), cut(many)], names=["range", "block", "low", "many"])

    def count(group: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x.as_buffer(), np.uint32) for x in group["low"]]
        low = np.concatenate(lows)
        many = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in group["many"]])
        order = np.argsort(low)
        ordered = low[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(many[order].astype(np.int64), np.flatnonzero(new))
        level = np.empty(len(low), np.uint8)
        level[order] = level_of(total)[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in lows])[:-1]
        return pa.table({"block": group["block"], "range": group["range"], "level": pa.array([x.tobytes() for x in np.split(level, ends)], pa.binary())})

    sent = blocks.mapInArrow(send, "range int, block long, low binary, many binary")
    found = sent.groupBy("range").applyInArrow(count, "block long, range int, level binary")
    return park(found.groupBy("block").agg(F.collect_list(F.struct("range", "level")).alias("levels")))


def with_levels(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with their levels (null for a block without fingerprints)."""
    return blocks.join(found, "block", "left")


def spread(batch: pa.RecordBatch, i: int, prints: np.ndarray) -> np.ndarray:
    """The level of each of a block's fingerprints, in their order; ``prints`` are all of the block."""
    parts = sorted((x["range"], x["level"]) for x in batch.column("levels")[i].as_py() or [])
    level = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
    value, back = np.unique(prints, return_inverse=True)
    if len(level) != len(value):
        raise RuntimeError("a block's fingerprints changed between two passes")
    return level[back]
