"""Exact dedup by content-defined chunk recipes.

Every text is normalised (each run of ASCII white space becomes one space) and cut
into chunks where a rolling hash of the last bytes meets a mask, so that equal
content yields equal chunks. Chunks are deduplicated to verified identifiers: the
chunk store groups chunk *bytes* under their 128-bit hash, map-side first, so a chunk
moves once however often it occurs; a hash that stands for two different byte strings
is detected there and its chunks are told apart by their bytes. Documents are then
compared by their ordered identifier lists (the recipe) alone.

Edge cases: null text counts as empty; an empty text has an empty recipe and equals
other empty texts; rows that repeat a doc_id stay separate rows (the group's smallest
doc_id stays; null doc_id sorts first); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, text_buffer
from .store import rows_with

CHUNK_BITS = 12  # about 4 KiB between cuts
CHUNK_MIN, CHUNK_MAX = 1024, 16384
_WINDOW = 16
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(raw: bytes) -> bytes:
    """Each run of the six ASCII white-space bytes becomes one space."""
    raw = raw.translate(_SPACES)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of a normalised text (the last is len(raw); none if empty)."""
    n = len(raw)
    if n <= CHUNK_MIN:
        return [n] if n else []
    gear = mix64(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) if n < 4096 else _GEAR[np.frombuffer(raw, np.uint8)]
    sums = np.cumsum(gear)
    rolled = sums[_WINDOW:] - sums[:-_WINDOW]
    marks = np.flatnonzero((mix64(rolled) >> np.uint64(64 - CHUNK_BITS)) == 0) + _WINDOW + 1
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > CHUNK_MAX:
            last += CHUNK_MAX
            ends.append(last)
        if m - last >= CHUNK_MIN and m < n:
            ends.append(m)
            last = m
    while n - last > CHUNK_MAX:
        last += CHUNK_MAX
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


_GEAR = mix64(np.arange(1, 257, dtype=np.uint64))


def _texts(batch: pa.RecordBatch):
    data, off = text_buffer(batch.column("text"))
    view = memoryview(data)
    for i in range(len(off) - 1):
        yield normalise(bytes(view[off[i] : off[i + 1]]))


def _recipes(batches):
    for batch in batches:
        sha, recipe = [], []
        for raw in _texts(batch):
            sha.append(hashlib.sha256(raw).hexdigest())
            at, ids = 0, []
            for end in cut_points(raw):
                ids.append(hashlib.blake2b(raw[at:end], digest_size=16).digest())
                at = end
            recipe.append(b"".join(ids))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], names=["doc_id", "text_sha256", "recipe"])


def _chunks(batches):
    """Chunk bytes, each once a batch (hash, bytes)."""
    for batch in batches:
        found = {}
        for raw in _texts(batch):
            at = 0
            for end in cut_points(raw):
                piece = raw[at:end]
                found[hashlib.blake2b(piece, digest_size=16).digest(), piece] = None
                at = end
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.binary()), pa.array([k[1] for k in found], pa.binary())], names=["id", "bytes"])


def ambiguous_chunks(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one byte string (``id``); normally none."""
    chunks = docs.select("text").mapInArrow(_chunks, "id binary, bytes binary")
    store = chunks.groupBy("id", "bytes").agg(F.lit(1).alias("one"))
    return store.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = slim.mapInArrow(_recipes, "doc_id long, text_sha256 string, recipe binary")
    # A recipe with an ambiguous identifier is compared with its text's digest besides.
    if ambiguous_chunks(slim).limit(1).count():
        recipes = recipes.withColumn("recipe", F.concat("recipe", F.unhex("text_sha256")))
    ranked = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    groups = recipes.groupBy("recipe").agg(F.min(ranked).alias("first"), F.count("*").alias("group_size"))
    joined = recipes.join(groups.select(F.col("recipe").alias("r"), "first", "group_size"), F.col("recipe") == F.col("r"))
    keep = F.col("first.doc_id")
    return joined.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without later copies; all columns stay. Rows that share the doc_id stay or go together."""
    return rows_with(docs, exact_groups(docs).filter("kept").select("doc_id"))
