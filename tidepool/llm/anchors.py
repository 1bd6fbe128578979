"""Repeated windows: documents meet at shared anchors, and an index answers for each shard.

A window of ``win`` units (bytes or words) has one anchor, the least hash of the k-grams
in it, which depends on the window's content alone; equal windows have equal anchors.
Consecutive windows with one anchor form a run, of at most RUN windows, and a run's units are
its string; so strings are bounded, also in periodic text, where one anchor holds for long.
A repeated window has the units before or after its anchor in common with its other
occurrences. Contexts are counted over the whole corpus and come back to the documents'
blocks by a join (see ``blocks``); runs of which neither context occurs twice go no
further. Equal strings collapse to one with its first occurrence, so copies move as
counts. All strings of an anchor meet in one shard; the number of shards follows the
number of strings, and an anchor with more than HOT distinct strings is dealt by its
windows. An index of each shard finds the first occurrence of every window of every
string; nothing is removed but by its answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, levels, pack, spread, unpack, with_levels
from .kernels import _tables, mix64, slices, span_hashes, window_min, word_spans
from .store import discard, park, release

HOT = 8192
RUN = 2048  # windows of a run
SLICE = 1 << 18  # bytes of text worked on at once


@dataclass(frozen=True)
class Unit:
    """What texts are cut into: ``words`` or bytes; window and anchor length in units."""

    words: bool
    win: int
    k: int


class Cut:
    """The units of a slice, its runs of windows with one anchor, and hashes of any span of units."""

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray):
        self.unit, self.data = unit, data
        if unit.words:
            self.starts, self.ends, self.first = word_spans(data, offsets)
            units = span_hashes(data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        else:
            self.first, units = offsets, data.astype(np.uint64) + np.uint64(1)
        n, width = len(units), unit.win - unit.k + 1
        self.down = _tables(n)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _tables(n)[0][:n], out=self.sums[1:])
        m = max(n - unit.k + 1, 0)
        self.grams = mix64((self.sums[unit.k :] - self.sums[:m]) * self.down[:m]) if m else np.zeros(0, np.uint64)
        anchor = window_min(self.grams, width)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(anchor)]
        inside = np.arange(len(anchor)) + unit.win <= self.first[1:][row] if len(anchor) else np.zeros(0, bool)
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        places = np.arange(len(anchor))
        new |= inside & ((places - np.maximum.accumulate(np.where(new, places, 0))) % RUN == 0) if len(anchor) else False
        stop = np.ones(len(anchor) + 1, bool)
        stop[:-1] = new | ~inside
        #: First window, number of windows, anchor and row of every run.
        self.start, ends = np.flatnonzero(new), np.flatnonzero(stop)
        self.count = ends[np.searchsorted(ends, self.start, side="right")] - self.start
        self.m, self.row = anchor[self.start], row[self.start]
        # Where anchors stand: a k-gram that equals the greatest of the anchors of the windows that hold it.
        held = np.zeros(len(anchor) + 2 * (width - 1), np.uint64)
        held[width - 1 : width - 1 + len(anchor)] = np.where(inside, anchor, 0)
        self.chosen = np.flatnonzero(~window_min(~held, width) == self.grams) if len(anchor) else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix64((self.sums[at + n] - self.sums[at]) * self.down[at] + np.uint64(n))

    def contexts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(run, hash) of the left and of the right contexts of every anchor place, where they fit in the text.

        Every window of a run holds the anchor with ``half`` units before it or with the rest
        of a window after it, so a repeated window has a repeated left or right context.
        """
        unit, width = self.unit, self.unit.win - self.unit.k + 1
        lo = np.searchsorted(self.chosen, self.start)
        size = np.searchsorted(self.chosen, self.start + self.count + width - 1) - lo
        own = np.repeat(np.arange(len(self.start)), size)
        place = self.chosen[np.arange(len(own)) + np.repeat(lo - (np.cumsum(size) - size), size)]
        hit = self.grams[place] == self.m[own]
        own, place = own[hit], place[hit]
        low, high = self.first[self.row[own]], self.first[self.row[own] + 1]
        half = width // 2
        right, out = unit.win - half + 1, []
        for at, n, salt in ((place - half, half + unit.k, 0x51), (place, right, 0x52)):
            fits = (at >= low) & (at + n <= high)
            out.append((own[fits], mix64(self.hashes(at[fits], n) + np.uint64(salt))))
        return out

    def strings(self, some: np.ndarray) -> pa.Array:
        """The strings of some runs: bytes, or words joined by single spaces."""
        start, size = self.start[some], self.count[some] + self.unit.win - 1
        if self.unit.words:
            length = self.ends - self.starts + 1
            text, off = _gather(np.append(self.data, np.uint8(32)), self.starts, length)
            text[off[1:] - 1] = 32
            a, b = off[start], off[start + size] - 1
        else:
            text, a, b = self.data, start, start + size
        text, off = _gather(text, a, b - a)
        return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.binary())


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of data one after another, and their offsets."""
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    return data[np.arange(off[-1]) + np.repeat(starts - off[:-1], lengths)], off


def _prints(unit: Unit):
    def run(data, off):
        for lo, hi in slices(off, SLICE):
            for _, x in Cut(unit, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).contexts():
                yield x

    return run


def _emit(unit: Unit):
    """Runs with a repeated context: anchor, string, block and row, document, place and number of windows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, data, off = unpack(batch, i)
                parts = [(lo, Cut(unit, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in slices(off, SLICE)]
                found = [c.contexts() for _, c in parts]
                prints = [x for f in found for _, x in f]
                level, at = spread(batch, i, np.concatenate(prints) if prints else np.zeros(0, np.uint64)), 0
                for (lo, c), f in zip(parts, found, strict=True):
                    some = np.zeros(len(c.start), bool)
                    for own, x in f:
                        some[own[level[at : at + len(x)] > 0]] = True
                        at += len(x)
                    if not some.any():
                        continue
                    some = np.flatnonzero(some)
                    r = c.row[some]
                    place = (c.start[some] - c.first[r]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c.m[some].astype(np.int64)), c.strings(some), pa.array(np.full(len(some), batch.column("block")[i].as_py(), np.int64)), pa.array((lo + r).astype(np.int32)), pa.array(docs[lo + r]), pa.array(place), pa.array(c.count[some].astype(np.int32))], names=["m", "body", "block", "row", "doc", "place", "n"])

    return run


def _id(body: str) -> Column:
    """An identifier of a string's content: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def _firsts(rows: DataFrame, *more: str) -> DataFrame:
    """Each distinct string once, with its first and last occurrence."""
    place = F.struct("doc", "place")
    found = rows.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.first(c).alias(c) for c in ("body", *more)])
    return found.select("id", "body", *more, "first.doc", "first.place", F.col("last.doc").alias("last_doc"), F.col("last.place").alias("last_place"))


_SOLVED = "id binary, at int, n int, doc long, place long"


def _solve(unit: Unit, index: Callable, within: bool):
    """First occurrences of a shard's windows, as runs (window, number, doc, place): within one, places go on by one a window.

    Runs that start no earlier than the string's last occurrence aren't returned.
    """

    def run(group: pa.Table) -> pa.Table:
        doc, place = group["doc"].to_numpy(), group["place"].to_numpy()
        order = np.lexsort((place, doc))
        bodies = [x.as_buffer() for x in group["body"]]
        fd, fp, off = index([bodies[i] for i in order], doc[order], place[order], unit.win)
        string = np.repeat(np.arange(len(order)), np.diff(off))
        new = np.ones(len(fd), bool)
        new[1:] = (string[1:] != string[:-1]) | (fd[1:] != fd[:-1])
        if within:
            new[1:] |= fp[1:] != fp[:-1] + 1
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fd)))
        s = string[at]
        inside = at - off[:-1][s]
        last_doc, last_place = group["last_doc"].to_numpy()[order][s], group["last_place"].to_numpy()[order][s]
        early = fd[at] < last_doc
        if within:
            early |= (fd[at] == last_doc) & (fp[at] < last_place + inside)
        at, s = at[early], s[early]
        return pa.table({"id": group["id"].take(pa.array(order[s])), "at": pa.array(inside[early].astype(np.int32)), "n": pa.array(size[early].astype(np.int32)), "doc": pa.array(fd[at]), "place": pa.array(fp[at])})

    return run


def _windows(unit: Unit):
    """The windows of strings, each as a string of its own."""

    def run(batches):
        for batch in batches:
            doc, place = batch.column("doc").to_numpy(), batch.column("place").to_numpy()
            for i, x in enumerate(batch.column("body")):
                raw = x.as_py()
                parts = raw.split(b" ") if unit.words else raw
                n = len(parts) - unit.win + 1
                bodies = [b" ".join(parts[j : j + unit.win]) if unit.words else raw[j : j + unit.win] for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[i].as_py()] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(bodies, pa.binary()), pa.array(np.full(n, doc[i])), pa.array(place[i] + np.arange(n))], names=["string", "at", "body", "doc", "place"])

    return run


def solved(where: DataFrame, unit: Unit, index: Callable, per_shard: int, within: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(of, at, run, first_doc, first_place): for windows at..at+run-1 of the string ``of``, their first occurrences; and the tables parked for it."""
    strings = park(_firsts(where, "m"))
    release(where.sparkSession)
    crowded = park(strings.groupBy("m").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("m"))
    parked = [strings, crowded]

    def dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
        shard = F.pmod(F.xxhash64(key), F.lit(max(1, size // per_shard)))
        return rows.groupBy(shard.alias("shard")).applyInArrow(_solve(unit, index, within), _SOLVED)

    out = dealt(strings.join(crowded, "m", "left_anti"), "m", strings.count())
    if crowded.limit(1).count():
        parts = strings.join(crowded, "m", "left_semi").select("id", "body", "doc", "place")
        parts = park(parts.mapInArrow(_windows(unit), "string binary, at int, body binary, doc long, place long").withColumn("id", _id("body")))
        parked.append(parts)
        alone = _firsts(parts)
        # A window is of use wherever a string holds it, so it counts as occurring last at the end of all.
        alone = alone.withColumn("last_doc", F.lit((1 << 63) - 1)).withColumn("last_place", F.lit(0).cast("long"))
        own = dealt(alone, "id", parts.count()).select(F.col("id").alias("w"), "doc", "place")
        out = out.union(parts.select("string", "at", F.col("id").alias("v")).join(own, F.col("v") == F.col("w")).select("string", "at", F.lit(1), "doc", "place"))
    return out.toDF("of", "at", "run", "first_doc", "first_place"), parked


def marked(docs: DataFrame, unit: Unit, index: Callable, per_shard: int, within: bool) -> DataFrame:
    """The documents' blocks with ``spans``: (row, first window, number of windows) to remove.

    index(strings, docs, places, win) gives, for the distinct strings of a shard with their
    first occurrences, the first occurrence (doc, place) of each window of each string.
    ``within``: an earlier place in the same document counts as earlier.
    """
    spark = docs.sparkSession
    blocks = pack(docs)
    counted = levels(blocks, _prints(unit))
    release(spark)
    found = with_levels(blocks, counted).mapInArrow(_emit(unit), "m long, body binary, block long, row int, doc long, place long, n int")
    where = park(found.withColumn("id", _id("body")))
    discard(counted)
    release(spark)
    runs, parked = solved(where, unit, index, per_shard, within)
    hits = where.select("id", "block", "row", "doc", "place").join(runs, F.col("id") == F.col("of"))
    gone = F.col("first_doc") < F.col("doc")
    if within:
        gone |= (F.col("first_doc") == F.col("doc")) & (F.col("first_place") < F.col("place") + F.col("at"))
    spans = hits.filter(gone).groupBy("block").agg(F.collect_list(F.struct("row", (F.col("place") + F.col("at")).alias("at"), F.col("run").alias("n"))).alias("spans"))
    spans = park(spans)
    discard(where, *parked)
    release(spark)
    return blocks.join(spans, "block", "left")


def covered(batch: pa.RecordBatch, i: int, rows: int, win: int) -> Callable[[int, int], np.ndarray]:
    """For row ``i`` of a batch of marked blocks: f(row, units), which units of a text lie in a removed window."""
    spans = batch.column("spans")[i].values if batch.column("spans")[i].is_valid else None
    if spans is None:
        return lambda row, size: np.zeros(size, bool)
    row, at, n = (spans.field(c).to_numpy() for c in ("row", "at", "n"))
    order = np.argsort(row, kind="stable")
    at, n = at[order], n[order]
    cuts = np.searchsorted(row[order], np.arange(rows + 1))

    def of(r: int, size: int) -> np.ndarray:
        a, b = cuts[r], cuts[r + 1]
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, at[a:b], 1)
        np.add.at(edge, at[a:b] + n[a:b] + win - 1, -1)
        return np.cumsum(edge[:-1]) > 0

    return of


def real_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)
