"""Ranked lexical search over a two-level quantised index.

Documents are indexed in blocks. A block's postings are ordered by term (a 64-bit hash);
beside the exact frequencies stand impacts of one byte: the part of a score that depends on
frequency and length, rounded up to a 255th of its bound. A search reads the byte level
first: with a query's integer weights the bytes give an upper bound of every document's
score, and the bytes less one a lower bound. The k-th largest lower bound of a query is its
threshold; every document whose upper bound reaches it is scored again in exact integers
from the frequencies. Tasks keep the best k of each query while they pass over blocks,
so what meets afterwards is k rows a query and task.

Queries come in shards whose terms number at most TERMS (or those of one query): a shard
is what is broadcast, and each shard passes over the index.

Edge cases: a null text has no term; items and documents without terms match nothing; rows
that repeat an item_id are queries of their own, rows that repeat a doc_id are documents of
their own; a null doc_id goes before others of equal score; an empty table on either side
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID
from .kernels import slices, span_hashes, text_buffer, word_spans
from .store import discard, park

K = 20
SCALE = 1_000_000  # no impact reaches it
TERMS, ITEMS = 1 << 18, 2048  # distinct query terms and queries in a shard
BLOCK, ROWS = 3 << 18, 1024  # bytes of text and documents in a block; its row stays well under a megabyte

# Bytes of the term contract (digits, letters, everything beyond ASCII), A-Z lowered, the rest white.
FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    FOLD[_a:_b] = np.arange(_a, _b)
FOLD[65:91] = np.arange(97, 123)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term and the first term of each row."""
    data = FOLD[data]
    starts, ends, first = word_spans(data, offsets)
    return (span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _parts(batch: pa.RecordBatch):
    """(first row, row after the last, text bytes, offsets) of blocks of a batch."""
    data, off = text_buffer(batch.column("text"))
    for lo, hi in slices(off, BLOCK):
        for a in range(lo, hi, ROWS):
            b = min(a + ROWS, hi)
            yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def _sizes(batches):
    documents = total = 0
    for batch in batches:
        for _, _, data, off in _parts(batch):
            n = np.diff(word_spans(FOLD[data], off)[2])
            documents += int(np.count_nonzero(n))
            total += int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "total"])


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document: 100 - 25 + (25 n N) div L."""
    if total and int(n.max(initial=0)) * 25 * documents < 1 << 63:
        return 75 + 25 * n * documents // total
    return np.array([75 + 25 * int(x) * documents // max(total, 1) for x in n], np.int64)


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


_BLOCK = "docs binary, m binary, terms binary, starts binary, rows binary, impact binary, tf binary"


def _index(documents: int, total: int):
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for a, b, data, off in _parts(batch):
                hashes, first = _terms(data, off)
                n = np.diff(first)
                m = _lengths(n, documents, total)
                terms, back = np.unique(hashes, return_inverse=True)
                key, tf = np.unique(back * (b - a) + np.repeat(np.arange(b - a), n), return_counts=True)
                term, row = key // (b - a), key % (b - a)
                impact = -(-_impacts(tf, m[row]) * 255 // SCALE)
                columns = [ids[a:b], m, terms, np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int32), row.astype(np.uint16), impact.astype(np.uint8), tf.astype(np.min_scalar_type(int(tf.max(initial=0))))]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=names)

    return run


@dataclass(frozen=True)
class Index:
    """Blocks of postings, the number of documents that have terms, and of all terms."""

    blocks: DataFrame
    documents: int
    total: int


def build(docs: DataFrame) -> Index:
    """The index of all documents; its table is parked until ``discard``."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    sizes = slim.select("text").mapInArrow(_sizes, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = int(sizes[0] or 0), int(sizes[1] or 0)
    return Index(park(slim.mapInArrow(_index(documents, total), _BLOCK), 1 << 24), documents, total)


def _item_terms(batches):
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        item = batch.column("item").to_numpy()
        for lo, hi in slices(off):
            hashes, first = _terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in range(hi - lo):
                term, times = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
                if len(term):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), item[lo + i])), pa.array(term.astype(np.int64)), pa.array(times)], names=["item", "term", "times"])


def _at(batch: pa.RecordBatch, i: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _tf(batch: pa.RecordBatch, i: int, n: int) -> np.ndarray:
    """Frequencies of a block of n postings, in as many bytes each as its largest needs."""
    raw = batch.column("tf")[i].as_buffer()
    return np.frombuffer(raw, f"<u{raw.size // max(n, 1) or 1}")


def _present(batch: pa.RecordBatch, i: int, wanted: np.ndarray):
    """Of the wanted terms (sorted) those in a block: their numbers, and where their postings begin and end."""
    terms, starts = _at(batch, i, "terms", np.uint64), _at(batch, i, "starts", np.int32)
    at = np.searchsorted(terms, wanted)
    held = np.flatnonzero(at < len(terms))
    held = held[terms[at[held]] == wanted[held]]
    return held, starts[at[held]], starts[at[held] + 1]


def _frequencies(shared):
    def run(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                held, lo, hi = _present(batch, i, wanted)
                total[held] += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


class Shard:
    """Some queries: their terms, and for each term the queries that hold it with weight times repeats."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, query: np.ndarray, worth: np.ndarray, size: int):
        self.terms, self.first, self.query, self.worth, self.size = terms, first, query, worth, size

    def bounds(self, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Upper bound of each (query, document) of a block in 255ths, what it is above the lower bound, and the present terms."""
        rows, impact = _at(batch, i, "rows", np.uint16), _at(batch, i, "impact", np.uint8)
        n = len(_at(batch, i, "m", np.int64))
        upper, slack = np.zeros((self.size, n), np.int64), np.zeros((self.size, n), np.int64)
        held, lo, hi = _present(batch, i, self.terms)
        for t, a, b in zip(held.tolist(), lo.tolist(), hi.tolist(), strict=True):
            own = slice(self.first[t], self.first[t + 1])
            query, worth = self.query[own], self.worth[own]
            cells = (query[:, None], rows[a:b][None])
            upper[cells] += worth[:, None] * impact[a:b][None].astype(np.int64)
            slack[cells] += worth[:, None]
        return upper, slack, [held, lo, hi]


def _lower(shared, k: int):
    """The k largest lower bounds of each query over a task's blocks."""

    def run(batches):
        shard = Shard(*shared.value)
        best = np.zeros((shard.size, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                upper, slack, _ = shard.bounds(batch, i)
                low = upper - slack
                better = np.flatnonzero(low.max(1, initial=0) > best[:, 0])
                both = np.concatenate((best[better], low[better]), 1)
                best[better] = np.sort(np.partition(both, both.shape[1] - k, 1)[:, -k:], 1)
        query, nth = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, nth])], names=["query", "low"])

    return run


def _exact(shared, k: int):
    """The best k of each query over a task's blocks, by exact scores of the documents whose bound reaches the threshold."""

    def run(batches):
        *parts, threshold = shared.value
        shard = Shard(*parts)
        none = np.zeros(0, np.int64)
        best = [(none, none)] * shard.size  # scores, documents
        for batch in batches:
            for i in range(batch.num_rows):
                upper, _, (held, lo, hi) = shard.bounds(batch, i)
                reached = upper >= threshold[:, None]
                some = np.flatnonzero(reached.any(1))
                if not len(some):
                    continue
                docs, m, rows = _at(batch, i, "docs", np.int64), _at(batch, i, "m", np.int64), _at(batch, i, "rows", np.uint16)
                tf = _tf(batch, i, len(rows))
                score = np.zeros((len(some), len(m)), np.int64)
                place = np.full(shard.size, -1)
                place[some] = np.arange(len(some))
                for t, a, b in zip(held.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    own = slice(shard.first[t], shard.first[t + 1])
                    at = place[shard.query[own]]
                    if (at >= 0).any():
                        value = _impacts(tf[a:b].astype(np.int64), m[rows[a:b]])
                        score[at[at >= 0][:, None], rows[a:b][None]] += shard.worth[own][at >= 0][:, None] * value[None]
                for j, q in enumerate(some.tolist()):
                    hit = np.flatnonzero(reached[q] & (score[j] > 0))
                    s, d = np.concatenate((best[q][0], score[j, hit])), np.concatenate((best[q][1], docs[hit]))
                    order = np.lexsort((d, -s))[:k]
                    best[q] = s[order], d[order]
        sizes = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(shard.size), sizes)), pa.array(np.concatenate([s for s, _ in best] or [none])), pa.array(np.concatenate([d for _, d in best] or [none]))], names=["query", "score", "doc"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _searched(index: Index, queries: list[tuple[int, int, int]], k: int) -> DataFrame:
    """(query, score, doc, rank) for a shard's (query, term, times)."""
    context = index.blocks.sparkSession.sparkContext
    query, term, times = (np.array(c, np.int64) for c in zip(*queries, strict=True))
    terms, number = np.unique(term.astype(np.uint64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    query, times, number = query[order], times[order], number[order]
    wanted = context.broadcast(terms)
    found = index.blocks.select("terms", "starts").mapInArrow(_frequencies(wanted), "term long, df long")
    weights = np.zeros(len(terms), np.int64)
    for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the shard at most
        weights[r.term] = weight(index.documents, r.df)
    parts = (terms, np.searchsorted(number, np.arange(len(terms) + 1)), query, weights[number] * times, int(query.max()) + 1)
    shared = context.broadcast(parts)
    bounds = index.blocks.select("m", "terms", "starts", "rows", "impact").mapInArrow(_lower(shared, k), "query long, low long")
    ranked = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc()))).filter(F.col("nth") <= k)
    threshold = np.ones(parts[-1], np.int64)
    for r in ranked.groupBy("query").agg(F.min("low").alias("low"), F.count("*").alias("n")).filter(F.col("n") == k).collect():
        threshold[r.query] = max(1, r.low)
    last = context.broadcast((*parts, threshold))
    best = index.blocks.mapInArrow(_exact(last, k), "query long, score long, doc long")
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item."""
    spark = items.sparkSession
    numbered = park(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    terms = park(numbered.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"))
    of_item = terms.groupBy("item").agg(F.count("*").alias("n"))
    n_items, n_terms = of_item.agg(F.count("*"), F.sum("n")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_items or not index.total:
        discard(terms, numbered)
        return empty
    shards = 1 if n_items <= ITEMS and n_terms <= TERMS else 2 * max(-(-n_items // ITEMS), -(-n_terms // TERMS))
    out = None
    for s in range(shards):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == s).orderBy("item", "term").collect()
        if not rows:
            continue
        own = sorted({r.item for r in rows})
        number = {x: i for i, x in enumerate(own)}
        found = _searched(index, [(number[r.item], r.term, r.times) for r in rows], k)
        named = spark.createDataFrame(list(enumerate(own)), "q long, item long")
        found = found.join(F.broadcast(named), F.col("query") == F.col("q")).select("item", "rank", "doc", "score")
        out = found if out is None else out.unionByName(found)
    ids = numbered.select(F.col("item").alias("i"), "item_id")
    return out.join(ids, F.col("item") == F.col("i")).select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


#: DuckDB's form of ``op13_two_level_search``.
SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT doc, unnest(terms) AS term FROM t),
sizes AS (SELECT doc, doc_id, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
of_all AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
counts AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
scored AS (SELECT a.item, a.item_id, s.doc, s.doc_id, CAST(sum(a.times * CAST(floor(1000 * ln((2 * o.big_n + 2) / (2 * d.df + 1))) AS BIGINT) * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (100 - 25 + (25 * s.n * o.big_n) // o.big_l)))) AS BIGINT) AS score
 FROM asked a JOIN dfs d USING (term) JOIN counts c USING (term) JOIN sizes s ON s.doc = c.doc CROSS JOIN of_all o GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 20"""
