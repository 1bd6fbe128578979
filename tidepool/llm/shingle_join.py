"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two documents
link when their Jaccard similarity is at least PERCENT. In a common order of shingles,
rare ones first, two linked sets share a shingle within their prefixes of
n - ceil(PERCENT n) + 1 shingles, and at the first one that they share neither has so few
left that the overlap can't suffice (the position filter). The join goes:

1. The texts are packed in blocks; shingles are counted over the whole corpus and the
   counts come back to the blocks (see ``blocks``).
2. Each block then gives every set's size and, only for sets of which enough shingles are
   repeated to link at all, the prefix with positions and the repeated shingles.
3. Equal sets collapse to one; sets of one size and one prefix (of repeated shingles, since
   lone ones join nothing) collapse to one group.
4. Groups that share a prefix shingle form a bucket. Every group is verified against one
   group of a bucket, and every member of a group against its group's first (stars, linear
   in the bucket); linked ones become components. Groups outside a bucket's largest
   component are verified against a drawn group of it, round by round while that links
   many. What is left are the group pairs of different components: those outside the
   largest component against the bucket, filtered by size and position. These pairs are
   expanded to members of different components and verified. So no link between
   components is lost and no bucket is expanded into pairs of near copies.

Edge cases: documents of fewer than five words are one shingle, the whole sequence; null
and empty texts and texts without words have no shingle and no link; rows that share a
doc_id are one document with the links of all its rows; null doc_id is one document, the
smallest, with a null component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, levels, pack, spread, unpack, with_levels
from .components import components
from .kernels import gram_hashes, slices, words_of
from .store import discard, park, release, rows_with

WORDS = 5
PERCENT = 80
#: Rounds of stars before the remaining pairs, partners of a group in a round, and the links that make another round worth it; they change the work, not the result.
ROUNDS = 4
PARTNERS = 2
WORTH = 1000


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of every row."""
    sets = []
    for lo, hi in slices(off):
        words, first = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
        grams = gram_hashes(words, WORDS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            sets.append(np.unique(grams[a : b - WORDS + 1]) if b - a >= WORDS else gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return sets


def _need(n):
    """Least overlap of a set of n with any set it links to: ceil(PERCENT n / 100)."""
    return -(-PERCENT * n // 100)


_PROFILE = "doc long, n long, sid binary, ph long, prefix array<struct<tok: long, pos: int>>, body binary"


def _profile(batches):
    """Size of every set; identity, prefix and repeated shingles of those that can link."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, data, off = unpack(batch, i)
            sets = shingle_sets(data, off)
            everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            level = spread(batch, i, everything)
            n, sid, ph, tok, pos, count, body, at = [], [], [], [], [], [0], [], 0
            for row, s in enumerate(sets):
                lev = level[at : at + len(s)]
                at += len(s)
                n.append(len(s))
                known = s[lev > 0]
                able = len(s) and len(known) >= _need(len(s))
                if able:
                    order = np.lexsort((s, lev))[: len(s) - _need(len(s)) + 1]
                    spot = np.flatnonzero(lev[order] > 0)
                if not able or not len(spot):
                    sid.append(None)
                    ph.append(None)
                    body.append(None)
                else:
                    raw = known.tobytes()
                    # A set with a shingle of its own equals no other set.
                    own = b"" if len(known) == len(s) else b"%d:%d" % (batch.column("block")[i].as_py(), row)
                    sid.append(hashlib.blake2b(raw + own, digest_size=16).digest())
                    body.append(raw)
                    tok.append(s[order][spot].astype(np.int64))
                    pos.append(spot)
                    ph.append(int(gram_hashes(s[order][spot], len(spot))[0].astype(np.int64)))
                count.append(count[-1] + (len(tok[-1]) if sid[-1] is not None else 0))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            items = pa.StructArray.from_arrays([pa.array(join(tok, np.int64), pa.int64()), pa.array(join(pos, np.int64), pa.int32())], names=["tok", "pos"])
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(ph, pa.int64()), pa.ListArray.from_arrays(pa.array(count, pa.int32()), items), pa.array(body, pa.binary())], names=["doc", "n", "sid", "ph", "prefix", "body"])


def _linked(batches):
    """Verification: exact overlap of two sorted sets of repeated shingles."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = np.zeros(len(na), bool)
        for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
            both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
            ok[i] = 100 * both >= PERCENT * (int(na[i]) + int(nb[i]) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["u", "v"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, as edges (u, v)."""
    second = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("body").alias("xb"))
    first = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("body").alias("xa"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_linked, "u long, v long")


def _may_link(n: Column, pos: Column, m: Column, qos: Column) -> Column:
    """Sets of sizes n and m that first share the shingles at pos and qos can link."""
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return fits & (F.least(n - pos, m - qos) * (100 + PERCENT) >= (n + m) * PERCENT)


def _mixed(posts: DataFrame, grouped: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component (parked), and the posts of buckets with several components, with the least and greatest of a group and the bucket's largest, ``big``."""
    own = grouped.join(label.select(F.col("v").alias("rep"), "component"), "rep", "left")
    own = park(own.select("rep", "gid", F.coalesce("component", "rep").alias("comp")))
    of_group = own.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    spread_ = posts.join(of_group, "gid")
    parts = spread_.groupBy("tok", "lo").agg(F.count("*").alias("k"), F.max("hi").alias("hi"))
    several = parts.groupBy("tok").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.max(F.struct("k", F.bitwise_not("lo").alias("low"))).alias("x")).filter("least <> most")
    return own, park(spread_.join(several.select("tok", F.bitwise_not(F.col("x.low")).alias("big")), "tok"))


def _star(mixed: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of a group outside the largest component of a bucket and a drawn group of it; PARTNERS a group, those met in most buckets."""
    inside = (F.col("lo") == F.col("big")) & (F.col("hi") == F.col("big"))
    one = F.min(F.struct(F.xxhash64("gid", F.lit(round_)).alias("h"), "gid", "n", "pos"))
    drawn = mixed.filter(inside).groupBy("tok").agg(one.alias("x")).select("tok", F.col("x.gid").alias("b"), F.col("x.n").alias("m"), F.col("x.pos").alias("qos"))
    pairs = mixed.filter(~inside).join(drawn, "tok").filter(_may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("qos")))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))
    return pairs.groupBy(F.col("gid").alias("a"), "b").agg(F.count("*").alias("k")).withColumn("r", rank).filter(F.col("r") <= PARTNERS).select("a", "b")


def _left(mixed: DataFrame, own: DataFrame) -> DataFrame:
    """All remaining pairs (a, b) of members of different components whose groups can link."""
    one = ~((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("big")))
    x = mixed.filter(one).select("tok", "gid", "n", "pos", "lo", "hi")
    y = mixed.select("tok", F.col("gid").alias("g2"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    apart = (F.least("lo", "lo2") < F.greatest("hi", "hi2")) & (F.col("gid") != F.col("g2"))
    pairs = x.join(y, "tok").filter(apart & _may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("qos")))
    pairs = pairs.select(F.least("gid", "g2").alias("g1"), F.greatest("gid", "g2").alias("g2")).distinct()
    within = own.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    first = own.select(F.col("gid").alias("g1"), F.col("rep").alias("a"), F.col("comp").alias("ca"))
    second = own.select(F.col("gid").alias("g2"), F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return pairs.union(within).join(first, "g1").join(second, "g2").filter((F.col("ca") != F.col("cb")) & ((F.col("g1") != F.col("g2")) | (F.col("a") < F.col("b")))).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    spark = docs.sparkSession
    blocks = pack(docs)
    counted = levels(blocks, lambda data, off: iter(shingle_sets(data, off)))
    release(spark)
    rows = park(with_levels(blocks, counted).mapInArrow(_profile, _PROFILE))
    discard(blocks, counted)
    release(spark)
    able = rows.filter("sid IS NOT NULL")
    one = [F.first(c).alias(c) for c in ("n", "ph", "prefix", "body")]
    sets = park(able.groupBy("sid").agg(F.min("doc").alias("rep"), *one))
    groups = sets.groupBy("n", "ph").agg(F.min("rep").alias("gid"))
    grouped = park(sets.select("n", "ph", "rep").join(groups, ["n", "ph"]).select("rep", "gid", "n"))

    # Buckets of groups by prefix shingle.
    heads = grouped.filter("rep = gid").select("rep", "n")
    posts = sets.select("rep", "n", "prefix").join(heads, ["rep", "n"]).select(F.col("rep").alias("gid"), "n", F.inline("prefix"))
    buckets = posts.groupBy("tok").agg(F.min(F.struct("gid", "n", "pos")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    posts = park(posts.join(buckets, "tok").select("tok", "gid", "n", "pos", "c"))
    star = posts.filter((F.col("gid") != F.col("c.gid")) & _may_link(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
    star = star.groupBy("gid", F.col("c.gid").alias("c")).count().groupBy("gid").agg(F.max_by("c", F.struct("count", F.bitwise_not("c"))).alias("c"))
    pairs = star.select(F.col("gid").alias("a"), F.col("c").alias("b")).union(grouped.filter("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
    # Different sets of one doc_id are one document.
    same = able.select("doc", "sid").distinct().join(sets.select("sid", "rep"), "sid")
    owner = same.groupBy("doc").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).filter("m <> x")
    tied = same.join(owner.select("doc", "m"), "doc").filter("rep <> m").select(F.col("rep").alias("u"), F.col("m").alias("v"))
    edges = park(_verify(pairs, sets).union(tied))
    label = components(edges)

    for round_ in range(ROUNDS):
        own, mixed = _mixed(posts, grouped, label)
        more = park(_verify(_star(mixed, round_), sets))
        found = more.count()
        if found:
            edges = edges.union(more)
            label = components(edges)
        if found < WORTH:
            break
        discard(own, mixed)
        release(spark)
    if found:
        own, mixed = _mixed(posts, grouped, label)
    more = park(_verify(_left(mixed, own), sets))
    if more.limit(1).count():
        label = components(edges.union(more))
    release(spark)

    final = sets.select("sid", "rep").join(label.select(F.col("v").alias("rep"), "component"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    final = able.select("doc", "sid").join(final, "sid").groupBy("doc").agg(F.min("component").alias("component"))
    out = rows.select("doc", "n").join(final, "doc", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component; all columns stay."""
    return rows_with(docs, near_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))
