"""Conversation prefix trie from mergeable partial tries.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then its
own turns after its first h (h = crc32(decimal c) % 6). A node of the trie is a distinct
sequence of first d rebuilt turns; its key is a hash of 128 bits made of sums over
(depth, turn) fingerprints, so a key of any depth is a running sum and a conversation of
any length can be split between tasks.

Turns are sorted into ranges of (conv_id, turn). Each range becomes a partial trie: one
row per node with its members counted, its smallest member and the decimal ids of the
conversations that end there, in order. Partial tries merge by key in rounds, FAN ranges
at a time. A merge streams over sorted rows, so its memory is one node; a list of ends
longer than BLOCK goes on in rows of their own, and the last round hashes it as it
streams. The merged table is rolled up from the leaves by doubling: each round a node
hands what it has gathered to the ancestor twice as far up, so that a trie of depth d
takes log2(d) rounds.

Edge cases: rows without conv_id belong to no conversation; null role or text counts as
empty; turns of one conversation that share a turn number go by role and a fingerprint of
their text; repeated rows are repeated turns; a conversation whose rebuilt form has no
turn ends at the root; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, parallelism, park

STEP, HEADS = 100, 6  # fixed values: conversations share heads within a hundred; h < 6
FAN = 64
BLOCK = 1 << 20  # characters of decimal ids in one row
_MASK = (1 << 32) - 1
_NODE = "key binary, parent binary, depth long, chars long, conv_id long, n long, at long, first long, ends string"


def _lanes(depth: Column, print_: Column) -> list[Column]:
    """Four numbers of 32 bits for a turn at a depth; sums of 2**31 of them fit a long."""
    a, b = F.xxhash64(print_, depth), F.xxhash64(F.lit("b"), depth, print_)
    return [F.shiftrightunsigned(a, 32), a.bitwiseAND(_MASK), F.shiftrightunsigned(b, 32), b.bitwiseAND(_MASK)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256), 1, 32))


def _total(columns: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


LANES = ["l1", "l2", "l3", "l4"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, print (128 bits of the turn's role and text), chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), mark.alias("print"), F.length(text).cast("long").alias("chars"))
    return slim.filter(F.col("conv_id").isNotNull())


def _heads(turns: DataFrame) -> DataFrame:
    """base, n_base and ``head``: key, chars and sums of the prefixes of the first turns of conversations divisible by STEP."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "print")
    first = turns.filter(F.col("conv_id") % STEP == 0).withColumn("i", F.row_number().over(order)).filter(F.col("i") < HEADS)
    for name, lane in zip(LANES, _lanes(F.col("i").cast("long"), F.col("print")), strict=True):
        first = first.withColumn(name, lane)
    run = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = first.select("conv_id", F.col("i").cast("long").alias("i"), "chars", *[F.sum(c).over(run).alias(c) for c in LANES])
    node = F.struct("i", _key(F.col("i"), [F.col(c) for c in LANES]).alias("key"), "chars", *LANES)
    return first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(node)).alias("head"))


def _carried(rows: DataFrame, pairs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(p, c, and each name): for conversations that span ranges, sums over their earlier ranges, ``all_`` over all, and the last range."""
    spanning = rows.join(F.broadcast(pairs), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")))
    sums = spanning.groupBy("p", "c").agg(*[F.sum(v).alias(k) for k, v in columns.items()])
    earlier = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    return sums.select("p", "c", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in columns], *[F.sum(k).over(whole).alias(f"all_{k}") for k in columns], F.max("p").over(whole).alias("last"))


def _prefixes(conversations: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One row per conversation and depth of its rebuilt form: part, conv_id, depth, key, parent, chars, ends; and parked tables."""
    spark = conversations.sparkSession
    turns = _turns(conversations)
    heads = park(_heads(turns))
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % STEP
    # What a conversation takes over: the number of turns and their sums.
    taken = F.least(h, F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    over = F.when(taken > 0, F.element_at("head", taken.cast("int")))
    known = heads.withColumnRenamed("base", "b")
    turns = turns.withColumn("h", h).join(known, base == F.col("b"), "left").withColumn("taken", taken)
    turns = turns.select("conv_id", "turn", "role", "print", "chars", "h", "taken", *[F.coalesce(over[c], F.lit(0)).alias(f"h{c}") for c in LANES])
    ranges = max(1, parallelism(spark))
    sorted_ = turns.repartitionByRange(ranges, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print"))
    rows = park(sorted_.withColumn("part", F.spark_partition_id().cast("long")))
    # At most two conversations of a range have turns in others: these pairs are few, a known number per range.
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).select(F.col("part").alias("p"), F.explode(F.array_distinct(F.array("a", "b"))).alias("c"))
    pairs = park(edges.withColumn("parts", F.count("*").over(Window.partitionBy("c"))).filter("parts > 1").select("p", "c"))
    counts = park(_carried(rows, pairs, {"start": F.lit(1)}))

    own = Window.partitionBy("part", "conv_id")
    order = own.orderBy(F.col("turn").asc_nulls_first(), "role", "print")
    placed = rows.join(F.broadcast(counts), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")), "left")
    placed = placed.withColumn("i", F.row_number().over(order) + F.coalesce("start", F.lit(0))).withColumn("n", F.coalesce("all_start", F.count("*").over(own)))
    depth = F.col("i") - F.col("h") + F.col("taken")
    placed = placed.withColumn("depth", depth.cast("long"))
    for name, lane in zip(LANES, _lanes(F.col("depth"), F.col("print")), strict=True):
        placed = placed.withColumn(name, F.when(F.col("i") > F.col("h"), lane).otherwise(0))
    placed = park(placed.select("part", "conv_id", "i", "n", "h", "taken", "depth", "chars", *LANES, *[f"h{c}" for c in LANES]))
    lanes = park(_carried(placed, pairs, {f"c{c}": F.col(c) for c in LANES}))

    run = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tail = placed.filter(F.col("i") > F.col("h")).join(F.broadcast(lanes), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")), "left")
    sums = [F.sum(c).over(run) + F.coalesce(f"c{c}", F.lit(0)) + F.col(f"h{c}") for c in LANES]
    tail = tail.select("part", "conv_id", "i", "n", "depth", "chars", *LANES, *[s.alias(f"s{c}") for s, c in zip(sums, LANES, strict=True)])
    own_key = _key(F.col("depth"), [F.col(f"s{c}") for c in LANES])
    parent = _key(F.col("depth") - 1, [F.col(f"s{c}") - F.col(c) for c in LANES])
    tail = tail.select("part", "conv_id", "depth", own_key.alias("key"), parent.alias("parent"), "chars", (F.col("i") == F.col("n")).alias("ends"))

    root = _key(F.lit(0).cast("long"), [F.lit(0)] * 4)
    convs = placed.filter(F.col("i") == 1).join(known, base == F.col("b"), "left")
    kept = F.slice("head", F.lit(1), F.col("taken").cast("int"))
    above = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(0).cast("long").alias("chars"))), F.coalesce(F.transform(kept, lambda x: F.struct(x["i"].alias("depth"), x["key"].alias("key"), x["chars"].alias("chars"))), F.array().cast("array<struct<depth:long,key:binary,chars:long>>")))
    top = F.transform(above, lambda x, k: F.struct(x["depth"].alias("depth"), x["key"].alias("key"), F.when(k > 0, F.get(above, k - 1)["key"]).alias("parent"), x["chars"].alias("chars")))
    top = convs.select("part", "conv_id", "n", "h", "taken", F.explode(top).alias("x")).select("part", "conv_id", "x.*", ((F.col("x.depth") == F.col("taken")) & (F.col("n") <= F.col("h"))).alias("ends"))
    return top.select("part", "conv_id", "depth", "key", "parent", "chars", "ends").unionByName(tail), [heads, rows, pairs, counts, placed, lanes]


class _Node:
    """A node while its rows stream by."""

    def __init__(self, whole: bool):
        self.whole, self.key = whole, None

    def begin(self, row: tuple) -> None:
        self.key, self.parent, self.depth, self.chars, self.at = row
        self.conv_id, self.n, self.ended, self.first = None, 0, 0, None
        self.pieces, self.size, self.sha = [], 0, hashlib.sha256()

    def add(self, conv_id: int, n: int, first: list, ends: list) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n += n
        for f, e in zip(first, ends, strict=True):
            if self.whole:
                self.sha.update((("," if self.ended else "") + e).encode())
            else:
                self.first = f if not self.pieces else self.first
                self.pieces.append(e)
            self.size += len(e) + 1
            self.ended += 1

    def row(self) -> tuple:
        out = (self.key, self.parent, self.depth, self.chars, self.conv_id, self.n, self.at, self.first, self.sha.hexdigest() if self.whole else ",".join(self.pieces) if self.pieces else None)
        self.n, self.first, self.pieces, self.size = 0, None, [], 0
        return out


def _merge(whole: bool):
    """Merges rows that are sorted by (at, key, first): one row a node, more for long lists of ends; if ``whole``, one row with the list's SHA-256."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    kinds = [kinds[c.split()[1]] for c in _NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = _Node(whole)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            c = {name: batch.column(name) for name in names}
            key = np.frombuffer(b"".join(c["key"].to_pylist()), np.uint64).reshape(-1, 2)
            at, conv, n = (c[x].to_numpy() for x in ("at", "conv_id", "n"))
            new = np.ones(batch.num_rows, bool)
            new[1:] = (key[1:] != key[:-1]).any(1) | (at[1:] != at[:-1])
            heads = np.flatnonzero(new)
            least, members = np.minimum.reduceat(conv, heads).tolist(), np.add.reduceat(n, heads).tolist()
            ended = np.flatnonzero(np.asarray(c["ends"].is_valid()))
            cuts = np.searchsorted(ended, np.append(heads, batch.num_rows)).tolist()
            first, ends = c["first"].take(pa.array(ended)).to_pylist(), c["ends"].take(pa.array(ended)).to_pylist()
            tops = list(zip(*[c[x].take(pa.array(heads)).to_pylist() for x in ("key", "parent", "depth", "chars", "at")], strict=True))
            for k, top in enumerate(tops):
                if node.key is None or (node.key, node.at) != (top[0], top[4]):
                    if node.key is not None and (node.n or node.pieces):
                        out.append(node.row())
                    node.begin(top)
                lo, hi = cuts[k], cuts[k + 1]
                node.add(least[k], members[k], first[lo:hi], ends[lo:hi])
                if not whole and node.size > BLOCK:
                    out.append(node.row())
            if out:
                yield table(out)
        if node.key is not None and (node.n or node.pieces):
            yield table([node.row()])

    return run


def _merged(rows: DataFrame, parts: int, whole: bool) -> DataFrame:
    key = [F.col("at"), F.col("key")]
    dealt = rows.repartition(parts, *key).sortWithinPartitions("at", "key", F.col("first").asc_nulls_first())
    return dealt.mapInArrow(_merge(whole), _NODE)


def nodes(conversations: DataFrame) -> DataFrame:
    """key, parent, depth, chars (code points of the last text), conv_id, n_convs, ended (n > 0 if some end here), ends_sha256; parked."""
    spark = conversations.sparkSession
    prefixes, parked = _prefixes(conversations)
    decimal = F.col("conv_id").cast("string")
    entries = prefixes.select("key", "parent", "depth", "chars", "conv_id", F.lit(1).cast("long").alias("n"), F.col("part").alias("at"), F.when(F.col("ends"), F.col("conv_id")).alias("first"), F.when(F.col("ends"), decimal).alias("ends"))
    ranges = max(1, parallelism(spark))
    # Partial tries: a range of conversations stays in one task.
    dealt = entries.repartitionByRange(ranges, "at", "conv_id", "depth").sortWithinPartitions("at", "key", F.col("first").asc_nulls_first())
    partial = park(dealt.mapInArrow(_merge(False), _NODE))
    discard(*parked)
    reach = ranges
    while reach > FAN:
        reach = -(-reach // FAN)
        last, partial = partial, park(_merged(partial.withColumn("at", F.floor(F.col("at") / FAN).cast("long")), ranges, False))
        discard(last)
    ended = F.col("ends") != hashlib.sha256(b"").hexdigest()
    out = park(_merged(partial.withColumn("at", F.lit(0).cast("long")), ranges, True).select("key", "parent", "depth", "chars", "conv_id", F.col("n").alias("n_convs"), ended.alias("ended"), F.col("ends").alias("ends_sha256")))
    discard(partial)
    return out


def rolled_up(found: DataFrame) -> DataFrame:
    """key, n_children, n_leaves, saved_tokens for the nodes of several conversations, and the root."""
    children = found.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("lone"))
    shared = found.filter((F.col("n_convs") > 1) | F.col("parent").isNull()).join(children, F.col("key") == F.col("k"), "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("lone"))
    state = park(shared.select("key", F.col("parent").alias("up"), "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), leaf.cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    deepest, hop = state.agg(F.max("depth")).first()[0] or 0, 1
    while hop <= deepest:
        given = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("k")).agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("gained"))
        onward = state.filter(F.col("depth") >= hop).select(F.col("key").alias("a"), F.col("up").alias("further"))
        summed = state.join(given, F.col("key") == F.col("k"), "left").join(onward, F.col("up") == F.col("a"), "left")
        last, state = state, park(summed.select("key", F.col("further").alias("up"), "depth", "n_children", (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("gained", F.lit(0))).alias("saved")))
        discard(last)
        hop *= 2
    return state.select("key", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    found = nodes(conversations)
    up = rolled_up(found).withColumnRenamed("key", "k")
    lone = F.col("n_convs") == 1
    parents = found.filter((F.col("n_convs") > 1) | ~F.col("ended") | F.col("parent").isNull()).select(F.col("key").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    rows = found.join(up, F.col("key") == F.col("k"), "left").join(parents, F.col("parent") == F.col("p"), "left")
    alone = F.when(F.col("ended"), F.lit(0)).otherwise(F.lit(1)).cast("long")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.when(lone, alone)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
        "ends_sha256",
    )


#: DuckDB's form of ``op11_prefix_trie``: nodes are the lists of turns themselves.
TRIE_SQL = r"""
WITH said AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY i) AS turns,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM said GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, o.h), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
steps AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built),
prefixes AS (SELECT conv_id, depth, depth = size AS ends, list_slice(turns, 1, depth) AS node FROM steps),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY node, depth),
up AS (SELECT *, CASE WHEN depth > 0 THEN list_slice(node, 1, depth - 1) END AS parent FROM nodes),
kids AS (SELECT parent, count(*) AS n FROM up WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT u.*, coalesce(k.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS saved FROM up u LEFT JOIN kids k ON k.parent = u.node),
above AS (SELECT list_slice(node, 1, d) AS top, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_)),
rolled AS (SELECT top, CAST(sum(leaf::BIGINT) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, r.n_leaves, r.saved_tokens, f.ends_sha256
FROM full_ f JOIN rolled r ON r.top = f.node LEFT JOIN nodes p ON p.node = f.parent"""
