"""Embedding near-dedup with a random-projection tree forest.

Trees are sets of random hyperplanes with split values; their upper levels are fitted on a
bounded sample, and every vector is routed through all of them. Leaves that hold too many
vectors of a label are split further, level by level, at the medians of seeded projections
that Spark computes over the leaf's own vectors, so leaves don't grow with the table. At a
fitted split, the vectors nearest to it go to both sides: a share of the node that falls
from level to level, so a tree holds less than twice the vectors however deep it is, and near
neighbours part in few of the trees. Vectors are compared within (label, leaf) only; a pair that shares
leaves of several trees counts in the first of them. Links (cosine of at least THRESHOLD in double precision) are counted
per vector and joined into components by one edge a vector and leaf.

Equal vectors of a label collapse to one with a multiplicity before routing. A leaf is
compared in blocks: its members are dealt to blocks of BLOCK rows and every pair of blocks
is a task of its own, so no leaf that can't be split (of vectors that are all near) is
gathered whole.

Edge cases: rows with a null label link with nothing, and so do null, empty and zero vectors
and those with null or non-finite components; vectors of different length don't link; rows that share a vec_id
are different vectors that count as one vertex (their links add up; two of them that are
equal link to each other); null vec_id is one vertex, the smallest, with a null component;
extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import park, release, small_hashes

THRESHOLD = 0.93
TREES = 12
LEAF = 256  # vectors of the sample a leaf stands for, scaled to the table
SAMPLE = 20_000
SPILL, FALL = 0.05, 0.8  # share of a node that spills over to either side at the root; what is left of it a level below
BLOCK = 1024
MAX_DEPTH = 24
FULL = 2048  # vectors of a label from which a leaf is split further
LEVELS = 24  # further levels at most
LEAST_GAIN = 0.9  # a split whose larger side keeps more than this share isn't made
SEED = 11
_NONE = -(1 << 63)


class Forest:
    """trees[t]: (plane, split, margin) by heap index; an index that isn't there is a leaf."""

    def __init__(self, sample: np.ndarray, leaf: float, seed: int = SEED, trees: int = TREES):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if len(sample) else 0
        self.trees = []
        for _ in range(trees):
            nodes: dict[int, tuple[np.ndarray, float, float]] = {}
            todo = [(1, np.arange(len(sample)))]
            while todo:
                at, rows = todo.pop()
                if len(rows) <= max(leaf, 8) or at >= 1 << MAX_DEPTH:
                    continue
                plane = rng.standard_normal(self.dim)
                plane /= np.linalg.norm(plane)
                put = sample[rows] @ plane
                split = float(np.median(put))
                low = put < split
                if low.all() or not low.any():
                    continue
                spill = 2 * SPILL * FALL ** (at.bit_length() - 1)
                nodes[at] = (plane, split, float(np.quantile(np.abs(put - split), spill)))
                todo += [(2 * at, rows[low]), (2 * at + 1, rows[~low])]
            self.trees.append(nodes)

    @classmethod
    def of(cls, dim: int, trees: list[dict]) -> Forest:
        """A forest from plain data, which is what travels to executors."""
        new = cls.__new__(cls)
        new.dim, new.trees = dim, trees
        return new

    def leaves(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of unit vectors in tree t; spilled rows have several."""
        done_rows, done_leaves, todo = [], [], [(1, np.arange(len(unit)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at not in self.trees[t]:
                done_rows.append(rows)
                done_leaves.append(np.full(len(rows), at, np.int64))
                continue
            plane, split, margin = self.trees[t][at]
            put = unit[rows] @ plane - split
            todo += [(2 * at, rows[put < margin]), (2 * at + 1, rows[put >= -margin])]
        if not done_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(done_rows), np.concatenate(done_leaves)


def _vectors(batch: pa.RecordBatch, name: str = "x") -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.float64) for x in batch.column(name)]


def _valid(batches):
    """Usable vectors as bytes of doubles."""
    for batch in batches:
        keep, raw = [], []
        for i, v in enumerate(batch.column("embedding").to_pylist()):
            if v and None not in v:
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and a.any():
                    keep.append(i)
                    raw.append(a.tobytes())
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(raw, pa.binary())], names=["vec_id", "label", "x"])


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.array(rows)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _route(shared):
    """(label, dim, cell, id): the leaves of every vector, cells being tree << 40 | leaf."""

    def run(batches):
        forest = Forest.of(*shared.value)
        for batch in batches:
            rows = _vectors(batch)
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                who, cells = [at], [np.ones(len(at), np.int64)]  # a length of its own: one leaf
                if d == forest.dim:
                    unit = _unit([rows[i] for i in at])
                    found = [forest.leaves(unit, t) for t in range(len(forest.trees))]
                    who, cells = [at[r] for r, _ in found], [(t << 40) | leaf for t, (_, leaf) in enumerate(found)]
                take = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([batch.column("label").take(take), pa.array(np.full(len(take), d, np.int32)), pa.array(np.concatenate(cells)), batch.column("id").take(take)], names=["label", "dim", "cell", "id"])

    return run


def _project(batches):
    """Projections of vectors on the plane of their cell."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        put = []
        for v, cell in zip(_vectors(batch), batch.column("cell").to_pylist(), strict=True):
            plane = planes.get((cell, len(v)))
            if plane is None:
                if len(planes) > 4096:
                    planes.clear()
                plane = np.random.default_rng([SEED, cell]).standard_normal(len(v))
                plane = planes[cell, len(v)] = plane / np.linalg.norm(plane)
            put.append(float(v @ plane) / float(np.sqrt(v @ v)))
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim"), batch.column("cell"), batch.column("id"), pa.array(put, pa.float64())], names=["label", "dim", "cell", "id", "put"])


def _split_full(cells: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Cells with those of more than FULL vectors split until none is left that a split makes smaller."""
    spark, keys = cells.sparkSession, ["label", "dim", "cell"]
    done, open_ = [], cells
    for _ in range(LEVELS):
        sizes = park(open_.groupBy(*keys).agg(F.count("*").alias("n")))
        full = sizes.filter(F.col("n") > FULL)
        if not full.limit(1).count():
            break
        done.append(park(open_.join(full, keys, "left_anti")))
        rows = open_.join(full.select(*keys), keys, "left_semi").join(vectors.select("id", "x"), "id")
        put = park(rows.select(*keys, "id", "x").mapInArrow(_project, f"label {kind}, dim int, cell long, id long, put double"))
        mid = put.groupBy(*keys).agg(F.percentile_approx("put", 0.5, 1000).alias("mid"), F.count("*").alias("n"))
        low, high = F.col("put") < F.col("mid"), F.col("put") >= F.col("mid")
        counted = put.join(mid, keys).groupBy(*keys, "mid", "n").agg(F.count_if(low).alias("a"), F.count_if(high).alias("b"))
        good = F.greatest("a", "b") <= F.col("n") * LEAST_GAIN
        counted = park(counted.select(*keys, "mid", good.alias("good")))
        split = put.join(counted, keys)
        leaf = F.col("cell").bitwiseAND((1 << 40) - 1)
        child = F.col("cell") - leaf + leaf * 2
        sides = F.array_compact(F.array(F.when(low, child), F.when(high, child + 1)))
        done.append(park(split.filter("NOT good").select(*keys, "id")))
        open_ = park(split.filter((F.col("good")) & (leaf < 1 << 38)).select("label", "dim", F.explode(sides).alias("cell"), "id"))
        done.append(park(split.filter((F.col("good")) & (leaf >= 1 << 38)).select(*keys, "id")))
        release(spark)
    return reduce(DataFrame.union, [*done, open_])


def _compare(group: pa.Table) -> pa.Table:
    """Links between two blocks of a leaf (or within one): per vector the copies linked, and one partner."""
    cell, side = group["cell"][0].as_py(), group["side"].to_numpy()
    ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
    unit = _unit([np.frombuffer(x.as_buffer(), np.float64) for x in group["x"]])
    own = group["own"].to_pylist()
    one = np.flatnonzero(side != 2)
    two = np.flatnonzero(side != 1)
    near = unit[one] @ unit[two].T >= THRESHOLD - 1e-9
    i, j = np.nonzero(near)
    i, j = one[i], two[j]
    keep = i < j if len(one) == len(side) else np.ones(len(i), bool)  # one block against itself
    i, j = i[keep], j[keep]
    exact = (unit[i] * unit[j]).sum(1) >= THRESHOLD
    i, j = i[exact], j[exact]
    if len(i):
        # A pair counts here only if this is the first leaf that both have.
        flat = np.unique(np.array([c for p in own for c in p if c <= cell], np.int64))
        has = np.zeros((len(own), len(flat)), bool)
        for r, p in enumerate(own):
            has[r, np.searchsorted(flat, [c for c in p if c <= cell])] = True
        has = has[:, flat < cell]
        fresh = np.ones(len(i), bool)
        for a in range(0, len(i), 100_000):
            fresh[a : a + 100_000] = ~(has[i[a : a + 100_000]] & has[j[a : a + 100_000]]).any(1)
        i, j = i[fresh], j[fresh]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    some = links > 0
    return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "partner": pa.array(_root(ids, i, j)[some], pa.int64())})


def _root(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least id of each row's component under the links (i, j)."""
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if np.array_equal(before, label):
            return label


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    spark = vectors.sparkSession
    slim = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NONE)).alias("vec_id"), F.col("label"), F.col("embedding"))
    kind = slim.schema["label"].dataType.simpleString()
    usable = park(slim.filter("label IS NOT NULL").mapInArrow(_valid, f"vec_id long, label {kind}, x binary"))
    distinct = park(usable.groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    total = distinct.count()
    labels = max(1, distinct.select("label").distinct().count())
    # The sample: vectors of small hashes, at most SAMPLE.
    sample = [np.frombuffer(x, np.float64) for (x,) in small_hashes(distinct, "x", SAMPLE)]
    if sample:
        dims = np.bincount([len(s) for s in sample])
        sample = _unit([s for s in sample if len(s) == dims.argmax()])
    # A leaf holds about LEAF vectors of a label.
    share = len(sample) / max(1, total)
    forest = Forest(np.array(sample), LEAF * labels * share)
    shared = spark.sparkContext.broadcast((forest.dim, forest.trees))
    cells = park(distinct.select("label", "x", "id").mapInArrow(_route(shared), f"label {kind}, dim int, cell long, id long"))
    cells = _split_full(cells, distinct, kind)
    own = cells.groupBy("id").agg(F.array_sort(F.collect_list("cell")).alias("own"))
    routed = cells.join(park(distinct.select("id", "copies", "x").join(own, "id")), "id")
    # Blocks of a leaf: as many as its size asks for; every pair of blocks is one group.
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = routed.join(sizes, ["label", "dim", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi"), F.when(F.col("b") == o, 0).when(F.col("b") < o, 1).otherwise(2).alias("side")))
    dealt = blocked.withColumn("p", F.explode(pairs)).select("label", "dim", "cell", "id", "copies", "x", "own", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("p.side").alias("side"))
    found = park(dealt.groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(_compare, "id long, links long, partner long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Components over vec_ids: equal vectors tie to their first; links tie firsts.
    first = distinct.select("id", "first")
    linked = found.filter("id <> partner").select("id", "partner").distinct().join(first, "id").withColumnRenamed("first", "u").join(first.select(F.col("id").alias("partner"), F.col("first").alias("v")), "partner").select("u", "v")
    members = park(usable.join(distinct.select("label", "x", "id", "first", "copies"), ["label", "x"]).select("vec_id", "id", "first", "copies"))
    shared_ids = members.groupBy("vec_id").agg(F.min("first").alias("m"), F.max("first").alias("hi")).filter("m <> hi")
    tied = members.join(shared_ids, "vec_id").select(F.col("first").alias("u"), F.col("m").alias("v"))
    component = park(components(linked.union(tied)))
    whole = members.join(links, "id", "left").join(component.select(F.col("v").alias("first"), "component"), "first", "left")
    per_id = whole.groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.min(F.coalesce("component", "first")).alias("c"))
    real = lambda c: F.when(c != _NONE, c)
    out = slim.select("vec_id").join(per_id, "vec_id", "left")
    chosen = F.coalesce("c", "vec_id")
    return out.select(real(F.col("vec_id")).alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), real(chosen).alias("component_id"), (F.col("vec_id") == chosen).alias("kept"))
