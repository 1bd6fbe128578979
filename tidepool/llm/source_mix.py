"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue. Its documents stand in a seeded order (an md5 of the doc_id);
up to ``passes`` passes over the queue are scheduled one after another. A scheduled
document's virtual finish time is the cumulative source tokens up to and including it,
divided by the source's target. All scheduled documents, sorted by virtual finish
time over all sources, are cut where their tokens reach the budget.

No step gathers a source or the queue into one task: cumulative sums go by ranges of
the order key (two levels: sums of range totals, then a window within a range), and
so does the global cut, which descends by radix to one range of finish times. The
tables that are ordered whole have one row per source, or per range of a fixed number.

Edge cases: a null source is a source of its own and comes last; null text has size 0;
rows that repeat a doc_id count as documents of their own; documents of size 0 take
nothing; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import park, unused

PASSES = 3
RANGES = 4096  # per source and per level of the global cut
SEED = "mix"


def size_of(text: Column) -> Column:
    """Number of runs of non-space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, passes: int = PASSES) -> DataFrame:
    """source, source_size, target by water filling: t = min(passes * size, level * weight).

    Sources by code point, null last, weigh 1, 2, 3, repeating. The level is the one
    at which targets sum to all sizes; it is found from prefix sums over the sources
    sorted by the level at which each is full.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_sources = Window.partitionBy(F.lit(1))
    order = all_sources.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    weighed = weighed.withColumn("full", F.col("source_size") * passes).withColumn("full_at", F.col("full") / F.col("weight"))
    filled = all_sources.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_sources) - F.coalesce(F.sum("full").over(before), F.lit(0))) / (F.sum("weight").over(all_sources) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # A source is open if the level that fills all from it on stays under its own full level; the first open one fixes the level.
    tried = weighed.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at"))
    fixed = tried.withColumn("final", F.min(F.when(F.col("open"), F.struct("full_at", "level"))).over(all_sources)["level"])
    target = F.when(F.col("final").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("final") * F.col("weight")))
    return fixed.select("source", "source_size", target.alias("target"))


def _by_order(sized: DataFrame) -> DataFrame:
    """Adds ``cum``: tokens of the source up to and including the row, in the queue's order."""
    sized = sized.withColumn("key", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    sized = sized.withColumn("range", F.substring("key", 1, 3))
    totals = sized.groupBy("source", "range").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    starts = starts.withColumnsRenamed({"source": "s", "range": "r"})
    joined = sized.join(starts, sized["source"].eqNullSafe(F.col("s")) & (sized["range"] == F.col("r"))).drop("s", "r")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("cum", F.col("start") + F.sum("size").over(within)).drop("start", "range")


def _cut(scheduled: DataFrame) -> Column:
    """Whether a scheduled pass ``x`` of a row is taken, as a function on structs (code, tail).

    Finish times become integers of 36 bits; three rounds sum the tokens of 4096 ranges
    each and descend into the range where the budget runs out. One row a round comes
    to the driver. Within the last range (2**-34 wide) rows are ordered exactly.
    """
    queue = scheduled.select("size", F.explode("plan").alias("p")).select("size", "p.code", "p.tail")
    left = scheduled.agg(F.sum("size")).first()[0] or 0
    whole = Window.partitionBy(F.lit(1))
    chosen = 0
    for shift in (24, 12, 0):
        part = F.shiftright("code", shift)
        run = F.sum("total").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        totals = queue.groupBy(part.alias("part")).agg(F.sum("size").alias("total")).withColumn("upto", run).withColumn("last", F.max("part").over(whole))
        crossing = totals.filter((F.col("upto") > left) | (F.col("part") == F.col("last")))
        found = crossing.agg(F.min(F.struct("part", (F.col("upto") - F.col("total")).alias("before")))["part"], F.min(F.struct("part", (F.col("upto") - F.col("total")).alias("before")))["before"]).first()
        if found[0] is None:
            return lambda code, tail: F.lit(False)
        chosen, left = found[0], left - found[1]
        queue = queue.filter(part == chosen)
    run = F.sum("size").over(whole.orderBy("tail").rowsBetween(Window.unboundedPreceding, 0))
    fits = queue.withColumn("upto", run).filter(F.col("upto") <= left)
    last = fits.agg(F.max("tail").alias("t")).first()["t"]
    if last is None:
        return lambda code, tail: code < chosen
    kind = scheduled.schema["plan"].dataType.elementType["tail"].dataType
    end = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    return lambda code, tail: (code < chosen) | ((code == chosen) & (tail <= end))


def schedule(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, text_key and ``plan``: a struct per pass.

    A pass has its virtual ``finish``, its range ``code``, and ``tail``: what orders
    equal codes. The plan is null for size 0.
    """
    text = F.col("text").cast("string")
    sized = park(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("text_key")))
    per_source = targets(sized, passes).withColumnRenamed("source", "s")
    rows = _by_order(sized).join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = []
    for p in range(passes):
        finish = F.try_divide((F.col("cum") + F.col("source_size") * p).cast("double"), F.col("target"))
        code = F.least(F.floor(finish * float(1 << 34)), F.lit((1 << 36) - 1)).cast("long")
        tail = F.struct(finish.alias("finish"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), F.col("key").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("size").alias("size"))
        plan.append(F.struct(F.lit(p).alias("pass"), code.alias("code"), tail.alias("tail")))
    return park(rows.select("doc_id", "source", "size", "source_size", "target", "text_key", F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*plan)).alias("plan")))


def mix(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, passes_taken, taken, finishes (virtual finish times of the passes taken), text_key."""
    scheduled = schedule(docs, passes)
    taken = _cut(scheduled)
    chosen = F.coalesce(F.filter("plan", lambda x: taken(x["code"], x["tail"])), F.array().cast(scheduled.schema["plan"].dataType))
    rows = scheduled.withColumn("chosen", chosen).withColumn("passes_taken", F.size("chosen"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "passes_taken", (F.col("size") * F.col("passes_taken")).alias("taken"), F.transform("chosen", lambda x: x["tail"]["finish"]).alias("finishes"), "text_key")


def mixed_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """The documents as the mix takes them: all columns, one row per pass taken."""
    times, number, ident, content, turn = unused(docs, "times", "number", "ident", "content", "turn")
    own = F.xxhash64(docs["text"].cast("string"))
    plan = mix(docs, passes).groupBy("doc_id", "text_key").agg(F.sum("passes_taken").alias(times), F.count("*").alias(number)).filter(F.col(times) > 0)
    plan = plan.withColumnsRenamed({"doc_id": ident, "text_key": content})
    joined = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(F.col(ident)) & (own == F.col(content)))
    repeated = joined.filter(F.col(number) > 1).dropDuplicates([ident, content])  # equal rows: one carries the passes of all
    both = joined.filter(F.col(number) == 1).unionByName(repeated)
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)


#: DuckDB's form of ``op6_fair_queue_mix``.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
tried AS (SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0)) AS BIGINT) / CAST((sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS BIGINT) AS level, 3 * source_size / weight AS full_at
 FROM weighed WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(level, full_at) AS level FROM tried WHERE level <= full_at),
targets AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(f.level * weight, CAST(3 * source_size AS DOUBLE))) AS target FROM tried CROSS JOIN final f),
queued AS (SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CAST(cum + source_size * pass AS DOUBLE) / nullif(target, 0) AS finish FROM queued CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM passes WHERE finish IS NOT NULL),
taken AS (SELECT doc_id, source, key, cum, CAST(sum(size) AS BIGINT) AS taken FROM cut WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken FROM queued q
LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.key = t.key AND q.cum = t.cum AND q.size > 0
"""
