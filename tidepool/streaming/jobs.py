"""Structured Streaming jobs: ingest, late rows, dedupe, stateful upsert and position tracking.

Every job runs to the end of what is there (AvailableNow). Its results lie in the shared
folder, one folder a batch, written over if a batch is run again; so a batch that is
repeated after a failure changes nothing, and a job that is started anew in the same
place goes on from its checkpoint. Reading puts the batches together: all rows, the last
row of each key, or sums over the batches.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.portfolio import Exit, decide, partial_sales, sale_rules
from ..sources.shared import shared_folder, until_exit
from .ledger import Ledger


def folder(spark: SparkSession) -> str:
    """A place of a job's own, until the driver ends; a job that is to go on later names its place."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    until_exit(spark, at)
    return at


def events(spark: SparkSession, sf_dir: str, glob: str = "events.parquet") -> DataFrame:
    """The events table as a file stream, one file a batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(sf_dir)


@dataclass(frozen=True)
class Budget:
    """When a job stops before its input ends: after so many batches, rows or seconds (None: no bound)."""

    batches: int | None = None
    rows: int | None = None
    seconds: float | None = None

    def spent(self, batches: int, rows: int, seconds: float) -> bool:
        return any(most is not None and used >= most for most, used in ((self.batches, batches), (self.rows, rows), (self.seconds, seconds)))


def run(stream: DataFrame, at: str, mode: str = "append", budget: Budget | None = None) -> None:
    """Runs a stream to its end, or until its budget is spent; what is left waits for the next run at the same place."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    if budget is None:
        query.awaitTermination()
        return
    began = time.monotonic()
    while not query.awaitTermination(0.2):
        done = query.recentProgress
        if budget.spent(len(done), sum(p["numInputRows"] for p in done), time.monotonic() - began):
            query.stop()


def batches(spark: SparkSession, at: str, schema) -> DataFrame:
    """All rows that a job has written, with their ``batch``."""
    full = schema if "batch" in schema.fieldNames() else schema.add("batch", "long")
    return spark.read.schema(full).option("basePath", f"{at}/table").parquet(f"{at}/table")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key: what an updating stream holds at its end."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_i", last).filter("_i = 1").drop("_i", "batch")


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, at: str | None = None, budget: Budget | None = None) -> DataFrame:
    """Runs a stream and reads what it has written: all rows, or with ``keys`` the last row of each key."""
    at = at or folder(stream.sparkSession)
    run(stream, at, mode, budget)
    rows = batches(stream.sparkSession, at, stream.schema)
    return latest(rows, keys) if keys else rows.drop("batch")


def heartbeat(stream: DataFrame, at: str | None = None) -> DataFrame:
    """(batch, rows): one row for each batch of a job that was done, empty ones too, from the ledger of its runs."""
    at = at or folder(stream.sparkSession)
    with Ledger(stream.sparkSession, at) as ledger:
        run(stream, at)
    return ledger.rows().filter("state = 'done'").groupBy("batch").agg(F.max("rows").alias("rows"))


def frames(stream: DataFrame) -> DataFrame:
    """Events as JSON frames, the form in which a socket delivers them; every fiftieth is damaged."""
    whole = F.to_json(F.struct(F.col("user_id").alias("mint"), F.col("event_type").alias("txType"), F.col("value").alias("solAmount"), F.col("event_id").alias("seq")))
    return stream.select(F.when(F.col("event_id") % 50 == 0, F.lit("<damaged>")).otherwise(whole).alias("frame"))


def ingest(raw: DataFrame) -> DataFrame:
    """Frames parsed by schema; frames that don't parse carry nulls and are counted by ``unparsed``."""
    p = raw.select("frame", F.from_json("frame", "mint long, txType string, solAmount double, seq long").alias("p"))
    return p.select(F.col("p.seq").alias("event_id"), F.col("p.mint").alias("token_key"), F.col("p.txType").alias("kind"), F.col("p.solAmount").alias("price"), F.col("p.mint").isNull().alias("unparsed"))


def unseen(stream: DataFrame, horizon: str = "40 days") -> DataFrame:
    """The first sight of each (token, kind); a key is forgotten ``horizon`` after its first sight, so state is bounded."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("token_key"), F.col("event_type").alias("kind"))
    return rows.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["token_key", "kind"]).select("token_key", "kind")


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of windows that have ended; rows later than ``late`` behind the newest are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def upsert(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Least event and count per token: each batch leaves its own sums, and reading merges them by key."""
    spark, at = stream.sparkSession, at or folder(stream.sparkSession)

    def fold(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.col("user_id").alias("token_key")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kind = stream.sparkSession.createDataFrame([], f"token_key {stream.schema['user_id'].dataType.simpleString()}, first_id {stream.schema['event_id'].dataType.simpleString()}, n long").schema
    return batches(spark, at, kind).groupBy("token_key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))


def positions(stream: DataFrame) -> DataFrame:
    """Marks and peaks per token in keyed state."""

    def track(key, parts, state):
        peak, low, n = state.get if state.exists else (float("-inf"), float("inf"), 0)
        for frame in parts:
            peak, low, n = max(peak, float(frame["value"].max())), min(low, float(frame["value"].min())), n + len(frame)
        state.update((peak, low, n))
        yield pd.DataFrame({"token_key": [key[0]], "peak": [peak], "low": [low], "n": [n]})

    return stream.groupBy("user_id").applyInPandasWithState(track, "token_key long, peak double, low double, n long", "peak double, low double, n long", "update", GroupStateTimeout.NoTimeout)


_HELD = "opened double, entry double, peak double, sold double, last double"


def exits(stream: DataFrame, rules: Exit | None = None, idle: int = 180, late: str = "1 minute") -> DataFrame:
    """(token_key, event_id, rule, part): each token's position, opened at its first mark, leaves by the rules of ``portfolio``.

    Marks have token_key, event_id, ts, price, liquidity and market_cap. State is one row a token; a token without a
    mark for ``idle`` seconds of event time is sold at its last mark (rule 'idle', event_id -1) by a timer,
    and its next mark opens a new position. Marks of a batch are taken in order of time, so batches must
    not be older than the watermark.
    """
    x = rules or Exit()
    selling = sale_rules(x)

    def track(key, parts, state):
        out = []
        held = SimpleNamespace(**dict(zip(("opened", "entry", "peak", "sold", "last"), state.get, strict=True))) if state.exists else None

        def expire():
            nonlocal held
            if held is not None and held.sold < 1 - 1e-9:
                out.append((key[0], -1, "idle", 1 - held.sold))
            held = None

        if state.hasTimedOut:
            expire()
            state.remove()
        else:
            frame = pd.concat(list(parts))
            frame["at"] = frame["ts"].astype("datetime64[ms]").astype("int64") / 1000
            for m in frame.sort_values(["at", "event_id"]).itertuples():
                if held is not None and m.at - held.last >= idle:
                    expire()
                if held is None:
                    held = SimpleNamespace(opened=m.at, entry=m.price, peak=m.price, sold=0.0, last=m.at)
                    continue
                held.last, held.peak = m.at, max(held.peak, m.price)
                if held.sold >= 1 - 1e-9 or held.entry <= 0 or m.price <= 0:
                    continue
                known = lambda v, other: other if v is None or v != v else float(v)
                rule = decide(selling, SimpleNamespace(price=m.price, entry=held.entry, peak=held.peak, held=m.at - held.opened, liquidity=known(m.liquidity, float("inf"))))
                for name, to in [(rule, 1.0)] if rule else partial_sales(x, held.sold, m.price / held.entry, known(m.market_cap, 0.0)):
                    if to > held.sold:
                        out.append((m.token_key, m.event_id, name, to - held.sold))
                        held.sold = to
            state.update((held.opened, held.entry, held.peak, held.sold, held.last))
            state.setTimeoutTimestamp(max(int((held.last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["token_key", "event_id", "rule", "part"])

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("token_key").applyInPandasWithState(track, "token_key long, event_id long, rule string, part double", _HELD, "append", GroupStateTimeout.EventTimeTimeout)
