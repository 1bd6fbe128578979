"""Streaming queries (survey section N), each drained and held against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import key


def _events(t):
    return jobs.events(t.spark, t.sf_dir)


@key("SELECT CASE WHEN ok THEN event_id END AS event_id, CASE WHEN ok THEN user_id END AS token_key, CASE WHEN ok THEN event_type END AS kind, CASE WHEN ok THEN value END AS price, NOT ok AS unparsed FROM (SELECT *, event_id % 50 <> 0 AS ok FROM events)")
def stream_ingest(t):
    return jobs.drain(jobs.ingest(jobs.frames(_events(t))))


@key("SELECT DISTINCT user_id AS token_key, event_type AS kind FROM events")
def stream_dedupe(t):
    return jobs.drain(jobs.unseen(_events(t)))


@key("SELECT user_id AS token_key, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY user_id")
def stream_upsert(t):
    return jobs.upsert(_events(t))


@key("SELECT user_id AS token_key, max(value) AS peak, min(value) AS low, count(*) AS n FROM events GROUP BY user_id")
def stream_positions(t):
    return jobs.drain(jobs.positions(_events(t)), "update", ["token_key"])


@key("SELECT CAST(epoch(h) AS BIGINT) AS start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h FROM events) x WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY h")
def stream_watermark(t):
    """Hours that the watermark has passed at the end of the stream."""
    return jobs.drain(jobs.tumbling(_events(t)), "append").select(F.unix_timestamp("start").alias("start"), "n")


@key("SELECT 0 AS batch, count(*) AS rows FROM events")
def stream_heartbeat(t):
    return jobs.heartbeat(_events(t))


@key()
def stream_exits(t):
    """Positions of each user's events as a stream: parts sold by rule, and what is left after six idle hours by a timer."""
    marks = _events(t).select(F.col("user_id").alias("token_key"), "event_id", "ts", F.col("value").alias("price"), (F.col("value") * (1 + F.col("event_id") % 9) * 100).alias("liquidity"), (F.col("value") * 1000).alias("market_cap"))
    return jobs.drain(jobs.exits(marks, idle=21_600))
