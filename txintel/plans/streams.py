"""Queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.functions.expressions import epoch_seconds
from txintel.streaming import replay


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = replay.source(spark, f"{sf}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("event_time"), epoch_seconds("ts").alias("ts"), F.col("user_id").cast("string").alias("ip"), F.round(F.least(F.lit(100.0), F.col("value") * 4), 2).alias("risk"), F.col("event_type").alias("case_id"))


def stream_totals(spark, sf):
    return replay.drain(replay.running_totals(_events(spark, sf)))


def stream_alerts(spark, sf):
    return replay.drain(replay.alert_state(_events(spark, sf)))


def stream_buckets(spark, sf):
    """Six-hour windows; their starts as seconds since the first of 1970 in the session's zone, as events are."""
    b = replay.drain(replay.buckets(_events(spark, sf), "6 hours"))
    return b.select(epoch_seconds(F.col("start").cast("timestamp_ntz")).alias("start"), "total", "flagged")


_E = "e AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_type AS case_id, round(least(100.0::DOUBLE, value * 4), 2) AS risk FROM events)"
QUERIES = {"stream_totals": stream_totals, "stream_alerts": stream_alerts, "stream_buckets": stream_buckets}
ORACLE_SQL = {
    "stream_totals": f"WITH {_E} SELECT count(*) AS seen, count(*) AS resolved, count(*) FILTER (risk >= 40) AS flagged FROM e",
    "stream_alerts": f"WITH {_E} SELECT case_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(risk) AS peak FROM e WHERE risk >= 40 GROUP BY case_id",
    "stream_buckets": f"WITH {_E} SELECT floor(ts / 21600)::DOUBLE * 21600 AS start, count(*) AS total, count(*) FILTER (risk >= 40) AS flagged FROM e GROUP BY 1",
}
