"""Captures as streams: replay totals, time buckets, alert state and first-seen origins by Structured Streaming.

events: event_time (timestamp), ts, ip, risk and case_id; sources name columns as the batch operators do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txintel.operators.reports import FLAGGED
from txintel.runtime import ensure_checkpoint_dir


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder, or one file, as a stream; its schema is read from the files there are."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def running_totals(events: DataFrame) -> DataFrame:
    flagged = F.count(F.when(F.col("risk") >= FLAGGED, 1))
    return events.agg(F.count("*").alias("seen"), F.count("ip").alias("resolved"), flagged.alias("flagged"))


def buckets(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, total, flagged) of tumbling windows; with late, windows close once the watermark has passed them."""
    marked = events.withWatermark("event_time", late) if late else events
    per = marked.groupBy(F.window("event_time", width).alias("w")).agg(F.count("*").alias("total"), F.count(F.when(F.col("risk") >= FLAGGED, 1)).alias("flagged"))
    return per.select(F.col("w.start").alias("start"), "total", "flagged")


def alert_state(events: DataFrame) -> DataFrame:
    """Keyed state of each case: first and last flagged event, their number and peak."""
    return events.filter(F.col("risk") >= FLAGGED).groupBy("case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max("risk").alias("peak"))


def first_seen(observations: DataFrame, window: str = "10 minutes", late: str = "1 minute", silent: str = "1 day") -> DataFrame:
    """(txid, origin_ip, first_time), once for each transaction: its first announcement (event_time, seq, src_ip) among those
    within the window of it, as soon as the watermark has passed the window's end.

    The window starts with the transaction's first announcement, wherever that falls. Announcements after it are dropped, and
    the transaction's state is kept for as long as `silent` so that they start no second one. seq: bigint.
    """
    span, quiet = (int(pd.Timedelta(x) / pd.Timedelta("1ms")) for x in (window, silent))
    marked = observations.select(F.col("txid").cast("string").alias("txid"), "event_time", F.col("seq").cast("bigint").alias("seq"), F.col("src_ip").cast("string").alias("src_ip")).withWatermark("event_time", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, at, seq, ip = state.get if state.exists else (False, None, None, None)
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            yield pd.DataFrame({"txid": [key[0]], "origin_ip": [ip], "first_time": [pd.Timestamp(at, unit="us")]})
            state.update((True, at, seq, ip))
            state.setTimeoutTimestamp(max(at // 1000 + span + quiet, state.getCurrentWatermarkMs() + 1))
            return
        for some in batches:
            for t, q, who in zip(some["event_time"], some["seq"], some["src_ip"], strict=True):
                mine = (int(t.value // 1000), int(q), who)
                if not done and (at is None or mine[:2] < (at, seq)):
                    at, seq, ip = mine
        state.update((done, at, seq, ip))
        state.setTimeoutTimestamp(max(at // 1000 + span + (quiet if done else 0), state.getCurrentWatermarkMs() + 1))

    return marked.groupBy("txid").applyInPandasWithState(step, "txid string, origin_ip string, first_time timestamp", "done boolean, at bigint, seq bigint, ip string", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result after all that is there now: micro-batches into the shared checkpoint folder, read back as a table.

    A batch goes to a folder of its own, which a repeated batch writes anew, so none counts twice; in complete mode the last one
    is the result.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/" + ("all" if mode == "complete" else f"batch-{number}"))

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out/*")
