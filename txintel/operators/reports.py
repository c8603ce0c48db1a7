"""Rollups of scored transactions: origins, timeline, networks, severities, bursts, alerts, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txintel.functions.expressions import SEVERITIES, category_label, severity
from txintel.operators.ordered import running
from txintel.runtime import checkpoint

FLAGGED, BINS, BURST_S = 40.0, 36, 600.0
#: Rows of one address up to which a window by address serves.
HOT = 1_000_000


def _flagged():
    return F.count(F.when(F.col("risk") >= FLAGGED, 1)).alias("flagged")


def origin_table(rows: DataFrame, limit: int = 40) -> DataFrame:
    """The addresses with most flagged transactions; the limit is the report's."""
    per = rows.groupBy("ip", "country", "asn", "org", "category", "category_label").agg(F.count("*").alias("transactions"), _flagged(), F.round(F.max("risk"), 1).alias("max_risk"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    return per.orderBy(F.desc("flagged"), F.desc("max_risk"), F.desc("transactions"), "ip").limit(limit)


def timeline(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, total, flagged) of equal-width bins over the capture; the last is closed, and empty ones are there."""
    span = rows.agg(F.min("ts").alias("t0"), F.greatest((F.max("ts") - F.min("ts")) / bins, F.lit(1.0)).alias("width"))
    placed = rows.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("ts") - F.col("t0")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("total"), _flagged())
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["total", "flagged"])


def timeline_span(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(t0, bucket_s), one row: when the timeline's first bin begins and how wide bins are."""
    return rows.agg(F.min("ts").alias("t0"), F.greatest((F.max("ts") - F.min("ts")) / bins, F.lit(1.0)).alias("bucket_s"))


def networks(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("category", F.coalesce("category", F.lit("unresolved")))
    return named.groupBy("category").agg(F.count("*").alias("total"), _flagged()).withColumn("category_label", category_label("category"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """Transactions of every severity, those with none too."""
    names = [n for _, n in SEVERITIES] + ["LOW"]
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "severity string")
    counts = rows.groupBy(severity("risk").alias("severity")).agg(F.count("*").alias("transactions"))
    return every.join(counts, "severity", "left").fillna(0, ["transactions"])


def origin_burst(rows: DataFrame, window: float = BURST_S, hot: int = HOT) -> DataFrame:
    """rows with burst, the other transactions of the address within the window either way, and its signal; 0 without address.

    A window by address counts them; where an address has more than hot rows, they are counted as a difference of two running
    totals over the order of all addresses and times, which no address has to fit into.
    """
    most = rows.filter("ip is not null").groupBy("ip").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= hot:
        within = F.expr(f"count(*) over (partition by ip order by ts range between {window}D preceding and {window}D following)")
        counted = rows.withColumn("burst", F.when(F.col("ip").isNull(), F.lit(0).cast("bigint")).otherwise(within - 1))
    else:
        held = checkpoint(rows.withColumn("__row", F.monotonically_increasing_id()))
        point = lambda shift, kind: held.filter("ip is not null").select("ip", (F.col("ts") + F.lit(shift)).alias("t"), F.lit(kind).alias("kind"), "__row")
        points = point(-window, 0).unionAll(point(0.0, 1)).unionAll(point(window, 2))
        upto = running(points, ["ip", "t", "kind", "__row"], {"n": (F.col("kind") == 1).cast("bigint")})
        ends = upto.filter("kind <> 1").groupBy("__row").agg((F.max("n") - F.min("n") - 1).alias("burst"))
        counted = held.join(ends, "__row", "left").fillna(0, ["burst"]).drop("__row")
    return counted.withColumn("origin_burst", F.least(F.lit(1.0), F.log2(1.0 + F.greatest("burst", F.lit(0))) / 4))


def alert_state(rows: DataFrame) -> DataFrame:
    """(case_id, first_ts, last_ts, n, peak) over flagged events."""
    return rows.filter(F.col("risk") >= FLAGGED).groupBy("case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max("risk").alias("peak"))


def search(rows: DataFrame, text: str, fields: tuple[str, ...], severities: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the severities whose fields, joined and lower-cased, hold the text."""
    hit = F.lower(F.concat_ws(" ", *(F.col(f).cast("string") for f in fields))).contains(text.lower())
    return rows.filter(hit & (severity("risk").isin(*severities) if severities else F.lit(True)))
