"""First-seen origin attribution of transactions from network announcements.

observations: txid, timestamp (seconds), src_ip, dst_ip (the sensor) and seq, a total order among equal timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txintel.functions.expressions import sigmoid
from txintel.operators.learn import fit_logistic
from txintel.runtime import checkpoint

RESOLVED, PROPAGATION_MS = 0.5, 250.0


def announced(obs: DataFrame) -> DataFrame:
    """(txid, src_ip, at) with each address's first announcement of each transaction."""
    return obs.groupBy("txid", "src_ip").agg(F.min(F.struct("timestamp", "seq")).alias("at"))


def first_seen(obs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(txid, origin_ip, first_ts, runner_up_ip, lead_ms): who announced first, and by how much ahead of anyone else.

    Each address's first announcement, then the two first of those: both steps are pre-aggregated before the shuffle, so a
    transaction that everybody announces is no more than two rows a task. own: announced(obs), if there.
    """
    own = own if own is not None else announced(obs)
    turn = F.row_number().over(Window.partitionBy("txid").orderBy("at", "src_ip"))
    two = own.withColumn("turn", turn).filter("turn <= 2").select("txid", "turn", F.struct("src_ip", "at.timestamp").alias("a"))
    found = two.groupBy("txid").agg(*(F.max(F.when(F.col("turn") == k, F.col("a"))).alias(n) for k, n in ((1, "first"), (2, "next"))))
    lead = F.round((F.col("next.timestamp") - F.col("first.timestamp")) * 1000, 1)
    return found.select("txid", F.col("first.src_ip").alias("origin_ip"), F.col("first.timestamp").alias("first_ts"), F.col("next.src_ip").alias("runner_up_ip"), lead.alias("lead_ms"))


def sensor_agreement(obs: DataFrame, first: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """(txid, origin_ip, sensor_agreement, sensor_count, announcer_count, peer_hop_count). first, own: first_seen(obs) and
    announced(obs), if there."""
    origins = (first if first is not None else first_seen(obs)).select("txid", "origin_ip")
    sensor = F.coalesce(F.col("dst_ip").cast("string"), F.lit("sensor"))
    heard = obs.groupBy("txid", sensor.alias("dst_ip")).agg(F.min_by("src_ip", F.struct("timestamp", "seq")).alias("heard"), F.count("*").alias("hops"))
    agreed = heard.join(origins, "txid").groupBy("txid").agg(
        F.first("origin_ip").alias("origin_ip"),
        F.round(F.avg((F.col("heard") == F.col("origin_ip")).cast("double")), 3).alias("sensor_agreement"),
        F.count("*").alias("sensor_count"),
        F.sum("hops").alias("peer_hop_count"),
    )
    pairs = own if own is not None else obs.groupBy("txid", "src_ip").agg(F.lit(1))
    announcers = pairs.groupBy("txid").agg(F.count("*").alias("announcer_count"))
    return agreed.join(announcers, "txid").select("txid", "origin_ip", "sensor_agreement", "sensor_count", "announcer_count", "peer_hop_count")


def relay_ratio(obs: DataFrame, first: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(origin_ip, announced, first_announced, relay_ratio) of every address that announced. own: announced(obs), if there."""
    pairs = own if own is not None else obs.select("src_ip", "txid").distinct()
    announced = pairs.groupBy(F.col("src_ip").alias("origin_ip")).agg(F.count("*").alias("announced"))
    led = first.groupBy("origin_ip").agg(F.count("*").alias("first_announced"))
    joined = announced.join(led, "origin_ip", "left").fillna({"first_announced": 0})
    return joined.withColumn("relay_ratio", F.round(1 - F.col("first_announced") / F.col("announced"), 3))


def signals() -> dict[str, Column]:
    """The four signals of an attribution, from lead_ms, sensor_agreement, sensor_count, relay_ratio and announcer_count as rounded."""
    lead = F.when(F.col("lead_ms").isNull(), 0.0).otherwise(1 - F.exp(-F.greatest(F.col("lead_ms"), F.lit(0.0)) / PROPAGATION_MS))
    agree = F.when(F.col("sensor_count") <= 1, 0.0).otherwise(F.col("sensor_agreement"))
    return {"lead": lead, "agreement": agree, "relay": F.col("relay_ratio"), "single": (F.col("announcer_count") <= 1).cast("double")}


def confidence(calibration: tuple[float, list[float]] | None = None) -> Column:
    """Confidence in an origin: calibrated (bias and a weight a signal), or by a rule of thumb."""
    s = signals()
    if calibration:
        z = F.lit(calibration[0])
        for w, x in zip(calibration[1], s.values(), strict=True):
            z = z + w * x
        return F.round(sigmoid(z), 3)
    many = (0.10 + 0.45 * s["lead"] + 0.45 * s["agreement"]) * (1 - 0.5 * s["relay"])
    return F.round(F.when(F.col("announcer_count") <= 1, 0.30).otherwise(F.least(F.lit(0.99), many)), 3)


def calibrate(attributed: DataFrame, truth: DataFrame, l2: float = 0.1) -> tuple[float, list[float]]:
    """Bias and weights of the signals from attributions whose true origin (txid, true_ip) is known."""
    known = attributed.join(truth, "txid")
    rows = known.select(F.array(*signals().values()).alias("x"), (F.col("origin_ip") == F.col("true_ip")).cast("int").alias("y"))
    w, b = fit_logistic(rows, l2, balanced=False)
    return b, w.tolist()


def attribute(obs: DataFrame, calibration: tuple[float, list[float]] | None = None) -> DataFrame:
    """One row a txid with every signal, the confidence, and whether it suffices."""
    own = checkpoint(announced(obs))  # three of the four signals need no more than this
    first = checkpoint(first_seen(obs, own))
    rated = relay_ratio(obs, first, own).select("origin_ip", "relay_ratio")
    agreed = sensor_agreement(obs, first, own).drop("origin_ip")
    return rated_by(first.join(agreed, "txid").join(rated, "origin_ip"), calibration)


def rated_by(attributed: DataFrame, calibration: tuple[float, list[float]] | None = None) -> DataFrame:
    """Attributions with the confidence of that calibration; their signals don't depend on it."""
    return attributed.withColumn("confidence", confidence(calibration)).withColumn("resolved", F.col("confidence") >= RESOLVED)
