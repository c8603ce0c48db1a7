"""Evaluation of scores against labels. rows: y (0 or 1) and score, with id as the tie-break among equal scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txintel.operators.ordered import running


def _ratio(a, b, places: int = 4):
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), places)


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of score >= threshold; ratios without a denominator are 0."""
    hit = F.col("score") >= threshold
    c = rows.agg(*(F.count(F.when(x, 1)).alias(n) for n, x in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)))))
    tp, fp, fn = (F.col(n) for n in ("tp", "fp", "fn"))
    return c.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def roc_auc(rows: DataFrame) -> DataFrame:
    """(roc_auc): rank-sum statistic with average ranks of ties; null if a class is empty. Scores are counted before they are
    ranked, so the ordered pass has one row a distinct score."""
    per = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    ranked = running(per, ["score"], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return s.select(F.round(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, (F.col("pos") * F.col("neg")).cast("double")), 6).alias("roc_auc"))


def precision_curve(rows: DataFrame) -> DataFrame:
    """rows with k, the rank by decreasing score, and hits among the first k."""
    return running(rows, [F.desc("score"), F.col("id")], {"k": F.lit(1).cast("bigint"), "hits": F.col("y").cast("bigint")})


def _with_positives(rows: DataFrame) -> DataFrame:
    return precision_curve(rows).crossJoin(F.broadcast(rows.agg(F.sum("y").alias("pos"))))


def average_precision(rows: DataFrame) -> DataFrame:
    c = precision_curve(rows)
    return c.agg(F.round(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("k"))), F.sum("y").cast("double")), 6).alias("average_precision"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """(threshold, f1) of the score that, used as threshold, gives most F1; of equals the highest score."""
    c = _with_positives(rows)
    f1 = F.try_divide(2.0 * F.col("hits"), (F.col("k") + F.col("pos")).cast("double"))
    best = c.withColumn("f1", F.round(f1, 9)).agg(F.max_by(F.struct("score", "f1"), F.struct("f1", -F.col("k"))).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.round("b.f1", 6).alias("f1"))


def top_k_flag(rows: DataFrame) -> DataFrame:
    """(k, tp, precision) when as many rows are flagged as are positive."""
    c = _with_positives(rows).filter("k <= pos")
    return c.agg(F.max("pos").alias("positives"), F.sum("y").alias("tp")).withColumn("precision", _ratio(F.col("tp"), F.col("positives")))


def bucket_accuracy(rows: DataFrame) -> DataFrame:
    """(bucket, total, correct, accuracy) for confidence under 0.5, under 0.75 and above, all three always there."""
    bucket = F.when(F.col("confidence") < 0.5, "low").when(F.col("confidence") < 0.75, "mid").otherwise("high")
    c = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"), F.sum(F.col("correct").cast("bigint")).alias("correct"))
    every = rows.sparkSession.createDataFrame([("low",), ("mid",), ("high",)], "bucket string")
    out = every.join(c, "bucket", "left").fillna(0, ["total", "correct"])
    return out.withColumn("accuracy", _ratio(F.col("correct"), F.col("total")))


def group_coverage(rows: DataFrame, group: str, part: str) -> DataFrame:
    """(group, part, covered, total, coverage): each group's most frequent part and its share of the whole group."""
    per = rows.groupBy(group, part).agg(F.count("*").alias("covered"))
    total = per.groupBy(group).agg(F.sum("covered").alias("total"), F.max_by(F.struct(part, "covered"), F.struct(F.col(part).isNotNull(), "covered", F.col(part))).alias("b"))
    return total.select(group, F.col("b." + part).alias(part), F.col("b.covered").alias("covered"), "total", _ratio(F.col("b.covered"), F.col("total")).alias("coverage"))


def group_recall(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    c = rows.groupBy(group).agg(F.count("*").alias("total"), F.count(F.when(F.col("score") >= threshold, 1)).alias("flagged"))
    return c.withColumn("rate", _ratio(F.col("flagged"), F.col("total")))
