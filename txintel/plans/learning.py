"""Queries on labels and vectors: evaluation metrics and learning operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.operators import evaluate as M
from txintel.operators import learn as L
from txintel.runtime import checkpoint, table

#: Labelled rows that the network of graphsage_score learns from at most.
FIT_ROWS = 4000


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """V_LABEL: y is toxic, the score a document's length in thousands of characters, so that there are ties."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("toxic").cast("bigint").alias("y"), F.floor(F.col("n_chars") / 100).cast("double").alias("score"), "source", "quality")


_L = "l AS (SELECT doc_id AS id, toxic AS y, floor(n_chars / 100)::DOUBLE AS score, source, quality FROM labels JOIN documents USING (doc_id))"
_C = "c AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, sum(y) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits, sum(y) OVER () AS pos FROM l)"


def prf(spark, sf):
    return M.confusion(_labelled(spark, sf), 20.0)


def roc_auc(spark, sf):
    return M.roc_auc(_labelled(spark, sf))


def average_precision(spark, sf):
    return M.average_precision(_labelled(spark, sf))


def best_threshold(spark, sf):
    return M.best_threshold(_labelled(spark, sf))


def topk_flag(spark, sf):
    return M.top_k_flag(_labelled(spark, sf))


def bucket_accuracy(spark, sf):
    rows = _labelled(spark, sf).select((F.col("id") * 29 % 83 / 83.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    return M.bucket_accuracy(rows)


def group_coverage(spark, sf):
    return M.group_coverage(_labelled(spark, sf), "source", "quality")


def typology_recall(spark, sf):
    return M.group_recall(_labelled(spark, sf).filter("y = 1"), "source", 20.0)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def _vector_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector leads to the two that its number's arithmetic names."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("src"))
    n = v.count()
    return v.select("src", F.explode(F.array((F.col("src") * 7 + 3) % n, (F.col("src") + 1) % n)).alias("dst")).filter("src <> dst").distinct()


def standardise(spark, sf):
    rows = _vectors(spark, sf)
    z = L.standardise(rows.select("id", "x"), *L.column_stats(rows), clip=3.0)
    return z.select("id", F.posexplode("x").alias("pos", "z")).select("id", "pos", F.round("z", 6).alias("z"))


STANDARDISE_SQL = """WITH u AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
s AS (SELECT pos, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-9 THEN 1 ELSE stddev_pop(v) END AS s FROM u GROUP BY pos)
SELECT id, u.pos::INT AS pos, round(greatest(least((v - m) / s, 3.0::DOUBLE), -3.0::DOUBLE), 6) AS z FROM u JOIN s ON s.pos = u.pos"""


def neighbour_mean(spark, sf):
    met = L.neighbour_mean(_vectors(spark, sf).select("id", "x"), _vector_edges(spark, sf))
    return met.select("id", *(F.round(F.col(c)[k], 6).alias(f"{c}_{k}") for c in ("mean_in", "mean_out") for k in (0, 31, 63)))


NEIGHBOUR_SQL = """WITH v AS (SELECT vec_id AS id, embedding AS x FROM embeddings), n AS (SELECT count(*) AS n FROM v),
e AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest([(id * 7 + 3) % n, (id + 1) % n]) AS dst FROM v, n) WHERE src <> dst)
SELECT v.id, """ + ", ".join(f"round(coalesce({a}.m{k}, 0.0::DOUBLE), 6) AS {c}_{k}" for a, c in (("i", "mean_in"), ("o", "mean_out")) for k in (0, 31, 63)) + """ FROM v
LEFT JOIN (SELECT dst AS id, """ + ", ".join(f"avg(x[{k + 1}]::DOUBLE) AS m{k}" for k in (0, 31, 63)) + """ FROM e JOIN v ON v.id = src GROUP BY dst) i ON i.id = v.id
LEFT JOIN (SELECT src AS id, """ + ", ".join(f"avg(x[{k + 1}]::DOUBLE) AS m{k}" for k in (0, 31, 63)) + """ FROM e JOIN v ON v.id = dst GROUP BY src) o ON o.id = v.id"""


def isolation_forest(spark, sf):
    rows = checkpoint(_vectors(spark, sf).select("id", "x"))
    return L.isolation_scores(rows, *L.fit_isolation_forest(rows)).withColumn("anomaly", F.round("anomaly", 6))


def bounded_graph(rows: DataFrame, edges: DataFrame, targets: int, most: int = L.TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, src, dst, label, mask): at most targets rows by hash, which mask marks, with all that two layers see of them.

    All edges of the targets and of their neighbours are there, so both layers' means are those of the whole graph wherever a
    target's score depends on them. Where that makes over most nodes there are fewer targets, never fewer neighbours.
    """
    ids = rows.select("id")
    both = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst")
    both = checkpoint(both)

    def touching(some: DataFrame) -> DataFrame:
        return both.join(some.toDF("src"), "src", "left_semi").select("src", "dst").unionByName(both.join(some.toDF("dst"), "dst", "left_semi").select("src", "dst")).distinct()

    def with_ends(some: DataFrame, met: DataFrame) -> DataFrame:
        return some.unionByName(met.select(F.col("src").alias("id"))).unionByName(met.select(F.col("dst").alias("id"))).distinct()

    while True:
        chosen = checkpoint(ids.orderBy(F.xxhash64("id"), "id").limit(targets))
        near = checkpoint(with_ends(chosen, touching(chosen)))
        met = checkpoint(touching(near))
        nodes = checkpoint(with_ends(near, met))
        if targets == 1 or nodes.count() <= most:
            break
        targets = max(1, targets // 2)
    data = rows.join(nodes, "id", "left_semi").orderBy("id").toPandas()
    place = {int(k): n for n, k in enumerate(data["id"])}
    some = met.orderBy("src", "dst").toPandas()
    src, dst = (some[c].map(place).to_numpy(np.int64) for c in ("src", "dst"))
    mask = data["id"].isin(chosen.toPandas()["id"]).to_numpy()
    return np.array(data["x"].tolist()), src, dst, data["label"].to_numpy(), mask


def graphsage_score(spark, sf):
    """A network trained on a bounded sample of the vectors (label 0 against the rest) and all their neighbours, applied to all."""
    rows, edges = checkpoint(_vectors(spark, sf)), checkpoint(_vector_edges(spark, sf))
    x, src, dst, label, mask = bounded_graph(rows, edges, FIT_ROWS)
    net = L.train_graph_net(x, src, dst, (label == 0).astype(float), hidden=16, epochs=40, mask=mask)
    return net.scores(rows.select("id", "x"), edges).withColumn("gnn_prob", F.round("gnn_prob", 6))


def logistic_fit(spark, sf):
    rows = _vectors(spark, sf).select("id", "x", (F.col("label") == 0).cast("int").alias("y"))
    w, b = L.fit_logistic(rows, l2=1.0)
    z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda p, q: p * q), F.lit(b), lambda s, v: s + v)
    return rows.select("id", "y", F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("p"))


QUERIES = {
    "prf": prf, "roc_auc": roc_auc, "average_precision": average_precision, "best_threshold": best_threshold, "topk_flag": topk_flag, "bucket_accuracy": bucket_accuracy,
    "group_coverage": group_coverage, "typology_recall": typology_recall, "standardise": standardise, "neighbour_mean": neighbour_mean, "isolation_forest": isolation_forest,
    "graphsage_score": graphsage_score, "logistic_fit": logistic_fit,
}
_PRF = "round(CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END, 4)"
ORACLE_SQL = {
    "prf": f"WITH {_L}, k AS (SELECT count(*) FILTER (score >= 20 AND y = 1) AS tp, count(*) FILTER (score >= 20 AND y = 0) AS fp, count(*) FILTER (score < 20 AND y = 1) AS fn FROM l) SELECT tp, fp, fn, {_PRF.format(a='tp', b='(tp + fp)')} AS precision, {_PRF.format(a='tp', b='(tp + fn)')} AS recall, {_PRF.format(a='(2 * tp)', b='(2 * tp + fp + fn)')} AS f1 FROM k",
    "roc_auc": f"WITH {_L} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc FROM l p JOIN l n ON p.y = 1 AND n.y = 0",
    "average_precision": f"WITH {_L}, {_C} SELECT round(sum(CASE WHEN y = 1 THEN hits::DOUBLE / k END) / sum(y), 6) AS average_precision FROM c",
    "best_threshold": f"WITH {_L}, {_C} SELECT score AS threshold, round(2.0::DOUBLE * hits / (k + pos), 6) AS f1 FROM c ORDER BY round(2.0::DOUBLE * hits / (k + pos), 9) DESC, k LIMIT 1",
    "topk_flag": f"WITH {_L}, {_C} SELECT max(pos)::BIGINT AS positives, sum(y)::BIGINT AS tp, round(sum(y)::DOUBLE / max(pos), 4) AS precision FROM c WHERE k <= pos",
    "bucket_accuracy": f"WITH {_L}, b AS (SELECT CASE WHEN id * 29 % 83 / 83.0::DOUBLE < 0.5 THEN 'low' WHEN id * 29 % 83 / 83.0::DOUBLE < 0.75 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS total, count(*) FILTER (quality = 1) AS correct FROM l GROUP BY 1) SELECT v.bucket, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, round(CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE correct::DOUBLE / total END, 4) AS accuracy FROM (VALUES ('low'), ('mid'), ('high')) v(bucket) LEFT JOIN b ON b.bucket = v.bucket",
    "group_coverage": f"WITH {_L}, g AS (SELECT source, quality, count(*) AS covered FROM l GROUP BY ALL), r AS (SELECT *, sum(covered) OVER (PARTITION BY source)::BIGINT AS total, row_number() OVER (PARTITION BY source ORDER BY (quality IS NOT NULL) DESC, covered DESC, quality DESC) AS k FROM g) SELECT source, quality, covered, total, round(covered::DOUBLE / total, 4) AS coverage FROM r WHERE k = 1",
    "typology_recall": f"WITH {_L} SELECT source, count(*) AS total, count(*) FILTER (score >= 20) AS flagged, round(count(*) FILTER (score >= 20)::DOUBLE / count(*), 4) AS rate FROM l WHERE y = 1 GROUP BY source",
    "standardise": STANDARDISE_SQL, "neighbour_mean": NEIGHBOUR_SQL,
}
