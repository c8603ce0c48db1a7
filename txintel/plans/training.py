"""Training on labelled captures, the saved bundle, evaluation against ground truth, and the labelled-graph experiment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.operators import cases as C
from txintel.operators import entities as E
from txintel.operators import evaluate as M
from txintel.operators import features as X
from txintel.operators import learn, origin
from txintel.operators.train import fit_graph_net
from txintel.plans.analysis import Result, Settings, evidence, prepare
from txintel.plans.stacking import name, number, stack, under
from txintel.runtime import checkpoint
from txintel.sources.elliptic import FIT, TEST, TUNE, Graph
from txintel.sources.files import Capture


@dataclass
class Bundle:
    """All that is learned: the origins' calibration, the graph network, the fusion's weights, bias and mean evidence."""

    calibration: tuple[float, list[float]]
    net: learn.GraphNet
    weights: dict[str, float]
    bias: float
    means: dict[str, float]

    def settings(self, networks: DataFrame | None = None) -> Settings:
        return Settings(self.weights, self.bias, self.calibration, networks, self.net, self.means)


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """One Parquet table of named arrays."""
    arrays = {f"net_{n}": a for n, a in learn.net_arrays(bundle.net).items()}
    arrays |= {"calibration": np.array([bundle.calibration[0], *bundle.calibration[1]]), "bias": np.array([bundle.bias])}
    arrays |= {f"weight_{n}": np.array([w]) for n, w in bundle.weights.items()} | {f"mean_{n}": np.array([w]) for n, w in bundle.means.items()}
    learn.save_arrays(spark, arrays, path)


def load(spark: SparkSession, path: str) -> Bundle:
    a = learn.load_arrays(spark, path)
    named = lambda p: {n.removeprefix(p): x for n, x in a.items() if n.startswith(p)}
    one = lambda p: {n: float(named(p)[n][0]) for n in X.EVIDENCE}
    return Bundle((float(a["calibration"][0]), a["calibration"][1:].tolist()), learn.net_of(named("net_")), one("weight_"), float(a["bias"][0]), one("mean_"))


def train(spark: SparkSession, captures: list[tuple[Capture, DataFrame]], fused: list[tuple[Capture, DataFrame]], networks: DataFrame | None = None, hidden: int = 24, epochs: int = 300) -> Bundle:
    """From captures with their truth (txid, label, origin_ip, ...): calibrates origins on all, fits the network on the first and
    the fusion, on evidence that the network hasn't learned from, on the others.

    All captures of a kind go through one plan, keyed by capture. Labels may be null: such transactions are part of the graph,
    but nothing is learned from them.
    """
    first = len(captures)
    groups = [(stack([c for c, _ in captures]), 0), (stack([c for c, _ in fused], first), first)]
    truth = under([t.select("txid", "label", F.col("origin_ip").alias("true_ip")) for _, t in (*captures, *fused)], "txid", "true_ip")
    attributed = []
    for c, _ in groups:
        c.observations = checkpoint(c.observations)
        attributed.append(checkpoint(origin.attribute(c.observations)))
    calibration = origin.calibrate(attributed[0].unionByName(attributed[1]), truth.select("txid", "true_ip"))
    ready = [prepare(spark, c, networks, calibration, name("origin_ip"), a, (number(), name())) for (c, _), a in zip(groups, attributed, strict=True)]

    told = ready[0].rows.join(truth.select(F.col("txid").alias("id"), F.col("label").cast("double").alias("y")), "id")
    net = fit_graph_net(checkpoint(told), ready[0].graph, hidden, epochs)

    names = list(X.EVIDENCE)
    known = truth.filter("label is not null").select("txid", F.col("label").cast("int").alias("y"))
    told = checkpoint(evidence(ready[1], net).join(known, "txid").select(F.array(*(F.col(n).cast("double") for n in names)).alias("x"), "y"))
    w, b = learn.fit_logistic(told, l2=1.0)
    means = told.agg(*(F.avg(F.col("x")[k]).alias(n) for k, n in enumerate(names))).first()
    return Bundle(calibration, net, dict(zip(names, w.tolist(), strict=True)), b, {n: means[n] for n in names})


def detector_rows(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, y, rule, anomaly, gnn_prob, risk, origin_ip, confidence, typology, scenario, true_ip) of scored transactions with truth."""
    said = truth.select("txid", F.col("label").cast("bigint").alias("y"), "typology", "scenario", F.col("origin_ip").alias("true_ip"))
    return scored.join(said, "txid").select(F.col("txid").alias("id"), "y", E.rule_flag().cast("double").alias("rule"), "anomaly", "gnn_prob", "risk", "origin_ip", "confidence", "typology", "scenario", "true_ip")


def detectors(rows: DataFrame) -> DataFrame:
    """(detector, tp, fp, fn, precision, recall, f1, roc_auc, average_precision) of the rule, the forest, which flags as many as
    there are positives, the network and the fused risk."""
    positives = max(1, rows.agg(F.sum("y")).first()[0] or 0)
    k = M.precision_curve(rows.withColumn("score", F.col("anomaly")).select("id", "y", "score")).filter(F.col("k") == positives).select("score").first()
    out = []
    for name, score, least in (("rule_baseline", "rule", 1.0), ("isolation_forest", "anomaly", None), ("graphsage", "gnn_prob", 0.5), ("fused", "risk", C.FLAGGED)):
        own = rows.select("id", "y", F.col(score).cast("double").alias("score"))
        if least is None:
            top = M.precision_curve(own).withColumn("score", (F.col("k") <= positives).cast("double")) if k is not None else own
            found = M.confusion(top, 1.0)
        else:
            found = M.confusion(own, least)
        if name != "rule_baseline":
            found = found.crossJoin(M.roc_auc(own)).crossJoin(M.average_precision(own))  # one row each
        else:
            found = found.withColumns({"roc_auc": F.lit(None).cast("double"), "average_precision": F.lit(None).cast("double")})
        out.append(found.withColumns({"detector": F.lit(name), "roc_auc": F.round("roc_auc", 4), "average_precision": F.round("average_precision", 4)}))
    return reduce(DataFrame.unionByName, out)


def evaluation_report(scored: DataFrame, members: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Tables of a report: totals (transactions with truth, positives, and how many located origins are right), detectors, typologies (recall of the fused risk), origin (accuracy by confidence), scenarios (the share
    of each that its best case holds). members: (txid, case_id)."""
    rows = checkpoint(detector_rows(scored, truth))
    located = rows.filter("origin_ip is not null").select("confidence", (F.col("origin_ip") == F.col("true_ip")).alias("correct"))
    placed = truth.filter("scenario is not null").select("txid", "scenario").join(members.select("txid", "case_id"), "txid", "left")
    best = M.group_coverage(placed, "scenario", "case_id")
    found = F.col("case_id").isNotNull()
    right = located.agg(F.count("*").alias("located"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    totals = rows.agg(F.count("*").alias("transactions"), F.coalesce(F.sum("y"), F.lit(0)).alias("positives")).crossJoin(right)  # one row each
    return {
        "totals": totals.withColumn("accuracy", F.when(F.col("located") > 0, F.round(F.col("correct") / F.col("located"), 4))),
        "detectors": detectors(rows),
        "typologies": M.group_recall(rows.withColumn("score", F.col("risk")), "typology", C.FLAGGED),
        "origin": M.bucket_accuracy(located),
        "scenarios": best.withColumns({"covered": F.when(found, F.col("covered")).otherwise(0), "coverage": F.when(found, F.col("coverage")).otherwise(0.0)}),
    }


def evaluate(result: Result, truth: DataFrame) -> dict[str, DataFrame]:
    """The report of an analysis whose truth is known."""
    named = result["members"].join(result["case_table"].select("case_root", "case_id"), "case_root")
    return evaluation_report(result["transactions"], named, truth)


def experiment(graph: Graph, hidden: int = 64, epochs: int = 100, clip: float = 5.0, steps: tuple = (FIT, TUNE, TEST)) -> DataFrame:
    """(detector, metrics...) on a labelled graph: fit on its first time steps, tuned on the next, tested on the last.

    A logistic regression on the features, the network with and without the graph, each at the threshold that is best on the
    steps for tuning, the network at its best epoch there, and the isolation forest.
    """
    fit, tune, test = steps
    spark = graph.rows.sparkSession
    early, late = graph.between(fit[0], tune[1]), graph.between(*test)
    known = lambda g, a, b: g.rows.filter(F.col("step").between(a, b) & F.col("y").isNotNull())
    fitted, tuned, tested = checkpoint(known(early, *fit)), checkpoint(known(early, *tune)), checkpoint(known(late, *test))
    out = []

    def told(name: str, tune_rows: DataFrame | None, test_rows: DataFrame, threshold: float | None = None) -> None:
        """tune_rows, test_rows: (id, y, score)."""
        least = threshold if threshold is not None else M.best_threshold(tune_rows).first()["threshold"]
        found = M.confusion(test_rows, least).crossJoin(M.roc_auc(test_rows)).crossJoin(M.average_precision(test_rows))
        out.append(found.withColumns({"detector": F.lit(name), "threshold": F.lit(float(least))}))

    mean, std = learn.column_stats(fitted)
    z = lambda rows: learn.standardise(rows, mean, std, clip)
    w, b = learn.fit_logistic(z(fitted).select("x", "y"), l2=10.0)
    linear = lambda rows: z(rows).select("id", "y", F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda p, q: p * q), F.lit(b), lambda s, v: s + v).alias("score"))
    told("logistic", linear(tuned), linear(tested))

    x, src, dst, y = learn.local_graph(early.rows, early.edges)
    when = np.array([r.step for r in early.rows.select("id", "step").orderBy("id").collect()])
    mask, look = ~np.isnan(y) & (when <= fit[1]), ~np.isnan(y) & (when >= tune[0])
    none = np.zeros(0, np.int64)
    for name, a, e in (("mlp", none, none), ("graphsage", src, dst)):
        best: dict = {"ap": -1.0}

        def watch(step: int, loss: float, net: learn.GraphNet, a=a, e=e, best=best) -> bool:
            if step % 10 == 0:
                score = learn.local_scores(net, x, a, e)[look]
                hits = y[look][np.argsort(-score, kind="stable")]
                ap = float((np.cumsum(hits) / np.arange(1, len(hits) + 1) * hits).sum() / max(1, hits.sum()))
                if ap > best["ap"]:
                    best |= {"ap": ap, "net": net}
            return False

        last = learn.train_graph_net(x, a, e, np.nan_to_num(y), hidden, epochs, l2=5e-4, mask=mask, callback=watch, clip=clip)
        net = best.get("net", last)
        score = lambda g, rows, net=net, a=a: rows.select("id", "y").join(net.scores(g.rows.select("id", "x"), g.edges if len(a) else g.edges.limit(0)), "id").withColumnRenamed("gnn_prob", "score")
        told(name, score(early, tuned), score(late, tested))

    forest = learn.isolation_scores(late.rows.select("id", "x"), *learn.fit_isolation_forest(early.rows.select("id", "x")))
    odd = checkpoint(tested.select("id", "y").join(forest, "id").withColumnRenamed("anomaly", "score"))
    top = M.precision_curve(odd).filter(F.col("k") == F.lit(max(1, odd.agg(F.sum("y")).first()[0] or 0))).select("score").first()
    told("isolation_forest", None, odd, float(top.score) if top else 1.0)
    return reduce(DataFrame.unionByName, out)
