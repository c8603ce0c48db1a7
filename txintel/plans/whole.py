"""Queries that run the analysis as a whole over the driver tables: V_OBS announces V_IO's transactions, from addresses of V_NET."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.functions.expressions import severity, severity_sql
from txintel.operators import cases as C
from txintel.operators import features as X
from txintel.plans import captures as V
from txintel.plans import network as N
from txintel.plans.analysis import Settings, analyse, evidence, prepare
from txintel.plans.learning import _L, _labelled
from txintel.plans.ledger import BIAS, WEIGHTS
from txintel.plans.training import detectors
from txintel.sources.files import Capture


def _capture(spark: SparkSession, sf: str) -> Capture:
    return Capture(V.observations(spark, sf), V.ledger(spark, sf), spark.createDataFrame([], "file string, sha256 string, records bigint"), columnar=True)


def _located() -> F.Column:
    """The address of V_NET that stands for an announcer's number."""
    base = F.element_at(F.array(*(F.lit(b) for b in V.BASES)), (F.col("origin_ip") % len(V.BASES) + 1).cast("int"))
    return F.concat(base, F.lit("."), ((F.col("origin_ip") * 7) % 250 + 1).cast("string"))


def analysis_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every transaction's computed evidence and fused risk, from origins, networks, chains, mixing, delays and bursts; what needs
    a trained network or a forest is 0 here, so that SQL can say the rest."""
    p = prepare(spark, _capture(spark, sf), locate=_located())
    rows = evidence(p, anomaly=False).withColumn("risk", X.risk(WEIGHTS, BIAS))
    return rows.select("txid", "origin_ip", "confidence", "resolved", "origin_category", "peel_hops", "burst", *(F.round(n, 6).alias(n) for n in WEIGHTS), F.round("risk", 4).alias("risk"), severity("risk").alias("severity"))


_IO_SQL = V.IO_SQL.replace("epoch(o_orderdate)::DOUBLE AS ts", "first_ts AS ts").replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN first ON first.txid = o_orderkey").replace("FROM orders LEFT JOIN (SELECT txid, count(*) AS n, round(sum(amount), 2) AS total FROM ins", "FROM orders JOIN first ON first.txid = o_orderkey LEFT JOIN (SELECT txid, count(*) AS n, round(sum(amount), 2) AS total FROM ins")
EVIDENCE_SQL = f"""WITH {N._FIRST_SQL}, {N._AGREE_SQL}, {N._RATIO_SQL}, {N._CONF_SQL}, {V.NETS_SQL}, {_IO_SQL}, {V.LINKS_SQL}, {V.DELAYS_SQL},
num AS (SELECT *, split_part(cidr, '/', 2)::INT AS prefix, list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS low FROM nets),
asked AS (SELECT DISTINCT origin_ip, {V.BASES_SQL}[(origin_ip % {len(V.BASES)}) + 1] || '.' || ((origin_ip * 7) % 250 + 1)::VARCHAR AS ip FROM conf),
ips AS (SELECT *, list_reduce(list_transform(string_split(ip, '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS n FROM asked),
hits AS (SELECT origin_ip, category, row_number() OVER (PARTITION BY origin_ip ORDER BY prefix DESC) AS k FROM ips JOIN num ON n BETWEEN low AND low + (1::BIGINT << (32 - prefix)) - 1),
loc AS (SELECT c.txid, c.origin_ip, c.confidence, c.confidence >= 0.5 AS resolved, CASE WHEN c.confidence >= 0.5 THEN coalesce(h.category, 'unknown') ELSE 'unresolved' END AS origin_category FROM conf c LEFT JOIN hits h ON h.origin_ip = c.origin_ip AND h.k = 1),
shaped AS (SELECT txid, ts FROM tx WHERE n_out = 2 AND n_in BETWEEN 1 AND 2 AND most_out > 0 AND least_out / most_out <= 0.25),
big AS (SELECT txid, arg_min(address, (-amount, pos)) AS address FROM outs GROUP BY txid),
hop AS (SELECT s.txid AS src, d.txid AS dst FROM shaped s JOIN big b ON b.txid = s.txid JOIN links l ON l.parent = s.txid AND l.address = b.address JOIN shaped d ON d.txid = l.child WHERE d.ts - s.ts <= 1800),
walked AS (WITH RECURSIVE walk(start, txid) AS (SELECT DISTINCT src, src FROM hop WHERE src NOT IN (SELECT dst FROM hop) UNION SELECT w.start, h.dst FROM walk w JOIN hop h ON h.src = w.txid) SELECT * FROM walk),
lengths AS (SELECT start, count(*) AS hops FROM walked GROUP BY start HAVING count(*) >= 3),
peels AS (SELECT w.txid, arg_max(hops, (tx.ts, w.start)) AS peel_hops FROM walked w JOIN lengths l ON l.start = w.start JOIN tx ON tx.txid = w.start GROUP BY w.txid),
bursts AS (SELECT txid, count(*) OVER (PARTITION BY origin_ip ORDER BY ts RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) - 1 AS burst FROM (SELECT loc.txid, origin_ip, ts FROM loc JOIN tx ON tx.txid = loc.txid)),
modes AS (SELECT txid, max(c) AS c FROM (SELECT txid, round(amount, 8) AS a, count(*) AS c FROM outs GROUP BY ALL) GROUP BY txid),
ev AS (SELECT tx.txid, origin_ip, confidence, resolved, origin_category, coalesce(peel_hops, 0) AS peel_hops, burst, 0.0::DOUBLE AS gnn_prob, 0.0::DOUBLE AS anomaly, (origin_category = 'tor_exit')::INT::DOUBLE AS origin_tor, (origin_category = 'vpn')::INT::DOUBLE AS origin_vpn,
  (origin_category = 'hosting')::INT::DOUBLE AS origin_hosting, (origin_category = 'exchange')::INT::DOUBLE AS origin_exchange, least(1.0::DOUBLE, log2(1 + coalesce(peel_hops, 0)) / 4) AS peel_chain,
  CASE WHEN n_in >= 3 AND coalesce(c, 0) >= 3 THEN round(c::DOUBLE / n_out, 3) ELSE 0.0::DOUBLE END AS coinjoin, exp(-least(since, until) / 300.0::DOUBLE) AS velocity, least(1.0::DOUBLE, log2(1 + burst) / 4) AS origin_burst
  FROM tx JOIN loc ON loc.txid = tx.txid JOIN delays ON delays.txid = tx.txid JOIN bursts ON bursts.txid = tx.txid LEFT JOIN peels ON peels.txid = tx.txid LEFT JOIN modes ON modes.txid = tx.txid),
scored AS (SELECT *, 100.0::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({BIAS}::DOUBLE {' '.join(f'+ {n} * {w}::DOUBLE' for n, w in WEIGHTS.items())}, 60.0), -60.0)))) AS risk FROM ev)
SELECT txid, origin_ip, confidence, resolved, origin_category, peel_hops, burst, {', '.join(f'round({n}, 6) AS {n}' for n in WEIGHTS)}, round(risk, 4) AS risk, {severity_sql('risk')} AS severity FROM scored"""


def analysis_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of the whole analysis, forest and all: number, risk, typology, sizes of the document's parts, narrative and seal."""
    cases = analyse(spark, _capture(spark, sf), Settings(bias=-1.5), locate=_located())["case_seals"]
    size = lambda p: F.size(p).alias(f"n_{p}") if p in C.BOUNDED else f"n_{p}"
    return cases.select("case_id", "case_root", "risk_score", "severity", "typology", "tx_count", "inflow", *map(size, C.PARTS), "narrative", "evidence_hash")


def analysis_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of the whole analysis, those that don't depend on models."""
    stats = analyse(spark, _capture(spark, sf), anomaly=False, locate=_located())["stats"]
    return stats.select("transactions", "observations", "origin_attributed", "origin_unresolved", "unobserved_transactions", "uncorrelated_observations", "observed_txids", "flow_edges", "origin_ips", "wallet_addresses", "graph_nodes", "graph_edges", "coinjoin_transactions", "capture_start", "capture_end")


STATS_SQL = f"""WITH {N._FIRST_SQL}, {N._AGREE_SQL}, {N._RATIO_SQL}, {N._CONF_SQL}, {_IO_SQL}, {V.LINKS_SQL},
modes AS (SELECT txid, max(c) AS c FROM (SELECT txid, round(amount, 8) AS a, count(*) AS c FROM outs GROUP BY ALL) GROUP BY txid),
used AS (SELECT address FROM ins UNION SELECT address FROM outs), one AS (SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(DISTINCT origin_ip) FROM conf JOIN tx USING (txid)) AS origin_ips, (SELECT count(*) FROM used) AS wallet_addresses)
SELECT transactions, (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM conf JOIN tx USING (txid) WHERE confidence >= 0.5) AS origin_attributed, (SELECT count(*) FROM conf JOIN tx USING (txid) WHERE confidence < 0.5) AS origin_unresolved,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT txid FROM obs)) AS unobserved_transactions, (SELECT count(*) FROM obs WHERE txid NOT IN (SELECT o_orderkey FROM orders)) AS uncorrelated_observations, (SELECT count(DISTINCT txid) FROM obs) AS observed_txids,
(SELECT count(*) FROM edges) AS flow_edges, origin_ips, wallet_addresses, origin_ips + wallet_addresses + transactions AS graph_nodes,
transactions + (SELECT count(*) FROM ins) + (SELECT count(*) FROM outs) AS graph_edges,
(SELECT count(*) FROM tx JOIN modes USING (txid) WHERE n_in >= 3 AND c >= 3 AND round(c::DOUBLE / n_out, 3) >= 0.5) AS coinjoin_transactions, (SELECT min(ts) FROM tx) AS capture_start, (SELECT max(ts) FROM tx) AS capture_end FROM one"""


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The detectors' part of an evaluation: toxic is the truth; a rule, an outlier score, a probability and a risk are dealt."""
    rows = _labelled(spark, sf)
    k = F.col("id")
    dealt = rows.select("id", "y", F.coalesce((F.col("quality") == 0).cast("double"), F.lit(0.0)).alias("rule"), F.col("score").alias("anomaly"), (k * 37 % 101 / 101.0).alias("gnn_prob"), F.least(F.lit(100.0), F.col("score") + k * 53 % 97).alias("risk"))
    return detectors(dealt)


def _detector_sql(name: str, score: str, least: str | None, ranked: bool) -> str:
    hit = f"s >= {least}" if least else "k <= (SELECT sum(y) FROM d)"
    ratio = "round(CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END, 4)"
    auc = "round((SELECT sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) FROM q p JOIN q n ON p.y = 1 AND n.y = 0), 4)" if ranked else "NULL::DOUBLE"
    ap = "round((SELECT sum(CASE WHEN y = 1 THEN hits::DOUBLE / k END) / sum(y) FROM q), 4)" if ranked else "NULL::DOUBLE"
    return f"""SELECT '{name}' AS detector, tp, fp, fn, {ratio.format(a='tp', b='(tp + fp)')} AS precision, {ratio.format(a='tp', b='(tp + fn)')} AS recall, {ratio.format(a='(2 * tp)', b='(2 * tp + fp + fn)')} AS f1, roc_auc, average_precision FROM (
WITH q AS (SELECT y, {score} AS s, row_number() OVER (ORDER BY {score} DESC, id) AS k, sum(y) OVER (ORDER BY {score} DESC, id ROWS UNBOUNDED PRECEDING) AS hits FROM d)
SELECT count(*) FILTER ({hit} AND y = 1) AS tp, count(*) FILTER ({hit} AND y = 0) AS fp, count(*) FILTER (NOT ({hit}) AND y = 1) AS fn, {auc} AS roc_auc, {ap} AS average_precision FROM q)"""


REPORT_SQL = f"""WITH {_L}, d AS (SELECT id, y, coalesce((quality = 0)::INT::DOUBLE, 0.0::DOUBLE) AS rule, score AS anomaly, id * 37 % 101 / 101.0::DOUBLE AS gnn_prob, least(100.0::DOUBLE, score + id * 53 % 97) AS risk FROM l)
""" + " UNION ALL ".join(_detector_sql(*x) for x in (("rule_baseline", "rule", "1", False), ("isolation_forest", "anomaly", None, True), ("graphsage", "gnn_prob", "0.5", True), ("fused", "risk", "40", True)))

QUERIES = {"analysis_evidence": analysis_evidence, "analysis_stats": analysis_stats, "analysis_cases": analysis_cases, "evaluation_report": evaluation_report}
ORACLE_SQL = {"analysis_evidence": EVIDENCE_SQL, "analysis_stats": STATS_SQL, "evaluation_report": REPORT_SQL}
