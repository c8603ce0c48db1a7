"""Queries on the ledger: money flow, wallets, features, risk and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.functions.expressions import category_label, severity, severity_sql
from txintel.operators import cases as C
from txintel.operators import entities as E
from txintel.operators import features as X
from txintel.operators import flow as G
from txintel.plans import captures as V
from txintel.runtime import checkpoint

# Weights of a stand-in fusion model, for queries whose results SQL has to reproduce; trained ones come from learn.fit_logistic.
WEIGHTS = {"gnn_prob": 3.0, "anomaly": 1.5, "origin_tor": 1.2, "origin_vpn": 0.8, "origin_hosting": 0.5, "origin_exchange": -1.0, "peel_chain": 1.5, "coinjoin": 1.0, "velocity": 0.7, "origin_burst": 0.9}
BIAS = -6.0
CATEGORIES = ("tor_exit", "vpn", "hosting", "exchange", "residential", "mobile", "unresolved")
DAYS180 = 15552000.0


def _flow(spark: SparkSession, sf: str):
    tx = checkpoint(V.ledger(spark, sf))
    links = checkpoint(G.spend_links(G.inputs(tx), G.outputs(tx)))
    return tx, links


def spend_links(spark: SparkSession, sf: str) -> DataFrame:
    tx = checkpoint(V.ledger(spark, sf).select("txid", "ts", "input_addresses", "output_addresses", "output_amounts"))  # read four times
    return G.spend_links(G.inputs(tx), G.outputs(tx))


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.flow_edges(spend_links(spark, sf))


def hetero_graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    tx = checkpoint(V.ledger(spark, sf).select("txid", "ts", "input_addresses", "output_addresses", "output_amounts"))  # read four times
    nodes, edges = G.hetero_graph(V.observations(spark, sf), G.inputs(tx), G.outputs(tx))
    return nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionAll(edges.groupBy(F.lit("edge"), "rel").agg(F.count("*")))


HETERO_SQL = f"""WITH {V.IO_SQL}, {V.OBS_SQL}, e AS (
SELECT 'IP:' || src_ip AS src, 'TXID:' || txid AS dst, 'ANNOUNCED' AS rel FROM obs UNION ALL SELECT 'WALLET:' || address, 'TXID:' || txid, 'SPENT_IN' FROM ins
UNION ALL SELECT 'TXID:' || txid, 'WALLET:' || address, 'PAID_TO' FROM outs)
SELECT 'node' AS what, split_part(id, ':', 1) AS kind, count(*) AS n FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel"""


def respend_delays(spark: SparkSession, sf: str) -> DataFrame:
    tx, links = _flow(spark, sf)
    return G.delays(tx, G.flow_edges(links))


def tx_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(flow_edges(spark, sf))


def peel_shaped(spark: SparkSession, sf: str) -> DataFrame:
    return V.ledger(spark, sf).select("txid", E.peel_shaped().alias("peel_shaped"), E.rule_flag().alias("rule_flag"))


PEEL_SQL = f"""WITH {V.IO_SQL} SELECT txid, coalesce(n_out = 2 AND n_in BETWEEN 1 AND 2 AND most_out > 0 AND least_out / most_out <= 0.25, false) AS peel_shaped,
coalesce(n_in = 1 AND n_out = 2 AND most_out > 0 AND least_out / most_out < 0.2, false) AS rule_flag FROM tx"""


def peel_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains over V_WALLET with half of the amount as the largest peel and half a year as the longest gap."""
    tx = checkpoint(V.wallets(spark, sf))
    links = G.spend_links(G.inputs(tx), G.outputs(tx))
    found = E.chains(E.remainder_hops(tx, links, E.peel_shaped(ratio=0.5), DAYS180), tx)
    return E.chain_table(found, tx).select("start", "hops", "peeled_total", "start_amount", "remainder", "duration_s", "chain_id")


CHAINS_SQL = f"""WITH {V.WALLET_SQL},
ok AS (SELECT * FROM hops WHERE ratio <= 0.5 AND total > 0),
isl AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND ts - lag(ts) OVER w <= {DAYS180} THEN 0 ELSE 1 END AS fresh FROM ok WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY k) AS g FROM isl),
ch AS (SELECT o_custkey, g, min_by(o_orderkey, k) AS start, count(*) AS hops, sum((total * ratio)::DECIMAL(28, 8))::DOUBLE AS peeled_total, round(min_by(total, k), 8) AS start_amount, round(max_by(total, k), 8) AS remainder,
  max(ts) - min(ts) AS duration_s, min(ts) AS start_ts FROM grp GROUP BY o_custkey, g HAVING count(*) >= 3)
SELECT start, hops, peeled_total, start_amount, remainder, duration_s, 'PEEL_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS chain_id FROM (SELECT *, row_number() OVER (ORDER BY start_ts, start) AS n FROM ch)"""


def coinjoin_score(spark: SparkSession, sf: str) -> DataFrame:
    return V.monthly(spark, sf).select("l_suppkey", "month", E.coinjoin_score().alias("coinjoin"))


COINJOIN_SQL = """WITH m AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, l_linestatus, l_partkey, round(l_discount, 2) AS amount FROM lineitem),
o AS (SELECT l_suppkey, month, max(n) AS equal, sum(n) AS n_out FROM (SELECT l_suppkey, month, amount, count(*) AS n FROM m WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY ALL),
i AS (SELECT l_suppkey, month, count(DISTINCT l_partkey) FILTER (l_linestatus = 'O') AS n_in FROM m GROUP BY ALL)
SELECT i.l_suppkey, i.month, CASE WHEN n_in >= 3 AND equal >= 3 THEN round(equal::DOUBLE / n_out::DOUBLE, 3) ELSE 0.0::DOUBLE END AS coinjoin FROM i LEFT JOIN o ON i.l_suppkey = o.l_suppkey AND i.month = o.month"""


def entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return E.entities(V.cospends(spark, sf))


_CC = """{name} AS (SELECT n, min(l) AS root FROM (WITH RECURSIVE walk(n, l) AS (SELECT a, a FROM {edges} UNION SELECT e.b, w.l FROM walk w JOIN {edges} e ON e.a = w.n) SELECT * FROM walk) GROUP BY n)"""
ENTITY_SQL = f"""WITH s AS (SELECT DISTINCT l_partkey || '-' || l_suppkey || '-' || l_linestatus AS txid, l_orderkey AS address FROM lineitem),
p AS (SELECT a.address AS a, b.address AS b FROM s a JOIN s b ON a.txid = b.txid AND a.address <> b.address), {_CC.format(name='cc', edges='p')},
z AS (SELECT root, count(*) AS size FROM cc GROUP BY root), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, root) AS k FROM z)
SELECT n AS address, r.root AS entity, 'ENTITY_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS entity_id, size FROM cc JOIN r ON r.root = cc.root"""


def tx_features(spark: SparkSession, sf: str) -> DataFrame:
    tx, links = _flow(spark, sf)
    edges = G.flow_edges(links)
    f = X.tx_features(tx, G.degrees(edges), G.delays(tx, edges))
    return f.select("txid", *(F.round(c, 6).alias(c) for c in X.FEATURES))


_BASE_SQL = f"{V.IO_SQL}, {V.LINKS_SQL}, {V.DELAYS_SQL}"
FEATURES_SQL = f"""WITH {_BASE_SQL}, deg AS (SELECT txid, sum(i) AS i, sum(o) AS o FROM (SELECT child AS txid, 1 AS i, 0 AS o FROM edges UNION ALL SELECT parent, 0, 1 FROM edges) GROUP BY txid),
modes AS (SELECT txid, max(c) AS c FROM (SELECT txid, round(amount, 8) AS a, count(*) AS c FROM outs GROUP BY ALL) GROUP BY txid),
v AS (SELECT tx.*, CASE WHEN total_in <> 0 THEN total_in ELSE total_out END AS value, since, until, coalesce(deg.i, 0)::DOUBLE AS di, coalesce(deg.o, 0)::DOUBLE AS dout, coalesce(modes.c, 0) AS c
  FROM tx JOIN delays ON delays.txid = tx.txid LEFT JOIN deg ON deg.txid = tx.txid LEFT JOIN modes ON modes.txid = tx.txid)
SELECT txid, round(ln(1 + value), 6) AS log_value, round(ln(1 + n_in), 6) AS log_inputs, round(ln(1 + n_out), 6) AS log_outputs,
round(CASE WHEN value > 0 THEN log10(fee / value + 1e-8::DOUBLE) ELSE -8.0::DOUBLE END, 6) AS log_fee_rate,
round(CASE WHEN n_out > 1 AND most_out > 0 THEN least_out / most_out ELSE 1.0::DOUBLE END, 6) AS output_ratio,
round(CASE WHEN n_out <= 1 THEN 0.0::DOUBLE WHEN most_out > 0 THEN c::DOUBLE / n_out ELSE 1.0::DOUBLE END, 6) AS equal_out_frac,
round(ln(1 + greatest(since, 0)), 6) AS log_respend, round(ln(1 + greatest(until, 0)), 6) AS log_next_spend, round(ln(1 + di), 6) AS log_in_degree, round(ln(1 + dout), 6) AS log_out_degree FROM v"""


def _evidence(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """V_IO with its own flow; what announcements and models would add is dealt by transaction number."""
    k = F.col("txid")
    category = F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (k * 11 % len(CATEGORIES) + 1).cast("int"))
    rows = tx.join(G.delays(tx, edges), "txid").withColumns({
        "gnn_prob": (k * 37 % 101) / 101.0, "anomaly": (k * 53 % 97) / 97.0, "origin_category": category, "peel_hops": (k % 6).cast("int"), "coinjoin": E.coinjoin_score(), "burst": k % 4,
    })
    return X.evidence(rows)


_EV_SQL = f"""{_BASE_SQL},
modes AS (SELECT txid, max(c) AS c FROM (SELECT txid, round(amount, 8) AS a, count(*) AS c FROM outs GROUP BY ALL) GROUP BY txid),
ev AS (SELECT tx.*, (tx.txid * 37 % 101) / 101.0::DOUBLE AS gnn_prob, (tx.txid * 53 % 97) / 97.0::DOUBLE AS anomaly,
  (tx.txid * 11 % 7 = 0)::INT::DOUBLE AS origin_tor, (tx.txid * 11 % 7 = 1)::INT::DOUBLE AS origin_vpn, (tx.txid * 11 % 7 = 2)::INT::DOUBLE AS origin_hosting, (tx.txid * 11 % 7 = 3)::INT::DOUBLE AS origin_exchange,
  least(1.0::DOUBLE, log2(1 + tx.txid % 6) / 4) AS peel_chain, CASE WHEN n_in >= 3 AND coalesce(c, 0) >= 3 THEN round(c::DOUBLE / n_out, 3) ELSE 0.0::DOUBLE END AS coinjoin,
  exp(-least(since, until) / 300.0::DOUBLE) AS velocity, least(1.0::DOUBLE, log2(1 + tx.txid % 4) / 4) AS origin_burst
  FROM tx JOIN delays ON delays.txid = tx.txid LEFT JOIN modes ON modes.txid = tx.txid),
scored AS (SELECT *, 100.0::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({BIAS}::DOUBLE {' '.join(f'+ {n} * {w}::DOUBLE' for n, w in WEIGHTS.items())}, 60.0), -60.0)))) AS risk FROM ev)"""


def evidence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    tx, links = _flow(spark, sf)
    return _evidence(tx, G.flow_edges(links)).select("txid", *(F.round(n, 6).alias(n) for n in WEIGHTS))


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    tx, links = _flow(spark, sf)
    scored = _evidence(tx, G.flow_edges(links)).withColumn("risk", X.risk(WEIGHTS, BIAS))
    return scored.select("txid", F.round("risk", 4).alias("risk"), severity("risk").alias("severity"))


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    tx, links = _flow(spark, sf)
    rows = checkpoint(_evidence(tx, G.flow_edges(links)).select("txid", *WEIGHTS))
    means = F.broadcast(rows.agg(*(F.avg(n).alias(f"mean_{n}") for n in WEIGHTS)))
    both = rows.crossJoin(means)
    return both.withColumns(X.shap(WEIGHTS, {n: F.col(f"mean_{n}") for n in WEIGHTS}))


def shap_values(spark: SparkSession, sf: str) -> DataFrame:
    return _explained(spark, sf).select("txid", *(F.round(f"shap_{n}", 6).alias(f"shap_{n}") for n in WEIGHTS))


SHAP_SQL = f"WITH {_EV_SQL}, mean AS (SELECT {', '.join(f'avg({n}) AS mean_{n}' for n in WEIGHTS)} FROM ev) SELECT txid, {', '.join(f'round({w}::DOUBLE * ({n} - mean_{n}), 6) AS shap_{n}' for n, w in WEIGHTS.items())} FROM ev, mean"


def explained_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Every transaction's three strongest factors, one row each."""
    top = _explained(spark, sf).select("txid", F.posexplode(X.factors(list(WEIGHTS), 3)).alias("place", "f"))
    return top.select("txid", "place", "f.key", "f.label", "f.value", "f.shap", "f.share_pct")


def _said(n: str) -> str:
    there, absent = X.EVIDENCE[n]
    return f"CASE WHEN {n} < 0.5 THEN '{absent}' ELSE '{there}' END" if absent else f"'{there}'"


FACTORS_SQL = f"""WITH {_EV_SQL}, mean AS (SELECT {', '.join(f'avg({n}) AS mean_{n}' for n in WEIGHTS)} FROM ev),
u AS (SELECT txid, unnest([{', '.join(f"{{'key': '{n}', 'label': {_said(n)}, 'v': {n}, 's': {w}::DOUBLE * ({n} - mean_{n})}}" for n, w in WEIGHTS.items())}]) AS f FROM ev, mean),
t AS (SELECT txid, f.key AS key, f.label AS label, round(f.v, 4) AS value, round(f.s, 4) AS shap, f.s AS s, sum(greatest(f.s, 0)) OVER (PARTITION BY txid) AS rising FROM u)
SELECT txid, place::INT AS place, key, label, value, shap, share_pct FROM (SELECT *, round(100.0::DOUBLE * greatest(s, 0) / CASE WHEN rising = 0 THEN 1 ELSE rising END, 1) AS share_pct,
row_number() OVER (PARTITION BY txid ORDER BY abs(shap) DESC, key) - 1 AS place FROM t) WHERE place < 3"""


def _cases(spark: SparkSession, sf: str):
    tx, links = _flow(spark, sf)
    edges = G.flow_edges(links)
    scored = checkpoint(
        _evidence(tx, edges).withColumn("risk", X.risk(WEIGHTS, BIAS)).select(
            "txid", "ts", "risk", F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x).alias("inflow"), F.size("output_addresses").alias("n_out"), F.array_min("output_amounts").alias("least_out"), "coinjoin", "peel_hops", "origin_category",
        )
    )
    return tx, links, scored, checkpoint(C.members(scored, edges))


def cases(spark: SparkSession, sf: str) -> DataFrame:
    _, links, scored, member = _cases(spark, sf)
    return C.case_table(member, scored, links)


_CASE_SQL = f"""{_EV_SQL},
fl AS (SELECT txid FROM scored WHERE risk >= 40),
br AS (SELECT txid FROM scored WHERE risk < 40 AND txid IN (SELECT child FROM edges WHERE parent IN (SELECT txid FROM fl)) AND txid IN (SELECT parent FROM edges WHERE child IN (SELECT txid FROM fl))),
mem AS (SELECT txid, true AS core FROM fl UNION ALL SELECT txid, false FROM br),
me AS (SELECT parent AS a, child AS b FROM edges WHERE parent IN (SELECT txid FROM mem) AND child IN (SELECT txid FROM mem)),
sym AS (SELECT a, b FROM me UNION SELECT b, a FROM me UNION SELECT txid, txid FROM mem), {_CC.format(name='cc', edges='sym')},
m AS (SELECT mem.txid, core, root AS case_root FROM mem JOIN cc ON cc.n = mem.txid),
cflow AS (SELECT p.case_root, parent, child, round(sum(amount), 8) AS amount FROM links JOIN m p ON p.txid = parent JOIN m c ON c.txid = child WHERE p.case_root = c.case_root GROUP BY ALL),
r AS (SELECT m.*, s.* EXCLUDE (txid), s.txid % 6 AS peel_hops, coalesce(np.n, 0) AS n_parents, coalesce(nc.n, 0) AS n_children FROM m JOIN scored s ON s.txid = m.txid
  LEFT JOIN (SELECT child, count(*) AS n FROM cflow GROUP BY child) np ON np.child = m.txid LEFT JOIN (SELECT parent, count(*) AS n FROM cflow GROUP BY parent) nc ON nc.parent = m.txid),
agg AS (SELECT case_root, max(risk) FILTER (core) AS peak, avg(risk) FILTER (core) AS mean, count(*) AS tx_count, count(*) FILTER (NOT core) AS bridges,
  coalesce(sum(CASE WHEN n_parents = 0 THEN total_in::DECIMAL(28, 8) END)::DOUBLE, 0.0::DOUBLE) AS inflow, min(ts) AS first_ts, max(ts) AS last_ts, max(peel_hops)::INT AS peel_hops,
  coalesce(sum(CASE WHEN peel_hops >= 3 THEN least_out::DECIMAL(28, 8) END)::DOUBLE, 0.0::DOUBLE) AS peeled, bool_or(coinjoin >= 0.5) AS mix, bool_or(n_children >= 4 AND coinjoin < 0.5) AS fan, bool_or(n_parents >= 2 AND n_out = 1) AS sweep FROM r GROUP BY case_root),
tagged AS (SELECT *, list_filter([CASE WHEN mix THEN 'CoinJoin mixing' END, CASE WHEN peel_hops >= 3 THEN 'Peeling chain' END, CASE WHEN fan THEN 'Fan-out / fan-in structuring' END, CASE WHEN sweep AND NOT fan THEN 'Consolidation sweep' END], lambda x: x IS NOT NULL) AS tags FROM agg),
cases AS (SELECT case_root, round(peak, 1) AS risk_score, round(mean, 1) AS mean_risk, {severity_sql('peak')} AS severity, CASE WHEN len(tags) = 0 THEN 'Anomalous flow' ELSE array_to_string(tags, ' + ') END AS typology, tx_count, bridges, round(inflow, 8) AS inflow, peel_hops, round(peeled, 8) AS peeled, first_ts, last_ts,
  CASE WHEN d < 60 THEN printf('%d s', d) WHEN d < 3600 THEN printf('%d min %d s', d // 60, d % 60) ELSE printf('%d h %d min', d // 3600, d % 3600 // 60) END AS duration FROM (SELECT *, round_even(last_ts - first_ts, 0)::BIGINT AS d FROM tagged)),
named AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, inflow DESC, first_ts, case_root) AS k FROM cases)"""
CASES_SQL = f"WITH {_CASE_SQL} SELECT * EXCLUDE (k), 'CASE-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS case_id FROM named"


def case_flow(spark: SparkSession, sf: str) -> DataFrame:
    _, links, _, member = _cases(spark, sf)
    return C.case_flow(member, links)


def case_terminals(spark: SparkSession, sf: str) -> DataFrame:
    tx, links, _, member = _cases(spark, sf)
    return C.terminals(member, G.outputs(tx), links)


_TERMINALS_SQL = """o AS (SELECT outs.txid, address, sum(amount) AS amount, case_root FROM outs JOIN m ON m.txid = outs.txid GROUP BY ALL),
sp AS (SELECT DISTINCT parent, address, child, m.case_root AS spender_root FROM links LEFT JOIN m ON m.txid = child),
t AS (SELECT o.case_root, o.txid, o.address, o.amount, CASE WHEN child IS NULL THEN 'unspent at end of capture' ELSE 'spent outside this case' END AS status
  FROM o LEFT JOIN sp ON sp.parent = o.txid AND sp.address = o.address WHERE spender_root IS NULL OR spender_root <> o.case_root),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_root ORDER BY amount DESC, txid, address) AS place, count(*) OVER (PARTITION BY case_root) AS terminal_outputs FROM t)"""
TERMINALS_SQL = f"WITH {_CASE_SQL}, {_TERMINALS_SQL} SELECT case_root, txid, address, round(amount, 8) AS amount, status, place::INT AS place, terminal_outputs FROM placed WHERE place <= 6"


def case_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Per case and origin category: transactions and mean of the origin's confidence (dealt by transaction number)."""
    _, _, scored, member = _cases(spark, sf)
    rows = member.join(scored, "txid").withColumn("confidence", (F.col("txid") * 29 % 83) / 83.0)
    per = rows.groupBy("case_root", "origin_category").agg(F.count("*").alias("transactions"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    return per.withColumn("resolved", F.col("mean_confidence") >= 0.5)


ORIGINS_SQL = f"""WITH {_CASE_SQL} SELECT case_root, ['{"', '".join(CATEGORIES)}'][(txid * 11 % 7) + 1] AS origin_category, count(*) AS transactions,
round(avg((txid * 29 % 83) / 83.0::DOUBLE), 3) AS mean_confidence, round(avg((txid * 29 % 83) / 83.0::DOUBLE), 3) >= 0.5 AS resolved FROM m GROUP BY 1, 2"""


def typologies(spark: SparkSession, sf: str) -> DataFrame:
    return C.typologies(cases(spark, sf))


TYPOLOGIES_SQL = f"WITH {_CASE_SQL}, u AS (SELECT *, unnest(string_split(typology, ' + ')) AS tag FROM named) SELECT tag, count(*) AS cases, sum(tx_count)::BIGINT AS transactions, sum(inflow::DECIMAL(28, 8))::DOUBLE AS inflow FROM u GROUP BY tag"


def _located(tx: DataFrame) -> DataFrame:
    """Origins dealt by transaction number, as _evidence deals categories."""
    k = F.col("txid")
    category = F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (k * 11 % len(CATEGORIES) + 1).cast("int"))
    rows = tx.select("txid", F.concat(F.lit("ip-"), (k % 91).cast("string")).alias("origin_ip"), F.lit("XX").alias("country"), F.lit("AS1").alias("asn"), F.lit("org").alias("org"), category.alias("category"), (k * 29 % 83 / 83.0).alias("confidence"))
    return rows.withColumn("category_label", category_label("category"))


def _told(spark: SparkSession, sf: str) -> DataFrame:
    tx, links, scored, member = _cases(spark, sf)
    outs = C.terminals(member, G.outputs(tx), links)
    parts = {
        "origins": (C.origins(member, _located(tx)), [~F.col("resolved"), -F.col("transactions"), F.col("ip")], ["ip", "transactions", "country", "asn", "category", "category_label", "mean_confidence", "resolved"]),
        "terminal_outputs": (outs, [F.col("place")], ["address", "amount", "status"]),
    }
    return C.documents(checkpoint(C.case_table(member, scored, links)), member, parts)


def case_narratives(spark: SparkSession, sf: str) -> DataFrame:
    """Every case's sentences: its flow, its typologies, its origins and its largest onward output."""
    return _told(spark, sf).select("case_id", C.narrative().alias("narrative"))


def case_origin_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Per case and first announcer: transactions, network and mean confidence."""
    tx, _, _, member = _cases(spark, sf)
    return C.origins(member, _located(tx))


def case_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Every case's factors, strongest first: means of signals and contributions over its flagged transactions."""
    tx, links = _flow(spark, sf)
    edges = G.flow_edges(links)
    rows = checkpoint(_evidence(tx, edges).withColumn("risk", X.risk(WEIGHTS, BIAS)).select("txid", "risk", *WEIGHTS))
    core = C.members(rows, edges).filter("core").join(rows, "txid")
    means = F.broadcast(rows.agg(*(F.avg(n).alias(f"mean_{n}") for n in WEIGHTS)))
    per = core.groupBy("case_root").agg(*(F.avg(n).alias(n) for n in WEIGHTS)).crossJoin(means).withColumns(X.shap(WEIGHTS, {n: F.col(f"mean_{n}") for n in WEIGHTS}))
    each = per.select("case_root", F.posexplode(X.factors(list(WEIGHTS))).alias("place", "f"))
    return each.select("case_root", "place", "f.key", "f.label", "f.value", "f.shap")


CASE_FACTORS_SQL = f"""WITH {_CASE_SQL}, mean AS (SELECT {', '.join(f'avg({n}) AS mean_{n}' for n in WEIGHTS)} FROM ev),
pc AS (SELECT case_root, {', '.join(f'avg({n}) AS {n}' for n in WEIGHTS)} FROM m JOIN ev ON ev.txid = m.txid WHERE core GROUP BY case_root),
u AS (SELECT case_root, unnest([{', '.join(f"{{'key': '{n}', 'label': {_said(n)}, 'v': {n}, 's': {w}::DOUBLE * ({n} - mean_{n})}}" for n, w in WEIGHTS.items())}]) AS f FROM pc, mean)
SELECT case_root, (row_number() OVER (PARTITION BY case_root ORDER BY abs(round(f.s, 4)) DESC, f.key) - 1)::INT AS place, f.key AS key, f.label AS label, round(f.v, 4) AS value, round(f.s, 4) AS shap FROM u"""

# What the sentences and labels have to be, written out here and not taken from the operators.
_ORIGINS_SQL = f"""og AS (SELECT case_root, 'ip-' || (m.txid % 91) AS ip, ['{"', '".join(CATEGORIES)}'][(m.txid * 11 % 7) + 1] AS category, (m.txid * 29 % 83) / 83.0::DOUBLE AS confidence FROM m),
oi AS (SELECT case_root, ip, count(*) AS transactions, min(category) AS category, min(CASE category WHEN 'tor_exit' THEN 'Tor exit relay' WHEN 'vpn' THEN 'Commercial VPN' WHEN 'hosting' THEN 'Datacentre / hosting'
  WHEN 'exchange' THEN 'Exchange infrastructure' WHEN 'residential' THEN 'Residential ISP' WHEN 'mobile' THEN 'Mobile carrier' WHEN 'unresolved' THEN 'Origin unresolved' END) AS category_label,
  round(avg(confidence), 3) AS mean_confidence, round(avg(confidence), 3) >= 0.5 AS resolved FROM og GROUP BY case_root, ip)"""
ADDRESSES_SQL = f"WITH {_CASE_SQL}, {_ORIGINS_SQL} SELECT case_root, ip, transactions, 'XX' AS country, 'AS1' AS asn, 'org' AS org, category, category_label, mean_confidence, resolved FROM oi"
NARRATIVES_SQL = f"""WITH {_CASE_SQL}, {_ORIGINS_SQL}, {_TERMINALS_SQL},
good AS (SELECT case_root, count(*) AS n, arg_min({{'ip': ip, 'label': category_label, 'mean': mean_confidence}}, (-transactions, ip)) AS top, bool_or(category = 'tor_exit') AS tor FROM oi WHERE resolved GROUP BY case_root),
lost AS (SELECT case_root, sum(transactions)::BIGINT AS n FROM oi WHERE NOT resolved GROUP BY case_root),
onward AS (SELECT * FROM placed WHERE place = 1)
SELECT 'CASE-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS case_id,
concat_ws(' ', printf('%d linked transaction%s carrying %.4f BTC over %s.', tx_count, CASE WHEN tx_count = 1 THEN '' ELSE 's' END, inflow, duration),
CASE WHEN typology LIKE '%CoinJoin%' THEN 'An equal-output mixing round breaks the link between senders and receivers.' END,
CASE WHEN typology LIKE '%Peeling%' THEN printf('A %d-hop peeling chain splits off %.4f BTC in small outputs while forwarding the remainder each hop.', peel_hops, peeled) END,
CASE WHEN typology LIKE '%Fan-out%' THEN 'Funds are fanned out into near-equal parts, moved one hop each and re-aggregated.' END,
CASE WHEN typology LIKE '%Consolidation%' THEN 'Outputs from earlier hops are swept together into a single address.' END,
CASE WHEN good.n > 0 THEN printf('The origin was resolved to %d IP address%s; most frequent is %s (%s, XX, AS1) with mean attribution confidence %.2f.', good.n, CASE WHEN good.n = 1 THEN '' ELSE 'es' END, top.ip, top.label, top.mean) END,
CASE WHEN good.tor THEN 'A Tor exit identifies the relay, not the sender.' END,
CASE WHEN lost.n > 0 THEN printf('For %d transaction%s the origin could not be resolved: only relays were seen announcing.', lost.n, CASE WHEN lost.n = 1 THEN '' ELSE 's' END) END,
CASE WHEN onward.amount IS NOT NULL THEN printf('Largest onward output: %.4f BTC at %s (%s).', round(onward.amount, 8), onward.address::VARCHAR, onward.status) END) AS narrative
FROM named LEFT JOIN good USING (case_root) LEFT JOIN lost USING (case_root) LEFT JOIN onward USING (case_root)"""

QUERIES = {
    "spend_links": spend_links, "flow_edges": flow_edges, "hetero_graph_counts": hetero_graph_counts, "respend_delays": respend_delays, "tx_degrees": tx_degrees, "peel_shaped": peel_shaped,
    "peel_chains": peel_chains, "coinjoin_score": coinjoin_score, "entity_clusters": entity_clusters, "tx_features": tx_features, "evidence_matrix": evidence_matrix, "risk_score": risk_score,
    "shap_values": shap_values, "explained_factors": explained_factors, "cases": cases, "case_flow": case_flow, "case_terminals": case_terminals, "case_origins": case_origins, "typologies": typologies,
    "case_narratives": case_narratives, "case_origin_addresses": case_origin_addresses, "case_factors": case_factors,
}
ORACLE_SQL = {
    "spend_links": f"WITH {V.IO_SQL}, {V.LINKS_SQL} SELECT * FROM links", "flow_edges": f"WITH {V.IO_SQL}, {V.LINKS_SQL} SELECT * FROM edges", "hetero_graph_counts": HETERO_SQL,
    "respend_delays": f"WITH {_BASE_SQL} SELECT * FROM delays",
    "tx_degrees": f"WITH {V.IO_SQL}, {V.LINKS_SQL} SELECT txid, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT child AS txid, 1 AS i, 0 AS o FROM edges UNION ALL SELECT parent, 0, 1 FROM edges) GROUP BY txid",
    "peel_shaped": PEEL_SQL, "peel_chains": CHAINS_SQL, "coinjoin_score": COINJOIN_SQL, "entity_clusters": ENTITY_SQL, "tx_features": FEATURES_SQL,
    "evidence_matrix": f"WITH {_EV_SQL} SELECT txid, {', '.join(f'round({n}, 6) AS {n}' for n in WEIGHTS)} FROM ev",
    "risk_score": f"WITH {_EV_SQL} SELECT txid, round(risk, 4) AS risk, {severity_sql('risk')} AS severity FROM scored",
    "shap_values": SHAP_SQL, "explained_factors": FACTORS_SQL, "case_narratives": NARRATIVES_SQL, "case_origin_addresses": ADDRESSES_SQL, "case_factors": CASE_FACTORS_SQL, "cases": CASES_SQL, "case_flow": f"WITH {_CASE_SQL} SELECT * FROM cflow", "case_terminals": TERMINALS_SQL, "case_origins": ORIGINS_SQL, "typologies": TYPOLOGIES_SQL,
}
