"""V_OPS, operations laid over the orders, and queries that run the analysis on them from announcements to cases.

A customer's orders, numbered by date, are a customer's transactions, a minute or so apart. By the customer's remainder they are
a peeling chain, a mix whose outputs are moved and swept together, a fan that is moved and gathered again, or plain payments.
The customer announces an order to three sensors and a relay follows; of every eleventh order only the relay is heard. So
chains, mixes, fans, sweeps, bursts, unresolved origins and flagged rows of every severity follow from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.functions.expressions import severity, severity_sql
from txintel.operators import cases as C
from txintel.operators import features as X
from txintel.operators import lookups as K
from txintel.plans import captures as V
from txintel.plans import ledger as L
from txintel.plans import network as N
from txintel.plans import whole as W
from txintel.plans.analysis import Settings, analyse, evidence, prepare
from txintel.plans.ledger import WEIGHTS
from txintel.runtime import checkpoint, table
from txintel.sources.files import Capture

#: Bias of the stand-in fusion on these data; without a network and a forest, it alone sets how many are flagged.
BIAS = -1.9
KINDS, SILENT, RELAYS, RELAY = 6, 11, 37, 10_000_000
#: What operation_search asks for: part of addresses, of networks' names and of transactions' numbers.
WANTED = "12"

OPS_SQL = f"""ord AS (SELECT o_orderkey AS txid, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
sides AS (SELECT txid, c, k, c * 7200.0::DOUBLE + k * 60 + txid % 50 AS t0,
  CASE WHEN c % {KINDS} = 0 THEN [{{'a': 'w' || c || ':' || k, 'v': (1000 - k) / 10.0::DOUBLE}}]
    WHEN c % {KINDS} = 1 AND k = 1 THEN list_transform([1, 2, 3, 4], lambda i: {{'a': 'm' || c || ':' || i, 'v': 10.0::DOUBLE}})
    WHEN c % {KINDS} = 1 AND k <= 5 THEN [{{'a': 'x' || c || ':' || (k - 1), 'v': 9.9::DOUBLE}}]
    WHEN c % {KINDS} = 1 AND k = 6 THEN list_transform([2, 3, 4, 5], lambda i: {{'a': 'y' || c || ':' || i, 'v': 9.8::DOUBLE}})
    WHEN c % {KINDS} = 2 AND k = 1 THEN [{{'a': 'f' || c || ':0', 'v': 50.0::DOUBLE}}]
    WHEN c % {KINDS} = 2 AND k <= 6 THEN [{{'a': 'f' || c || ':' || (k - 1), 'v': (89 + k) / 10.0::DOUBLE}}]
    WHEN c % {KINDS} = 2 AND k = 7 THEN list_transform([2, 3, 4, 5, 6], lambda i: {{'a': 'g' || c || ':' || i, 'v': 8.9::DOUBLE}})
    ELSE [{{'a': 'a' || c || ':' || k, 'v': 5.0::DOUBLE}}] END AS i,
  CASE WHEN c % {KINDS} = 0 THEN [{{'a': 'w' || c || ':' || (k + 1), 'v': (999 - k) / 10.0::DOUBLE}}, {{'a': 'p' || c || ':' || k, 'v': 0.1::DOUBLE}}]
    WHEN c % {KINDS} = 1 AND k = 1 THEN list_transform([1, 2, 3, 4], lambda i: {{'a': 'x' || c || ':' || i, 'v': 9.9::DOUBLE}})
    WHEN c % {KINDS} = 1 AND k <= 5 THEN [{{'a': 'y' || c || ':' || k, 'v': 9.8::DOUBLE}}]
    WHEN c % {KINDS} = 1 AND k = 6 THEN [{{'a': 'z' || c, 'v': 39.0::DOUBLE}}]
    WHEN c % {KINDS} = 2 AND k = 1 THEN list_transform([1, 2, 3, 4, 5], lambda i: {{'a': 'f' || c || ':' || i, 'v': (90 + i) / 10.0::DOUBLE}})
    WHEN c % {KINDS} = 2 AND k <= 6 THEN [{{'a': 'g' || c || ':' || k, 'v': 8.9::DOUBLE}}]
    WHEN c % {KINDS} = 2 AND k = 7 THEN [{{'a': 'h' || c, 'v': 44.0::DOUBLE}}]
    ELSE [{{'a': 'b' || c || ':' || k, 'v': 3.0::DOUBLE}}, {{'a': 'd' || c || ':' || k, 'v': 1.9::DOUBLE}}] END AS o FROM ord)"""
OBS_SQL = f"""{OPS_SQL},
obs AS (SELECT txid, t0 + 0.05::DOUBLE * s AS timestamp, c AS src_ip, s AS dst_ip, 0 AS l_partkey, s AS l_linenumber FROM sides, (VALUES (0), (1), (2)) v(s) WHERE txid % {SILENT} <> 0
  UNION ALL SELECT txid, t0 + 0.4::DOUBLE + 0.1::DOUBLE * s, {RELAY} + txid % {RELAYS}, s, 0, s FROM sides, (VALUES (0), (1)) v(s))"""
IO_SQL = """ins AS (SELECT sides.txid, first_ts AS ts, unnest(i).a AS address, unnest(i).v AS amount, generate_subscripts(i, 1) - 1 AS pos FROM sides JOIN first ON first.txid = sides.txid),
outs AS (SELECT sides.txid, first_ts AS ts, unnest(o).a AS address, unnest(o).v AS amount, generate_subscripts(o, 1) - 1 AS pos FROM sides JOIN first ON first.txid = sides.txid),
tx AS (SELECT sides.txid, first_ts AS ts, len(i) AS n_in, list_sum(list_transform(i, lambda x: x.v)) AS total_in, len(o) AS n_out, list_min(list_transform(o, lambda x: x.v)) AS least_out, list_max(list_transform(o, lambda x: x.v)) AS most_out FROM sides JOIN first ON first.txid = sides.txid)"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = o.select(F.col("o_orderkey").alias("txid"), F.col("o_custkey").alias("c"), k.alias("k"))
    return rows.withColumn("at", F.col("c") * 7200.0 + F.col("k") * 60 + F.col("txid") % 50)


def ledger(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """V_OPS's transactions. rows: _orders, if there."""
    c, k = F.col("c"), F.col("k")
    name = lambda p, i: F.concat(F.lit(p), c.cast("string"), F.lit(":"), (i if isinstance(i, Column) else F.lit(i)).cast("string"))
    one = lambda p, i, v: F.struct(name(p, i).alias("a"), (v if isinstance(v, Column) else F.lit(v)).alias("v"))
    bare = lambda p, v: F.array(F.struct(F.concat(F.lit(p), c.cast("string")).alias("a"), F.lit(v).alias("v")))
    several = lambda p, ids, v: F.array(*(one(p, i, v(i)) for i in ids))
    kind = c % KINDS

    def by(peel: Column, mix: tuple[Column, ...], fan: tuple[Column, ...], plain: Column) -> Column:
        """The side of a transaction, by the customer's kind and the order's number; mix and fan: first, moved, gathered."""
        out = F.when(kind == 0, peel)
        for n, last, (first, moved, gathered) in ((1, 6, mix), (2, 7, fan)):
            out = out.when((kind == n) & (k == 1), first).when((kind == n) & (k < last), moved).when((kind == n) & (k == last), gathered)
        return out.otherwise(plain)

    ins = by(
        F.array(one("w", k, (1000 - k) / 10.0)), (several("m", (1, 2, 3, 4), lambda i: 10.0), F.array(one("x", k - 1, 9.9)), several("y", (2, 3, 4, 5), lambda i: 9.8)),
        (F.array(one("f", 0, 50.0)), F.array(one("f", k - 1, (89 + k) / 10.0)), several("g", (2, 3, 4, 5, 6), lambda i: 8.9)), F.array(one("a", k, 5.0)),
    )
    outs = by(
        F.array(one("w", k + 1, (999 - k) / 10.0), one("p", k, 0.1)), (several("x", (1, 2, 3, 4), lambda i: 9.9), F.array(one("y", k, 9.8)), bare("z", 39.0)),
        (several("f", (1, 2, 3, 4, 5), lambda i: (90 + i) / 10.0), F.array(one("g", k, 8.9)), bare("h", 44.0)), F.array(one("b", k, 3.0), one("d", k, 1.9)),
    )
    return (rows if rows is not None else _orders(spark, sf)).withColumns({"i": ins, "o": outs}).select("txid", F.col("at").alias("ts"), F.lit(0.0).alias("fee"), *(F.col(s)[f].alias(f"{n}_{w}") for s, n in (("i", "input"), ("o", "output")) for f, w in (("a", "addresses"), ("v", "amounts"))))


def observations(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """V_OPS's announcements. rows: _orders, if there."""
    rows = rows if rows is not None else checkpoint(_orders(spark, sf))
    heard = lambda sensors: rows.withColumn("s", F.explode(F.array(*map(F.lit, range(sensors)))))
    own = heard(3).filter(F.col("txid") % SILENT != 0).select("txid", (F.col("at") + 0.05 * F.col("s")).alias("timestamp"), F.col("c").alias("src_ip"), F.col("s").alias("dst_ip"))
    relayed = heard(2).select("txid", (F.col("at") + 0.4 + 0.1 * F.col("s")).alias("timestamp"), (F.lit(RELAY) + F.col("txid") % RELAYS).alias("src_ip"), F.col("s").alias("dst_ip"))
    return own.unionByName(relayed).withColumn("seq", F.struct("src_ip", "dst_ip"))


def capture(spark: SparkSession, sf: str) -> Capture:
    rows = checkpoint(_orders(spark, sf))
    return Capture(observations(spark, sf, rows), ledger(spark, sf, rows), spark.createDataFrame([], "file string, sha256 string, records bigint"), columnar=True)


def operation_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every operation's computed evidence and risk; a forest and a network, which SQL can't say, are 0."""
    rows = evidence(prepare(spark, capture(spark, sf), locate=W._located()), anomaly=False).withColumn("risk", X.risk(WEIGHTS, BIAS))
    return rows.select("txid", "origin_ip", "confidence", "resolved", "origin_category", "peel_hops", "burst", *(F.round(n, 6).alias(n) for n in WEIGHTS), F.round("risk", 4).alias("risk"), severity("risk").alias("severity"))


def _analysis(spark: SparkSession, sf: str):
    return analyse(spark, capture(spark, sf), Settings(bias=BIAS), anomaly=False, locate=W._located())


def operation_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked cases of the whole analysis."""
    return _analysis(spark, sf)["case_table"]


def operation_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of those cases: sizes of their parts and their narratives."""
    size = lambda p: F.size(p).cast("bigint").alias(f"n_{p}") if p in C.BOUNDED else f"n_{p}"
    parts = ("origins", "terminal_outputs", "factors", "transactions", "edges")
    return _analysis(spark, sf)["case_sizes"].select("case_id", "case_root", "typology", "severity", "tx_count", *map(size, parts), "narrative")


def operation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The analysis's counters, those of entities, chains, flagged rows and cases too."""
    return _analysis(spark, sf)["stats"]


def operation_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level of every transaction in its case's flow."""
    p = prepare(spark, capture(spark, sf), locate=W._located())
    member = checkpoint(C.members(checkpoint(evidence(p, anomaly=False).withColumn("risk", X.risk(WEIGHTS, BIAS)).select("txid", "risk")), p.edges))
    return K.levels(member, C.case_flow(member, p.links))


def operation_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The figures at the head of a report."""
    r = _analysis(spark, sf)
    return K.overview(r["stats"], r["case_table"])


def operation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cases and what flowed into them, by severity and in all."""
    return K.case_counts(_analysis(spark, sf)["case_table"])


def operation_top(spark: SparkSession, sf: str) -> DataFrame:
    return K.top_cases(_analysis(spark, sf)["case_table"]).select("case_id", "case_root", "risk_score", "severity", "typology", "inflow")


def operation_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 newest transactions of cases, each with what its case is."""
    r = _analysis(spark, sf)
    named = r["members"].join(r["case_table"].select("case_root", "case_id"), "case_root").join(r["transactions"].select("txid", "ts", "risk"), "txid")
    feed = K.newest(named.select(F.col("ts").alias("t"), F.col("txid").alias("id"), F.round("risk", 1).alias("r"), "case_id"))
    return K.alerts_with_cases(feed, r["case_table"])


def operation_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of the two upper severities that hold a text in any of their fields."""
    r = _analysis(spark, sf)
    return K.search_parts(r["case_table"], r.parts(), WANTED, ("CRITICAL", "HIGH")).select("case_id", "case_root", "severity")


_EV_SQL = W.EVIDENCE_SQL[: W.EVIDENCE_SQL.index("\nscored AS")].replace(V.OBS_SQL, OBS_SQL).replace(W._IO_SQL, IO_SQL).rstrip(",")
_RISK_SQL = f"100.0::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({BIAS}::DOUBLE {' '.join(f'+ {n} * {w}::DOUBLE' for n, w in WEIGHTS.items())}, 60.0), -60.0))))"
_SCORED_SQL = f"{_EV_SQL},\nscored AS (SELECT ev.*, ts, total_in, n_out, least_out, {_RISK_SQL} AS risk FROM ev JOIN tx ON tx.txid = ev.txid)"
EVIDENCE_SQL = f"{_SCORED_SQL} SELECT txid, origin_ip, confidence, resolved, origin_category, peel_hops, burst, {', '.join(f'round({n}, 6) AS {n}' for n in WEIGHTS)}, round(risk, 4) AS risk, {severity_sql('risk')} AS severity FROM scored"
_CASE_SQL = _SCORED_SQL + ",\n" + L._CASE_SQL[L._CASE_SQL.index("\nfl AS") + 1 :].replace("s.txid % 6 AS peel_hops, ", "")
_ID_SQL = "'CASE-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS case_id"
CASES_SQL = f"{_CASE_SQL} SELECT * EXCLUDE (k), {_ID_SQL} FROM named"
_TOLD_SQL = f"""{_CASE_SQL},
og AS (SELECT case_root, loc.origin_ip AS ip, coalesce(h.country, 'UNKNOWN') AS country, coalesce(h.asn, 'UNKNOWN') AS asn, coalesce(h.category, 'unknown') AS category, loc.confidence
  FROM m JOIN loc ON loc.txid = m.txid LEFT JOIN (SELECT hits.origin_ip, nets.country, nets.asn, nets.category FROM hits JOIN num nets ON nets.cidr = hits.cidr WHERE k = 1) h ON h.origin_ip = loc.origin_ip),
oi AS (SELECT case_root, ip, count(*) AS transactions, min(country) AS country, min(asn) AS asn, min(category) AS category, min({N._LABELS_SQL}) AS category_label, round(avg(confidence), 3) AS mean_confidence, round(avg(confidence), 3) >= 0.5 AS resolved FROM og GROUP BY case_root, ip),
{L._TERMINALS_SQL},"""
DOCUMENTS_SQL = (
    _TOLD_SQL.replace("SELECT origin_ip, category, row_number() OVER (PARTITION BY origin_ip ORDER BY prefix DESC) AS k FROM ips", "SELECT origin_ip, category, cidr, row_number() OVER (PARTITION BY origin_ip ORDER BY prefix DESC) AS k FROM ips")
    + L.NARRATIVES_SQL[L.NARRATIVES_SQL.index("\ngood AS") :]
    .replace("arg_min({'ip': ip, 'label': category_label, 'mean': mean_confidence}", "arg_min({'ip': ip, 'label': category_label, 'country': country, 'asn': asn, 'mean': mean_confidence}")
    .replace("most frequent is %s (%s, XX, AS1) with", "most frequent is %s (%s, %s, %s) with").replace("top.ip, top.label, top.mean)", "top.ip::VARCHAR, top.label, top.country, top.asn, top.mean)")
    .replace("\nconcat_ws(", f"""\ncase_root, typology, severity, tx_count, (SELECT count(*) FROM oi WHERE oi.case_root = named.case_root) AS n_origins, (SELECT count(*) FROM placed WHERE placed.case_root = named.case_root AND place <= 6) AS n_terminal_outputs,
{len(WEIGHTS)}::BIGINT AS n_factors, tx_count AS n_transactions, (SELECT count(*) FROM cflow WHERE cflow.case_root = named.case_root) AS n_edges,\nconcat_ws(""")
)
STATS_SQL = f"""{_CASE_SQL},
pair AS (SELECT ins.txid, min(address) OVER (PARTITION BY ins.txid) AS a, address AS b FROM ins JOIN ev ON ev.txid = ins.txid WHERE coinjoin < 0.5),
spent AS (SELECT DISTINCT a, b FROM pair WHERE a <> b), esym AS (SELECT a, b FROM spent UNION SELECT b, a FROM spent UNION SELECT a, a FROM spent UNION SELECT b, b FROM spent), {L._CC.format(name='ec', edges='esym')},
used AS (SELECT address FROM ins UNION SELECT address FROM outs),
one AS (SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(DISTINCT origin_ip) FROM loc) AS origin_ips, (SELECT count(*) FROM used) AS wallet_addresses)
SELECT transactions, (SELECT count(*) FROM loc WHERE resolved) AS origin_attributed, (SELECT count(*) FROM loc WHERE NOT resolved) AS origin_unresolved, (SELECT count(*) FROM ev WHERE coinjoin >= 0.5) AS coinjoin_transactions,
(SELECT min(ts) FROM tx) AS capture_start, (SELECT max(ts) FROM tx) AS capture_end, transactions + (SELECT count(*) FROM ins) + (SELECT count(*) FROM outs) AS graph_edges, origin_ips, (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT txid) FROM obs) AS observed_txids,
0::BIGINT AS unobserved_transactions, 0::BIGINT AS uncorrelated_observations, wallet_addresses, (SELECT count(*) FROM edges) AS flow_edges, (SELECT count(DISTINCT root) FROM ec) AS entities, (SELECT count(*) FROM lengths) AS peel_chains,
(SELECT count(*) FROM scored WHERE risk >= 40) AS flagged_transactions, (SELECT count(*) FROM named) AS cases, transactions + wallet_addresses + origin_ips AS graph_nodes FROM one"""

LEVELS_SQL = f"""{_CASE_SQL}, lw AS (WITH RECURSIVE go(txid, d) AS (SELECT txid, 0 FROM m UNION SELECT child, d + 1 FROM go JOIN cflow ON parent = go.txid) SELECT * FROM go)
SELECT m.case_root, m.txid, max(d)::BIGINT AS depth FROM m JOIN lw ON lw.txid = m.txid GROUP BY 1, 2"""
OVERVIEW_SQL = f"""WITH st AS ({STATS_SQL}), cs AS ({CASES_SQL}) SELECT observations, transactions, CASE WHEN transactions > 0 THEN round(100.0::DOUBLE * origin_attributed / transactions) ELSE 0 END::BIGINT AS resolved_pct, entities, flagged_transactions, cases,
(SELECT count(*) FROM cs WHERE severity = 'CRITICAL') AS critical_cases, (SELECT count(*) FROM cs WHERE severity = 'HIGH') AS high_cases, (SELECT count(*) FROM cs WHERE severity = 'MEDIUM') AS medium_cases, (SELECT coalesce(sum(inflow::DECIMAL(28, 8)), 0)::DOUBLE FROM cs) AS inflow FROM st"""
COUNTS_SQL = f"""WITH cs AS ({CASES_SQL}) SELECT v.severity, count(cs.case_id) AS cases, coalesce(sum(cs.inflow::DECIMAL(28, 8)), 0)::DOUBLE AS inflow
FROM (VALUES ('ALL'), ('CRITICAL'), ('HIGH'), ('MEDIUM')) v(severity) LEFT JOIN cs ON v.severity = 'ALL' OR v.severity = cs.severity GROUP BY v.severity"""
TOP_SQL = f"SELECT case_id, case_root, risk_score, severity, typology, inflow FROM ({CASES_SQL}) ORDER BY risk_score DESC, inflow DESC, first_ts, case_root LIMIT 6"
FEED_SQL = f"""{_CASE_SQL} SELECT r.ts AS t, r.txid AS id, round(r.risk, 1) AS r, {_ID_SQL}, typology, risk_score, severity FROM r JOIN named ON named.case_root = r.case_root ORDER BY r.ts DESC, r.txid DESC LIMIT 40"""
SEARCH_SQL = f"""{DOCUMENTS_SQL[: DOCUMENTS_SQL.index("good AS")]}
hay AS (SELECT case_root, lower(concat_ws(' ', {_ID_SQL.removesuffix(' AS case_id')}, typology, (SELECT string_agg(concat_ws(' ', ip::VARCHAR, asn, category_label), ' ') FROM oi WHERE oi.case_root = named.case_root), (SELECT string_agg(m.txid::VARCHAR, ' ') FROM m WHERE m.case_root = named.case_root),
  (SELECT string_agg(address, ' ') FROM placed WHERE placed.case_root = named.case_root AND place <= 6))) AS h FROM named)
SELECT {_ID_SQL}, named.case_root, severity FROM named JOIN hay ON hay.case_root = named.case_root WHERE severity IN ('CRITICAL', 'HIGH') AND h LIKE '%{WANTED}%'"""

QUERIES = {
    "operation_evidence": operation_evidence, "operation_cases": operation_cases, "operation_documents": operation_documents, "operation_stats": operation_stats, "operation_levels": operation_levels,
    "operation_overview": operation_overview, "operation_counts": operation_counts, "operation_top": operation_top, "operation_feed": operation_feed, "operation_search": operation_search,
}
ORACLE_SQL = {
    "operation_evidence": EVIDENCE_SQL, "operation_cases": CASES_SQL, "operation_documents": DOCUMENTS_SQL, "operation_stats": STATS_SQL, "operation_levels": LEVELS_SQL,
    "operation_overview": OVERVIEW_SQL, "operation_counts": COUNTS_SQL, "operation_top": TOP_SQL, "operation_feed": FEED_SQL, "operation_search": SEARCH_SQL,
}
