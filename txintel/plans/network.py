"""Queries on announcements and addresses: origins, enrichment, rollups, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.functions.expressions import list_items, severity, severity_sql, whole_number
from txintel.operators import geo, origin, reports
from txintel.operators.ordered import running
from txintel.plans import captures as V
from txintel.runtime import table


def first_seen_origin(spark: SparkSession, sf: str) -> DataFrame:
    return origin.first_seen(V.observations(spark, sf))


_FIRST_SQL = f"""{V.OBS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY timestamp, src_ip, l_linenumber, l_partkey) AS rn FROM obs),
lead1 AS (SELECT txid, src_ip AS origin_ip, timestamp AS first_ts FROM ranked WHERE rn = 1),
second AS (SELECT r.txid, r.src_ip, r.timestamp, row_number() OVER (PARTITION BY r.txid ORDER BY rn) AS k FROM ranked r JOIN lead1 f ON f.txid = r.txid WHERE r.src_ip <> f.origin_ip),
first AS (SELECT f.*, s.src_ip AS runner_up_ip, round((s.timestamp - first_ts) * 1000, 1) AS lead_ms FROM lead1 f LEFT JOIN second s ON s.txid = f.txid AND s.k = 1)"""
FIRST_SEEN_SQL = f"WITH {_FIRST_SQL} SELECT * FROM first"
_AGREE_SQL = """heard AS (SELECT r.txid, r.dst_ip, r.src_ip, row_number() OVER (PARTITION BY r.txid, r.dst_ip ORDER BY rn) AS k FROM ranked r),
agree AS (SELECT h.txid, any_value(f.origin_ip) AS origin_ip, round(avg(CASE WHEN h.src_ip = f.origin_ip THEN 1.0::DOUBLE ELSE 0.0 END), 3) AS sensor_agreement, count(*) AS sensor_count
  FROM heard h JOIN lead1 f ON f.txid = h.txid WHERE k = 1 GROUP BY h.txid),
agreed AS (SELECT a.*, n.announcer_count, n.peer_hop_count FROM agree a JOIN (SELECT txid, count(DISTINCT src_ip) AS announcer_count, count(*) AS peer_hop_count FROM obs GROUP BY txid) n ON n.txid = a.txid)"""
_RATIO_SQL = """ratio AS (SELECT a.src_ip AS origin_ip, announced, coalesce(first_announced, 0) AS first_announced, round(1 - coalesce(first_announced, 0)::DOUBLE / announced, 3) AS relay_ratio
  FROM (SELECT src_ip, count(DISTINCT txid) AS announced FROM obs GROUP BY src_ip) a LEFT JOIN (SELECT origin_ip, count(*) AS first_announced FROM lead1 GROUP BY origin_ip) f ON f.origin_ip = a.src_ip)"""
_CONF_SQL = """conf AS (SELECT f.*, sensor_agreement, sensor_count, announcer_count, peer_hop_count, relay_ratio,
  round((CASE WHEN announcer_count <= 1 THEN 0.30::DOUBLE ELSE least(0.99::DOUBLE,
    (0.10::DOUBLE + 0.45::DOUBLE * CASE WHEN lead_ms IS NULL THEN 0.0::DOUBLE ELSE 1 - exp(-greatest(lead_ms, 0.0::DOUBLE) / 250.0::DOUBLE) END
     + 0.45::DOUBLE * CASE WHEN sensor_count <= 1 THEN 0.0::DOUBLE ELSE sensor_agreement END) * (1 - 0.5::DOUBLE * relay_ratio)) END)::DECIMAL(20, 16), 3)::DOUBLE AS confidence
  FROM first f JOIN agreed a ON a.txid = f.txid JOIN ratio r ON r.origin_ip = f.origin_ip)"""


def sensor_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return origin.sensor_agreement(V.observations(spark, sf))


def relay_ratio(spark: SparkSession, sf: str) -> DataFrame:
    obs = V.observations(spark, sf)
    return origin.relay_ratio(obs, origin.first_seen(obs))


def origin_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return origin.attribute(V.observations(spark, sf))


def layer_join_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements against orders: how many match, on either side."""
    obs = V.observations(spark, sf)
    tx = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txid"))
    first = origin.first_seen(obs)
    joined = tx.join(first, "txid", "left").agg(F.count("*").alias("transactions"), F.count("origin_ip").alias("observed"), F.count(F.when(F.col("origin_ip").isNull(), 1)).alias("unobserved"))
    lone = obs.join(tx, "txid", "left_anti").agg(F.count("*").alias("uncorrelated"))
    return joined.crossJoin(lone)


LAYER_SQL = f"""WITH {V.OBS_SQL} SELECT count(*) AS transactions, count(f.txid) AS observed, count(*) FILTER (f.txid IS NULL) AS unobserved,
(SELECT count(*) FROM obs WHERE txid NOT IN (SELECT o_orderkey FROM orders)) AS uncorrelated FROM orders LEFT JOIN (SELECT DISTINCT txid FROM obs) f ON f.txid = o_orderkey"""


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return geo.enrich(V.network_events(spark, sf), geo.networks(V.network_table(spark)))


# What the labels have to be, written out here and not taken from the operators.
_LABELS_SQL = """CASE category WHEN 'tor_exit' THEN 'Tor exit relay' WHEN 'vpn' THEN 'Commercial VPN' WHEN 'hosting' THEN 'Datacentre / hosting' WHEN 'residential' THEN 'Residential ISP' WHEN 'mobile' THEN 'Mobile carrier'
WHEN 'exchange' THEN 'Exchange infrastructure' WHEN 'sensor' THEN 'Monitoring sensor' WHEN 'unknown' THEN 'Unclassified network' WHEN 'unresolved' THEN 'Origin unresolved' ELSE category END"""
_GEO_SQL = f"""{V.NET_SQL}, {V.NETS_SQL},
num AS (SELECT *, split_part(cidr, '/', 2)::INT AS prefix, list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS low FROM nets),
ips AS (SELECT DISTINCT ip, list_reduce(list_transform(string_split(ip, '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS n FROM net),
hits AS (SELECT ip, num.*, row_number() OVER (PARTITION BY ip ORDER BY prefix DESC) AS k FROM ips JOIN num ON n BETWEEN low AND low + (1::BIGINT << (32 - prefix)) - 1),
geo AS (SELECT net.*, coalesce(country, 'UNKNOWN') AS country, coalesce(asn, 'UNKNOWN') AS asn, coalesce(org, 'Unknown network') AS org, coalesce(category, 'unknown') AS category
  FROM net LEFT JOIN hits ON hits.ip = net.ip AND k = 1),
risk AS (SELECT *, round(least(100.0::DOUBLE, value * CASE category WHEN 'tor_exit' THEN 8 WHEN 'vpn' THEN 5 WHEN 'hosting' THEN 3 ELSE 1 END), 2) AS risk FROM geo)"""


def cidr_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("txid", "ip", "country", "asn", "org", "category", "category_label", "is_high_risk_network")


CIDR_SQL = f"WITH {_GEO_SQL} SELECT txid, ip, country, asn, org, category, {_LABELS_SQL} AS category_label, category IN ('tor_exit', 'vpn') AS is_high_risk_network FROM geo"


def _risky(spark: SparkSession, sf: str) -> DataFrame:
    """V_NET with a stand-in risk: the event's value, weighted by its network's category."""
    factor = F.when(F.col("category") == "tor_exit", 8).when(F.col("category") == "vpn", 5).when(F.col("category") == "hosting", 3).otherwise(1)
    return _enriched(spark, sf).withColumn("risk", F.round(F.least(F.lit(100.0), F.col("value") * factor), 2))


def origin_table(spark: SparkSession, sf: str) -> DataFrame:
    """Over V_NET, with confidences dealt by event number."""
    return reports.origin_table(_risky(spark, sf).withColumn("confidence", F.col("txid") * 29 % 83 / 83.0))


ORIGIN_TABLE_SQL = f"""WITH {_GEO_SQL} SELECT ip, country, asn, org, category, {_LABELS_SQL} AS category_label, count(*) AS transactions, count(*) FILTER (risk >= 40) AS flagged, round(max(risk), 1) AS max_risk,
round(avg((txid * 29 % 83) / 83.0::DOUBLE), 3) AS mean_confidence FROM risk GROUP BY ip, country, asn, org, category ORDER BY flagged DESC, max_risk DESC, transactions DESC, ip LIMIT 40"""


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return reports.timeline(_risky(spark, sf))


TIMELINE_SQL = f"""WITH {_GEO_SQL}, span AS (SELECT min(ts) AS t0, greatest((max(ts) - min(ts)) / 36, 1.0) AS width FROM risk),
b AS (SELECT least(floor((ts - t0) / width), 35)::INT AS bin, count(*) AS total, count(*) FILTER (risk >= 40) AS flagged FROM risk, span GROUP BY 1)
SELECT r.bin::INT AS bin, coalesce(total, 0) AS total, coalesce(flagged, 0) AS flagged FROM range(36) r(bin) LEFT JOIN b ON b.bin = r.bin"""


def networks(spark: SparkSession, sf: str) -> DataFrame:
    return reports.networks(_risky(spark, sf))


NETWORKS_SQL = f"WITH {_GEO_SQL} SELECT category, {_LABELS_SQL} AS category_label, count(*) AS total, count(*) FILTER (risk >= 40) AS flagged FROM risk GROUP BY category"


def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.severity_counts(_risky(spark, sf))


SEVERITY_SQL = f"""WITH {_GEO_SQL}, c AS (SELECT {severity_sql('risk')} AS severity, count(*) AS n FROM risk GROUP BY 1)
SELECT s.severity, coalesce(n, 0) AS transactions FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) LEFT JOIN c ON c.severity = s.severity"""


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 riskiest events, then those that are flagged."""
    return _risky(spark, sf).orderBy(F.desc("risk"), "txid").limit(25).filter("risk >= 40").select("txid", "ip", "category", "risk", severity("risk").alias("severity"))


LEADS_SQL = f"WITH {_GEO_SQL}, top AS (SELECT * FROM risk ORDER BY risk DESC, txid LIMIT 25) SELECT txid, ip, category, risk, {severity_sql('risk')} AS severity FROM top WHERE risk >= 40"


def origin_burst(spark: SparkSession, sf: str) -> DataFrame:
    return reports.origin_burst(V.network_events(spark, sf)).select("txid", "ip", "burst", F.round("origin_burst", 6).alias("origin_burst"))


BURST_SQL = f"""WITH {V.NET_SQL}, b AS (SELECT txid, ip, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) - 1 AS burst FROM net)
SELECT txid, ip, burst, round(least(1.0::DOUBLE, log2(1 + burst) / 4), 6) AS origin_burst FROM b"""


def replay_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The compact replay log, in a total order."""
    r = running(_risky(spark, sf), ["ts", "txid"], {"seq": F.lit(1).cast("bigint")})
    return r.select(F.round(F.col("ts"), 3).alias("t"), F.col("txid").alias("id"), F.col("risk").alias("r"), F.col("category").alias("n"), "ip", F.lit(1).alias("o"), "seq")


REPLAY_SQL = f"WITH {_GEO_SQL} SELECT round(ts, 3) AS t, txid AS id, risk AS r, category AS n, ip, 1 AS o, row_number() OVER (ORDER BY ts, txid) AS seq FROM risk"


def running_counters(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c: c.cast("bigint")
    totals = {"seen": one(F.lit(1)), "resolved": one(F.col("category") != "unknown"), "flagged": one(F.col("risk") >= 40)}
    return running(_risky(spark, sf), ["ts", "txid"], totals).select("txid", *totals)


RUNNING_SQL = f"""WITH {_GEO_SQL} SELECT txid, count(*) OVER w AS seen, (sum((category <> 'unknown')::INT) OVER w)::BIGINT AS resolved, (sum((risk >= 40)::INT) OVER w)::BIGINT AS flagged
FROM risk WINDOW w AS (ORDER BY ts, txid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def alert_state(spark: SparkSession, sf: str) -> DataFrame:
    return reports.alert_state(_risky(spark, sf).withColumn("case_id", F.col("category")))


ALERT_SQL = f"WITH {_GEO_SQL} SELECT category AS case_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(risk) AS peak FROM risk WHERE risk >= 40 GROUP BY category"


def case_search(spark: SparkSession, sf: str) -> DataFrame:
    return reports.search(_risky(spark, sf), "as5", ("txid", "ip", "asn", "org", "category"), ("CRITICAL", "HIGH")).select("txid", "ip", "asn", "risk")


SEARCH_SQL = f"""WITH {_GEO_SQL} SELECT txid, ip, asn, risk FROM risk WHERE {severity_sql('risk')} IN ('CRITICAL', 'HIGH')
AND lower(concat_ws(' ', txid::VARCHAR, ip, asn, org, category)) LIKE '%as5%'"""


def list_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """List fields in each of the spellings that captures use, from events."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    forms = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), k, F.lit(",7]"))).when(F.col("event_id") % 5 == 1, F.concat(k, F.lit(" | 7|"))).when(F.col("event_id") % 5 == 2, F.concat(k, F.lit("; 7"))).when(F.col("event_id") % 5 == 3, k).otherwise(F.lit(""))
    items = list_items(forms)
    return e.select("event_id", F.size(items).alias("n_items"), F.array_join(items, "/").alias("items"), whole_number(F.concat(k, F.lit(".0"))).alias("port"))


COERCION_SQL = """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 = 1 THEN 3 WHEN event_id % 5 = 2 THEN 2 WHEN event_id % 5 = 3 THEN 1 ELSE 0 END::INT AS n_items,
CASE WHEN event_id % 5 = 0 THEN k || '/7' WHEN event_id % 5 = 1 THEN k || '/7/' WHEN event_id % 5 = 2 THEN k || '/7' WHEN event_id % 5 = 3 THEN k ELSE '' END AS items, k::INT AS port FROM e"""

QUERIES = {
    "first_seen_origin": first_seen_origin, "sensor_agreement": sensor_agreement, "relay_ratio": relay_ratio, "origin_confidence": origin_confidence,
    "layer_join_stats": layer_join_stats, "cidr_enrich": cidr_enrich, "origin_table": origin_table, "timeline": timeline, "networks": networks,
    "severity_rollup": severity_rollup, "leads": leads, "origin_burst": origin_burst, "replay_stream": replay_stream, "running_counters": running_counters,
    "alert_state": alert_state, "case_search": case_search, "list_coercion": list_coercion,
}
ORACLE_SQL = {
    "first_seen_origin": FIRST_SEEN_SQL,
    "sensor_agreement": f"WITH {_FIRST_SQL}, {_AGREE_SQL} SELECT * FROM agreed",
    "relay_ratio": f"WITH {_FIRST_SQL}, {_RATIO_SQL} SELECT * FROM ratio",
    "origin_confidence": f"WITH {_FIRST_SQL}, {_AGREE_SQL}, {_RATIO_SQL}, {_CONF_SQL} SELECT *, confidence >= 0.5 AS resolved FROM conf",
    "layer_join_stats": LAYER_SQL, "cidr_enrich": CIDR_SQL, "origin_table": ORIGIN_TABLE_SQL, "timeline": TIMELINE_SQL, "networks": NETWORKS_SQL,
    "severity_rollup": SEVERITY_SQL, "leads": LEADS_SQL, "origin_burst": BURST_SQL, "replay_stream": REPLAY_SQL, "running_counters": RUNNING_SQL,
    "alert_state": ALERT_SQL, "case_search": SEARCH_SQL, "list_coercion": COERCION_SQL,
}
