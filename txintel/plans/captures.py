"""Captures laid over the driver tables: the same relation as a DataFrame and, for the SQL side, as a common table expression.

V_OBS reads order lines as announcements, V_NET user events as announcements of addresses, V_IO orders as transactions that
spend and pay parts, V_WALLET a customer's orders as a wallet's successive payments, V_MIX a supplier's month as one
transaction, V_COSPEND orders of one part, supplier and status as addresses spent together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.functions.expressions import epoch_seconds
from txintel.runtime import table

# The bundled CIDR table.
NETWORKS = (
    ("185.220.100.0/24", "DE", "AS205100", "F3 Netze e.V. (Tor exit relays)", "tor_exit"),
    ("185.220.101.0/24", "DE", "AS205100", "F3 Netze e.V. (Tor exit relays)", "tor_exit"),
    ("104.244.72.0/21", "LU", "AS53667", "FranTech Solutions (Tor exit hosting)", "tor_exit"),
    ("193.32.126.0/24", "SE", "AS39351", "31173 Services AB (commercial VPN)", "vpn"),
    ("146.70.0.0/16", "RO", "AS9009", "M247 Europe (commercial VPN hosting)", "vpn"),
    ("159.65.0.0/16", "US", "AS14061", "DigitalOcean LLC", "hosting"),
    ("95.216.0.0/16", "FI", "AS24940", "Hetzner Online GmbH", "hosting"),
    ("49.36.0.0/14", "IN", "AS55836", "Reliance Jio Infocomm", "residential"),
    ("106.192.0.0/11", "IN", "AS45609", "Bharti Airtel", "mobile"),
    ("117.192.0.0/10", "IN", "AS9829", "BSNL", "residential"),
    ("73.0.0.0/8", "US", "AS7922", "Comcast Cable", "residential"),
    ("91.0.0.0/10", "DE", "AS3320", "Deutsche Telekom", "residential"),
    ("203.0.113.0/24", "SG", "AS64500", "Demo Exchange Infrastructure", "exchange"),
    ("198.51.100.0/24", "IN", "AS64501", "Monitoring sensor network", "sensor"),
)
#: Prefixes in which V_NET puts its users: first octets, by the user's remainder.
BASES = ("185.220.101", "104.244.75", "193.32.126", "146.70.9", "159.65.3", "95.216.1", "49.37.10", "106.200.5", "117.200.7", "73.1.2", "91.20.3", "203.0.113", "8.8.8")

NETS_SQL = "nets(cidr, country, asn, org, category) AS (VALUES " + ", ".join("('" + "', '".join(r) + "')" for r in NETWORKS) + ")"
BASES_SQL = "[" + ", ".join(f"'{b}'" for b in BASES) + "]"

OBS_SQL = """obs AS (
  SELECT l_orderkey AS txid, epoch(l_shipdate)::DOUBLE AS timestamp, l_suppkey AS src_ip, l_linenumber AS dst_ip, l_partkey, l_linenumber
  FROM lineitem)"""
NET_SQL = f"""net AS (
  SELECT event_id AS txid, epoch_us(ts) / 1000000.0::DOUBLE AS ts, user_id, event_type, value,
         {BASES_SQL}[(user_id % {len(BASES)}) + 1] || '.' || ((user_id * 7) % 250 + 1)::VARCHAR AS ip FROM events)"""
IO_SQL = """lines AS (
  SELECT l_orderkey AS txid, epoch(o_orderdate)::DOUBLE AS ts, l_linestatus, l_partkey AS address, round(sum(l_extendedprice), 2) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
ins AS (SELECT txid, ts, address, amount, row_number() OVER (PARTITION BY txid ORDER BY address) - 1 AS pos FROM lines WHERE l_linestatus = 'O'),
outs AS (SELECT txid, ts, address, amount, row_number() OVER (PARTITION BY txid ORDER BY address) - 1 AS pos FROM lines WHERE l_linestatus = 'F'),
tx AS (SELECT o_orderkey AS txid, epoch(o_orderdate)::DOUBLE AS ts, o_totalprice / 1000.0::DOUBLE AS fee,
  coalesce(i.n, 0) AS n_in, coalesce(i.total, 0.0) AS total_in, coalesce(o.n, 0) AS n_out, coalesce(o.total, 0.0) AS total_out,
  o.least AS least_out, o.most AS most_out, coalesce(o.amounts, []) AS amounts
  FROM orders LEFT JOIN (SELECT txid, count(*) AS n, round(sum(amount), 2) AS total FROM ins GROUP BY txid) i ON i.txid = o_orderkey
  LEFT JOIN (SELECT txid, count(*) AS n, round(sum(amount), 2) AS total, min(amount) AS least, max(amount) AS most, list(amount) AS amounts FROM outs GROUP BY txid) o ON o.txid = o_orderkey)"""
LINKS_SQL = """evts AS (
  SELECT address, ts, txid, 0 AS kind, pos, NULL::DOUBLE AS amount FROM ins UNION ALL
  SELECT address, ts, txid, 1, pos, amount FROM outs),
prev AS (SELECT *, lag(kind) OVER w AS pk, lag(txid) OVER w AS pt, lag(amount) OVER w AS pa FROM evts WINDOW w AS (PARTITION BY address ORDER BY ts, txid, kind, pos)),
links AS (SELECT pt AS parent, txid AS child, address, pa AS amount FROM prev WHERE kind = 0 AND pk = 1),
edges AS (SELECT DISTINCT parent, child FROM links)"""
DELAYS_SQL = """delays AS (
  SELECT tx.txid, coalesce(tx.ts - (SELECT max(p.ts) FROM edges JOIN tx p ON p.txid = parent WHERE child = tx.txid), 604800.0)::DOUBLE AS since,
         coalesce((SELECT min(c.ts) FROM edges JOIN tx c ON c.txid = child WHERE parent = tx.txid) - tx.ts, 604800.0)::DOUBLE AS until FROM tx)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_OBS."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("txid"), epoch_seconds("l_shipdate").alias("timestamp"), F.col("l_suppkey").alias("src_ip"), F.col("l_linenumber").alias("dst_ip"), F.struct("l_suppkey", "l_linenumber", "l_partkey").alias("seq"))


def network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_NET: txid, ts, user_id, event_type, value, ip."""
    t = table(spark, sf_dir, "events")
    base = F.element_at(F.array(*(F.lit(b) for b in BASES)), (F.col("user_id") % len(BASES) + 1).cast("int"))
    ip = F.concat(base, F.lit("."), ((F.col("user_id") * 7) % 250 + 1).cast("string"))
    return t.select(F.col("event_id").alias("txid"), epoch_seconds("ts").alias("ts"), "user_id", "event_type", "value", ip.alias("ip"))


def network_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NETWORKS), "cidr string, country string, asn string, org string, category string")


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("txid"), "o_orderdate", "l_linestatus", F.col("l_partkey").alias("address")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return grouped.withColumn("ts", epoch_seconds("o_orderdate")).drop("o_orderdate")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_IO as transactions: lines of status O are inputs, of status F outputs, in order of their address."""
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == flag, F.struct("address", "amount"))))
    sides = ledger_lines(spark, sf_dir).groupBy("txid").agg(side("O").alias("i"), side("F").alias("o"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txid"), epoch_seconds("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000.0).alias("fee"))
    empty = F.array().cast("array<struct<address:bigint,amount:double>>")
    both = orders.join(sides, "txid", "left").withColumns({"i": F.coalesce("i", empty), "o": F.coalesce("o", empty)})
    return both.select("txid", "ts", "fee", *(F.col(s)[f].alias(n) for s, f, n in (("i", "address", "input_addresses"), ("i", "amount", "input_amounts"), ("o", "address", "output_addresses"), ("o", "amount", "output_amounts"))))


WALLET_SQL = """hops AS (
  SELECT o_custkey, o_orderkey, epoch(o_orderdate)::DOUBLE AS ts, o_totalprice AS total, ((o_orderkey * 37) % 100) / 200.0::DOUBLE AS ratio,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"""


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_WALLET: a customer's kth order spends c:k, keeps the rest at c:k+1 and pays a share to c:pay:k."""
    o = table(spark, sf_dir, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    r = o.withColumns({"k": k, "ratio": (F.col("o_orderkey") * 37 % 100) / 200.0, "ts": epoch_seconds("o_orderdate")})
    wallet = lambda *c: F.concat_ws(":", F.col("o_custkey"), *c)
    return r.select(
        F.col("o_orderkey").alias("txid"), "ts",
        F.array(wallet(F.col("k"))).alias("input_addresses"), F.array("o_totalprice").alias("input_amounts"),
        F.array(wallet(F.col("k") + 1), wallet(F.lit("pay"), F.col("k"))).alias("output_addresses"),
        F.array(F.col("o_totalprice"), F.col("o_totalprice") * F.col("ratio")).alias("output_amounts"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_MIX: inputs are the parts of status O of a supplier's month, outputs its discounts of status F."""
    t = table(spark, sf_dir, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    return t.groupBy("l_suppkey", month.alias("month")).agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("input_addresses"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", F.round("l_discount", 2))).alias("output_amounts"),
    )


def cospends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_COSPEND: (txid, address), lines of one part, supplier and status as a transaction that spends from their orders."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.concat_ws("-", "l_partkey", "l_suppkey", "l_linestatus").alias("txid"), F.col("l_orderkey").alias("address"))
