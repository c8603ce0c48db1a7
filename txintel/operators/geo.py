"""Longest-prefix enrichment of addresses, IPv4 and IPv6, from a CIDR table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.functions.expressions import HIGH_RISK_CATEGORIES, category_label, ip_masked, with_ip_number
from txintel.runtime import checkpoint, ship_package

#: Rows of a CIDR table that are broadcast; a larger one joins by shuffle on the same equal keys.
BROADCAST_ROWS = 200_000
FIELDS = ("country", "asn", "org", "category")


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """A CIDR table from a CSV file with the header cidr,country,asn,org,category; seq is the place in the file."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    return rows.select("cidr", *FIELDS).withColumn("seq", F.monotonically_increasing_id())


def networks(cidrs: DataFrame) -> DataFrame:
    """(prefix, net, country, asn, org, category, asn_category) from cidr, country, asn, org, category and, where rows have an
    order, seq: the last of equal prefixes wins, and asn_category is the category of the first row with that asn. A cidr whose
    address has bits beyond its prefix, or is none, fails."""
    ship_package(cidrs.sparkSession)
    ordered = cidrs if "seq" in cidrs.columns else cidrs.withColumn("seq", F.monotonically_increasing_id())
    parts = F.split(F.trim("cidr"), "/")
    cut = with_ip_number(ordered.withColumn("_text", parts[0]), "_text", "_ip").drop("_text")
    cut = cut.withColumn("prefix", F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.when(F.col("_ip.version") == 4, 32).otherwise(128)))
    strict = cut.withColumn("net", F.when(ip_masked(F.col("_ip"), F.col("prefix")) == F.col("_ip"), F.col("_ip")).otherwise(F.raise_error(F.concat(F.lit("no network, or host bits set in "), "cidr")).cast("struct<version:int,hi:bigint,lo:bigint>")))
    last = F.row_number().over(Window.partitionBy("prefix", "net").orderBy(F.desc("seq")))
    by_asn = ordered.groupBy(F.col("asn").alias("_asn")).agg(F.min_by("category", "seq").alias("asn_category"))
    kept = strict.withColumn("_turn", last).filter("_turn = 1").join(by_asn, F.col("asn") == F.col("_asn"), "left")
    return checkpoint(kept.select("prefix", "net", *FIELDS, "asn_category"))  # read several times by each lookup


def enrich(ips: DataFrame, nets: DataFrame, ip_col: str = "ip", asn_col: str | None = None) -> DataFrame:
    """ips' rows with country, asn, org, category, category_label, is_high_risk_network.

    Each address is looked up under its masked value for every prefix length of the table, an equi-join, and the longest match
    is kept; distinct addresses only take part. Malformed addresses match nothing.
    """
    rows = nets.count()
    lengths = [(r.version, r.prefix) for r in nets.select(F.col("net.version").alias("version"), "prefix").distinct().collect()]  # 32 and 128 at most
    known = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(p).alias("prefix")) for v, p in lengths)) if lengths else F.array().cast("array<struct<version:int,prefix:int>>")
    ship_package(ips.sparkSession)
    distinct = with_ip_number(checkpoint(ips.select(ip_col).distinct()), ip_col, "_n").filter("_n is not null")
    own = distinct.select(ip_col, "_n", F.explode(F.filter(known, lambda k: k["version"] == F.col("_n.version"))).alias("_k"))
    probes = own.select(ip_col, F.col("_k.prefix").alias("prefix"), ip_masked(F.col("_n"), F.col("_k.prefix")).alias("net"))
    side = F.broadcast(nets) if rows <= BROADCAST_ROWS else nets
    best = probes.join(side, ["prefix", "net"]).groupBy(ip_col).agg(F.max_by(F.struct(*FIELDS), "prefix").alias("_hit"))
    out = ips.join(best, ip_col, "left")
    category = F.col("_hit.category")
    if asn_col:
        by_asn = nets.select(F.col("asn").alias("_asn"), F.col("asn_category").alias("_asn_category")).distinct()
        out = out.join(F.broadcast(by_asn) if rows <= BROADCAST_ROWS else by_asn, F.col(asn_col) == F.col("_asn"), "left")
        category = F.coalesce(category, F.col("_asn_category"))
    country, asn, org = (F.coalesce(F.col(f"_hit.{c}"), F.lit(d)) for c, d in (("country", "UNKNOWN"), ("asn", "UNKNOWN"), ("org", "Unknown network")))
    out = out.withColumns({"country": country, "asn": asn, "org": org, "category": F.coalesce(category, F.lit("unknown"))})
    out = out.withColumns({"category_label": category_label("category"), "is_high_risk_network": F.col("category").isin(*HIGH_RISK_CATEGORIES)})
    return out.drop("_hit", "_asn", "_asn_category")
