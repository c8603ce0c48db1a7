"""Column expressions shared by the operators."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Risk bands from the top, and display names of network categories.
SEVERITIES = ((85.0, "CRITICAL"), (65.0, "HIGH"), (40.0, "MEDIUM"))
CATEGORY_LABELS = {
    "tor_exit": "Tor exit relay",
    "vpn": "Commercial VPN",
    "hosting": "Datacentre / hosting",
    "residential": "Residential ISP",
    "mobile": "Mobile carrier",
    "exchange": "Exchange infrastructure",
    "sensor": "Monitoring sensor",
    "unknown": "Unclassified network",
    "unresolved": "Origin unresolved",
}
HIGH_RISK_CATEGORIES = ("tor_exit", "vpn")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without zone, as double."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / 1e6


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def severity(risk: Column | str) -> Column:
    r = F.col(risk) if isinstance(risk, str) else risk
    out = F.lit("LOW")
    for least, name in reversed(SEVERITIES):
        out = F.when(r >= least, name).otherwise(out)
    return out


def severity_sql(risk: str) -> str:
    return "CASE " + " ".join(f"WHEN {risk} >= {least} THEN '{name}'" for least, name in SEVERITIES) + " ELSE 'LOW' END"


def category_label(category: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    known = F.create_map(*(F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv))
    return F.coalesce(known[c], c)


def list_items(text: Column | str) -> Column:
    """A list field given as text: a JSON array, or parts between | or else ;, or one value; null and empty give no items."""
    c = F.col(text) if isinstance(text, str) else text
    t = F.trim(c)
    parts = lambda sep: F.transform(F.split(t, sep), lambda x: F.trim(x))
    return (
        F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
        .when(t.startswith("["), F.from_json(t, "array<string>"))
        .when(t.contains("|"), parts(r"\|"))
        .when(t.contains(";"), parts(";"))
        .otherwise(F.array(t))
    )


def whole_number(text: Column | str) -> Column:
    """An integer given as text such as 8333 or 8333.0; null for empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(c) == "", None).otherwise(c).cast("double").cast("int")


IP_TYPE = "struct<version:int,hi:bigint,lo:bigint>"


def _ip_v6(texts: pd.Series) -> pd.DataFrame:
    """Version, upper and lower 64 bits of IPv6 addresses, as signed numbers; nulls for what is none."""

    def parts(text: str) -> tuple[int | None, int | None, int | None]:
        try:
            n = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None, None, None
        return 6, *(x - (x >> 63 << 64) for x in (n >> 64, n & (1 << 64) - 1))

    return pd.DataFrame([parts(t) for t in texts], columns=["version", "hi", "lo"], dtype="Int64")


def with_ip_number(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with name: the address as struct (version, hi, lo), the upper and lower 64 bits of an IPv6 address, 0 and the number of
    an IPv4 one; null if it is neither. Give it distinct addresses: those with a colon go through a helper in Python."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    c = F.trim(text)
    v4 = F.aggregate(F.split(c, r"\."), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x.cast("bigint")))
    colon = F.coalesce(F.col(text).contains(":"), F.lit(False))
    four = rows.filter(~colon).withColumn(name, F.when(c.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.struct(F.lit(4).alias("version"), F.lit(0).cast("bigint").alias("hi"), v4.alias("lo"))))
    six = rows.filter(colon).withColumn("__six", F.pandas_udf(_ip_v6, IP_TYPE)(c)).withColumn(name, F.when(F.col("__six.version").isNotNull(), F.col("__six"))).drop("__six")
    return four.unionByName(six)


def ip_masked(number: Column, prefix: Column) -> Column:
    """The address with all bits after its first prefix ones at 0."""
    keep = lambda bits, x: F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, x).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - bits).cast("int"))))
    low = F.when(number["version"] == 4, prefix + 32).otherwise(prefix - 64)
    return F.struct(number["version"].alias("version"), keep(prefix, number["hi"]).alias("hi"), keep(low, number["lo"]).alias("lo"))


def duration_text(seconds: Column | str) -> Column:
    """Whole seconds as 59 s, 59 min 59 s or 5 h 59 min."""
    s = F.bround(F.col(seconds) if isinstance(seconds, str) else seconds, 0).cast("bigint")
    whole = lambda n: F.floor(s / n).cast("bigint")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %d s", whole(60), s % 60)).otherwise(F.format_string("%d h %d min", whole(3600), F.floor(s % 3600 / 60).cast("bigint")))


def fixed(number: Column | str, places: int) -> Column:
    """A number with so many decimals, rounded by its exact value, as text."""
    return F.replace(F.format_number(number, places), F.lit(","), F.lit(""))


def same_amounts(amounts: Column) -> Column:
    """How often the most frequent amount, to 8 places, occurs; 0 for none. One pass over the sorted amounts."""
    rounded = F.array_sort(F.transform(amounts, lambda x: F.round(x, 8)))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.coalesce(F.aggregate(rounded, start, step, lambda a: a["most"]), F.lit(0))


def exact_sum(amount: Column | str) -> Column:
    """The sum of amounts to 8 places, the same in whatever order they are added."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(c.cast("decimal(28,8)")).cast("double"), F.lit(0.0))
