"""Numbering and running totals over a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txintel.runtime import checkpoint


def running(rows: DataFrame, order: list[Column | str], totals: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows with, for each name, the running total of its column up to and with the row, in the order given.

    Rows are dealt by range and kept as dealt by a checkpoint; each range runs its own totals, and the ranges before it, one
    row each, add their sums. An order without ties makes the result unique; a running total of 1 is a row number.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.withColumns({f"__{k}": c for k, c in totals.items()}).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    dealt = checkpoint(parts)
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("__range").agg(*(F.sum(f"__{k}").alias(f"__s_{k}") for k in totals))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__range", *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in totals))
    out = dealt.join(F.broadcast(offsets), "__range")  # as many rows as ranges
    return out.withColumns({k: F.col(f"__o_{k}") + F.sum(f"__{k}").over(w) for k in totals}).select(*rows.columns, *totals)


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their number in the order, from 1."""
    return running(rows, order, {name: F.lit(1).cast("bigint")})


def one_before(rows: DataFrame, key: str, order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """rows with name: the value of the row before in the order among those of the same key, null for the first.

    Rows are dealt by range of (key, order), so a key with very many rows is dealt over several ranges; the last row of the
    range before, one row each, stands before the first of a range. An order without ties makes the result unique.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumn("__value", F.struct(F.col(key).alias("k"), value.alias("v")))
    dealt = checkpoint(valued.repartitionByRange(n, key, *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(key, *order)
    last = dealt.groupBy("__range").agg(F.max_by("__value", F.struct(key, *order)).alias("__last"))
    ends = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__end"))  # as many rows as ranges
    met = dealt.withColumn("__before", F.lag("__value").over(within)).join(F.broadcast(ends), "__range")
    before = F.coalesce("__before", "__end")
    return met.withColumn(name, F.when(before["k"].eqNullSafe(F.col(key)), before["v"])).select(*rows.columns, name)
