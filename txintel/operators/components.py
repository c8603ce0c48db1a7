"""Connected components of an edge list that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txintel.runtime import checkpoint, release


#: Edges up to which the rounds' tables are kept in FILES files, as most of their cost would be that of tasks without rows.
FEW, FILES = 100_000, 8


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs each larger neighbour of u on the least node of u's neighbourhood."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs u and its smaller neighbours on the least of them; edges run from larger u to smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Alternates large-star and small-star steps until every node hangs directly on the least node of its component;
    each step is a grouped minimum and an equi-join, so hubs pre-aggregate and skewed joins can be split. Rows with a null
    end and self-loops connect nothing; a node that only has a self-loop is its own component. The result is checkpointed, and
    no round before it is left in the checkpoint folder.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    named = checkpoint(named)
    fit = (lambda df: df.coalesce(FILES)) if named.count() <= FEW else (lambda df: df)
    work = named.filter("u <> v").distinct()
    before = None
    for _ in range(max_rounds):
        last, work = work, checkpoint(fit(_small_star(_large_star(work))))
        release(last)
        now = _state(work)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    members = work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    alone = named.filter("u = v").select(F.col("u").alias("node")).distinct().join(members, "node", "left_anti")
    found = checkpoint(fit(members.unionAll(alone.select("node", F.col("node").alias("component")))))
    release(named, work)
    return found
