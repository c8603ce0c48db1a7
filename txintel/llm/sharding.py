"""Sharding by k-d tree: recursive splits at weighted medians along the widest dimension.

Every node that stands for more than one shard is split along the dimension in which its rows spread widest, at the value
that divides its bytes as its shards' goals divide. All nodes of a level are split together: histograms of the cut dimension,
refined round by round, find each weighted median without sorting; only a few numbers a node reach the driver. Dimensions
are functions of the text, so equal texts share a point and stay together. A group of copies over WHOLE_GROUP of a shard would
make the medians uneven: such groups, of which there can be only so many, are dealt to shards whole before the tree is grown,
and each shard's goal is what they leave of it. Only a group that fits no shard is cut, into even pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.llm.mixing import _small
from txintel.runtime import checkpoint, table

SHARDS, BINS = 24, 4096
#: Of a shard's bytes: what a group of copies may hold to go through the tree, and how near a cut comes to its weighted median.
WHOLE_GROUP, NEAR = 0.01, 0.0005
#: Rows of one shard that are numbered together.
NUMBERED = 50_000
_TIE = 1 << 32


@dataclass
class Split:
    """Rows of the node with key(dim) < cut go left."""

    dim: str
    cut: int
    left: int
    right: int


def _key(dim: str) -> Column:
    """The dimension's value, ties broken by the row's tie; an integer below 2 ^ 53."""
    return F.col(dim) * F.lit(_TIE) + F.col("tie")


def _assign(points: DataFrame, levels: list[dict[int, Split]]) -> DataFrame:
    """points with the node that the splits of all levels lead to."""

    def below(at: int, level: int) -> Column:
        for k in range(level, len(levels)):
            if s := levels[k].get(at):
                return F.when(_key(s.dim) < s.cut, below(s.left, k + 1)).otherwise(below(s.right, k + 1))
        return F.lit(at)

    return points.withColumn("node", below(0, 0))


def _medians(placed: DataFrame, dims: list[str], open_: dict[int, dict], weight: str, near: float) -> dict[int, int]:
    """For each node {dim, low, high, goal}: the cut at which the weight below comes nearest to goal."""
    cuts: dict[int, int] = {}
    state = {k: x | {"base": 0} for k, x in open_.items()}
    while state:
        for x in state.values():
            x["width"] = max(1, -(-(x["high"] - x["low"] + 1) // BINS))
        told = [(k, dims.index(x["dim"]) + 1, x["low"], x["width"], float(x["goal"] - x["base"])) for k, x in state.items()]
        tasks = F.broadcast(placed.sparkSession.createDataFrame(told, "node int, dim int, low bigint, width bigint, goal double"))
        key = F.element_at(F.array(*(F.col(d) for d in dims)), F.col("dim")) * F.lit(_TIE) + F.col("tie")
        place = F.floor((key - F.col("low")) / F.col("width"))
        inside = placed.join(tasks, "node").select("node", place.alias("bin"), weight, "goal").filter(F.col("bin").between(0, BINS - 1))
        bins = inside.groupBy("node", "bin").agg(F.sum(weight).alias("w"), F.first("goal").alias("goal"))
        upto = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        hits = upto.groupBy("node").agg(F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "w", "upto"))).alias("hit"), F.max(F.struct("bin", "w", "upto")).alias("last")).collect()
        for r in hits:
            x, b = state[r.node], r.hit or r.last
            low, below, above = x["low"] + b.bin * x["width"], x["base"] + b.upto - b.w, x["base"] + b.upto
            if b.w <= near or x["width"] == 1:
                cuts[r.node] = low if x["goal"] - below <= above - x["goal"] else low + x["width"]
                del state[r.node]
            else:
                x |= {"low": low, "high": low + x["width"] - 1, "base": below}
    return cuts


def kd_tree(points: DataFrame, dims: list[str], weight: str, goals: list[float], near: float = NEAR) -> list[dict[int, Split]]:
    """Splits, level by level, into shards whose weights are as their goals. dims: integer columns from 0 to 2 ^ 20, none null;
    tie: integer column from 0 to 2 ^ 32 that tells apart what may be parted. Nodes are named by their first shard."""
    total, *spans = points.agg(F.sum(weight), *(F.max(d) - F.min(d) for d in dims)).first()
    levels: list[dict[int, Split]] = []
    nodes = {0: len(goals)}
    while total and any(n > 1 for n in nodes.values()):
        placed = _assign(points, levels)
        wide = placed.filter(F.col("node").isin([k for k, n in nodes.items() if n > 1])).groupBy("node")
        seen = wide.agg(F.sum(weight).alias("w"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max)))).collect()
        open_ = {}
        for r in seen:
            dim = max(dims, key=lambda d, r=r: ((r[f"max_{d}"] - r[f"min_{d}"]) / max(1, spans[dims.index(d)]), -dims.index(d)))
            n = nodes[r.node]
            left, all_ = sum(goals[r.node : r.node + n // 2]), sum(goals[r.node : r.node + n])
            open_[r.node] = {"dim": dim, "low": r[f"min_{dim}"] * _TIE, "high": (r[f"max_{dim}"] + 1) * _TIE - 1, "goal": r.w * (left / all_ if all_ > 0 else 0.5)}
        cuts = _medians(placed, dims, open_, weight, near * total / len(goals))
        levels.append({k: Split(open_[k]["dim"], cuts[k], k, k + nodes[k] // 2) for k in open_})
        nodes = {k: n for k, n in nodes.items() if n == 1} | {c: m for k, n in nodes.items() if n > 1 for c, m in ((k, n // 2), (k + n // 2, n - n // 2))}
    return levels


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("bigint")
    chars = F.char_length(text)
    lines = chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        (size + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        F.floor(F.log2(size + 1.0) * 16384).cast("bigint").alias("d_bytes"),
        F.floor((size - chars) / F.greatest(size, F.lit(1)) * 1048575).cast("bigint").alias("d_script"),
        F.floor(F.log2(lines + 1.0) * 16384).cast("bigint").alias("d_lines"),
    )


def place_groups(sizes: list[int], shards: int, room: float) -> list[int]:
    """A shard for each group, largest first and each where most room is left; -1 for one that fits none."""
    left, out = [room] * shards, [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = max(range(shards), key=lambda s: (left[s], -s))
        if sizes[k] <= left[at]:
            left[at] -= sizes[k]
            out[k] = at
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", whole_group: float = WHOLE_GROUP) -> DataFrame:
    """(id, size, crc, hash, shard, slot) for every row; size: UTF-8 bytes plus 8, slot: 0, 1, ... within the shard.

    A null text is an empty one; rows with a null or a repeated id and repeated rows are rows like others, and a group of them
    that fits no shard is cut as evenly as one of different ids. An empty table gives no rows; with fewer groups than shards
    some shards stay empty.
    """
    points = checkpoint(_points(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    n, total = points.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    limit = max(1.0, whole_group * total / shards)
    # at most shards / whole_group groups can be this large
    groups = points.groupBy("hash", "size").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit).orderBy("hash", "size").collect()
    homes = place_groups([g.bytes for g in groups], shards, total / shards)
    told = [(g.hash, g.size, home, math.ceil(g.bytes / limit)) for g, home in zip(groups, homes, strict=True)]
    large = F.broadcast(points.sparkSession.createDataFrame(told, "hash bigint, size bigint, home int, pieces bigint"))
    piece = F.when(F.col("home") < 0, F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(0)
    tied = points.join(large, ["hash", "size"], "left").withColumn("tie", F.pmod(F.xxhash64("hash", piece), F.lit(_TIE))).drop("pieces")
    tied = checkpoint(tied.withColumn("home", F.when(F.col("home") >= 0, F.col("home"))))
    goals = [total / shards] * shards
    for g, home in zip(groups, homes, strict=True):
        if home >= 0:
            goals[home] -= g.bytes
    free = tied.filter("home is null")
    placed = _assign(tied, kd_tree(free, ["d_bytes", "d_script", "d_lines"], "size", goals)).withColumn("shard", F.coalesce("home", "node"))
    buckets = max(1, -(-n // (shards * NUMBERED)))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = _small(counts.select("shard", "bucket", before.alias("before")))
    turn = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    return dealt.withColumn("turn", turn).join(offsets, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "crc", "hash", "shard", (F.col("before") + F.col("turn")).cast("bigint").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document of the whole table, by the law `bytes`; shard says what odd rows give."""
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
