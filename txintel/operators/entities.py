"""Wallet clustering: mixing detection, co-spend entities, peeling shapes and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txintel.functions.expressions import exact_sum, same_amounts
from txintel.operators.components import connected_components
from txintel.operators.ordered import numbered
from txintel.runtime import checkpoint

MIX_INPUTS, MIX_OUTPUTS, MIXED = 3, 3, 0.5
PEEL_RATIO, PEEL_GAP_S, PEEL_HOPS = 0.25, 1800.0, 3


def coinjoin_score(inputs: str = "input_addresses", amounts: str = "output_amounts") -> Column:
    """Share of outputs of the most frequent amount, if enough distinct inputs and equal outputs make a mix, else 0."""
    equal = same_amounts(F.col(amounts))
    mixed = (F.size(F.array_distinct(inputs)) >= MIX_INPUTS) & (equal >= MIX_OUTPUTS)
    return F.when(mixed, F.round(equal / F.size(amounts), 3)).otherwise(0.0)


def peel_shaped(inputs: str = "input_addresses", amounts: str = "output_amounts", ratio: float = PEEL_RATIO) -> Column:
    top = F.array_max(amounts)
    return F.coalesce((F.size(amounts) == 2) & F.size(inputs).between(1, 2) & (top > 0) & (F.array_min(amounts) / F.when(top > 0, top) <= ratio), F.lit(False))


def rule_flag(inputs: str = "input_addresses", amounts: str = "output_amounts") -> Column:
    """The one-transaction baseline: one input, two outputs, the smaller below a fifth of the larger."""
    top = F.array_max(amounts)
    return F.coalesce((F.size(inputs) == 1) & (F.size(amounts) == 2) & (top > 0) & (F.array_min(amounts) / F.when(top > 0, top) < 0.2), F.lit(False))


def entities(spends: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(address, entity, entity_id, size): addresses spent together, transitively; ranked by size and least address.

    spends: (txid, address), one row an input. skip: txids that join nobody, such as mixes. Addresses never spent with another
    are no entity. Each transaction's inputs hang on its least one, so edges are as many as inputs.
    """
    used = spends.select("txid", "address").distinct()
    if skip is not None:
        used = used.join(skip.select("txid"), "txid", "left_anti")
    least = used.groupBy("txid").agg(F.min("address").alias("hub"), F.count("*").alias("n")).filter("n >= 2")
    edges = used.join(least, "txid").filter("address <> hub").select(F.col("hub").alias("src"), F.col("address").alias("dst"))
    member = connected_components(edges).withColumnsRenamed({"node": "address", "component": "entity"})
    sizes = member.groupBy("entity").agg(F.count("*").alias("size"))
    ranked = numbered(sizes, [F.desc("size"), F.col("entity")], "k").select("entity", "size", F.format_string("ENTITY_%03d", "k").alias("entity_id"))
    return member.join(ranked, "entity").select("address", "entity", "entity_id", "size")


def remainder_hops(tx: DataFrame, links: DataFrame, shaped: Column, gap: float = PEEL_GAP_S) -> DataFrame:
    """(src, dst): from a peel-shaped transaction to the spender of its largest output (the first of equals), within the gap."""
    peels = tx.filter(shaped).select(F.col("txid").alias("src"), F.col("ts").alias("t0"), F.element_at("output_addresses", F.array_position("output_amounts", F.array_max("output_amounts")).cast("int")).alias("address"))
    spent = links.select(F.col("parent").alias("src"), "address", F.col("child").alias("dst"))
    later = tx.filter(shaped).select(F.col("txid").alias("dst"), F.col("ts").alias("t1"))
    return peels.join(spent, ["src", "address"]).join(later, "dst").filter(F.col("t1") - F.col("t0") <= gap).select("src", "dst")


def chains(hops: DataFrame, order: DataFrame, least_hops: int = PEEL_HOPS) -> DataFrame:
    """(start, txid, step, hops): maximal chains of at least least_hops transactions, each from a node nothing leads to.

    Every node has one successor at most. Pointer doubling: after round r each node knows the nodes up to 2^r steps ahead, so a
    chain of n hops takes log n joins. order: (txid, ts) names the nodes' times, for the caller's numbering.
    """
    nodes = checkpoint(hops.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    starts = nodes.select("at").join(nodes.select(F.col("to").alias("at")).distinct(), "at", "left_anti").select(F.col("at").alias("start"))
    reach = starts.select("start", F.col("start").alias("txid"), F.lit(0).cast("bigint").alias("step"))
    jump, length = nodes, 1
    while True:
        ahead = reach.join(jump, reach.txid == jump["at"]).select("start", F.col("to").alias("txid"), (F.col("step") + length).alias("step"))
        reach = checkpoint(reach.unionAll(ahead))
        far = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.at")).select(F.col("a.at").alias("at"), F.col("b.to").alias("to"))
        jump, length = checkpoint(far), 2 * length
        if not jump.head(1):
            break
    sized = reach.withColumn("hops", F.count("*").over(Window.partitionBy("start")))
    return sized.filter(F.col("hops") >= least_hops).join(order.select(F.col("txid").alias("start"), F.col("ts").alias("start_ts")), "start")


def chain_table(steps: DataFrame, tx: DataFrame) -> DataFrame:
    """One row a chain of chains(): chain_id by time of its start, hops, amounts to 8 places and its txids in order."""
    rows = steps.join(tx.select("txid", "ts", F.array_min("output_amounts").alias("least"), F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x).alias("spent"), F.array_max("output_amounts").alias("most")), "txid")
    per = rows.groupBy("start", "hops").agg(
        exact_sum("least").alias("peeled_total"), F.round(F.min_by("spent", "step"), 8).alias("start_amount"), F.round(F.max_by("most", "step"), 8).alias("remainder"),
        (F.max("ts") - F.min("ts")).alias("duration_s"), F.min("ts").alias("start_ts"), F.transform(F.array_sort(F.collect_list(F.struct("step", "txid"))), lambda x: x["txid"]).alias("txids"),
    )
    return numbered(per, ["start_ts", "start"], "k").withColumn("chain_id", F.format_string("PEEL_%03d", "k")).drop("k")
