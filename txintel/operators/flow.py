"""Money flow: spend links, flow edges, the heterogeneous graph, degrees and delays.

transactions: txid, ts, input_addresses, input_amounts, output_addresses, output_amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txintel.operators.ordered import one_before

NEVER_S = 604800.0
#: Events of one address up to which a window by address serves; with more, rows are dealt by range.
HOT = 2_000_000


def inputs(tx: DataFrame) -> DataFrame:
    return tx.select("txid", "ts", F.posexplode("input_addresses").alias("pos", "address"))


def outputs(tx: DataFrame) -> DataFrame:
    """One row an output; addresses without an amount, and amounts without an address, are left out."""
    n = F.least(F.size("output_addresses"), F.size("output_amounts"))
    pairs = F.slice(F.arrays_zip("output_addresses", "output_amounts"), F.lit(1), F.greatest(n, F.lit(0)))
    return tx.select("txid", "ts", F.posexplode(pairs).alias("pos", "o")).select("txid", "ts", "pos", F.col("o.output_addresses").alias("address"), F.col("o.output_amounts").alias("amount"))


def spend_links(tx_inputs: DataFrame, tx_outputs: DataFrame, hot: int = HOT, times: bool = False) -> DataFrame:
    """(parent, child, address, amount), with times parent_ts and child_ts too: a spend links to the payment just before it on its address, if nothing spent it yet.

    In the order of (ts, txid), a transaction's inputs before its outputs, a spend has a link if and only if the event before
    it on the address is a payment: one window by address over narrow rows, or where an address has more than hot events, an
    order by ranges that no address has to fit into.
    """
    events = tx_inputs.select("address", "ts", "txid", F.lit(0).alias("kind"), "pos", F.lit(None).cast("double").alias("amount")).unionByName(
        tx_outputs.select("address", "ts", "txid", F.lit(1).alias("kind"), "pos", "amount")
    )
    order, value = ["ts", "txid", "kind", "pos"], F.struct("kind", "txid", "amount", *(("ts",) if times else ()))
    most = events.groupBy("address").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= hot:
        placed = events.withColumn("before", F.lag(value).over(Window.partitionBy("address").orderBy(*order)))
    else:
        placed = one_before(events, "address", order, value, "before")
    linked = placed.filter("kind = 0 and before.kind = 1")
    return linked.select(F.col("before.txid").alias("parent"), F.col("txid").alias("child"), "address", F.col("before.amount").alias("amount"), *((F.col("before.ts").alias("parent_ts"), F.col("ts").alias("child_ts")) if times else ()))


def flow_edges(links: DataFrame) -> DataFrame:
    return links.select("parent", "child").distinct()


def hetero_graph(obs: DataFrame, tx_inputs: DataFrame, tx_outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type) and edges (src, dst, rel) of addresses, transactions and wallets."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edges = (
        obs.select(name("IP", "src_ip").alias("src"), name("TXID", "txid").alias("dst"), F.lit("ANNOUNCED").alias("rel"))
        .unionAll(tx_inputs.select(name("WALLET", "address"), name("TXID", "txid"), F.lit("SPENT_IN")))
        .unionAll(tx_outputs.select(name("TXID", "txid"), name("WALLET", "address"), F.lit("PAID_TO")))
    )
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("type", F.split("id", ":")[0])
    return nodes, edges


def degrees(edges: DataFrame) -> DataFrame:
    """(txid, in_degree, out_degree) of every transaction with a flow edge."""
    ends = edges.select(F.col("child").alias("txid"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("parent", F.lit(0), F.lit(1)))
    return ends.groupBy("txid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def delays(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """(txid, since, until): seconds since the latest funding transaction and until the first spend, a week where none is."""
    times = tx.select("txid", "ts")
    funded = edges.join(times.withColumnsRenamed({"txid": "parent", "ts": "t"}), "parent").groupBy(F.col("child").alias("txid")).agg(F.max("t").alias("last"))
    spent = edges.join(times.withColumnsRenamed({"txid": "child", "ts": "t"}), "child").groupBy(F.col("parent").alias("txid")).agg(F.min("t").alias("next"))
    both = times.join(funded, "txid", "left").join(spent, "txid", "left")
    return both.select("txid", F.coalesce(F.col("ts") - F.col("last"), F.lit(NEVER_S)).alias("since"), F.coalesce(F.col("next") - F.col("ts"), F.lit(NEVER_S)).alias("until"))


def link_delays(tx: DataFrame, links: DataFrame) -> DataFrame:
    """delays() of links that have their times: one grouping of both ends in place of a join for each end."""
    none = F.lit(None).cast("double")
    ends = links.select(F.col("child").alias("txid"), F.col("parent_ts").alias("last"), none.alias("next")).unionAll(links.select("parent", none, "child_ts"))
    near = ends.groupBy("txid").agg(F.max("last").alias("last"), F.min("next").alias("next"))
    both = tx.select("txid", "ts").join(near, "txid", "left")
    return both.select("txid", F.coalesce(F.col("ts") - F.col("last"), F.lit(NEVER_S)).alias("since"), F.coalesce(F.col("next") - F.col("ts"), F.lit(NEVER_S)).alias("until"))
