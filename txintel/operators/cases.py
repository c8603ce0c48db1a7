"""Cases: flagged transactions and the bridges between them, joined along the money flow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txintel.functions.expressions import SEVERITIES, duration_text, exact_sum, fixed, severity
from txintel.operators.components import connected_components
from txintel.operators.entities import MIXED, PEEL_HOPS
from txintel.operators.ordered import numbered
from txintel.operators.origin import RESOLVED
from txintel.runtime import checkpoint, ship_package

FLAGGED = 40.0
#: A bound for callers that ask documents() for one, which has none otherwise, and cases up to which their numbers are broadcast.
DOCUMENT_ROWS, BROADCAST = 100_000, 200_000

# Typology tags, and the sentences of a case's narrative.
TAGS = {"mix": "CoinJoin mixing", "peel": "Peeling chain", "fan": "Fan-out / fan-in structuring", "sweep": "Consolidation sweep", "none": "Anomalous flow"}
SENTENCES = {
    "lead": "%d linked transaction%s carrying %s BTC over %s.",
    "mix": "An equal-output mixing round breaks the link between senders and receivers.",
    "peel": "A %d-hop peeling chain splits off %s BTC in small outputs while forwarding the remainder each hop.",
    "fan": "Funds are fanned out into near-equal parts, moved one hop each and re-aggregated.",
    "sweep": "Outputs from earlier hops are swept together into a single address.",
    "origin": "The origin was resolved to %d IP address%s; most frequent is %s (%s, %s, %s) with mean attribution confidence %s.",
    "tor": "A Tor exit identifies the relay, not the sender.",
    "lost": "For %d transaction%s the origin could not be resolved: only relays were seen announcing.",
    "out": "Largest onward output: %s BTC at %s (%s).",
}


def members(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(txid, case_root, core) of every flagged transaction and every bridge: unflagged, with a flagged one on either side."""
    flagged = scored.filter(F.col("risk") >= FLAGGED).select("txid")
    quiet = scored.filter(F.col("risk") < FLAGGED).select("txid")
    into = edges.join(flagged, edges.parent == flagged.txid, "left_semi").select(F.col("child").alias("txid"))
    outof = edges.join(flagged, edges.child == flagged.txid, "left_semi").select(F.col("parent").alias("txid"))
    bridges = quiet.join(into, "txid", "left_semi").join(outof, "txid", "left_semi")
    both = checkpoint(flagged.withColumn("core", F.lit(True)).unionAll(bridges.withColumn("core", F.lit(False))))
    ids = both.select("txid")
    inner = edges.join(ids.withColumnRenamed("txid", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("txid", "child"), "child", "left_semi")
    loops = ids.select(F.col("txid").alias("parent"), F.col("txid").alias("child"))
    roots = connected_components(inner.select("parent", "child").unionAll(loops), "parent", "child")
    return both.join(roots.withColumnRenamed("node", "txid"), "txid").select("txid", F.col("component").alias("case_root"), "core")


def case_flow(member: DataFrame, links: DataFrame) -> DataFrame:
    """(case_root, parent, child, amount) of links with both ends in one case."""
    m = member.select("txid", "case_root")
    inner = links.join(m.withColumnsRenamed({"txid": "parent", "case_root": "r1"}), "parent").join(m.withColumnsRenamed({"txid": "child", "case_root": "r2"}), "child").filter("r1 = r2")
    return inner.groupBy(F.col("r1").alias("case_root"), "parent", "child").agg(F.round(F.sum("amount"), 8).alias("amount"))


def terminals(member: DataFrame, outputs: DataFrame, links: DataFrame, top: int = 6) -> DataFrame:
    """(case_root, txid, address, amount, status, place, terminal_outputs): the largest outputs that leave each case."""
    m = member.select("txid", "case_root")
    last = outputs.groupBy("txid", "address").agg(F.count("*").alias("times"), F.sum("amount").alias("amount"))
    owned = last.join(m, "txid")
    spent = links.select(F.col("parent").alias("txid"), "address", "child").distinct().join(m.withColumnsRenamed({"txid": "child", "case_root": "spender_root"}), "child", "left")
    met = owned.join(spent, ["txid", "address"], "left").filter(F.col("spender_root").isNull() | (F.col("spender_root") != F.col("case_root")))
    status = F.when(F.col("child").isNull(), "unspent at end of capture").otherwise("spent outside this case")
    w = Window.partitionBy("case_root")
    placed = met.withColumns({"status": status, "place": F.row_number().over(w.orderBy(F.desc("amount"), "txid", "address")), "terminal_outputs": F.count("*").over(w)})
    return placed.filter(F.col("place") <= top).select("case_root", "txid", "address", F.round("amount", 8).alias("amount"), "status", "place", "terminal_outputs")


def case_table(member: DataFrame, scored: DataFrame, links: DataFrame) -> DataFrame:
    """One row a case, ranked. scored: txid, ts, risk, inflow (sum of inputs), n_out (addresses), least_out, coinjoin, peel_hops.
    Amounts are sums to 8 places."""
    rows = member.join(scored, "txid")
    flow = case_flow(member, links)
    parents = flow.groupBy(F.col("child").alias("txid")).agg(F.count("*").alias("n_parents"))
    children = flow.groupBy(F.col("parent").alias("txid")).agg(F.count("*").alias("n_children"))
    full = rows.join(parents, "txid", "left").join(children, "txid", "left").fillna(0, ["n_parents", "n_children"])
    any_ = lambda c: F.max(c.cast("int")) == 1
    core = F.col("core")
    agg = full.groupBy("case_root").agg(
        F.max(F.when(core, F.col("risk"))).alias("peak"),
        F.avg(F.when(core, F.col("risk"))).alias("mean"),
        F.count("*").alias("tx_count"),
        F.count(F.when(~core, 1)).alias("bridges"),
        exact_sum(F.when(F.col("n_parents") == 0, F.col("inflow"))).alias("inflow"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("peel_hops").alias("peel_hops"),
        exact_sum(F.when(F.col("peel_hops") >= PEEL_HOPS, F.col("least_out"))).alias("peeled"),
        any_(F.col("coinjoin") >= MIXED).alias("mix"),
        any_((F.col("n_children") >= 4) & (F.col("coinjoin") < MIXED)).alias("fan"),
        any_((F.col("n_parents") >= 2) & (F.col("n_out") == 1)).alias("sweep"),
    )
    said = [F.when(F.col("mix"), TAGS["mix"]), F.when(F.col("peel_hops") >= PEEL_HOPS, TAGS["peel"]), F.when(F.col("fan"), TAGS["fan"]), F.when(F.col("sweep") & ~F.col("fan"), TAGS["sweep"])]
    tags = F.array_compact(F.array(*said))
    named = agg.withColumn("tags", F.when(F.size(tags) == 0, F.array(F.lit(TAGS["none"]))).otherwise(tags))
    done = named.select(
        "case_root", F.round("peak", 1).alias("risk_score"), F.round("mean", 1).alias("mean_risk"), severity("peak").alias("severity"), F.array_join("tags", " + ").alias("typology"), "tx_count", "bridges",
        F.round("inflow", 8).alias("inflow"), "peel_hops", F.round("peeled", 8).alias("peeled"), "first_ts", "last_ts", duration_text(F.col("last_ts") - F.col("first_ts")).alias("duration"),
    )
    ranked = numbered(done, [F.desc("risk_score"), F.desc("inflow"), F.col("first_ts"), F.col("case_root")], "k")
    return ranked.withColumn("case_id", F.format_string("CASE-%03d", "k")).drop("k")


def by_severity(cases: DataFrame) -> DataFrame:
    """(severity, cases) of every level that a case can have, those without any too."""
    every = cases.sparkSession.createDataFrame([(n,) for _, n in SEVERITIES], "severity string")
    return every.join(cases.groupBy("severity").agg(F.count("*").alias("cases")), "severity", "left").fillna(0, ["cases"])


def typologies(cases: DataFrame) -> DataFrame:
    one = cases.withColumn("tag", F.explode(F.split("typology", r" \+ ")))
    return one.groupBy("tag").agg(F.count("*").alias("cases"), F.sum("tx_count").alias("transactions"), exact_sum("inflow").alias("inflow"))


def origins(member: DataFrame, located: DataFrame) -> DataFrame:
    """(case_root, ip, transactions, country, asn, org, category, category_label, mean_confidence, resolved) for each address that
    announced first in a case. located: txid, origin_ip, its network and the confidence; below the threshold the first announcer
    is more likely a relay than the origin."""
    rows = member.select("txid", "case_root").join(located.filter("origin_ip is not null"), "txid")
    per = rows.groupBy("case_root", F.col("origin_ip").alias("ip")).agg(
        F.count("*").alias("transactions"), *(F.min(c).alias(c) for c in ("country", "asn", "org", "category", "category_label")),
        F.round(F.avg("confidence"), 3).alias("mean_confidence"),
    )
    return per.withColumn("resolved", F.col("mean_confidence") >= RESOLVED)


def origin_facts(found: DataFrame) -> DataFrame:
    """(case_root, origin_facts) of origins(): how many addresses the origin was resolved to, the best of them, whether a Tor exit
    is among them, and the transactions whose origin wasn't resolved. Sums and extremes, so a case of any size has them."""
    good = F.col("resolved")
    item = F.struct("ip", "category_label", "country", "asn", "mean_confidence")
    return found.groupBy("case_root").agg(F.struct(
        F.count(F.when(good, 1)).alias("good"), F.min_by(item, F.when(good, F.struct(-F.col("transactions"), F.col("ip")))).alias("top"),
        F.coalesce(F.max(F.when(good, F.col("category") == "tor_exit")), F.lit(False)).alias("tor"), F.coalesce(F.sum(F.when(~good, F.col("transactions"))), F.lit(0)).alias("lost"),
    ).alias("origin_facts"))


def narrative() -> Column:
    """A case's sentences, from the columns of case_table and, where there are any, origin_facts and terminal_outputs."""
    has = lambda tag: F.col("typology").contains(TAGS[tag])
    plural = lambda n, one, many: F.when(n == 1, one).otherwise(many)
    good, top, lost = (F.col(f"origin_facts.{n}") for n in ("good", "top", "lost"))
    out = F.try_element_at("terminal_outputs", F.lit(1))
    return F.concat_ws(
        " ",
        F.format_string(SENTENCES["lead"], "tx_count", plural(F.col("tx_count"), "", "s"), fixed("inflow", 4), "duration"),
        F.when(has("mix"), SENTENCES["mix"]),
        F.when(has("peel"), F.format_string(SENTENCES["peel"], "peel_hops", fixed("peeled", 4))),
        F.when(has("fan"), SENTENCES["fan"]),
        F.when(has("sweep"), SENTENCES["sweep"]),
        F.when(good > 0, F.format_string(SENTENCES["origin"], good, plural(good, "", "es"), top["ip"].cast("string"), top["category_label"], top["country"], top["asn"], fixed(top["mean_confidence"], 2))),
        F.when((good > 0) & F.col("origin_facts.tor"), SENTENCES["tor"]),
        F.when(lost > 0, F.format_string(SENTENCES["lost"], lost, plural(lost, "", "s"))),
        F.when(F.size("terminal_outputs") > 0, F.format_string(SENTENCES["out"], fixed(out["amount"], 4), out["address"].cast("string"), out["status"])),
    )


#: Parts of every document; one of an analysis with a graph network has gnn_drivers too.
PARTS = ("origins", "entities", "terminal_outputs", "factors", "transactions", "edges")
#: Parts of a document that are small by what they are: the largest outputs, one factor a signal, the first drivers.
BOUNDED = ("terminal_outputs", "factors", "gnn_drivers")


#: A part of documents: rows with case_root, their order within a case, the fields that a document says.
Part = tuple[DataFrame, list[Column], list[str]]


def _keyed(part: Part) -> DataFrame:
    """(case_root, x) of a part: x is a struct of a row's place and of what a document says of it, and sorts as documents do."""
    rows, order, fields = part
    return rows.select("case_root", F.struct(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("at"), F.struct(*fields).alias("item")).alias("x"))


def documents(cases: DataFrame, member: DataFrame, parts: dict[str, Part], most: int | None = None) -> DataFrame:
    """cases with an array of structs for each part, its name: (rows with case_root, order, fields), and origin_facts where origins
    are a part.

    A document is one row and has all of its case, however large. Whoever wants bounded rows gives `most`: parts that grow with a
    case are then gathered for cases of at most that many transactions; beyond, their arrays are null. BOUNDED parts and
    origin_facts, and with them the narrative, are there in any case. sizes() and told() need no row that grows.
    """
    out, fit = cases, None
    if most is not None:
        fit = F.broadcast(cases.filter(F.col("tx_count") <= most).select("case_root")) if cases.count() <= BROADCAST else cases.filter(F.col("tx_count") <= most).select("case_root")
    for name, (rows, order, fields) in parts.items():
        whole = fit is None or name in BOUNDED
        keyed = _keyed((rows if whole else rows.join(fit, "case_root"), order, fields))
        gathered = keyed.groupBy("case_root").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias(name))
        empty = F.coalesce(name, F.array().cast(gathered.schema[name].dataType))
        out = out.join(gathered, "case_root", "left").withColumn(name, empty if whole else F.when(F.col("tx_count") <= most, empty))
    if "origins" in parts:
        out = out.join(origin_facts(parts["origins"][0]), "case_root", "left")
    return out


def sizes(cases: DataFrame, parts: dict[str, Part]) -> DataFrame:
    """cases with n_<part>, the case's rows of each part: grouped counts, for cases of any size."""
    out = cases
    for name, (rows, _, _) in parts.items():
        out = out.join(rows.groupBy("case_root").agg(F.count("*").alias(f"n_{name}")), "case_root", "left")
    return out.fillna(0, [f"n_{name}" for name in parts])


def told(heads: DataFrame, parts: list[tuple[int, Part]], said: Callable[[Column, T.StructType], Column], fold: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """What fold makes of the cases' texts, each read from its first piece to its last.

    heads: (case_root, n, piece), at most one row for each n of a case; parts: at n, the part whose rows stand there, in their
    order; said: the piece of a row's item. fold sees Arrow batches (case_root, n, piece), a case's rows one after another and
    all in one task. They are sorted on disk and read once, so a text may be longer than any row or memory.
    """
    ship_package(heads.sparkSession)
    rows, kinds = heads.select("case_root", "n", "piece"), {}
    for n, part in parts:
        keyed = _keyed(part).select("case_root", F.lit(n).alias("n"), F.col("x").alias(f"x{n}"))
        kinds[f"x{n}"] = keyed.schema[f"x{n}"].dataType["item"].dataType
        rows = rows.unionByName(keyed, allowMissingColumns=True)
    dealt = rows.repartition("case_root").sortWithinPartitions("case_root", "n", *kinds)
    piece = F.coalesce("piece", *(F.when(F.col(x).isNotNull(), said(F.col(x)["item"], kind)) for x, kind in kinds.items()))
    return dealt.select("case_root", "n", piece.alias("piece")).mapInArrow(fold, schema)
