"""What an analyst looks up in finished cases: overview, leading cases, newest events, search, and a case's levels of flow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txintel.functions.expressions import SEVERITIES, exact_sum
from txintel.operators import cases as C
from txintel.runtime import checkpoint, release

#: Cases and events that reports show; limits of the reports.
TOP_CASES, FEED = 6, 40
#: What a search looks at in documents beside their id and typology, in this order: parts and their fields.
SEARCHED = {"origins": ("ip", "asn", "category_label"), "transactions": ("txid",), "terminal_outputs": ("address",)}


def overview(stats: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: announcements, transactions, the percentage with a resolved origin, entities, flagged transactions, cases by
    severity and what flowed into them. stats: one row of counters; cases: a case table. Without cases the sums are 0."""
    per = cases.agg(*(F.count(F.when(F.col("severity") == n, 1)).alias(f"{n.lower()}_cases") for _, n in SEVERITIES), F.coalesce(exact_sum("inflow"), F.lit(0.0)).alias("inflow"))
    share = F.when(F.col("transactions") > 0, F.round(100.0 * F.col("origin_attributed") / F.col("transactions"))).otherwise(0.0).cast("bigint")
    out = stats.crossJoin(F.broadcast(per))  # one row each
    return out.select("observations", "transactions", share.alias("resolved_pct"), "entities", "flagged_transactions", "cases", *(f"{n.lower()}_cases" for _, n in SEVERITIES), "inflow")


def case_counts(cases: DataFrame) -> DataFrame:
    """(severity, cases, inflow) of every level and of ALL."""
    levels = cases.sparkSession.createDataFrame([("ALL",), *((n,) for _, n in SEVERITIES)], "severity string")
    per = cases.select(F.explode(F.array(F.lit("ALL"), "severity")).alias("severity"), "inflow").groupBy("severity").agg(F.count("*").alias("cases"), exact_sum("inflow").alias("inflow"))
    return levels.join(per, "severity", "left").fillna(0, ["cases"]).fillna(0.0, ["inflow"])


def top_cases(cases: DataFrame, most: int = TOP_CASES) -> DataFrame:
    """The leading cases, by risk, inflow, time and root, as cases are ranked."""
    return cases.orderBy(F.desc("risk_score"), F.desc("inflow"), "first_ts", "case_root").limit(most)


def newest(events: DataFrame, at: str = "t", tie: str = "id", most: int = FEED) -> DataFrame:
    return events.orderBy(F.desc(at), F.desc(tie)).limit(most)


def case_by_id(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.filter(F.col("case_id") == case_id)


def alerts_with_cases(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Alerts (case_id, ...) with their case's typology, risk_score and severity; one whose case is gone has nulls."""
    return alerts.join(cases.select("case_id", "typology", "risk_score", "severity"), "case_id", "left")


def matches(text: str) -> Column:
    """Whether a case's document holds the text, in whatever case: in its id, typology, its origins' addresses, systems and
    networks, its transactions or its terminal outputs' addresses. An empty text is in every document."""
    wanted = text.strip().lower()
    said = [F.array("case_id", "typology"), *(_fields(array, *names) for array, names in SEARCHED.items())]
    return F.lower(F.array_join(F.concat(*said), " ")).contains(wanted)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _words(x: Callable[[str], Column], names: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *(_text(x(n)) for n in names))


def _fields(array: str, *names: str) -> Column:
    return F.coalesce(F.transform(array, lambda x: _words(lambda n: x[n], names)), F.array().cast("array<string>"))


def search(documents: DataFrame, text: str, severities: tuple[str, ...] | None = None) -> DataFrame:
    """Documents of the severities that hold the text."""
    found = documents.filter(matches(text))
    return found.filter(F.col("severity").isin(*severities)) if severities else found


def search_parts(cases: DataFrame, parts: dict[str, C.Part], text: str, severities: tuple[str, ...] | None = None) -> DataFrame:
    """Cases of the severities whose documents hold the text, as search() finds them, looked up in the parts' tables: documents
    aren't needed, so cases of any size are searched whole.

    What a document says is joined by spaces, so a text without a space is within one row of a part, or nowhere. One with spaces
    may run over several; a case's rows are then read in order, keeping no more than the text is long.
    """
    wanted = text.strip().lower()
    some = cases.filter(F.col("severity").isin(*severities)) if severities else cases
    heads = some.select("case_root", F.lower(F.concat_ws(" ", "case_id", "typology")).alias("piece"))
    if " " in wanted:
        own = some.select("case_root")
        looked = [(n, (rows.join(own, "case_root", "left_semi"), order, list(names))) for n, (names, (rows, order, _)) in enumerate(((names, parts[name]) for name, names in SEARCHED.items()), 1)]
        said = lambda x, kind: F.lower(_words(lambda n: x[n], tuple(kind.fieldNames())))
        found = C.told(heads.withColumn("n", F.lit(0)), looked, said, _holding(wanted), f"case_root {heads.schema['case_root'].dataType.simpleString()}")
    else:
        found = heads.filter(F.col("piece").contains(wanted)).select("case_root")
        for name, names in SEARCHED.items():
            found = found.unionAll(parts[name][0].filter(F.lower(_words(F.col, names)).contains(wanted)).select("case_root"))
        found = found.distinct()
    return some.join(found, "case_root", "left_semi")


def _holding(wanted: str) -> Callable[[Iterator], Iterator]:
    """For cases.told: the cases whose pieces, joined by spaces, hold the text."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        case, seen, hit = None, None, False
        for batch in batches:
            found = []
            for root, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != case or seen is None:
                    case, seen, hit = root, piece, False
                else:
                    seen = f"{seen} {piece}"
                if not hit and wanted in seen:
                    hit = True
                    found.append(root)
                seen = seen[1 - len(wanted) :]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field(0).type)], ["case_root"])

    return fold


def levels(member: DataFrame, flow: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(case_root, txid, depth): how many payments the longest way to a transaction within its case has.

    flow: (case_root, parent, child), without cycles. A transaction with one parent is a step from it: pointer doubling takes
    such runs to where they begin in log n joins. What then is left are transactions with several parents, and their levels
    settle after as many rounds as there are of these on one way. A case's transactions without parents are at level 0.
    """
    edges = checkpoint(flow.select("parent", "child").distinct())
    many = checkpoint(edges.groupBy("child").agg(F.count("*").alias("n")))
    run = checkpoint(edges.join(many.filter("n = 1"), "child").select(F.col("child").alias("at"), F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("hops")))
    while True:
        ahead = run.select(F.col("at").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"))
        last, run = run, checkpoint(run.join(ahead, "to", "left").select("at", F.coalesce("far", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("moved")))
        release(last)
        if not run.filter("moved").head(1):
            break
    begun = lambda df, at: df.join(run.select(F.col("at").alias(at), "to", "hops"), at, "left").withColumns({"begin": F.coalesce("to", at), "hops": F.coalesce("hops", F.lit(0))}).drop("to")
    merged = checkpoint(begun(edges.join(many.filter("n > 1").select("child"), "child"), "parent").select("begin", "child", (F.col("hops") + 1).alias("hops")))
    zero = F.lit(0).cast("bigint")
    level = checkpoint(merged.select(F.explode(F.array("begin", "child")).alias("begin")).distinct().withColumn("depth", zero))
    for _ in range(most_rounds):
        known = merged.join(level, "begin").groupBy(F.col("child").alias("begin")).agg(F.max(F.col("depth") + F.col("hops")).alias("deeper"))
        last, level = level, checkpoint(level.select("begin", F.col("depth").alias("was")).join(known, "begin", "left").select("begin", F.greatest("was", F.coalesce("deeper", zero)).alias("depth"), "was"))
        release(last)
        if not level.filter("depth <> was").head(1):
            break
        level = level.drop("was")
    else:
        raise RuntimeError(f"levels did not settle within {most_rounds} rounds; the flow has a cycle")
    placed = begun(member.select("case_root", "txid"), "txid").join(level.select("begin", "depth"), "begin", "left")
    return placed.select("case_root", "txid", (F.coalesce("depth", zero) + F.col("hops")).alias("depth"))
