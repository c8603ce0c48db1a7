"""Cases over the 100,000 transactions beyond which documents once had no arrays."""

from pyspark.sql import functions as F

from txintel.operators import cases as C
from txintel.operators import lookups as K
from txintel.plans import analysis, whole
from txintel.plans import operations as O
from txintel.plans.analysis import Settings, analyse

SF = "/root/testdata/sf0.001"
LARGE = C.DOCUMENT_ROWS + 1


def drawn(spark):
    """A large case, a small one and one without edges: a table and two parts that grow, with nulls and signs to be escaped."""
    table = spark.createDataFrame([(7, LARGE, 'a "b"\n', None), (8, 2, "ü", 0.1), (9, 1, "", -0.0)], "case_root long, tx_count long, word string, inflow double")
    rows = spark.range(LARGE + 3).select(F.when(F.col("id") < LARGE, 7).when(F.col("id") < LARGE + 2, 8).otherwise(9).cast("long").alias("case_root"), F.col("id").alias("txid"))
    tx = rows.select("*", (F.col("txid") % 100 / 7).alias("ts"), F.when(F.col("txid") % 3 > 0, F.concat(F.lit('é"\\'), F.col("txid").cast("string"))).alias("name"), F.array(F.col("txid") / 3, F.lit(None)).alias("evidence"))
    edges = rows.filter("case_root < 9").select("case_root", F.col("txid").alias("parent"), (F.col("txid") + 1).alias("child"))
    return table, {"transactions": (tx, [F.col("ts"), F.col("txid")], ["txid", "ts", "name", "evidence"]), "edges": (edges, [F.col("parent"), F.col("child")], ["parent", "child"])}


def test_documents_and_seals_have_all_of_a_large_case(spark):
    table, parts = drawn(spark)
    whole_ = analysis.sealed(C.documents(table, table, parts)).localCheckpoint()
    got = {r.case_root: (r.n, r.m, r.up) for r in whole_.select("case_root", F.size("transactions").alias("n"), F.size("edges").alias("m"), (F.array_sort("edges") == F.col("edges")).alias("up")).collect()}
    assert got == {7: (LARGE, LARGE, True), 8: (2, 2, True), 9: (1, 0, True)}
    seals = {r.case_root: r for r in analysis.seals(table, parts).collect()}
    assert {k: (r.n_transactions, r.n_edges) for k, r in seals.items()} == {k: v[:2] for k, v in got.items()}
    assert {k: r.evidence_hash for k, r in seals.items()} == {r.case_root: r.evidence_hash for r in whole_.select("case_root", "evidence_hash").collect()}


def test_seals_are_those_of_documents(spark):
    r = analyse(spark, O.capture(spark, SF), Settings(bias=O.BIAS), anomaly=False, locate=whole._located())
    grown = [n for n in C.PARTS if n not in C.BOUNDED]
    names = ["case_id", "narrative", "terminal_outputs", "terminal_output_count", "evidence_hash", *(f"n_{n}" for n in grown)]
    want = r["cases"].withColumns({f"n_{n}": F.size(n) for n in grown}).select(names)
    assert {tuple(map(str, x)) for x in r["case_seals"].select(names).collect()} == {tuple(map(str, x)) for x in want.collect()}


def bounded(monkeypatch):
    """Documents hold only cases of at most 4 transactions, as before only those of at most 100,000."""
    for made in (C.documents, analysis.documents):
        monkeypatch.setattr(made, "__defaults__", (4,))


def test_analysis_cases_need_no_documents(spark, monkeypatch):
    want = {tuple(r) for r in whole.analysis_cases(spark, SF).collect()}
    bounded(monkeypatch)
    got = whole.analysis_cases(spark, SF).collect()
    assert {tuple(r) for r in got} == want and all(r.n_transactions == r.tx_count for r in got) and max(r.tx_count for r in got) > 4


def test_operation_documents_need_no_documents(spark, monkeypatch):
    want = {tuple(r) for r in O.operation_documents(spark, SF).collect()}
    bounded(monkeypatch)
    got = O.operation_documents(spark, SF).collect()
    assert {tuple(r) for r in got} == want and all(r.n_transactions == r.tx_count for r in got) and max(r.tx_count for r in got) > 4


def test_operation_search_needs_no_documents(spark, monkeypatch):
    want = {tuple(r) for r in O.operation_search(spark, SF).collect()}
    bounded(monkeypatch)
    assert {tuple(r) for r in O.operation_search(spark, SF).collect()} == want


def test_search_of_parts_finds_what_documents_hold(spark):
    r = analyse(spark, O.capture(spark, SF), Settings(bias=O.BIAS), anomaly=False, locate=whole._located())
    docs, every = r["cases"], ("CRITICAL", "HIGH", "MEDIUM")
    large = docs.orderBy(F.desc("tx_count"), "case_root").first()
    at, origin = [str(t.txid) for t in large.transactions], large.origins[-1]
    held = ["", f"{at[0]} {at[1]} {at[2][:1]}", f"{origin.category_label[-3:]} {at[0]}".upper(), f"{at[-1]} {large.terminal_outputs[0].address[:2]}", f"{large.case_id} {large.typology[:3]}", f"{origin.asn} {origin.category_label}"]
    for text in (*held, "12", " As2", "no such text", f"{at[1]} {at[0]}"):
        want = {x.case_id for x in K.search(docs, text, every).collect()}
        assert {x.case_id for x in K.search_parts(r["case_table"], r.parts(), text, every).collect()} == want
        assert text not in held or large.case_id in want


def test_a_large_case_is_searched_whole(spark):
    """A text over the border of two rows, far behind what a document once held, in one case of 100,001 transactions."""
    table, parts = drawn(spark)
    cases = table.select("case_root", F.lit("HIGH").alias("severity"), F.concat(F.lit("CASE-"), F.col("case_root").cast("string")).alias("case_id"), F.lit("none").alias("typology"))
    none = spark.createDataFrame([], "case_root long, ip string, asn string, category_label string, address string")
    tx, _, fields = parts["transactions"]
    looked = {"origins": (none, [F.col("ip")], ["ip", "asn", "category_label"]), "transactions": (tx, [F.col("txid")], fields), "terminal_outputs": (none, [F.col("address")], ["address"])}
    find = lambda text: sorted(x.case_root for x in K.search_parts(cases, looked, text).collect())
    assert find("99999 100000") == [7] == find("CASE-7 None 0 1 2") and find("100000 99999") == find("100000 100001") == [] and find("100002") == [8] and find("case") == [7, 8, 9]
