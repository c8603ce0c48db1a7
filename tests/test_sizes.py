"""Shuffles that grow with the tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from txintel import runtime
from txintel.plans import ledger, registry

SF = "/root/testdata/sf0.001"
NUMBER, JOINED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_grow_with_the_input_and_settings_come_back(spark):
    before, seen = (spark.conf.get(NUMBER), spark.conf.get(JOINED)), []

    def query(spark, sf):
        seen.append((int(spark.conf.get(NUMBER)), spark.conf.get(JOINED)))
        return runtime.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))

    rows = runtime.table(spark, SF, "lineitem").count()
    want = {(r.l_orderkey, r.n) for r in query(spark, SF).collect()}
    seen.clear()
    for each, task_rows in ((1, rows), (1, rows // 40), (3, rows // 40)):
        assert {(r.l_orderkey, r.n) for r in runtime.sized(query, "lineitem", each, task_rows)(spark, SF).collect()} == want
    assert seen[0] == (int(before[0]), before[1]) and 40 <= seen[1][0] <= 41 and 120 <= seen[2][0] <= 123 and seen[1][1] == str(runtime.TASK_BYTES)
    assert (spark.conf.get(NUMBER), spark.conf.get(JOINED)) == before
    with pytest.raises(ZeroDivisionError):
        runtime.sized(lambda s, d: s.range(1 // 0), "lineitem", 1, 10)(spark, SF)
    assert (spark.conf.get(NUMBER), spark.conf.get(JOINED)) == before


@pytest.mark.parametrize("name", ["tx_degrees", "hetero_graph_counts", "case_flow"])
def test_results_are_the_same_at_any_number_of_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(runtime, "TASK_ROWS", 600)
    got = registry.QUERIES[name](spark, SF)
    assert got.count() and got.exceptAll(ledger.QUERIES[name](spark, SF)).count() == 0
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    assert got.count() == c.sql(f"SELECT count(*) FROM ({registry.ORACLE_SQL[name]})").fetchall()[0][0]
