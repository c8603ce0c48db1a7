"""The corpus pipeline: each stage against its operator's results, and the whole run."""

from collections import Counter

import corpus_pipeline as P
from tests.llm.test_neardup import brute_groups
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.util import SF, odd_docs
from txintel.llm import langid, simhash


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(0)).unionByName(spark.createDataFrame([(-1, "!!!", "en", "src0", 3), (-2, None, None, None, 0), (-3, "zqxw kvjx qqzz wxkj " * 200, None, "src1", 9)], docs.schema))
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        before = docs.collect()
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        assert set(after) <= set(before)
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {-1, -2, -3}
            assert len(after) > 0.97 * (len(before) - 3)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in after) == sorted(min(g) for g in brute_groups([(r.doc_id, r.text) for r in before]))
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())


def test_run_is_the_stages(spark):
    a, b = (Counter(tuple(r) for r in P.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_dedup_with_repeated_rows_and_null_ids(spark):
    docs = odd_docs(spark)
    kept = simhash.near_dedup(docs).collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = brute_components(rows)
    assert len(kept) == len({least[x] for x in rows} - {None}) + len({f for d, f in rows if least[d, f] is None})
    assert Counter(r.doc_id for r in kept)[-5] == 1


def test_stages_of_odd_rows_keep_their_columns(spark):
    """Nulls in every column, repeats, long and empty texts, and extra columns with names that the stages use themselves."""
    docs = odd_docs(spark).selectExpr("*", "1 AS __key", "2 AS __id", "'x' AS __score", "3 AS __words", "4 AS c0_", "true AS __rejected", "5 AS __u", "6 AS __digest")
    before = Counter(tuple(r) for r in docs.collect())
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = Counter(tuple(r) for r in out.collect())
        assert set(after) <= set(before) and after, name
        if name != "source_mix":
            assert after <= before, name
    last = P.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r[0] for r in before.elements())


def test_empty_tables(spark, tmp_path):
    """Every stage and the whole run over tables without rows, and over documents that are all rejected."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], empty.schema)
    for name, stage in P.STAGES[2:]:
        assert stage(spark, one, SF).count() == (name != "source_mix"), name


def test_language_stage_rejects_what_the_operator_rejects(spark):
    docs = odd_docs(spark)
    judged = langid.identify(docs, langid.train(docs), prefix="p_").filter("not p_rejected")
    assert P.language_id(spark, docs, SF).count() == judged.count()
