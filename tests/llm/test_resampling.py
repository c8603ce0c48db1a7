"""Importance resampling against a plain version and SQL; ranks by regular sampling against sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import SF, empty_docs, lower, odd_docs
from txintel.llm import resampling as R


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(docs, target):
    """(id, n_features, weight, score, rank) of each (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out, enough = [], []
    for k, x in docs:
        words, f = plain_features(x)
        weight = math.floor(sum(gain[bucket(v)] for v in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        enough += [len(out) - 1] if words >= 20 else []
    enough.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    for rank, i in enumerate(enough[: 25 * len(enough) // 100]):
        out[i][4] = rank + 1
    return Counter(map(tuple, out))


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.fixture
def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_whole_table_and_odd_rows(spark, target):
    docs = odd_docs(spark)
    rows, goal = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()]
    got = told(R.resample(docs, target))
    assert got == plain(rows, goal)
    assert got[(-2, 0, 0, R.gumbel(-2), None)] == 1


def test_sql_agrees(spark, target):
    docs = odd_docs(spark)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r.doc_id for r in docs.collect()], pa.int64()), "text": [r.text for r in docs.collect()]}))
    c.register("benchmark", pa.table({"text": [r.text for r in target.collect()]}))
    assert Counter(c.execute(R.OP13_SQL).fetchall()) == told(R.resample(docs, target))


def test_empty_tables(spark, target):
    assert R.resample(empty_docs(spark), target).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(R.resample(docs, target.limit(0))) == plain(rows, [])


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = ("One two-THREE été " * 50 + "\x1c漢字 " + "w" * 300).encode()
    want = plain_features(text.decode())
    found = lambda: (sum(n for n, _ in R.features(text)), Counter(x for _, c in R.features(text) for x in c.tolist()))
    assert found() == (want[0], Counter(zlib.crc32(f.encode()) for f in want[1]))
    monkeypatch.setattr(R, "chunks", lambda t: __import__("txintel.llm.text", fromlist=["x"]).chunks(t, 7))
    assert found() == (want[0], Counter(zlib.crc32(f.encode()) for f in want[1]))


@pytest.mark.parametrize(("n", "runs", "rows"), [(0, 4, 10), (1, 4, 10), (5000, 3, 100), (5000, 40, 37), (5000, 7, 10_000)])
def test_ranks_are_exact_and_buckets_even(spark, n, runs, rows):
    rng = np.random.default_rng(n + runs)
    data = [(int(i) if i % 17 else None, int(s), k) for k, (i, s) in enumerate(zip(rng.integers(0, 900, n), np.where(rng.random(n) < 0.4, 7, rng.integers(-50, 50, n)), strict=True))]
    df = spark.createDataFrame(data, "id long, score long, more long").repartition(9)
    got = R.ranked(df, runs, rows).collect()
    assert sorted(r.more for r in got) == list(range(n))
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, n + 1))
    order = lambda i, s: (-s, i is None, i or 0)
    assert [order(r.id, r.score) for r in sorted(got, key=lambda r: r.rank)] == sorted(order(i, s) for i, s, _ in data)


def test_a_third_of_all_rows_alike_is_dealt_to_many_buckets(spark):
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 1, id) AS id", "if(id % 3 = 0, 5L, id % 100) AS score").repartition(6)
    out = R.ranked(df, 6, 100)
    sizes = [r["count"] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(sizes) > 80 and max(sizes) <= 2 * 100 + 6
