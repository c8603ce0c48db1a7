"""Exact and approximate search against brute force."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from txintel.llm import ann, topk


def table(spark, n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[100:350] = x[100]  # one very common vector
    return [(k, v.astype(float).tolist()) for k, v in enumerate(x)]


ODD = [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2020, [1.0, 2.0]), (2040, [3.0, 1.0]), (2060, [0.0] * 8)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS block", "4 AS dim")


def fine(rows, empty=True, zero=True):
    return [(k, v) for k, v in rows if k is not None and v is not None and (v or empty) and all(a is not None and np.isfinite(a) for a in v) and (zero or any(v))]


def brute(rows, every, k, score, empty=True, zero=True):
    """(query id, rank, id, score) of every query row, each row being a candidate of all others."""
    rows = fine(rows, empty, zero)
    out = Counter()
    for n, (q, a) in enumerate(rows):
        if q % every == 0:
            found = sorted((-score(a, b), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(found))
    return out


dot = lambda a, b: max(topk.LEAST, min(topk.MOST, sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))))
cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def told(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [3, 20, 2000])
def test_topk_exact(spark, k):
    rows = table(spark) + ODD
    assert told(topk.top_k(frame(spark, rows), k=k)) == brute(rows, 20, k, dot)


def test_topk_repeated_ids_large_values_and_empty(spark):
    rows = [(0, [1e9, -1e9]), (0, [2e9, 1.0]), (1, [1e9, 1e9]), (2, [-1e9, 5.0]), (20, [0.25, 0.5]), (20, [0.25, 0.5]), (40, []), (41, []), (41, [])]
    assert told(topk.top_k(frame(spark, rows))) == brute(rows, 20, 20, dot)
    assert told(topk.top_k(frame(spark, [(0, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [9.0, 0.0]), (2, [24.0, 24.0])]))) == Counter({(0, 1, 2, 64 * 64 * 24): 1, (0, 2, 1, 4096): 1, (0, 3, 1, 0): 1})
    assert topk.top_k(frame(spark, [])).count() == 0


def test_topk_query_alone_in_its_length(spark):
    rows = [(k, [float(k), 1.0]) for k in range(50)]
    for alone in (-20, 30 * 20, 60):
        got = topk.top_k(frame(spark, [*rows, (alone, [1.0, 2.0, 3.0])]), k=3).collect()
        assert sorted(r.query_id for r in got) == [0] * 3 + [20] * 3 + [40] * 3


def test_topk_sql_agrees_on_odd_rows(spark):
    rows = [*table(spark, 380), *ODD, (20, [1.0] * 8), (20, [2.0] * 8), (7, [3.0] * 8), (7, [3.0] * 8)]
    c = duckdb.connect()
    c.register("given", pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    c.sql("CREATE VIEW embeddings AS SELECT * FROM given")
    assert Counter(c.sql(topk.OP1_SQL).fetchall()) == told(topk.top_k(frame(spark, rows)))


def test_topk_many_blocks(spark, monkeypatch):
    for name, value in (("CANDIDATES", 90), ("QUERIES", 3)):
        monkeypatch.setattr(topk, name, value)
    rows = table(spark) + [(20, [5.0] * 8)]
    assert told(topk.top_k(frame(spark, rows), k=7)) == brute(rows, 20, 7, dot)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_ann_recall_and_exact_scores(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in v.collect()]
    got = ann.nearest(v).collect()
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    by = dict(rows)
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    recalls = []
    for q in ids[ids % 50 == 0]:
        near = unit @ unit[ids == q][0]
        near[ids == q] = -2
        recalls.append(len(found[q] & set(ids[np.argsort(-near)[:5]].tolist())) / 5)
    assert np.mean(recalls) >= 0.93
    assert all(abs(r.score - cos(by[r.query_id], by[r.vec_id])) < 1e-12 for r in got)


@pytest.mark.parametrize(("n", "touches"), [(40, 1.0), (500, 0.85), (2000, 0.65), (8192, 0.4), (50_000, 0.4)])
def test_forest_touches_and_verifies_few_and_finds_nine_tenths(n, touches):
    """Near-uniform vectors, the hardest: recall at 5 over all blocks, rows under the prefixes and rows verified in each."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    queries = np.arange(0, n, max(4, n // 120))
    best: dict = {q: [] for q in queries.tolist()}
    shares = []
    for at in np.array_split(np.arange(n), -(-n // ann.CANDIDATES)):
        forest = ann.Forest(at, at, x[at])
        for i, found, s, cost, seen in ann.search(forest, queries, x[queries], 5):
            assert cost <= max(ann.SHARE_ROWS, 0.12 * len(at) + 1)
            shares.append(seen / len(at))
            best[int(queries[i])] += zip(s.tolist(), at[found].tolist())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, got in best.items():
        near = unit @ unit[q]
        near[q] = -2
        hits += len({k for _, k in sorted(got, reverse=True)[:5]} & set(np.argsort(-near)[:5].tolist()))
    told = (n, hits / (5 * len(queries)), np.mean(shares), max(shares))
    print(told)
    assert hits / (5 * len(queries)) >= 0.9, told
    assert np.mean(shares) <= touches, told


def test_forest_slices_are_prefix_matches_and_longest_is_the_longest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[250:] = x[3]
    f = ann.Forest(np.arange(300), np.arange(300), x, trees=16, bits=20, pool=64)
    q = np.vstack([rng.normal(size=(20, 8)), x[3], x[5]])
    but = np.array([-1] * 20 + [3, 5])
    own, all_ = ann.codes(q, f.pool, 16, 20), ann.codes(x, f.pool, 16, 20)
    for d in (1, 5, 12, 13, 20):
        a, b = f.slices(own, d)
        for t in range(16):
            for i in range(len(q)):
                assert set(f.order[t, a[t, i] : b[t, i]]) == set(np.flatnonzero(all_[t] >> (20 - d) == own[t, i] >> (20 - d)))
    shared = lambda u, v: 20 - int(u ^ v).bit_length()
    assert f.longest(own, but).tolist() == [max(shared(all_[t, r], own[t, i]) for t in range(16) for r in range(300) if r != but[i]) for i in range(len(q))]
    for i, (votes, depth) in enumerate(f.ascend(q, but, 60)):
        held = lambda d, i=i: np.array([0 if r == but[i] else sum(all_[t, r] >> (20 - d) == own[t, i] >> (20 - d) for t in range(16)) for r in range(300)])
        want = max((d for d in range(1, 21) if np.count_nonzero(held(d)) >= 60), default=0)
        assert depth == want and np.count_nonzero(votes) >= min(60, 299)
        assert (votes <= held(want)).all() and (want == 20 or (votes >= held(want + 1)).all())


def test_ann_ties_and_odd_rows(spark):
    rows = table(spark) + ODD + [(50, [1.0] * 8), (51, [1.0] * 8), (51, [-1.0] * 8)]
    got = ann.nearest(frame(spark, rows), every=50).collect()
    same = [r for r in got if r.query_id == 150]
    assert [r.vec_id for r in sorted(same, key=lambda r: r.rank)] == [100, 101, 102, 103, 104]
    assert Counter(r.query_id for r in got) == Counter({q: n * min(5, len(rows)) for q, n in Counter(q for q, _ in fine(rows, False, False) if q % 50 == 0).items()})
    assert any(r.query_id == 50 and r.rank == 1 and r.vec_id == 51 and abs(r.score - 1) < 1e-12 for r in got)
    small = ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0])]), every=50).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in small] == [(0, 1, 1)]
    assert ann.nearest(frame(spark, [])).count() == 0
