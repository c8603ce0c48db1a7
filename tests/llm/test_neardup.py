"""Near duplicates by shingle sets against brute force, with planted copies."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.util import SF, odd_docs, words
from txintel.llm import neardup as N
from txintel.llm import simhash


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_groups(rows):
    """rows: (id, text) -> the groups of ids linked by Jaccard 0.8 or more."""
    sets = {}
    for k, t in rows:
        sets.setdefault(shingles(t), set()).add(k)
    groups = []
    for s, ids in sets.items():
        near = [g for g in groups if any(5 * len(s & o) >= 4 * len(s | o) for o in g[0])]
        groups = [g for g in groups if not any(g is x for x in near)] + [({s}.union(*(g[0] for g in near)), ids.union(*(g[1] for g in near)))]
    return [g[1] for g in groups]


def planted():
    """(id, text): copies with some words replaced, at similarities around and over 0.8, chains of them, and a common line."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for group in range(30):
        base = [word() for _ in range(rng.choice((20, 60, 200, 400)))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 40))):
                copy[k] = word()
            rows.append((len(rows), " ".join(copy)))
            if group % 3 == 0:
                base = copy
    line = "this common line stands in every one of these documents for all to read "
    rows += [(len(rows) + k, line + " ".join(word() for _ in range(rng.randint(0, 5)))) for k in range(60)]
    exact = [word() for _ in range(94)]
    # 90 shingles; the next has 80 of them and 10 others, which is 0.8 exactly
    rows += [(900, " ".join(exact)), (901, " ".join(exact[:84] + [word() for _ in range(10)]))]
    return rows


def test_stage_finds_all_planted_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect())
    groups = brute_groups(rows)
    assert got == sorted(min(g) for g in groups)
    assert 900 in got and 901 not in got
    assert len(got) < simhash.near_dedup(docs).count()


def test_crowded_buckets_change_no_result(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "crowd", lambda *_: 2.0)
    assert sorted(r.doc_id for r in N.near_dedup(docs).collect()) == sorted(min(g) for g in brute_groups(rows))


@pytest.mark.parametrize("similar, least", [(0.8, 0.99), (0.85, 0.998), (0.9, 0.999)])
def test_pairs_at_the_threshold_are_found(similar, least):
    """Recall of the plan on pairs of sets of just that similarity, and that no such pair is dropped by fingerprints."""
    rng = np.random.default_rng(7)
    bits, other, word_ok, all_ok = [], [], 0, 0
    for _ in range(1500):
        n = int(rng.integers(20, 600))
        both = round(2 * n * similar / (1 + similar))
        h = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = (np.unpackbits(np.frombuffer(N.wide_fingerprint(x), np.uint8)) for x in (h[:n], h[n - both :]))
        word_ok += (a[: 64 * N.CHECKED] != b[: 64 * N.CHECKED]).sum() <= N.most_apart(64 * N.CHECKED, 80, N.WORD_SLACK, n < N.FEW)
        all_ok += (a != b).sum() <= N.most_apart(len(a), 80, N.SLACK, n < N.FEW)
        bits.append(a), other.append(b)
    a, b = np.array(bits), np.array(other)
    parts, limits = N.plan_parts(a[:1000].astype(np.float32), 150_000, 80)
    found = np.zeros(len(a), bool)
    for part, t in zip(parts, limits, strict=True):
        found |= (a[:, part] != b[:, part]).sum(axis=1) <= t
    assert found.mean() >= least and word_ok >= 0.998 * len(a) and all_ok >= len(a) - 1


def test_a_crowd_of_copies_that_are_hardly_alike(spark, monkeypatch):
    """Copies of one text with more and more words changed: about half are linked over it, the others to nothing or each other."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 14)):
            copy[at] = f"x{rng.randrange(60)}"
        rows.append((k, " ".join(copy)))
    groups = brute_groups(rows)
    assert len(groups) > 50 and max(map(len, groups)) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 60):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "crowd", lambda *_: 8.0)
        assert sorted(r.doc_id for r in N.near_dedup(docs).collect()) == sorted(min(g) for g in groups)


def test_odd_rows_on_the_table(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    least = [min((k for k in g if k is not None), default=None) for g in brute_groups(rows)]
    kept = N.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else 10**9 for r in kept.collect()) == sorted(10**9 if k is None else k for k in least)
    assert N.near_dedup(docs.limit(0)).count() == 0
