"""MinHash near-duplicates against brute force, planted copies and SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_neardup import planted
from tests.llm.util import SF, empty_docs, odd_docs, words
from txintel.llm import minhash as M


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """(id, n_shingles, component_id, kept) of each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    groups = []
    for s in set(sets) - {frozenset()}:
        near = [g for g in groups if any(100 * len(s & o) >= 80 * len(s | o) for o in g)]
        groups = [g for g in groups if not any(g is x for x in near)] + [{s}.union(*near)]
    least = {}
    for g in groups:
        ids = [k for (k, _), s in zip(rows, sets, strict=True) if s in g and k is not None]
        least |= dict.fromkeys(g, min(ids, default=None))
    out = Counter()
    for (k, _), s in zip(rows, sets, strict=True):
        c = least[s] if s else k
        out[(k, len(s), c, None if k is None or c is None else k == c)] += 1
    return out


def told(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_whole_table_and_odd_rows(spark):
    docs = odd_docs(spark)
    assert told(M.minhash_components(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert M.minhash_components(empty_docs(spark)).count() == 0
    assert told(M.minhash_components(frame(spark, [(None, "a b c d e"), (None, "a b c d e"), (3, None), (3, "")]))) == Counter({(None, 2, None, None): 2, (3, 0, 3, True): 2})


def test_all_planted_copies(spark):
    rows = planted()
    assert told(M.minhash_components(frame(spark, rows))) == brute(rows)


def alike(rng, many=260):
    """Near copies of one text, some only linked over others, and texts that share half of their words but aren't links."""
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    rows = []
    for k in range(many):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    for k in range(many):
        rows.append((many + k, " ".join(base[:110] + [f"u{rng.randrange(10**6)}" for _ in range(50)])))
    return rows


@pytest.mark.parametrize(("rounds", "block"), [(4, 1024), (1, 40), (0, 40)])
def test_stars_and_blocks_find_the_same(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = alike(random.Random(3))
    docs = frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS key_")
    prints = M.checkpoint(M.signed(docs, "key_", "doc_id", "text"))
    nodes = M.checkpoint(prints.groupBy("node").agg(*(M.F.first(c).alias(c) for c in ("size", "bands", "bits")), M.F.min("key").alias("row"), M.F.min("id").alias("least")))
    _, links = M.set_components(nodes, docs, "text", "key_", rounds=rounds)
    name = {r.node: r.least for r in nodes.collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for r in links.collect():
        a, b = sorted((root(name[r.a]), root(name[r.b])))
        parent[b] = a
    ids = {t: k for k, t in reversed(rows)}
    assert {k: root(ids[t]) for k, t in rows} == {k: c for k, _, c, _ in brute(rows)}
    if rounds == 4:
        assert links.count() < 4 * len(rows)  # a star or so, not all pairs


def test_signatures_agree_by_similarity_and_small_sets_too():
    rng = np.random.default_rng(0)
    signer = M.Signer()
    for size, common, apart in ((5, 4, 0), (9, 8, 1), (40, 36, 4), (300, 280, 20), (2000, 1500, 400), (5000, 2500, 2500)):
        shares, off = [], []
        for _ in range(30):
            x = rng.integers(0, 2**64, size + apart, np.uint64)
            s = np.stack([signer.sign(np.sort(v)) for v in (x[:size], x[size - common :])])
            shares.append((s[0] == s[1]).mean())
            b = signer.bits(s).view(np.uint64)
            off.append(int(np.bitwise_count(b[0] ^ b[1]).sum()))
        similarity = common / (size + apart)
        assert abs(np.mean(shares) - similarity) < 0.05, (size, np.mean(shares), similarity)
        if similarity >= 0.8:
            assert max(off) <= M.most_apart(np.array([float(size)]), 80)[0]


def test_densification_is_the_first_filled_bin_in_order():
    rng = np.random.default_rng(1)
    signer = M.Signer()
    for n in (1, 3, 33, 200, 4000):
        own = np.unique(rng.integers(0, 2**64, n, np.uint64))
        h = np.sort(M._mixed(own ^ np.uint64(M._SEED)))
        least = {}
        for v in h.tolist():
            least.setdefault(v >> 55, v)
        got = signer.sign(own).tolist()
        for k in range(M.BINS):
            assert got[k] == least[k if k in least else next(j for j in signer.order[k].tolist() if j in least)]
    assert (1 - 0.8**M.ROWS) ** M.BANDS < 1e-5


@pytest.mark.parametrize("sf", [SF, "odd"])
def test_sql_agrees(spark, sf):
    docs = odd_docs(spark) if sf == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r.doc_id for r in rows], pa.int64()), "text": [r.text for r in rows]}))
    assert Counter(c.execute(M.OP11_SQL).fetchall()) == told(M.minhash_components(docs))
