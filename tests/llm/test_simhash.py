import random

import numpy as np
import pytest
import xxhash

from txintel.llm import simhash as S

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        w = w.replace(bytes([c]), b" ")
    w = [x for x in w.split(b" ") if x]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fp) -> {id: least id reachable}."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    fps = sorted({f for _, f in rows})
    for i, a in enumerate(fps):
        root(a)
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in rows}


def test_fingerprint_matches_definition():
    texts = ["", None, "One", "a b c d", "A b  c\td\ne f g h i", "x " * 40000, "é È ß " * 9, "w" * 3000000]
    assert [S.fingerprint(None if t is None else t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def signed(x):
    return int(np.uint64(x).view(np.int64))


def linked(spark, fps, radius=4):
    got = S.hamming_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), radius).collect()
    return {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in got}, len(got)


def groups(nodes, links):
    """Components of all nodes as a set of frozensets."""
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    out = {}
    for x in nodes:
        out.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def some_fingerprints(seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for r in range(1, 7):
            x = b
            for k in rng.sample(range(64), r):
                x ^= 1 << k
            fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("crowded", [None, 2.0])
def test_links_are_links_and_make_all_components(spark, monkeypatch, crowded):
    """Every pair given is a link, and no link between components is lost, whether buckets count as crowded or not."""
    if crowded:
        monkeypatch.setattr(S, "crowd", lambda *_: crowded)
    fps = some_fingerprints()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4}
    got, n = linked(spark, fps)
    assert n == len(got) and got <= want | {(b, a) for a, b in want}
    assert groups(fps, got) == groups(fps, want)


def test_dense_groups_cost_stars_not_pairs(spark):
    """Mutually near fingerprints: links grow with their number, not with its square, and components equal brute force."""
    rng = random.Random(9)
    for n in (500, 1000, 2000):
        base = rng.getrandbits(64)
        near = [base] + [base ^ 1 << i for i in range(64)] + [base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
        rng.shuffle(near)
        got, k = linked(spark, sorted(near[:n]))
        assert groups(near[:n], got) == {frozenset(near[:n])} and k <= 6 * n


def test_thresholds_that_probe_find_the_same(spark, monkeypatch):
    """A plan with balls of values to probe, as a large table would get."""
    fps = some_fingerprints(4)
    small = S.plan_probes
    monkeypatch.setattr(S, "plan_probes", lambda sample, n, radius: small(sample, 10**8, radius))
    want = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4}
    got, _ = linked(spark, fps)
    assert got <= want | {(b, a) for a, b in want} and groups(fps, got) == groups(fps, want)


def test_plans_obey_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500).astype(np.uint64)
    seen = set()
    for n in (10, 10**5, 10**8, 10**11):
        parts, limits = S.plan_probes(sample, n, 4)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in limits) == 5
        seen.add(len(parts))
    assert len(seen) > 1


def test_components_on_the_table_and_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a b c d e"), (-5, None), (-4, ""), (-3, "a b c d e"), (-3, "a b c d e"), (-2, "q " * 50000)], "doc_id long, text string")
    both = docs.union(odd).selectExpr("*", "1 AS fp", "'x' AS component_id")
    got = S.simhash_components(both.select("doc_id", "text", "fp", "component_id")).collect()
    rows = [(r.doc_id, r.fp & (2**64 - 1)) for r in got]
    assert sorted(rows, key=str) == sorted(((r.doc_id, brute_fingerprint(r.text)) for r in both.select("doc_id", "text").collect()), key=str)
    want = brute_components(rows)
    assert all(r.component_id == want[(r.doc_id, r.fp & (2**64 - 1))] for r in got)


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
