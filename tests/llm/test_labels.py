"""Buckets are labelled through their nodes."""

from txintel.llm import simhash as S


def test_labels_meet_nodes_once(spark, monkeypatch):
    """Components are joined to nodes, one row each, never to the many bucket rows that a node has."""
    seen = []
    real = S.bucket_links
    monkeypatch.setattr(S, "bucket_links", lambda nodes, index, *more: real(nodes, lambda df: seen.append(df) or index(df), *more))
    fps = spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40, (1 << 40) + 1, 0x5555555555555555)], "fp long")
    got = {(r.a, r.b) for r in S.hamming_links(fps, 4).collect()}
    assert {(0, 1), (1 << 40, (1 << 40) + 1)} <= got and not any(0x5555555555555555 in p for p in got)
    assert len(seen) == 2 and all(df.count() == 6 and {"component", "grouped"} <= set(df.columns) for df in seen)


def test_components_are_joined_to_nodes_once(spark, monkeypatch):
    seen = []
    real = S.bucket_links
    monkeypatch.setattr(S, "bucket_links", lambda nodes, index, *more: real(nodes, lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or index(df), *more))
    fps = [0, 1, 3, 1 << 40, (1 << 40) + 7, 1 << 63]
    S.hamming_links(spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp bigint")).collect()
    assert len(seen) == 2 and not any("Join" in plan for plan in seen)  # each search would run the join again
