"""Levels of flow, search and large cases."""

import random

from txintel.operators import cases as C
from txintel.operators import lookups as K
from txintel.plans import operations as O
from txintel.plans.analysis import Settings, analyse
from txintel.plans import analysis, whole

SF = "/root/testdata/sf0.001"


def test_levels_are_longest_ways(spark):
    rng = random.Random(4)
    edges = [(0, k, k + 1) for k in range(70)] + [(0, 5, 40), (0, 71, 30)]  # a long run with a short cut and a second way in
    for case in range(1, 30):
        n = rng.randint(1, 14)
        edges += [(case, 1000 * case + a, 1000 * case + b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
    nodes = {(c, v) for c, a, b in edges for v in (a, b)} | {(50, 50_000)}
    depth = dict.fromkeys(nodes, 0)
    for c, a, b in sorted(edges, key=lambda e: e[1]) * 2:
        depth[c, b] = max(depth[c, b], depth[c, a] + 1)
    for _ in range(20):
        for c, a, b in edges:
            depth[c, b] = max(depth[c, b], depth[c, a] + 1)
    got = K.levels(spark.createDataFrame(sorted(nodes), "case_root long, txid long"), spark.createDataFrame(edges, "case_root long, parent long, child long"))
    assert {(r.case_root, r.txid): r.depth for r in got.collect()} == depth
    empty = K.levels(spark.createDataFrame([(1, 7)], "case_root long, txid long"), spark.createDataFrame([], "case_root long, parent long, child long"))
    assert [tuple(r) for r in empty.collect()] == [(1, 7, 0)]


def test_large_cases_keep_their_narrative_and_bounded_parts(spark, monkeypatch):
    """The same documents with arrays for cases of at most 4 transactions: nothing but what grows with a case goes."""
    told = []
    for most in (C.DOCUMENT_ROWS, 4):
        monkeypatch.setattr(analysis.documents, "__defaults__", (most,))
        result = analyse(spark, O.capture(spark, SF), Settings(bias=O.BIAS), anomaly=False, locate=whole._located())
        told.append({r.case_id: r for r in result["cases"].collect()})
    large = [k for k, r in told[0].items() if r.tx_count > 4]
    assert len(large) > 5 and set(told[0]) == set(told[1])
    for k, r in told[1].items():
        assert r.narrative == told[0][k].narrative and r.terminal_outputs == told[0][k].terminal_outputs and r.factors == told[0][k].factors and r.notes and r.typology_tags == r.typology.split(" + ")
        assert (r.transactions is None) == (k in large) == (r.edges is None) == (r.origins is None)
    first = told[0]["CASE-001"]
    wanted = {"risk_score", "mean_risk", "severity", "typology", "typology_tags", "tx_count", "inflow", "peel_hops", "peeled", "first_ts", "last_ts", "duration", "origins", "entities", "terminal_outputs", "terminal_output_count", "factors", "base_value_log_odds", "transactions", "edges", "notes", "narrative", "case_id", "evidence_hash"}
    assert wanted <= set(first.asDict())
    card = {r.key: r for r in result["model_card"].collect()}
    assert set(card) == set(O.WEIGHTS) and card["coinjoin"].absent_label and result["model"].first().bias == O.BIAS
    assert abs(result["model"].first().base_value_log_odds - (O.BIAS + sum(O.WEIGHTS[k] * r.background for k, r in card.items()))) < 1e-2
    said = result["meta"].first()
    assert len(said.model_sha256) == 64 and said.model_sha256 == Settings(bias=O.BIAS).digest() != Settings().digest()
    assert result["timeline_span"].first().bucket_s > 1
    hits = K.search(result["cases"].filter("tx_count <= 4"), " As", ("HIGH", "CRITICAL", "MEDIUM")).count()
    assert hits == result["cases"].filter("tx_count <= 4").count()  # every case has an origin in some system
    assert K.case_by_id(result["case_table"], "CASE-001").count() == 1
