"""Training on small labelled captures, the bundle, the report against ground truth, the labelled-graph experiment."""

import json

import numpy as np
import pytest

from txintel import __main__ as cli
from txintel.operators import learn
from txintel.plans import stacking, training
from txintel.plans.analysis import analyse, evidence, prepare
from txintel.sources import elliptic, files


def write_capture(folder, seed):
    """Peeling chains announced by a Tor exit among plain payments of residential addresses; returns the folder."""
    rng = np.random.default_rng(seed)
    observations, ledger, truth = [], [], {}

    def add(txid, t, ip, ins, outs, label, kind, scenario):
        ledger.append({"txid": txid, "input_addresses": [a for a, _ in ins], "input_amounts": [x for _, x in ins], "output_addresses": [a for a, _ in outs], "output_amounts": [x for _, x in outs], "fee": 0.0001})
        observations.extend({"txid": txid, "timestamp": t + d, "src_ip": who, "dst_ip": s} for d, who, s in ((0.0, ip, "s1"), (0.05, ip, "s2"), (0.5 + rng.random(), f"91.0.0.{rng.integers(1, 99)}", "s1")))
        truth[txid] = {"label": label, "typology": kind, "scenario": scenario, "origin_ip": ip, "timestamp": t}

    for c in range(3):
        value = 20.0 + c
        for k in range(6):
            paid = round(value * 0.03, 6)
            add(f"{seed}-c{c}-{k}", 5000.0 * c + 90 * k, "185.220.101.7", [(f"{seed}w{c}.{k}", value)], [(f"{seed}w{c}.{k + 1}", value - paid), (f"{seed}p{c}.{k}", paid)], 1, "peeling", f"op{c}")
            value -= paid
    for k in range(40):
        x = float(rng.uniform(0.1, 3))
        add(f"{seed}-n{k}", float(rng.uniform(0, 20000)), f"73.0.{k}.9", [(f"{seed}a{k}", x)], [(f"{seed}b{k}", round(x * 0.6, 6)), (f"{seed}d{k}", round(x * 0.39, 6))], 0, "payment", None)
    folder.mkdir()
    (folder / "ledger.json").write_text(json.dumps(ledger))
    (folder / "seen.jsonl").write_text("\n".join(map(json.dumps, observations)))
    (folder.parent / f"{folder.name}-truth.json").write_text(json.dumps({"seed": seed, "transactions": truth}))
    return str(folder), str(folder.parent / f"{folder.name}-truth.json")


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    top = tmp_path_factory.mktemp("captures")
    return [write_capture(top / f"c{k}", k) for k in (1, 2, 3)]


def test_train_save_load_and_evaluate(spark, captures, tmp_path):
    load = lambda k: (files.load(spark, captures[k][0]), files.ground_truth(spark, captures[k][1]))
    bundle = training.train(spark, [load(0)], [load(1)], epochs=60)
    training.save(spark, bundle, str(tmp_path / "bundle"))
    again = training.load(spark, str(tmp_path / "bundle"))
    assert again.weights == pytest.approx(bundle.weights) and again.calibration == (pytest.approx(bundle.calibration[0]), pytest.approx(bundle.calibration[1])) and again.means == pytest.approx(bundle.means)
    result = analyse(spark, captures[2][0], again.settings())
    case = result["cases"].orderBy("case_id").first()
    assert len(case.gnn_drivers) == 4 and all(d.label for d in case.gnn_drivers)
    report = training.evaluate(result, files.ground_truth(spark, captures[2][1]))
    found = {r.detector: r for r in report["detectors"].collect()}
    assert set(found) == {"rule_baseline", "isolation_forest", "graphsage", "fused"}
    assert found["fused"].f1 > 0.85 and found["fused"].roc_auc > 0.95 and found["fused"].tp + found["fused"].fn == 18
    assert found["isolation_forest"].tp + found["isolation_forest"].fp == 18
    assert {r.typology: r.total for r in report["typologies"].collect()} == {"peeling": 18, "payment": 40}
    assert sum(r.total for r in report["origin"].collect()) == 58 and sum(r.correct for r in report["origin"].collect()) == 58
    assert {r.scenario: (r.covered, r.total) for r in report["scenarios"].collect()} == {f"op{c}": (6, 6) for c in range(3)}


def test_command_line(spark, captures, tmp_path):
    cli.main(["evaluate", captures[0][0], "--truth", captures[0][1], "--out", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out" / "stats")).first().transactions == 58
    assert spark.read.json(str(tmp_path / "out" / "evaluation" / "detectors")).count() == 4


def test_trainer_takes_200_000_nodes():
    rng = np.random.default_rng(0)
    n = 200_000
    x = rng.normal(size=(n, 5))
    src, dst = rng.integers(0, n, 230_000), rng.integers(0, n, 230_000)
    y = (x[:, 0] > 1).astype(float)
    net = learn.train_graph_net(x, src, dst, y, hidden=8, epochs=25, lr=0.05)
    p = learn.local_scores(net, x, src, dst)
    assert np.mean((p > 0.5) == (y > 0.5)) > 0.9


def test_local_scores_are_the_distributed_ones(spark):
    rng = np.random.default_rng(3)
    x, src, dst = rng.normal(size=(40, 4)), np.arange(39), np.arange(1, 40)
    net = learn.train_graph_net(x, src, dst, (x[:, 0] > 0).astype(float), hidden=5, epochs=5)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist())), "src long, dst long")
    got = {r.id: r.gnn_prob for r in net.scores(rows, edges).collect()}
    assert np.allclose([got[k] for k in range(40)], learn.local_scores(net, x, src, dst))


def test_experiment_on_a_labelled_graph(spark):
    rng = np.random.default_rng(5)
    n, d = 600, 4
    step = np.repeat(np.arange(1, 7), 100)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    rows = spark.createDataFrame([(k, int(step[k]), None if k % 5 == 0 else int(y[k]), x[k].tolist()) for k in range(n)], "id long, step int, y int, x array<double>")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1) if step[k] == step[k + 1]], "src long, dst long")
    got = {r.detector: r for r in training.experiment(elliptic.Graph(rows, edges), hidden=8, epochs=60, steps=((1, 3), (4, 4), (5, 6))).collect()}
    assert set(got) == {"logistic", "mlp", "graphsage", "isolation_forest"}
    positives = int(sum(y[k] for k in range(n) if step[k] >= 5 and k % 5))
    assert all(r.tp + r.fn == positives for r in got.values())
    assert got["logistic"].roc_auc > 0.9 and got["graphsage"].f1 > 0.6


def test_captures_in_one_pass_are_those_of_their_own_passes(spark, tmp_path):
    """18 captures go through one plan; four of them are held against plans of their own, forests and all."""
    loaded = [files.load(spark, write_capture(tmp_path / f"c{k}", 50 + k)[0]) for k in range(18)]
    all_ = prepare(spark, stacking.stack(loaded), locate=stacking.name("origin_ip"), part=(stacking.number(), stacking.name()))
    signals = ("peel_chain", "coinjoin", "velocity", "origin_burst", "anomaly", "confidence", "relay_ratio", "category", "burst")
    got = {}
    for r in stacking.bare(evidence(all_), "txid", "origin_ip").select("capture", "txid", "origin_ip", *signals).collect():
        got.setdefault(r.capture, {})[r.txid] = tuple(r)[2:]
    assert set(got) == set(range(18)) and all(len(v) == 58 for v in got.values())
    for k in (0, 7, 11, 17):
        want = {r.txid: tuple(r)[1:] for r in evidence(prepare(spark, loaded[k])).select("txid", "origin_ip", *signals).collect()}
        assert got[k] == want


def test_repeated_addresses_are_edges_each(spark):
    tx = spark.createDataFrame([("t", ["a", "a"], [1.0, 1.0], ["b", "b", "c"], [1.0, 0.5, 0.5], 0.0)], "txid string, input_addresses array<string>, input_amounts array<double>, output_addresses array<string>, output_amounts array<double>, fee double")
    seen = spark.createDataFrame([(1.0, "1.1.1.1", "s", "t", 0), (2.0, "1.1.1.2", "s", "t", 1), (3.0, "1.1.1.2", "s", "u", 2)], "timestamp double, src_ip string, dst_ip string, txid string, seq long")
    result = analyse(spark, files.Capture(seen, tx, spark.createDataFrame([], "file string, sha256 string, records bigint")), anomaly=False)
    s = result["stats"].first()
    assert (s.graph_edges, s.graph_nodes, s.wallet_addresses, s.origin_ips, s.observations, s.observed_txids, s.uncorrelated_observations, s.unobserved_transactions) == (6, 5, 3, 1, 3, 2, 1, 0)
    assert {r.severity: r.cases for r in result["case_severities"].collect()} == {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0}
