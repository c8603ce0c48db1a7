"""Distributed back-propagation against the one on arrays."""

import time

import numpy as np

from txintel.operators import learn as L
from txintel.operators import train as T


def graph(spark, n=120, d=5, seed=0, known=0.8):
    """A random graph with a hub, repeated edges, loops, lone nodes and nodes without a label."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.where(rng.random(n) < known, (x[:, 0] + 0.2 * rng.normal(size=n) > 0.3).astype(float), np.nan)
    src, dst = rng.integers(0, n - 10, 3 * n), rng.integers(0, n - 10, 3 * n)
    dst[: n // 2] = 7
    src[-5:], dst[-5:] = src[:5], dst[:5]
    rows = spark.createDataFrame([(k, x[k].tolist(), None if np.isnan(y[k]) else float(y[k])) for k in range(n)], "id long, x array<double>, y double")
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), strict=True)), "src long, dst long")
    return x, y, src, dst, rows, edges


def test_gradient_is_the_one_on_arrays(spark):
    x, y, src, dst, rows, edges = graph(spark)
    mean, std = L.column_stats(rows)
    for clip in (None, 1.5):
        table = T.training_table(rows, edges, mean, std, clip)
        mask = ~np.isnan(y)
        pos = int((y == 1).sum())
        weight = np.where(y == 1, 0.5 / pos, 0.5 / (mask.sum() - pos)) * mask
        z = L.clipped((x - mean) / std, clip)
        rng = np.random.default_rng(3)
        p = [w + 0.1 * rng.normal(size=w.shape) for w in L.first_weights([5, 6, 6], 1)]
        want = L.graph_net_gradient(p, z, src, dst, np.nan_to_num(y), weight, 0.01)
        got = T.gradient(p, table, edges, 0.01)
        assert abs(got[0] - want[0]) < 1e-9
        assert all(u.shape == v.shape and np.abs(u - v).max() < 1e-9 for u, v in zip(got[1], want[1], strict=True))


def test_training_takes_the_same_steps_and_leaves_nothing_behind(spark):
    x, y, src, dst, rows, edges = graph(spark, n=60, seed=4)
    outside = edges.union(spark.createDataFrame([(3, 10**6), (10**6, 4)], "src long, dst long"))
    near = L.train_graph_net(x, src, dst, np.nan_to_num(y), 4, 3, mask=~np.isnan(y))
    far = T.train_graph_net(rows, outside, 4, 3)
    for u, v in zip((*near.layers[0], *near.layers[1], near.head[0]), (*far.layers[0], *far.layers[1], far.head[0]), strict=True):
        assert np.allclose(u, v, atol=1e-8)
    assert np.allclose(L.local_scores(near, x, src, dst), L.local_scores(far, x, src, dst))


def test_a_graph_too_large_for_the_driver_trains(spark):
    x, y, src, dst, rows, edges = graph(spark, n=300, seed=9)
    began = time.time()
    nets = [T.fit_graph_net(rows, edges, 4, 5, cells=cells) for cells in (None, 100)]  # 1,500 features are more than 100
    assert np.allclose(nets[0].layers[0][0], nets[1].layers[0][0], atol=1e-7)
    assert time.time() - began < 300


def test_rows_without_labels_or_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [0.0, 5.0], None)], "id long, x array<double>, y double")
    edges = spark.createDataFrame([], "src long, dst long")
    net = T.train_graph_net(rows, edges, 3, 2)
    assert all(np.isfinite(w).all() for layer in net.layers for w in layer)
