"""The bounded graph that graphsage_score trains on, against the whole graph."""

import numpy as np

from txintel.operators import learn as L
from txintel.plans import learning


def test_sampled_targets_keep_their_neighbourhoods(spark):
    rng = np.random.default_rng(0)
    n = 400
    x, label = rng.normal(size=(n, 3)), rng.integers(0, 3, n)
    pairs = sorted({(k, d) for k in range(n) for d in ((k * 7 + 3) % n, (k + 1) % n) if d != k})
    src, dst = (np.array(v) for v in zip(*pairs, strict=True))
    rows = spark.createDataFrame([(k, x[k].tolist(), int(label[k])) for k in range(n)], "id long, x array<double>, label long")
    edges = spark.createDataFrame([*pairs, (5, 10**6)], "src long, dst long")
    p = [rng.normal(size=s) for s in ((3, 4), (3, 4), (3, 4), (4,), (4, 4), (4, 4), (4, 4), (4,), (4,), (1,))]
    for targets, most in ((12, 10**5), (12, 60)):
        gx, gsrc, gdst, glabel, mask = learning.bounded_graph(rows, edges, targets, most)
        assert len(gx) < n and 0 < mask.sum() <= 12 and len(gx) <= most
        place = [int(np.flatnonzero((x == v).all(axis=1))[0]) for v in gx]
        assert (label[place] == glabel).all()
        whole = np.zeros(n)
        whole[place] = mask
        a = L.graph_net_gradient(p, gx, gsrc, gdst, (glabel == 0).astype(float), mask.astype(float), 0.1)
        b = L.graph_net_gradient(p, x, src, dst, (label == 0).astype(float), whole, 0.1)
        assert np.isclose(a[0], b[0]) and all(np.allclose(u, v) for u, v in zip(a[1], b[1], strict=True))


def test_small_graph_is_whole(spark):
    rows = spark.createDataFrame([(k, [float(k)], 0) for k in range(9)], "id long, x array<double>, label long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (7, 8)], "src long, dst long")
    gx, gsrc, gdst, _, mask = learning.bounded_graph(rows, edges, 4000)
    assert gx.ravel().tolist() == list(range(9)) and mask.all() and list(zip(gsrc, gdst)) == [(0, 1), (1, 2), (7, 8)]
