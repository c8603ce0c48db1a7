"""Whitening against exact fractions and plain eigenvectors."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from txintel.llm import whitening as W

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS component", "'x' AS id", "4.0D AS w", "5 AS dim")


def plain(rows, most=8):
    """{id: (deviation, [|whitened|...])}, explained shares, for vectors of one length."""
    x = [[floor(1024 * Fraction(c)) + 100000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    z = [[n * r[i] - s[i] for i in range(dim)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(dim)] for i in range(dim)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, dim)
    centred = np.array([[float(Fraction(c, n)) for c in r] for r in z])
    return [(sum(c * c for c in r), np.abs(p)) for r, p in zip(z, centred @ u[:, :k] / np.sqrt(e[:k]), strict=True)], e[:k] / np.trace(v)


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in out.items()}


@pytest.mark.parametrize("dim", [3, 12])
def test_equals_plain_covariance(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(k, (v * np.arange(1, dim + 1)).tolist()) for k, v in enumerate(rng.normal(size=(300, dim)))]
    rows[100:200] = [(k, rows[100][1]) for k in range(100, 200)]  # one very common vector
    got, (want, share) = told(W.whiten(frame(spark, rows))), plain(rows)
    for (k, _), (deviation, w) in zip(rows, want, strict=True):
        own = got[k]
        assert [r.component for r in own] == list(range(1, min(8, dim) + 1))
        assert {(r.n, r.deviation) for r in own} == {(300, deviation)}
        assert np.allclose([abs(r.whitened) for r in own], w, rtol=1e-9, atol=1e-9)
        assert np.allclose([r.explained for r in own], share, rtol=1e-10)
        assert {r.identity_error for r in own} == {own[0].identity_error} and own[0].identity_error < 1e-9


def test_polarisation_is_exact():
    rng = np.random.default_rng(1)
    for scale in (1, 2**11, 2**22, 2**24, 2**40, 2**61):
        y = rng.integers(-scale, scale + 1, size=(50, 5))
        t = [[int(v) for v in r] for r in y]
        want = [sum(r[i] ** 2 for r in t) for i in range(5)] + [sum((r[i] + r[j]) ** 2 for r in t) for i in range(5) for j in range(i + 1, 5)]
        assert W.squares(y) == want
        assert W.sums_of(y) == [sum(r[i] for r in t) for i in range(5)]
        n, rest = 1000, [3, 999, 0, 7, 500]
        exact = [sum((n * v - c) ** 2 for v, c in zip(r, rest, strict=True)) for r in t]
        assert W.deviations(y, n, rest) == [v if v < 2**63 else None for v in exact]
    for value in (0, 1, -1, 2**63, -(2**100), 2**170 + 12345):
        assert sum(d << (W.DIGIT * k) for k, d in enumerate(W.digits(value))) == value


def test_far_mean_small_spread(spark):
    """A mean millions of times the spread: squares about zero would lose all digits."""
    rng = np.random.default_rng(4)
    rows = [(k, (1e6 + v).tolist()) for k, v in enumerate(rng.integers(-3, 4, size=(200, 4)) / 1024.0)]
    got, (want, _) = told(W.whiten(frame(spark, rows))), plain(rows)
    for (k, _), (deviation, w) in zip(rows, want, strict=True):
        assert got[k][0].deviation == deviation
        assert np.allclose([abs(r.whitened) for r in got[k]], w, rtol=1e-8, atol=1e-8)


def test_odd_rows_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 3)))]
    short = [(100 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(20, 2)))]
    odd = [(200, None), (201, []), (202, [float("nan")] * 3), (203, [None, 1.0, 1.0]), (204, [float("inf")] * 3), (300, [1.0] * 5)]
    got = told(W.whiten(frame(spark, [*rows, *short, *odd, (None, rows[0][1]), (0, rows[0][1])])))
    assert set(got) == {*range(40), *range(100, 120), 300, None}
    assert len(got[0]) == 6 and len(got[None]) == 3 and len(got[100]) == 2
    assert {r.n for r in got[5]} == {42} and {r.n for r in got[105]} == {20}
    want, _ = plain(short)
    assert np.allclose([abs(r.whitened) for r in got[103]], want[3][1])
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in got[300]] == [(0, 0.0, 0.0, 1.0)] * 5  # alone in its length
    big = told(W.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])))
    assert big[1][0].deviation is None and abs(abs(big[1][0].whitened) - 1.5**0.5) < 1e-9 and big[1][1].whitened == 0.0
    assert W.whiten(frame(spark, [])).count() == 0 and W.whiten(frame(spark, [(1, None)])).count() == 0


def test_whole_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in v.collect()]
    got, (want, share) = told(W.op12_whitening(spark, SF)), plain(rows)
    for (k, _), (deviation, w) in zip(rows, want, strict=True):
        assert got[k][0].deviation == deviation
        assert np.allclose([abs(r.whitened) for r in got[k]], w, atol=1e-9)
        assert np.allclose([r.explained for r in got[k]], share, rtol=1e-9)
        assert got[k][0].identity_error < 1e-4
