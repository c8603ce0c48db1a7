"""Whitening of embeddings by polarisation: covariances from variances of sums.

For two dimensions, 2 cov(i, j) = var(i + j) - var(i) - var(j). So all that is gathered from the rows are sums of squares, one
for each dimension and one for each sum of two dimensions, and these are exact: components are whole numbers, centred at the
whole part of their mean before they are squared, and what is left of the mean is taken off afterwards in whole numbers too.
No large squares are subtracted from each other in floating point, however far the mean is from zero. The covariance matrix, of
fixed size, is assembled on the driver and goes to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.text import forget
from txintel.llm.vectors import finite
from txintel.runtime import checkpoint, ship_package, table

#: A component c counts as floor(SCALE * c) + SHIFT, which is kept within MOST in size.
SCALE, SHIFT, MOST = 1024.0, 100_000, 2**62
#: Rows squared at once, and bits of a digit in which exact sums travel.
ROWS, DIGIT, DIGITS = 4096, 44, 5
_EXACT = 52


class Fit(NamedTuple):
    """What whitening needs of the vectors of one length: rows, sums by dimension, and the unit eigenvectors (columns) of the
    covariance with their eigenvalues, falling, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def whole(cells: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * cells.astype(np.float64))
    return np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def by_length(batches: Iterator[pa.RecordBatch], vec: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows of one length, their components as whole numbers); empty vectors are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            sizes = some.column(vec).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = some.filter(pa.array(sizes == size))
                yield own, whole(own.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def digits(value: int) -> list[int]:
    """Little-endian digits of DIGIT bits, the last one signed; sums of digits are digits of sums."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def exact_sums(rows: DataFrame, partial, schema: str) -> list:
    """The sums by key of what each task's partial(batches) yields: (key..., whole number of any size)."""
    keys = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found = list(partial(batches))
        if found:
            key, value = [list(x) for x in zip(*((x[:-1], x[-1]) for x in found), strict=True)]
            split = list(zip(*map(digits, value), strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int32()) for x in zip(*key, strict=True)), *(pa.array(list(x), pa.int64()) for x in split)], names=[*keys, *(f"d{k}" for k in range(DIGITS))])

    parts = rows.mapInArrow(run, schema + "".join(f", d{k} bigint" for k in range(DIGITS)))
    total = parts.groupBy(*keys).agg(*(F.sum(F.col(f"d{k}").cast("decimal(19,0)")).alias(f"d{k}") for k in range(DIGITS)))
    return [(*(r[k] for k in keys), sum(int(r[f"d{k}"]) << (DIGIT * k) for k in range(DIGITS))) for r in total.collect()]


def sums_of(x: np.ndarray) -> list[int]:
    """Exact sums of columns."""
    return [(int(h) << 31) + int(low) for h, low in zip((x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0), strict=True)]


def squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of every column, then of every sum of two columns i < j, by i and j. y: (rows, dim), centred."""
    dim = y.shape[1]
    bits = max(abs(int(y.min())), abs(int(y.max()))).bit_length() + 1
    out = np.zeros(dim * (dim + 1) // 2, object)
    small = _EXACT - 2 * bits >= 4
    step = min(ROWS, 1 << (_EXACT - 2 * bits)) if small else ROWS
    for at in range(0, len(y), step):
        t = np.ascontiguousarray(y[at : at + step].T).astype(np.float64 if small else object)  # doubles hold these sums exactly
        own = [(t * t).sum(axis=1)]
        for i in range(dim - 1):
            w = t[i + 1 :] + t[i]
            own.append(np.einsum("jr,jr->j", w, w) if small else (w * w).sum(axis=1))
        found = np.concatenate(own)
        out += found.astype(np.int64).astype(object) if small else found
    return out.tolist()


def covariance(n: int, sums: list[int], squared: list[int]) -> np.ndarray:
    """The covariance matrix, each entry the double nearest to its exact value. squared: as squares gives them, of components
    less the whole parts of their means."""
    dim, rest = len(sums), [s % n for s in sums]
    # (n x - S) squared and summed, with y = x - S // n: n n sum(y y) - n rest rest
    own = [n * n * squared[i] - n * rest[i] ** 2 for i in range(dim)]
    out, k = np.zeros((dim, dim)), dim
    for i in range(dim):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, dim):
            both = n * n * squared[k] - n * (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**3)
            k += 1
    return out


def decompose(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry above zero."""
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(v))])
    return values, axes * np.where(flip == 0, 1.0, flip)


def fit(vectors: DataFrame, vec_col: str = "embedding") -> dict[int, Fit]:
    """For each length of vectors, what whitening needs of all of them. Vectors null or with null or non-finite components and
    empty ones take no part; without others there is no fit. The driver gets dim (dim + 1) / 2 numbers a length."""
    ship_package(vectors.sparkSession)
    rows = vectors.filter(finite(F.col(vec_col))).select(vec_col)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[int, np.ndarray] = {}
        for some, x in by_length(batches, vec_col):
            held[x.shape[1]] = held.get(x.shape[1], 0) + np.array([len(some), *sums_of(x)], object)
        for dim, found in held.items():
            for i, value in enumerate(found.tolist()):
                yield dim, i, value

    totals: dict[int, list[int]] = {}
    for dim, i, value in exact_sums(rows, firsts, "dim int, i int"):
        totals.setdefault(dim, [0] * (dim + 1))[i] = value
    middle = {dim: np.array([s // found[0] for s in found[1:]], np.int64) for dim, found in totals.items()}

    def seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[int, np.ndarray] = {}
        for _, x in by_length(batches, vec_col):
            held[x.shape[1]] = held.get(x.shape[1], 0) + np.array(squares(x - middle[x.shape[1]]), object)
        for dim, found in held.items():
            for k, value in enumerate(found.tolist()):
                yield dim, k, value

    squared: dict[int, list[int]] = {dim: [0] * (dim * (dim + 1) // 2) for dim in totals}
    for dim, k, value in exact_sums(rows, seconds, "dim int, k int"):
        squared[dim][k] = value
    out = {}
    for dim, (n, *sums) in totals.items():
        v = covariance(n, sums, squared[dim])
        values, axes = decompose(v)
        out[dim] = Fit(n, sums, np.where(values > dim * np.finfo(float).eps * max(values[0], 0.0), values, 0.0), axes, float(np.trace(v)))
    return out


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """For each row the sum over dimensions of (n y - rest) squared, exact; None where a long can't hold it."""
    top = max(abs(int(y.min())), abs(int(y.max())))
    if top < 2**26 and top * sum(rest) < 2**62 and top * top * y.shape[1] < 2**62:
        square, cross = (y * y).sum(axis=1), y @ np.array(rest, np.int64)
    else:
        wide = y.astype(object)
        square, cross = (wide * wide).sum(axis=1), (wide * np.array(rest, object)).sum(axis=1)
    const = sum(r * r for r in rest)
    exact = (n * n * int(a) - 2 * n * int(b) + const for a, b in zip(square, cross, strict=True))
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and each of its first
    most components, fewer where the vectors are shorter.

    Vectors null or with null or non-finite components are dropped, and so are empty ones, which have no component; rows with a
    null id and repeated rows are rows like others. Vectors of each length are a table of their own. identity_error is measured
    on the whitened values themselves. A component without variance (a single or equal vectors; more components than the
    vectors span; less than dim * 2**-52 of the largest) has whitened values and explained share 0 and leaves identity_error at 1. Scaled components beyond 2**62 count
    as that; deviation is null where a long can't hold it. An empty table gives no rows.
    """
    spark, fits = vectors.sparkSession, fit(vectors, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not fits:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    middle = {dim: np.array([s // f.n for s in f.sums], np.int64) for dim, f in fits.items()}
    rest = {dim: [s % f.n for s in f.sums] for dim, f in fits.items()}
    turn = {dim: f.axes[:, :most] * np.where(f.values[:most] > 0, 1 / np.sqrt(np.where(f.values[:most] > 0, f.values[:most], 1.0)), 0.0) for dim, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in by_length(batches, "vec"):
            dim = x.shape[1]
            y, n = x - middle[dim], fits[dim].n
            w = (y - np.array(rest[dim], np.float64) / n) @ turn[dim]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(np.full(len(w), dim, np.int32)), pa.array(deviations(y, n, rest[dim]), pa.int64()), cells], names=["id", "dim", "deviation", "w"])

    rows = vectors.filter(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    found = checkpoint(rows.mapInArrow(run, f"id {kind}, dim int, deviation bigint, w array<double>"))
    facts = spark.createDataFrame([(dim, f.n, [float(e) / f.trace if f.trace > 0 else 0.0 for e in f.values[:most]], error) for (dim, f), error in zip(fits.items(), identity_errors(found, fits, most), strict=True)], "dim int, n bigint, explained array<double>, identity_error double")
    shown = found.join(F.broadcast(facts), "dim").select("id", "n", "deviation", "explained", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return shown.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def identity_errors(found: DataFrame, fits: dict[int, Fit], most: int) -> list[float]:
    """For each length, the largest absolute entry of the whitened values' covariance, centred before multiplying, less the identity."""
    w = lambda a: F.try_element_at("w", F.lit(a + 1))
    wide = range(max(min(most, dim) for dim in fits))
    mean = {r.dim: r for r in found.groupBy("dim").agg(*(F.avg(w(a)).alias(f"m{a}") for a in wide)).collect()}
    pairs = [(a, b) for a in wide for b in wide if a <= b]
    off = lambda a: w(a) - F.coalesce(*(F.when(F.col("dim") == dim, F.lit(r[f"m{a}"])) for dim, r in mean.items()))
    second = {r.dim: r for r in found.groupBy("dim").agg(*(F.avg(off(a) * off(b)).alias(f"c{a}_{b}") for a, b in pairs)).collect()}
    return [max(abs(second[dim][f"c{a}_{b}"] - (a == b)) for a, b in pairs if b < min(most, dim)) for dim in fits]


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every vector of the whole table; whiten says what odd rows give."""
    return whiten(table(spark, sf_dir, "embeddings"))
