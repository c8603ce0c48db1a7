"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class is a Gaussian with its own mean and covariance, shrunk towards the pooled covariance and a multiple of the
identity. The score is the posterior of class 1, from the difference of the two Mahalanobis log-densities; each class keeps
the Cholesky factor of its covariance, so scoring is one triangular product a class. All labelled training rows are used:
Spark sums their first and second moments, so nothing but those few numbers reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.bpe import _schema
from txintel.llm.text import chunks, forget, slices
from txintel.runtime import checkpoint, ship_package, table

STATISTICS = ("words", "word_bytes", "upper", "digits", "marks", "symbols", "bars", "shouts", "lines", "beyond_ascii", "repeats", "variety", "short_words", "entropy")
X = "__statistics"
_SETS = {name: np.frombuffer(bytes(range(256)), np.uint8)[[b in chars for b in range(256)]] for name, chars in {"upper": range(0x41, 0x5B), "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)], "digits": range(0x30, 0x3A), "marks": b".,;:?'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{}~", "bars": b"|", "shouts": b"!", "lines": b"\n", "beyond_ascii": range(0x80, 0x100)}.items()}


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of STATISTICS; finite for every text."""
    seen, n, short, repeats, word_bytes, last = np.zeros(256, np.int64), 0, 0, 0, 0, None
    distinct: set[int] = set()
    for piece in chunks(text or b""):
        seen += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        ws = piece.split()
        if ws:
            repeats += sum(map(eq, ws, ws[1:])) + (ws[0] == last)
            last = ws[-1]
            n += len(ws)
            sizes = list(map(len, ws))
            word_bytes += sum(sizes)
            short += sum(map((4).__gt__, sizes))
            distinct.update(map(hash, ws)) if n > len(ws) or len(text or b"") > len(piece) else distinct.update(set(ws))
    size = int(seen.sum())
    count = {k: int(seen[v].sum()) for k, v in _SETS.items()}
    share = lambda k, of: np.log((count[k] + 0.5) / (of + 50.0))
    p = seen[seen > 0] / max(1, size)
    return [
        float(np.log1p(n)),
        float(np.log1p(word_bytes / max(1, n))),
        float(share("upper", count["letters"])),
        *(float(share(k, size)) for k in ("digits", "marks", "symbols", "bars", "shouts", "lines", "beyond_ascii")),
        float(np.log((repeats + 0.5) / (n + 50.0))),
        float(np.log((len(distinct) + 1.0) / (n + 1.0))),
        float(np.sqrt(short / max(1, n))),
        float(-(p * np.log(p)).sum()) if size else 0.0,
    ]


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text", name: str = X) -> DataFrame:
    """(keep..., name): each row's statistics as array<double>; a null text is an empty one, whose statistics are finite too."""
    ship_package(docs.sparkSession)
    rest = list(keep)
    both = rest if text_col in rest else [*rest, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col):
            x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), x], names=[*rest, name])

    return docs.select(*both).mapInArrow(run, _schema(docs.select(*rest), f"`{name}` array<double>"))


@dataclass
class Discriminant:
    """For each class (0 and 1): mean, inverse Cholesky factor, and log prior minus half the log determinant."""

    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        z = np.einsum("kij,nkj->nki", self.inverses, x[:, None, :] - self.means)
        return self.offsets - 0.5 * (z * z).sum(axis=2)

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.log_densities(x)
        return 1.0 / (1.0 + np.exp(np.clip(d[:, 0] - d[:, 1], -700, 700)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], size: int, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """From each class's count, sum of x and sum of x xT. A class without rows lies at the other's mean with its covariance
    (both: at zero with the identity), so that its prior alone speaks."""
    n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
    total = sum(n.values())
    overall = sum((moments[k][1] for k in moments), np.zeros(size)) / max(1, total)
    means = {k: moments[k][1] / n[k] if n[k] else overall for k in (0, 1)}
    within = sum((moments[k][2] - n[k] * np.outer(means[k], means[k]) for k in moments), np.zeros((size, size))) / max(1, total) if total else np.eye(size)
    inverses, offsets = [], []
    for k in (0, 1):
        own = moments[k][2] / n[k] - np.outer(means[k], means[k]) if n[k] > size else within
        s = (1 - pooled) * own + pooled * within
        s = (1 - ridge) * (s + s.T) / 2 + ridge * max(1e-6, float(np.trace(s)) / size) * np.eye(size)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(inverses), np.array(offsets))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", name: str = X) -> Discriminant:
    """Learns from the rows that aren't held out and have a label of 0 or 1; a row counts once for each of its labels. Null ids
    have no label; without labels, or with those of one class only, priors alone tell the classes apart."""
    ship_package(rows.sparkSession)
    size = len(STATISTICS)
    said = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__y in (0, 1)")
    train = rows.filter(~held_out(id_col)).join(said, F.col(id_col) == F.col("__id")).select("__y", name)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column("__y").to_numpy()
            x = batch.column(name).flatten().to_numpy().reshape(-1, size)
            for k in np.unique(y).tolist():
                own = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, k, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["y", "place", "value"])

    found = train.mapInArrow(moments, "y int, place int, value double").groupBy("y", "place").agg(F.sum("value").alias("value")).collect()
    sums = {k: np.zeros((size + 1) ** 2) for k in {r.y for r in found}}
    for r in found:
        sums[r.y][r.place] = r.value
    square = {k: s.reshape(size + 1, size + 1) for k, s in sums.items()}
    return discriminant({k: (round(s[0, 0]), s[0, 1:], s[1:, 1:]) for k, s in square.items()}, size)


def scored(rows: DataFrame, model: Discriminant, score_col: str = "score", name: str = X) -> DataFrame:
    """rows with their statistics replaced by the posterior of class 1, between 0 and 1 for every row."""
    ship_package(rows.sparkSession)
    rest = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(name).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(model.score(x))], names=[*rest, score_col])

    return rows.mapInArrow(run, _schema(rows.select(*rest), f"`{score_col}` double"))


def classify(docs: DataFrame, model: Discriminant, keep: tuple[str, ...], score_col: str = "score", text_col: str = "text") -> DataFrame:
    """(keep..., score_col): statistics and posterior of every row in one pass over the texts; null and empty texts get a score,
    repeated rows stay, an empty table gives no rows."""
    ship_package(docs.sparkSession)
    rest = list(keep)
    both = rest if text_col in rest else [*rest, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part, texts in slices(batches, text_col):
            score = model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(score)], names=[*rest, score_col])

    return docs.select(*both).mapInArrow(run, _schema(docs.select(*rest), f"`{score_col}` double"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document of the whole table, learned from its labels; classify says what odd rows give."""
    rows = checkpoint(with_statistics(table(spark, sf_dir, "documents"), ("doc_id",)))
    model = fit(rows, table(spark, sf_dir, "labels"))
    return scored(rows, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
