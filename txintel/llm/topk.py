"""Exact top-k search by distributed histogram selection.

Everything is scored, block of queries by block of candidates, several times over, and only counts travel: each round sums,
for every query, a histogram of the scores still in question and keeps the bin that holds the kth score, until that bin is one
score wide. A last pass keeps what lies above the kth score and, of what equals it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.llm.vectors import CANDIDATES, QUERIES, block_count, blocks, is_query, past_blocks, usable
from txintel.runtime import checkpoint, table

SCALE, BINS = 64.0, 1024
#: Scores stay within these bounds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; those beyond 64 bits count as the least or the most."""
    bound = float(q.shape[1]) * max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(c).max(initial=0)))
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.clip(whole(q) @ whole(c).T, LEAST, MOST).astype(np.int64)


def _floor(x: Column) -> Column:
    """Floor as a double; doubles of 2 ^ 52 or more are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _histogram(k: int, width: int, before: int):
    """Histograms, in bins of width, of the scores in question: all, or those in the query's bin of the width before."""

    def found(candidates, q_rows, q_ids, q, state) -> Iterator[pa.RecordBatch]:
        c_rows, _, c = candidates
        scores, at = inner_products(q, c), np.searchsorted(state["query_row"], q_rows) if state else None
        rows, bins, counts = [], [], []
        for i, own in enumerate(q_rows.tolist()):
            s = scores[i][c_rows != own]
            if state:
                if at[i] == len(state["query_row"]) or state["query_row"][at[i]] != own:
                    continue
                s = s[s // before == state["bin"][at[i]]]
            if len(s) > k:  # below the block's own kth score lies nothing that counts
                s = s[s // width >= np.partition(s, len(s) - k)[len(s) - k] // width]
            b, n = np.unique(s // width, return_counts=True)
            rows.append(np.full(len(b), own)), bins.append(b), counts.append(n)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, bins, counts)], names=["query_row", "bin", "n"])

    return found


def _choice(k: int):
    """Rows above the kth score, and those of the smallest ids that equal it. A query that met no other row has no state."""

    def found(candidates, q_rows, q_ids, q, state) -> Iterator[pa.RecordBatch]:
        c_rows, c_ids, c = candidates
        scores, at = inner_products(q, c), np.searchsorted(state["query_row"], q_rows)
        rows, ids, vecs, got = [], [], [], []
        for i, own in enumerate(q_rows.tolist()):
            if at[i] == len(state["query_row"]) or state["query_row"][at[i]] != own:
                continue
            s, kth = scores[i], state["bin"][at[i]]
            others = c_rows != own
            equal = np.flatnonzero((s == kth) & others)[: k - int(state["above"][at[i]])]  # a block's ids ascend
            some = np.concatenate((np.flatnonzero((s > kth) & others), equal))
            rows.append(np.full(len(some), own)), ids.append(np.full(len(some), q_ids[i])), vecs.append(c_ids[some]), got.append(s[some])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, ids, vecs, got)], names=["query_row", "query_id", "vec_id", "score"])

    return found


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose id is divisible by every, its k highest scores among all
    rows but itself.

    A score is the inner product of floor(scale * x) over components; ties go to the smaller id. Vectors null or with null or
    non-finite components and rows with a null id take no part. Rows that share an id are rows like others: each is a candidate,
    also of the other, and each query row has ranks of its own. Vectors meet only those of their own length (an empty one only
    empty ones, score 0); a query that meets none gives no rows, with fewer than k candidates all are returned, and an empty
    table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col, empty=True).select("row", "id", F.transform("vec", lambda x: _floor(x * scale)).alias("vec"))
    n, m, norm = rows.agg(F.count("*"), F.count(F.when(is_query(every), 1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    c_number, q_number = block_count(n, CANDIDATES), block_count(m, QUERIES)
    c, q = checkpoint(blocks(rows, c_number)), checkpoint(blocks(rows.filter(is_query(every)), q_number))
    as_they_are = lambda *block: block
    width = 1 << max(0, (int(min(2 * (norm or 0.0), 2.0**64)) // BINS).bit_length())
    state, before = None, width
    while True:
        counts = past_blocks(c, q, c_number, q_number, as_they_are, _histogram(k, width, before), "query_row bigint, bin bigint, n bigint", state)
        bins = counts.groupBy("query_row", "bin").agg(F.sum("n").alias("n"))
        if state is not None:
            bins = bins.join(state.select("query_row", "above"), "query_row")
        else:
            bins = bins.withColumn("above", F.lit(0).cast("bigint"))
        upto = bins.withColumn("upto", F.col("above") + F.sum("n").over(Window.partitionBy("query_row").orderBy(F.desc("bin"))))
        best = upto.groupBy("query_row").agg(F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))).alias("hit"), F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("last"))
        hit = F.coalesce("hit", "last")
        state = checkpoint(best.select("query_row", hit["bin"].alias("bin"), hit["above"].alias("above")))
        if width == 1:
            break
        before, width = width, max(1, width // BINS)
    chosen = past_blocks(c, q, c_number, q_number, as_they_are, _choice(k), "query_row bigint, query_id bigint, vec_id bigint, score bigint", state)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 highest scores over the whole table of vectors; top_k says what odd rows give."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e)::BIGINT END AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
