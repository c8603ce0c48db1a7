"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree is a sorted array of long bit strings, one a row, from the signs of random projections: each tree takes its bits in
an order of its own from one pool of directions. A query descends in all trees of a block of candidates to its longest prefix
match with another row, then ascends in all of them together, a bit at a time, until enough different rows stand under its
prefixes. Of these, those that most trees hold, a fixed share of the block, are verified by their exact cosine, and no others.
Each block of candidates has its own forest, built once for many queries; all blocks are searched, and the best of all are
kept, so no forest outgrows one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.llm.vectors import CANDIDATES, QUERIES, block_count, blocks, is_query, past_blocks, usable
from txintel.runtime import checkpoint, table

TREES, BITS, POOL, SEED = 512, 24, 2048, 20
#: An ascent ends when the prefixes hold this share of the block's rows, or in a small block this many of them, but not nearly all.
TOUCHED, TOUCHED_ROWS, NEARLY = 0.36, 1200, 0.8
#: Of a block's rows, the share that is verified at most, or in a small block so many.
SHARE, SHARE_ROWS = 0.12, 400
#: Trees that ascend to the last depth together, until there are enough rows.
TOGETHER = 16
#: First bits whose slices are looked up in a table; beyond them they are searched for.
_TABLE = 12


def directions(dim: int, pool: int = POOL) -> np.ndarray:
    """Random directions, the same wherever they are drawn, orthogonal by groups of dim."""
    rng = np.random.default_rng([SEED, dim])
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-pool // dim))])[:, :pool].astype(np.float32)


def codes(x: np.ndarray, pool: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """One row a tree: each vector's bit string as an integer, first bit highest."""
    rng = np.random.default_rng(SEED)
    order = np.stack([rng.permutation(pool.shape[1])[:bits] for _ in range(trees)])
    unit = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    signs = np.ascontiguousarray((unit @ pool > 0).T)
    out = np.zeros((trees, len(x)), np.uint32)
    for k in range(bits):
        out <<= np.uint32(1)
        out |= signs[order[:, k]]
    return out


class Forest:
    """Sorted arrays of one block of candidates."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, trees: int = TREES, bits: int = BITS, pool: int = POOL):
        self.rows, self.ids, self.x, self.bits = rows, ids, x, bits
        self.pool = directions(x.shape[1], pool)
        found = codes(x, self.pool, trees, bits)
        self.order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, axis=1)
        self.table = min(_TABLE, bits)
        first = (self.sorted >> np.uint32(bits - self.table)).astype(np.int64)
        counts = np.bincount(((np.arange(trees) * ((1 << self.table) + 1))[:, None] + first + 1).ravel(), minlength=trees * ((1 << self.table) + 1))
        self.starts = counts.reshape(trees, -1).cumsum(axis=1).astype(np.int32)

    def longest(self, own: np.ndarray, but: np.ndarray) -> np.ndarray:
        """For each query, the length of the longest prefix that it shares with a row in some tree. but: each query's own place
        in the block, which doesn't count, or -1."""
        best, n = np.zeros(own.shape[1], np.int64), len(self.x)
        for s, rows, c in zip(self.sorted, self.order, own, strict=True):
            at = np.searchsorted(s, c)
            for near in (at - 1, at, at + 1):  # where the middle one is the query itself, its neighbours come next
                k = np.clip(near, 0, n - 1)
                shared = self.bits - np.frexp((s[k] ^ c).astype(np.float64))[1]
                best = np.maximum(best, np.where(rows[k] == but, 0, shared))
        return best

    def slices(self, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the slice of the sorted array under the query's prefix of depth bits."""
        if depth <= self.table:
            prefix = (own >> np.uint32(self.bits - depth)).astype(np.int64) << (self.table - depth)
            return np.take_along_axis(self.starts, prefix, axis=1), np.take_along_axis(self.starts, prefix + (1 << (self.table - depth)), axis=1)
        cut = np.uint32(self.bits - depth)
        low = own >> cut << cut
        high = low + np.uint32((1 << (self.bits - depth)) - 1)
        return (np.stack([np.searchsorted(s, v, side) for s, v in zip(self.sorted, x, strict=True)]) for x, side in ((low, "left"), (high, "right")))

    def ascend(self, q: np.ndarray, but: np.ndarray, want: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each query, how many trees hold each row where its ascent ends, and the depth there: the greatest at which at
        least want different rows other than its own are under its prefixes. To that depth trees come up TOGETHER at a time, and
        those that aren't needed stay a bit below. but: as for longest."""
        own = codes(q, self.pool, len(self.sorted), self.bits)
        depth = self.longest(own, but)
        # no prefix has more rows than all slices together: who hasn't enough of them at the table's depth ends above it
        a, b = self.slices(own, self.table)
        depth = np.where((b - a).sum(axis=0) < want, np.minimum(depth, self.table - 1), depth)
        done: dict[int, tuple[np.ndarray, int]] = {}
        open_ = np.arange(own.shape[1])
        for d in range(int(depth.max(initial=0)), -1, -1):
            at = open_[depth[open_] >= d]
            if not len(at):
                continue
            a, b = self.slices(own[:, at], d)
            for k in np.flatnonzero((b - a).sum(axis=0) >= want).tolist():
                votes = self.votes(a[:, k], b[:, k], but[at[k]])
                if not d or np.count_nonzero(votes) >= want:
                    done[int(at[k])] = (self.as_many(own[:, [at[k]]], d, a[:, k], b[:, k], but[at[k]], want), d)
            open_ = np.array([k for k in open_.tolist() if k not in done], np.int64)
        for k in range(own.shape[1]):
            yield done[k] if k in done else (self.votes(*(x[:, 0] for x in self.slices(own[:, [k]], 0)), but[k]), 0)

    def as_many(self, own: np.ndarray, d: int, low: np.ndarray, high: np.ndarray, but: int, want: int) -> np.ndarray:
        """Votes of slices at depth d + 1, and of those at d of the first trees that make it want rows."""
        if d == self.bits:
            return self.votes(low, high, but)
        below = [x[:, 0] for x in self.slices(own, d + 1)]
        votes = self.votes(*below, but)
        for t in range(0, len(low), TOGETHER):
            if np.count_nonzero(votes) >= want:
                break
            some = slice(t, t + TOGETHER)
            votes = votes + self.votes(low[some], high[some], but, t) - self.votes(below[0][some], below[1][some], but, t)
        return votes

    def votes(self, low: np.ndarray, high: np.ndarray, but: int, first: int = 0) -> np.ndarray:
        """In how many of one query's slices, one a tree from the first on, each row but its own is."""
        sizes = high - low
        flat = np.arange(sizes.sum()) + np.repeat(low + (first + np.arange(len(low))) * len(self.x) - np.cumsum(sizes) + sizes, sizes)
        out = np.bincount(self.order.ravel()[flat], minlength=len(self.x))
        if but >= 0:
            out[but] = 0
        return out


def chosen(votes: np.ndarray, most: int) -> np.ndarray:
    """At most the most rows with votes: those with most of them, of equal ones the first."""
    if np.count_nonzero(votes) <= most:
        return np.flatnonzero(votes)
    cut = np.partition(votes, len(votes) - most)[len(votes) - most]
    above = np.flatnonzero(votes > cut)
    return np.sort(np.concatenate((above, np.flatnonzero(votes == cut)[: most - len(above)])))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with each row in double precision; equal rows get equal values."""
    top, tops = np.abs(q).max(), np.abs(x).max(axis=1)
    a, b = q / top, x / tops[:, None]
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def search(forest: Forest, q_rows: np.ndarray, q: np.ndarray, k: int, touched: float = TOUCHED, share: float = SHARE) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(place of the query, rows found, their cosines, rows verified, rows under its prefixes) for each query; at most k rows,
    nearest first."""
    n = len(forest.x)
    want = max(1, int(np.ceil(max(touched * n, min(TOUCHED_ROWS, NEARLY * n)))))
    most = max(k, SHARE_ROWS, int(np.ceil(share * n)))
    order = np.argsort(forest.rows, kind="stable")
    at = np.minimum(np.searchsorted(forest.rows[order], q_rows), n - 1)
    but = np.where(forest.rows[order[at]] == q_rows, order[at], -1)
    for i, (votes, _) in enumerate(forest.ascend(q, but, want)):
        found = chosen(votes, most)
        s = cosines(q[i], forest.x[found])
        best = np.lexsort((forest.ids[found], -s))[:k]
        yield i, found[best], s[best], len(found), int(np.count_nonzero(votes))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", touched: float = TOUCHED, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose id is divisible by every, the k nearest found among all rows
    but itself.

    Nearness is the largest cosine, ties go to the smaller id. Vectors null, empty, zero or with null or non-finite components
    and rows with a null id take no part; rows that share an id are rows like others, each query row with ranks of its own.
    Vectors meet only those of their own length. All rows are indexed. With fewer than k candidates all are returned; an empty
    table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query(every), 1))).first()
    c_number, q_number = block_count(n, CANDIDATES), block_count(m, QUERIES)

    def found(forest, q_rows, q_ids, q, state) -> Iterator[pa.RecordBatch]:
        queries, ids, vecs, got = [], [], [], []
        for i, at, s, _, _ in search(forest, q_rows, q, k, touched, share):
            queries.append(np.full(len(at), q_rows[i])), ids.append(np.full(len(at), q_ids[i])), vecs.append(forest.ids[at]), got.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (queries, ids, vecs, got)], names=["query_row", "query_id", "vec_id", "score"])

    c, q = checkpoint(blocks(rows, c_number)), checkpoint(blocks(rows.filter(is_query(every)), q_number))
    every_best = past_blocks(c, q, c_number, q_number, Forest, found, "query_row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return every_best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 nearest found over the whole table of vectors; nearest says what odd rows give."""
    return nearest(table(spark, sf_dir, "embeddings"))
