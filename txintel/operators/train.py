"""Training of the graph network on graphs that no single machine has to hold.

Every step is full-batch back-propagation as Spark jobs. Features and their neighbours' means don't change between steps, so
they are computed once and checkpointed. A step then sends hidden vectors along edges once, and their gradients back once: four
equi-joins with sums that pre-aggregate. Products with weights, and the outer products that make up the gradient, are done by
Arrow batches; each task adds up its own. The driver sees sums as large as the weights, and takes the Adam step.

rows: id, x (array of doubles) and y (1, 0, or null where the label isn't known); edges: src, dst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txintel.operators import learn
from txintel.runtime import checkpoint, release, ship_package


def inner_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the rows; repeated edges stay."""
    ids = rows.select("id")
    return edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst")


def training_table(rows: DataFrame, edges: DataFrame, mean: np.ndarray, std: np.ndarray, clip: float | None = None) -> DataFrame:
    """(id, x, mean_in, mean_out, y, weight, in_scale, out_scale), checkpointed: standardised features with their neighbours'
    means, the weight of each row in a loss in which both classes count the same, and one over the number of edges in and out.

    Rows without a label have weight 0. A class without rows counts nothing.
    """
    known = rows.agg(F.count(F.when(F.col("y") == 1, 1)), F.count("y")).first()
    pos = max(1, known[0])
    other = max(1, known[1] - pos)
    weight = F.when(F.col("y").isNull(), 0.0).when(F.col("y") == 1, 0.5 / pos).otherwise(0.5 / other)
    z = learn.standardise(rows.select("id", "x"), mean, std, clip)
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("src", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    told = rows.select("id", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), weight.alias("weight"))
    scale = lambda c: 1.0 / F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)).cast("double")
    met = learn.neighbour_mean(z, edges).join(told, "id").join(counts, "id", "left")
    return checkpoint(met.select("id", "x", "mean_in", "mean_out", "y", "weight", scale(F.col("i")).alias("in_scale"), scale(F.col("o")).alias("out_scale")))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(cells: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, max(1, cells.shape[1]), dtype=np.int32)), pa.array(cells.ravel()))


def _total(parts: DataFrame, column: str) -> np.ndarray:
    """The sum of arrays of one length, by pre-aggregation."""
    found = parts.select(array_to_vector(column).alias("v")).agg(Summarizer.sum(F.col("v")).alias("s")).first()
    return found.s.toArray() if found and found.s is not None else np.zeros(0)


def gradient(p: list[np.ndarray], table: DataFrame, edges: DataFrame, l2: float) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradient in every parameter, those of learn.graph_net_gradient, over a training_table and its edges."""
    spark = table.sparkSession
    ship_package(spark)
    kind = dict(table.dtypes)["id"]
    shared = spark.sparkContext.broadcast(p)
    hidden = p[3].shape[0]

    def first(x: np.ndarray, i: np.ndarray, o: np.ndarray) -> np.ndarray:
        w = shared.value
        return np.maximum(x @ w[0] + i @ w[1] + o @ w[2] + w[3], 0)

    h = learn._mapped(table, ["x", "mean_in", "mean_out"], first, "h", "array<double>", ["id"]).withColumnRenamed("h", "x")
    met = learn.neighbour_mean(checked := checkpoint(h), edges).join(table.select("id", "y", "weight", "in_scale", "out_scale"), "id")

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes back from the second layer: to the node itself, to those its edges come from and to those they go to."""
        w = shared.value
        total = np.zeros(1 + 3 * hidden * hidden + hidden + hidden + 1)
        names = ["id", "own", "to_src", "to_dst", "total"]
        none = lambda n, k: pa.nulls(n, k)
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            x, i, o = (_matrix(b, c) for c in ("x", "mean_in", "mean_out"))
            y, weight, si, so = (b.column(c).to_numpy() for c in ("y", "weight", "in_scale", "out_scale"))
            a = x @ w[4] + i @ w[5] + o @ w[6] + w[7]
            top = np.maximum(a, 0)
            logit = top @ w[8] + w[9][0]
            d = weight * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y)
            back = np.outer(d, w[8]) * (a > 0)
            loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
            total += np.concatenate([[loss], (x.T @ back).ravel(), (i.T @ back).ravel(), (o.T @ back).ravel(), back.sum(axis=0), top.T @ d, [d.sum()]])
            sent = (back @ w[4].T, back @ w[5].T * si[:, None], back @ w[6].T * so[:, None])
            last = b
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(_lists, sent), none(b.num_rows, pa.list_(pa.float64()))], names=names)
        if last is not None:
            one = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([none(1, last.column("id").type), none(1, one), none(1, one), none(1, one), _lists(total[None])], names=names)

    back = checkpoint(met.mapInArrow(upper, f"id {kind}, own array<double>, to_src array<double>, to_dst array<double>, total array<double>"))
    high = _total(back.filter("total is not null"), "total")
    rows = back.filter("total is null")
    sent = [
        edges.join(rows.select(F.col("id").alias(at), array_to_vector(what).alias("v")), at).select(F.col(to).alias("id"), "v")
        for at, to, what in (("dst", "src", "to_src"), ("src", "dst", "to_dst"))
    ]
    gathered = sent[0].unionAll(sent[1]).groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("far"))
    low_rows = rows.select("id", "own").join(gathered, "id", "left").select("id", F.when(F.col("far").isNull(), F.col("own")).otherwise(F.zip_with("own", "far", lambda u, v: u + v)).alias("down"))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = shared.value, None
        for b in batches:
            if not b.num_rows:
                continue
            x, i, o = (_matrix(b, c) for c in ("x", "mean_in", "mean_out"))
            back = _matrix(b, "down") * (x @ w[0] + i @ w[1] + o @ w[2] + w[3] > 0)
            own = np.concatenate([(x.T @ back).ravel(), (i.T @ back).ravel(), (o.T @ back).ravel(), back.sum(axis=0)])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([_lists(total[None])], names=["total"])

    low = _total(table.select("id", "x", "mean_in", "mean_out").join(low_rows, "id").select("x", "mean_in", "mean_out", "down").mapInArrow(lower, "total array<double>"), "total")
    release(checked, back)
    shared.unpersist()
    if not len(high):
        return learn.penalty(p, l2), [l2 * w if w.ndim == 2 or k == 8 else np.zeros_like(w) for k, w in enumerate(p)]
    cells = np.concatenate([low, high[1:]])
    g, at = [], 0
    for k, w in enumerate(p):
        own = cells[at : at + w.size].reshape(w.shape)
        g.append(own + l2 * w if w.ndim == 2 or k == 8 else own)
        at += w.size
    return float(high[0]) + learn.penalty(p, l2), g


def train_graph_net(rows: DataFrame, edges: DataFrame, hidden: int = 24, epochs: int = 300, lr: float = 0.01, l2: float = 1e-4, seed: int = 0, clip: float | None = None, callback: Callable | None = None) -> learn.GraphNet:
    """The network that learn.train_graph_net finds from the same start, on a graph of any size: of all rows the features and
    edges count, of labelled ones the loss. callback(step, loss, net) ends the training by returning true."""
    mean, std = learn.column_stats(rows)
    inner = checkpoint(inner_edges(rows, edges))
    held = training_table(rows, inner, mean, std, clip)
    stop = (lambda step, loss, p: callback(step, loss, learn.net_with(p, mean, std, clip))) if callback else None
    p = learn.adam(learn.first_weights([len(mean), hidden, hidden], seed), lambda p: gradient(p, held, inner, l2), epochs, lr, stop)
    release(held, inner)
    return learn.net_with(p, mean, std, clip)


def fit_graph_net(rows: DataFrame, edges: DataFrame, hidden: int = 24, epochs: int = 300, l2: float = 1e-4, clip: float | None = None, cells: int | None = None) -> learn.GraphNet:
    """A network trained on the driver where the counted features are at most cells (TRAIN_CELLS) numbers, else by Spark; both
    take the same steps."""
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if n * (d or 0) > (learn.TRAIN_CELLS if cells is None else cells):
        return train_graph_net(rows, edges, hidden, epochs, l2=l2, clip=clip)
    x, src, dst, y = learn.local_graph(rows, inner_edges(rows, edges))
    return learn.train_graph_net(x, src, dst, np.nan_to_num(y), hidden, epochs, l2=l2, mask=~np.isnan(y), clip=clip)
