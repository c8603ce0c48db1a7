"""Learning operators: standardisation, neighbourhood means, isolation forest, graph network, logistic fusion.

rows: id and x, an array<double> of fixed length. Forests, weights and fits are small and go to executors by broadcast; rows,
edges and messages stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.runtime import ship_package

TREES, SAMPLE, FEWEST = 128, 256, 8
#: Numbers in the feature table of the graph that a network is trained on at most, 400 MB; larger graphs need a bounded subgraph.
TRAIN_CELLS = 50_000_000
#: Nodes of a bounded subgraph at most.
TRAIN_ROWS = 50_000


def column_stats(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each component; a deviation under 1e-9 counts as 1."""
    v = rows.select(array_to_vector("x").alias("v"))
    s = v.select(Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("v"), Summarizer.count(F.col("v")).alias("n")).first()
    mean, n = s.m.toArray(), max(1, s.n)
    std = np.sqrt(s.v.toArray() * (n - 1) / n)
    return mean, np.where(std < 1e-9, 1.0, std)


def standardise(rows: DataFrame, mean: np.ndarray, std: np.ndarray, clip: float | None = None) -> DataFrame:
    z = F.transform(F.arrays_zip("x", F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, std.tolist())).alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    if clip is not None:
        z = F.transform(z, lambda v: F.greatest(F.least(v, F.lit(clip)), F.lit(-clip)))
    return rows.withColumn("x", z)


def neighbour_mean(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with mean_in and mean_out over the nodes that edges (src, dst) come from and go to; zeros where none do."""
    msg = rows.select(F.col("id").alias("_n"), array_to_vector("x").alias("_v"))

    def mean(to: str, of: str, name: str) -> DataFrame:
        met = edges.select(F.col(to).alias("id"), F.col(of).alias("_n")).join(msg, "_n")
        return met.groupBy("id").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(name))

    out = rows.join(mean("dst", "src", "mean_in"), "id", "left").join(mean("src", "dst", "mean_out"), "id", "left")
    zeros = F.transform("x", lambda v: F.lit(0.0))
    return out.withColumns({c: F.coalesce(c, zeros) for c in ("mean_in", "mean_out")})


def _mapped(rows: DataFrame, columns: list[str], function, name: str, kind: str, keep: list[str]) -> DataFrame:
    """keep and name = function(matrix of each of the columns) by Arrow batches."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = function(*(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in columns))
                value = pa.array(out) if out.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), value], names=[*keep, name])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{name}` {kind}"])
    return rows.select(*keep, *(c for c in columns if c not in keep)).mapInArrow(run, schema)


# --- isolation forest


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, seed: int, height: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, depth plus what the rest of its rows would add)."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, float, int, int, float]] = [(-1, 0.0, 0, 0, 0.0)]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0, initial=np.inf), x[rows].max(axis=0, initial=-np.inf)
        free = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or not len(free):
            nodes[at] = (-1, 0.0, 0, 0, depth + path_norm(len(rows)))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        less = x[rows, f] < cut
        left = len(nodes)
        nodes += [(-1, 0.0, 0, 0, 0.0)] * 2
        nodes[at] = (f, cut, left, left + 1, 0.0)
        todo += [(left, rows[less], depth + 1), (left + 1, rows[~less], depth + 1)]
    return nodes


def fit_isolation_forests(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> dict[int, tuple[list[np.ndarray], int]]:
    """For each part of rows (id, x, part int) its trees and their sample size, all in one pass. Each tree gets about sample rows
    by a hash of the id, so a part's forest is the same every time and whatever other parts there are."""
    ship_package(rows.sparkSession)
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = {part: min(sample, n) for part, n in counts.items()}
    grown = {part: [] for part in counts}
    large = {part: n for part, n in counts.items() if n >= FEWEST}
    if large:
        limit = {part: int(min(1.0, 1.3 * sizes[part] / n) * (1 << 30)) for part, n in large.items()}
        cut = F.create_map(*(F.lit(v) for kv in limit.items() for v in kv))[F.col("part")]
        dealt = rows.filter(F.col("part").isin(*large)).withColumn("cut", cut)
        dealt = dealt.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 30)) < F.col("cut"))))

        def grow(group):
            import pandas as pd

            part, tree = int(group["part"].iloc[0]), int(group["tree"].iloc[0])
            x, size = np.array(group.sort_values("id")["x"].tolist(), float), sizes[part]
            pick = np.random.default_rng([seed, tree]).permutation(len(x))[:size]
            nodes = grow_tree(x[pick], seed * 1000 + tree, int(np.ceil(np.log2(max(2, size)))))
            return pd.DataFrame({"part": [part], "tree": [tree], "nodes": [np.array(nodes, float).ravel()]})

        for r in dealt.groupBy("part", "tree").applyInPandas(grow, "part int, tree int, nodes array<double>").orderBy("part", "tree").collect():
            grown[r.part].append(np.array(r.nodes).reshape(-1, 5))
    return {part: (grown[part], sizes[part]) for part in counts}


def fit_isolation_forest(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Trees and their sample size, over all rows (id, x)."""
    return fit_isolation_forests(rows.withColumn("part", F.lit(0)), trees, sample, seed).get(0, ([], 0))


def forest_score(x: np.ndarray, forest: list[np.ndarray], size: int) -> np.ndarray:
    if not forest:
        return np.full(len(x), 0.5)
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = t[at, 0] >= 0
            if not inner.any():
                break
            k = at[inner]
            less = x[inner, t[k, 0].astype(int)] < t[k, 1]
            at[inner] = np.where(less, t[k, 2], t[k, 3]).astype(int)
        total += t[at, 4]
    return 2.0 ** (-(total / len(forest)) / max(1e-9, path_norm(size)))


def isolation_scores(rows: DataFrame, forest: list[np.ndarray], size: int) -> DataFrame:
    """(id, anomaly) from 0 to 1; all 0.5 where there were too few rows to learn from."""
    shared = rows.sparkSession.sparkContext.broadcast((forest, size))
    return _mapped(rows, ["x"], lambda x: forest_score(x, *shared.value), "anomaly", "double", ["id"])


def part_scores(rows: DataFrame, forests: dict[int, tuple[list[np.ndarray], int]]) -> DataFrame:
    """(id, anomaly) of rows (id, x, part), each by the forest of its part. Forests are broadcast, some 3 MB each."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def score(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in np.unique(part):
            own = part[:, 0] == k
            out[own] = forest_score(x[own], *shared.value[int(k)])
        return out

    return _mapped(rows.select("id", "x", F.array("part").alias("part")), ["x", "part"], score, "anomaly", "double", ["id"])


# --- graph network


@dataclass
class GraphNet:
    """Two mean-aggregating layers and a logit head; layers are (self, in, out, bias)."""

    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    head: tuple[np.ndarray, float]
    mean: np.ndarray
    std: np.ndarray
    clip: float | None = None

    def scores(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, gnn_prob): each layer is two joins that bring neighbours' means, and one product by Arrow batches."""
        h = standardise(rows.select("id", "x"), self.mean, self.std, self.clip)
        for layer in self.layers:
            met = neighbour_mean(h, edges)
            h = _mapped(met, ["x", "mean_in", "mean_out"], lambda x, i, o, w=layer: np.maximum(x @ w[0] + i @ w[1] + o @ w[2] + w[3], 0), "h", "array<double>", ["id"]).withColumnRenamed("h", "x")
        w, b = self.head
        return _mapped(h, ["x"], lambda x: 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))), "gnn_prob", "double", ["id"])


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Named arrays as a Parquet table (name, shape, cells)."""
    rows = [(n, list(a.shape), a.astype(float).ravel().tolist()) for n, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.cells).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def net_arrays(net: GraphNet) -> dict[str, np.ndarray]:
    arrays = {f"layer{k}_{n}": w for k, layer in enumerate(net.layers) for n, w in zip(("self", "in", "out", "bias"), layer, strict=True)}
    return arrays | {"head": net.head[0], "head_bias": np.array([net.head[1]]), "mean": net.mean, "std": net.std, "clip": np.array([np.nan if net.clip is None else net.clip])}


def net_of(a: dict[str, np.ndarray]) -> GraphNet:
    layers = [tuple(a[f"layer{k}_{n}"] for n in ("self", "in", "out", "bias")) for k in range(2)]
    clip = float(a["clip"][0])
    return GraphNet(layers, (a["head"], float(a["head_bias"][0])), a["mean"], a["std"], None if np.isnan(clip) else clip)


def save_net(spark: SparkSession, net: GraphNet, path: str) -> None:
    save_arrays(spark, net_arrays(net), path)


def load_net(spark: SparkSession, path: str) -> GraphNet:
    return net_of(load_arrays(spark, path))


def _summed(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by where they go."""
    total = np.zeros((n, values.shape[1]))
    if len(to):
        order = np.argsort(to, kind="stable")
        own, first = np.unique(to[order], return_index=True)
        total[own] = np.add.reduceat(values[order], first, axis=0)
    return total


def _mean_of(h: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 1 / np.maximum(np.bincount(dst, minlength=n).astype(float), 1)
    return _summed(h[src], dst, n) * scale[:, None], scale


def clipped(z: np.ndarray, clip: float | None) -> np.ndarray:
    return z if clip is None else np.clip(z, -clip, clip)


def local_scores(net: GraphNet, x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A network's scores over a graph that fits the driver, as training looks at them between steps."""
    h = clipped((x - net.mean) / net.std, net.clip)
    for own, into, out, bias in net.layers:
        h = np.maximum(h @ own + _mean_of(h, src, dst, len(h))[0] @ into + _mean_of(h, dst, src, len(h))[0] @ out + bias, 0)
    return 1 / (1 + np.exp(-np.clip(h @ net.head[0] + net.head[1], -60, 60)))


def local_graph(rows: DataFrame, edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, src, dst, y) of a graph (id, x, y), (src, dst) in order of its ids, on the driver; refused beyond TRAIN_CELLS."""
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if n * (d or 0) > TRAIN_CELLS:
        raise ValueError(f"{n} nodes of {d} features exceed {TRAIN_CELLS} values; draw a bounded subgraph first")
    data = rows.select("id", "x", "y").orderBy("id").toPandas()
    place = {k: i for i, k in enumerate(data["id"])}
    ends = edges.select("src", "dst").orderBy("src", "dst").toPandas()
    src, dst = (ends[c].map(place).to_numpy(np.int64) for c in ("src", "dst"))
    return np.array(data["x"].tolist()).reshape(len(data), -1), src, dst, data["y"].to_numpy(float, na_value=np.nan)


def first_weights(dims: list[int], seed: int) -> list[np.ndarray]:
    """Uniform Glorot weights of two layers of three matrices and a bias, and of the head."""
    rng = np.random.default_rng(seed)
    uniform = lambda a, b, *shape: rng.uniform(-1, 1, shape) * np.sqrt(6 / (a + b))
    layers = [uniform(dims[k], dims[k + 1], dims[k], dims[k + 1]) if j < 3 else np.zeros(dims[k + 1]) for k in range(2) for j in range(4)]
    return [*layers, uniform(dims[2], 1, dims[2]), np.zeros(1)]


def net_with(p: list[np.ndarray], mean: np.ndarray, std: np.ndarray, clip: float | None) -> GraphNet:
    return GraphNet([tuple(p[0:4]), tuple(p[4:8])], (p[8], float(p[9][0])), mean, std, clip)


def adam(p: list[np.ndarray], gradient, epochs: int, lr: float, stop=None) -> list[np.ndarray]:
    """p after at most so many steps along gradient(p) -> (loss, gradient); stop(step, loss, p) ends it by returning true."""
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        loss, g = gradient(p)
        p = list(p)
        for k in range(len(p)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if stop and stop(step, loss, p):
            break
    return p


def train_graph_net(x: np.ndarray, src: np.ndarray, dst: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 300, lr: float = 0.01, l2: float = 1e-4, seed: int = 0, mask: np.ndarray | None = None, callback=None, clip: float | None = None) -> GraphNet:
    """Full-batch Adam on class-balanced cross-entropy with L2 on weights, for a graph whose features are at most TRAIN_CELLS
    numbers; operators.train takes larger ones. callback(step, loss, net) ends the training by returning true."""
    if x.size > TRAIN_CELLS:
        raise ValueError(f"train on at most {TRAIN_CELLS} feature values here; operators.train takes larger graphs")
    mask = np.ones(len(x), bool) if mask is None else mask
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std < 1e-9, 1.0, std)
    z = clipped((x - mean) / std, clip)
    pos = max(1, int(y[mask].sum()))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(1, int(mask.sum()) - pos)) * mask
    stop = (lambda step, loss, p: callback(step, loss, net_with(p, mean, std, clip))) if callback else None
    p = adam(first_weights([x.shape[1], hidden, hidden], seed), lambda p: graph_net_gradient(p, z, src, dst, y, weight, l2), epochs, lr, stop)
    return net_with(p, mean, std, clip)


def penalty(p: list[np.ndarray], l2: float) -> float:
    """The loss's share of weights, biases left out."""
    return 0.5 * l2 * (sum(float((w * w).sum()) for w in p if w.ndim == 2) + float((p[8] ** 2).sum()))


def graph_net_gradient(p: list[np.ndarray], z: np.ndarray, src: np.ndarray, dst: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradient in every parameter."""
    n, h, kept = len(z), z, []
    for k in (0, 4):
        i, i_scale = _mean_of(h, src, dst, n)
        o, o_scale = _mean_of(h, dst, src, n)
        a = h @ p[k] + i @ p[k + 1] + o @ p[k + 2] + p[k + 3]
        kept.append((h, i, o, i_scale, o_scale, a))
        h = np.maximum(a, 0)
    logit = h @ p[8] + p[9][0]
    prob = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum()) + penalty(p, l2)
    d = weight * (prob - y)
    g: list[np.ndarray] = [np.zeros_like(a) for a in p]
    g[8], g[9] = h.T @ d + l2 * p[8], np.array([d.sum()])
    back = np.outer(d, p[8])
    for k, (h0, i, o, i_scale, o_scale, a) in zip((4, 0), reversed(kept), strict=True):
        back = back * (a > 0)
        g[k], g[k + 1], g[k + 2], g[k + 3] = h0.T @ back + l2 * p[k], i.T @ back + l2 * p[k + 1], o.T @ back + l2 * p[k + 2], back.sum(axis=0)
        down = back @ p[k].T
        down += _summed((back @ p[k + 1].T * i_scale[:, None])[dst], src, n) + _summed((back @ p[k + 2].T * o_scale[:, None])[src], dst, n)
        back = down
    return loss, g


def _logit(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.log(held / (1 - held))


def occlusion(net: GraphNet, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, feature, drop): how far the log-odds fall when one standardised feature is zero everywhere.

    All features go through the network in one pass: rows and edges are keyed by the feature left out.
    """
    d = len(net.mean)
    every = F.explode(F.sequence(F.lit(-1), F.lit(d - 1))).alias("f")
    means = F.array(*map(F.lit, net.mean.tolist()))
    left = rows.select("id", "x", every).withColumn("x", F.transform("x", lambda v, k: F.when(k == F.col("f"), means[k]).otherwise(v)))
    keyed = left.select(F.struct("id", "f").alias("id"), "x")
    links = edges.select("src", "dst", every).select(F.struct(F.col("src").alias("id"), "f").alias("src"), F.struct(F.col("dst").alias("id"), "f").alias("dst"))
    p = net.scores(keyed, links).select(F.col("id.id").alias("id"), F.col("id.f").alias("f"), _logit(F.col("gnn_prob")).alias("z"))
    full = p.filter("f = -1").select("id", F.col("z").alias("z0"))
    return p.filter("f >= 0").join(full, "id").select("id", F.col("f").alias("feature"), (F.col("z0") - F.col("z")).alias("drop"))


# --- logistic fusion


def fit_logistic(rows: DataFrame, l2: float = 1.0, balanced: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of min sum w logloss + l2/2 |w|^2 over rows (x, y), the bias free; classes weigh the same if balanced."""
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    w = F.when(F.col("y") == 1, n / (2.0 * max(1, pos))).otherwise(n / (2.0 * max(1, n - pos))) if balanced else F.lit(1.0)
    train = rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), w.alias("w"))
    model = LogisticRegression(weightCol="w", regParam=l2 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(train)
    return model.coefficients.toArray(), float(model.intercept)
