"""MinHash near-duplicates: sets of word shingles linked by exact Jaccard similarity, found by one-permutation hashing.

A set's hashes are sorted once, and the first of each of BINS ranges is that bin's least: one permutation gives all of a
signature. An empty bin takes the value of the first filled one in an order of its own (optimal densification), so that bins of
two sets agree with about the chance of their similarity, each bin by itself. Bands of ROWS bins are the buckets; with BANDS of
them a pair at the threshold shares none with a chance of (1 - 0.8 ** 8) ** 64, less than one in 100,000.

Candidate edges are stars. In every bucket that still holds different components one set is the centre, and each set meets one
centre of another component, that which most buckets hold; then components are found anew, other sets are centres, and so on
for ROUNDS rounds. So a round has no more edges than sets, and a large group of near copies is settled by a few stars. What then
is left in buckets in different components is compared in blocks, as arrays of one-bit signatures; so whatever stars were drawn,
no pair that shares a bucket goes unseen. Every link is confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.neardup import CELL_BYTES, _node, kept_pairs, near_sets, shingle_set
from txintel.llm.simhash import _small
from txintel.llm.text import forget, neutral, slices
from txintel.operators.components import connected_components
from txintel.runtime import checkpoint, release, ship_package, table

#: Words of a shingle, and the similarity that links, in percent.
SHINGLE, SIMILAR = 4, 80
BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
#: Rounds of stars before blocks are compared, and nodes of a block.
ROUNDS, BLOCK = 3, 1024
#: Standard deviations that one-bit signatures of a link may be off, that of the share of bins that agree, and sets too small for either.
SLACK, STRAY, FEW = 5.0, 0.015, 16
_SEED = 11


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """The fixed tables behind signatures: for each bin the order in which it looks for a filled one, and numbers to mix with."""

    def __init__(self, bins: int = BINS):
        rng = np.random.default_rng(_SEED)
        self.bins, self.shift = bins, np.uint64(64 - bins.bit_length() + 1)
        self.order = rng.permuted(np.tile(np.arange(bins, dtype=np.int16), (bins, 1)), axis=1)
        self.rank = np.argsort(self.order, axis=1).astype(np.int16)
        self.salt, self.odd = rng.integers(0, 2**64, (2, bins), np.uint64)

    def sign(self, own: np.ndarray) -> np.ndarray:
        """The value of each bin, empty ones densified. own: distinct 64-bit hashes, at least one."""
        h = np.sort(_mixed(own ^ np.uint64(_SEED)))
        bin_ = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_, prepend=-1))
        filled = bin_[first]
        out = np.zeros(self.bins, np.uint64)
        out[filled] = h[first]
        if len(filled) == self.bins:
            return out
        has = np.zeros(self.bins, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        if len(filled) <= 32:
            out[empty] = out[filled[self.rank[empty][:, filled].argmin(axis=1)]]
            return out
        for k in range(self.bins):
            at = self.order[empty, k]
            found = has[at]
            out[empty[found]] = out[at[found]]
            empty = empty[~found]
            if not len(empty):
                break
        return out

    def bands(self, signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """Keys of the buckets of each signature, one column a band."""
        n = len(signs)
        summed = _mixed(_mixed(signs + self.salt) * self.odd).reshape(n, -1, rows).sum(axis=2, dtype=np.uint64)
        return _mixed(summed + self.salt[: summed.shape[1]]).view(np.int64)

    def bits(self, signs: np.ndarray) -> np.ndarray:
        """One bit of each bin, packed into 64-bit words."""
        return np.packbits((_mixed((signs ^ self.salt) * self.odd) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)


def most_apart(least: Column | np.ndarray, percent: int, bins: int = BINS) -> Column | np.ndarray:
    """Bits in which one-bit signatures of linked sets differ at most, given the size of the smaller set. Of the bins that
    disagree, whose share is that of a pair at the threshold, half differ in their bit; elements that share a bin hide each
    other and let that share stray by STRAY. Sets of fewer than FEW elements may differ in all bits."""
    apart = 1 - percent / 100
    limit = bins * apart / 2 + SLACK * (bins * apart / 2 * (1 - apart / 2) + (bins / 2 * STRAY) ** 2) ** 0.5
    return F.when(least < FEW, bins).otherwise(F.lit(limit)) if isinstance(least, Column) else np.where(least < FEW, bins, limit)


def signed(docs: DataFrame, key_col: str, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, key, node, size, bands, bits) for every row: node names its set, bands and bits are raw numbers. A set without
    shingles has neither."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        signer = Signer()
        for some, texts in slices(batches, text_col):
            own = [shingle_set(t, shingle) for t in texts]
            signs = np.stack([signer.sign(x) if len(x) else np.zeros(BINS, np.uint64) for x in own]) if own else np.zeros((0, BINS), np.uint64)
            raw = [[x.tobytes() for x in y] for y in (signer.bands(signs), signer.bits(signs))]
            node = np.array([_node(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(id_col), some.column(key_col), pa.array(node), pa.array(list(map(len, own)), pa.int32()), *(pa.array(x, pa.binary()) for x in raw)], names=["id", "key", "node", "size", "bands", "bits"])

    return docs.select(id_col, key_col, text_col).mapInArrow(run, f"id {kind}, key bigint, node bigint, size int, bands binary, bits binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                keys = np.frombuffer(b"".join(some.column("bands").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some.column("node").to_numpy(), BANDS))], names=["bucket", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "bucket bigint, node bigint")


def _bit_words() -> list[str]:
    return [f"b{k}" for k in range(BINS // 64)]


def possible(p: str, q: str, percent: int) -> Column:
    """Whether two rows, whose columns have these prefixes, can be linked by size and one-bit signature."""
    m, n = F.col(p + "size"), F.col(q + "size")
    off = sum((F.bit_count(F.col(p + w).bitwiseXOR(F.col(q + w))) for w in _bit_words()), F.lit(0))
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (off <= most_apart(F.least(m, n), percent))


def block_links(met: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Links (a < b) between different components in a bucket. met: (bucket, node, component, size, b0, ...); cells: (node, cells),
    their sets.

    A bucket's rows are dealt into blocks of about BLOCK rows and CELL_BYTES, and each pair of blocks is compared by a task that
    holds no more than these two: signatures as arrays first, then the sets of pairs that they leave. Only links leave the task,
    however many pairs a bucket has.
    """
    words, exact = _bit_words(), near_sets(percent)
    deal = met.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("size") / CELL_BYTES)).cast("int").alias("number"))
    placed = met.join(deal, "bucket").withColumn("at", F.pmod(F.xxhash64("node"), F.col("number")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    both = placed.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "node", "component", "size", *words).join(cells, "node")

    def compare(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        node, component, at, size, i, j = (some.column(c).to_numpy() for c in ("node", "component", "at", "size", "i", "j"))
        bits = np.stack([some.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
        group, members = np.unique(component, return_counts=True)
        largest = group[members.argmax()]
        out = [(np.zeros(0, np.int64),) * 2]
        for p in np.array_split(rest := np.flatnonzero(component != largest), max(1, len(rest) // 256)):
            off = sum(np.bitwise_count(bits[p, k][:, None] ^ bits[None, :, k]).astype(np.int32) for k in range(len(words)))
            least, most = np.minimum(size[p][:, None], size[None]), np.maximum(size[p][:, None], size[None])
            good = (component[p][:, None] != component[None]) & (least.astype(np.int64) * 100 >= most.astype(np.int64) * percent) & (off <= most_apart(least, percent))
            good &= (component[None] == largest) | (node[p][:, None] < node[None])
            if i[0] != j[0]:  # pairs within one block meet where that block is compared with itself
                good &= at[p][:, None] != at[None]
            x, y = np.nonzero(good)
            out.append((p[x], y))
        u, v = (np.concatenate(x) for x in zip(*out, strict=True))
        kept = exact({"cells": some.column("cells")}, u, v) if len(u) else np.zeros(0, bool)
        u, v = node[u[kept]], node[v[kept]]
        return np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> pa.RecordBatch:
            a, b = compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
            edges = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(key[:, x].tolist())
                if own != at and held:
                    yield done()
                    held = []
                at = own
                held.append(batch.slice(x, y - x))
        if held:
            yield done()

    return both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a bigint, b bigint")


def set_components(nodes: DataFrame, docs: DataFrame, text_col: str, key_col: str, shingle: int = SHINGLE, percent: int = SIMILAR, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes with a link, and the links (a, b) confirmed: enough of them that the components are those of
    all pairs that share a bucket and whose sets' similarity is percent or more. nodes: (node, size, bands, bits, row),
    checkpointed; row is the key of a row of docs with that set."""
    words = _bit_words()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.int64).reshape(batch.num_rows, len(words))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(words)))], names=["node", "size", *words])

    rows = buckets(nodes)
    keys = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    met = checkpoint(rows.join(_small(keys), "bucket"))
    # the centre of a bucket is its node in most shared buckets: near copies gather around what they copy
    shared = checkpoint(met.join(met.groupBy("node").agg(F.count("*").alias("often")), "node"))
    release(keys, met)
    sketch = checkpoint(nodes.select("node", "size", "bits").join(shared.select("node"), "node", "left_semi").mapInArrow(unpacked, "node bigint, size int, " + ", ".join(f"{w} bigint" for w in words)))
    side = lambda p, as_: sketch.select(F.col("node").alias(as_), *(F.col(c).alias(p + c) for c in ("size", *words)))

    def sets(wanted: DataFrame) -> DataFrame:
        """(node, cells) of the nodes wanted, a checkpointed table with their rows."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in slices(batches, text_col):
                own = [shingle_set(t, shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in own], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "cells"])

        again = docs.join(_small(wanted.select(F.col("row").alias("__row")).distinct()), F.col(key_col) == F.col("__row"), "left_semi").select(text_col)
        # equal rows of docs give a set each
        return again.mapInArrow(whole, "node bigint, cells binary").groupBy("node").agg(F.first("cells").alias("cells"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among checkpointed pairs, by their sets."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = checkpoint(ends.join(nodes.select("node", "row", "size"), "node"))
        out = kept_pairs(pairs, sets(wanted), 8 * (wanted.agg(F.sum("size")).first()[0] or 0), near_sets(percent))
        release(wanted)
        return out

    links = nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    part, centres = connected_components(links, "a", "b"), nodes.select("node").limit(0)

    def labelled() -> DataFrame:
        return shared.join(_small(part), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def joined(found: DataFrame) -> None:
        nonlocal links, part
        links = links.unionByName(found)
        release(part)
        part = connected_components(links, "a", "b")

    for _ in range(rounds):
        label = labelled()
        # who has been a centre is none again
        free = label.join(_small(centres.select("node", F.lit(True).alias("was"))), "node", "left")
        most = F.max(F.when(F.col("was").isNull(), F.struct("often", "node", "component"))).alias("c")
        open_ = free.groupBy("bucket").agg(most, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi and c is not null")
        around = checkpoint(open_.select("bucket", "c"))
        met = label.join(_small(around), "bucket").filter(F.col("component") != F.col("c.component"))
        stars = checkpoint(met.groupBy("node").agg(F.max("c").alias("c")).select("node", F.col("c.node").alias("centre")))
        pairs = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        maybe = checkpoint(pairs.join(side("p_", "a"), "a").join(side("q_", "b"), "b").filter(possible("p_", "q_", percent)).select("a", "b"))
        centres = centres.unionByName(checkpoint(stars.select(F.col("centre").alias("node")).distinct()))
        found = maybe.head(1)
        if found:
            joined(verified(maybe))
        release(around, stars, maybe)
        if not found:
            break
    label = labelled()
    open_ = label.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    left = checkpoint(label.join(_small(checkpoint(open_)), "bucket").select("bucket", "node", "component"))
    if left.head(1):
        wanted = checkpoint(left.select("node").distinct().join(nodes.select("node", "row"), "node"))
        found = checkpoint(block_links(left.join(sketch, "node"), sets(wanted), percent).distinct())
        release(wanted)
        if found.head(1):
            joined(found)
    release(shared, sketch, left)
    return part, links


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: the size of its set of shingles, the least id reachable over links,
    and whether that is its own id.

    Rows of equal sets are one node, so a group of copies of any size is one row to the search. Null and empty texts and those
    without words have no shingles and are linked with nothing, not even each other. A row with a null id joins its component
    but can't name it; where all ids are null component_id and kept are null. Repeated rows stay, and each of a repeated least
    id is kept. Extra columns play no part. An empty table gives no rows.
    """
    plain, (row_id, text), _ = neutral(docs.select(id_col, text_col), id_col, text_col)
    keyed = plain.withColumn("key_", F.xxhash64(*plain.columns))
    prints = checkpoint(signed(keyed, "key_", row_id, text, shingle))
    nodes = checkpoint(prints.filter("size > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "bands", "bits")), F.min("key").alias("row"), F.min("id").alias("least")))
    part, _ = set_components(nodes, keyed, text, "key_", shingle, percent)
    linked = nodes.select("node", "least").join(part, "node")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = checkpoint(linked.join(named, "component").select("node", "component_id"))
    least = checkpoint(nodes.select("node", "least").join(_small(reached), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
    release(nodes, part, reached)
    alone = prints.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    out = prints.filter("size > 0").select("id", "size", "node").join(least, "node").select("id", "size", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept of every document of the whole table; minhash_components says what odd rows give."""
    return minhash_components(table(spark, sf_dir, "documents"))


#: Sets by their shingles as text; pairs of equal sets first collapse to one, else groups of copies would be squared.
OP11_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(list_zip(w[1 : len(w) - 3], w[2 : len(w) - 2], w[3 : len(w) - 1], w[4 :]), lambda z : z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4]) END)) AS s FROM cut
), node AS (
  SELECT min(row) AS node, min(doc_id) AS least, s FROM shingled WHERE len(s) > 0 GROUP BY s
), each AS (
  SELECT node, unnest(s) AS f FROM node
), met AS (
  SELECT x.node AS a, y.node AS b, count(*) AS n FROM each x JOIN each y ON x.f = y.f AND x.node < y.node GROUP BY 1, 2
), link AS (
  SELECT a, b FROM met JOIN node x ON x.node = a JOIN node y ON y.node = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), reach(node, other) AS (
  SELECT node, node FROM node
  UNION
  SELECT reach.node, CASE WHEN link.a = reach.other THEN link.b ELSE link.a END FROM reach JOIN link ON reach.other IN (link.a, link.b)
), named AS (
  SELECT reach.node, min(o.least) AS component_id FROM reach JOIN node o ON o.node = reach.other GROUP BY reach.node
)
SELECT doc_id, len(shingled.s)::BIGINT AS n_shingles, CASE WHEN len(shingled.s) = 0 THEN doc_id ELSE component_id END AS component_id, doc_id = CASE WHEN len(shingled.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM shingled LEFT JOIN node ON shingled.s = node.s LEFT JOIN named USING (node)
"""
