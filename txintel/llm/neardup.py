"""Near duplicates by Jaccard similarity of word shingle sets, found by wide SimHash fingerprints.

Each set gets a fingerprint of many bits. Two sets of Jaccard similarity s have a cosine of at least 2 s / (1 + s), so each bit
differs with a known chance; a part of the bits lies within a threshold with a chance that follows from it. As for narrow
fingerprints, correlated bits share a part, and a dynamic program allocates thresholds to parts by estimated candidate counts,
here such that a pair of just that similarity is missed by all parts with a chance of MISSED at most. Pairs that meet in a part
are held against two words of the fingerprint, then against all of it, and what is left against the sets themselves: every link
is exact. In a bucket crowded by near copies, blocks of fingerprints are compared as arrays, as most such pairs are no links.
A shingle counts as its 64-bit XXH64, a set as that of its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txintel.llm.simhash import _small, allocate, bucket_links, bucket_rows, crowd, first_of_each, part_costs, part_values, parts_by_correlation
from txintel.llm.text import forget, give_back, neutral, slices, words
from txintel.operators.components import connected_components
from txintel.runtime import checkpoint, release, ship_package

#: Words of a shingle, and the similarity that links, in percent.
SHINGLE, SIMILAR = 5, 80
#: 64-bit words of a fingerprint, the chance that a pair at the threshold is missed, and the widths tried for its parts.
WORDS, MISSED, WIDTHS = 16, 0.002, (12, 14, 16, 18, 20)
#: Fingerprints in the sample behind the cost estimates.
SAMPLE = 1000
#: Bits in which links may differ beyond what is expected of a pair at the threshold, in standard deviations: for all bits and
#: for the CHECKED words that meet first. Sets of fewer than FEW shingles differ in up to a quarter more bits, as halves of even numbers count as zeros.
SLACK, WORD_SLACK, FEW, CHECKED = 4.0, 3.5, 24, 2
#: Nodes of a block in a crowded bucket, and bounds of a block of verification: bytes of its sets, and pairs.
BLOCK, CELL_BYTES, BLOCK_PAIRS = 1024, 32 << 20, 250_000


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending. Fewer words than a shingle are one shingle; no words, no shingle."""
    held, found = [], []
    for some in words(text):
        held += some
        n = len(held) - shingle + 1
        if n > 0:
            runs = map(b" ".join, zip(*(held[k:] for k in range(shingle)), strict=False))
            found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, n)))
            held = held[n:]
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held))] if held else [], np.uint64)
    return np.unique(np.concatenate(found))


def wide_fingerprint(own: np.ndarray, size: int = WORDS) -> bytes:
    """64 * size bits: each 1 if set in over half of the set's hashes, which are mixed anew for each word; 0 for an empty set."""
    words_, counts = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(64 * size, np.int64)
    for at in range(0, len(own), 255):  # a byte counts up to 255
        x = own[at : at + 255, None] + words_
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(x), -1), axis=1)
        counts += np.add.reduce(ones.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(own)).tobytes()


def chance_apart(percent: int) -> float:
    """The chance that a bit differs between sets of equal size and that Jaccard similarity; for unequal sizes it is less."""
    s = percent / 100
    return acos(2 * s / (1 + s)) / pi


def most_apart(bits: int, percent: int, slack: float, few: bool) -> int:
    """Bits in which fingerprints of linked sets differ at most, but for a chance that slack makes as small as wanted."""
    p = (1.25 if few else 1.0) * chance_apart(percent)
    return min(bits, ceil(bits * p + slack * (bits * p * (1 - p)) ** 0.5))


def plan_parts(bits: np.ndarray, n: int, percent: int, missed: float = MISSED) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds (-1: left out) of least estimated cost for n sets, such that the chance to miss a pair of that
    similarity is at most missed. bits: those of a sample, one row a fingerprint."""
    p, step, best = chance_apart(percent), 0.01, None
    need = ceil(-log(missed) / step)
    for width in WIDTHS:
        m = bits.shape[1] // width
        parts = parts_by_correlation(bits, m)
        units = [[0] for _ in parts]
        for unit, part in zip(units, parts, strict=True):
            for t in (0, 1, 2):
                found = sum(comb(len(part), k) * p**k * (1 - p) ** (len(part) - k) for k in range(t + 1))
                unit.append(int(-log(1 - found) / step))
        cost, limits = allocate(part_costs(bits, parts, n, 2), units, need)
        if limits and (best is None or cost < best[0]):
            best = (cost, parts, limits)
    assert best is not None, "no plan misses so little"
    return best[1], best[2]


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _bits(prints: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)


def _numbers(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, given as 64-bit numbers in the last axis."""
    out = np.zeros(np.broadcast_shapes(p.shape, q.shape)[:-1], np.uint16)
    for k in range(p.shape[-1]):
        out += np.bitwise_count(p[..., k] ^ q[..., k])
    return out


def _possible(off: np.ndarray, m: np.ndarray, n: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Whether sets of m and n shingles, whose fingerprints are off bits apart, can be linked."""
    limit = np.where(np.minimum(m, n) < FEW, most_apart(width, percent, SLACK, True), most_apart(width, percent, SLACK, False))
    return (off <= limit) & (np.minimum(m, n).astype(np.int64) * 100 >= np.maximum(m, n).astype(np.int64) * percent)


def kept_pairs(pairs: DataFrame, cells: DataFrame, size: int, keep: Callable[[dict[str, pa.Array], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs (a, b) that keep accepts, given the cells' columns and both nodes' places there. cells: (node, ...), about size bytes in all.

    Nodes are dealt into blocks; each pair of blocks gets its pairs and, once each, the cells that they need. So a node's cells
    travel at most once a block, however many pairs it has. Pairs come to keep in order of a.
    """
    number = max(8, ceil(size / CELL_BYTES), ceil((pairs.count() / BLOCK_PAIRS) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(number)).cast("int")
    dealt = pairs.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b")
    ends = [dealt.select("i", "j", F.col(c).alias("node")).distinct() for c in ("a", "b")]
    need = checkpoint(ends[0].unionByName(ends[1]).distinct())

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        node = there.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        held = {c: there.column(c).combine_chunks() for c in there.column_names if c not in ("i", "j", "node")}
        here = here.select(["a", "b"]).sort_by("a")
        ends, there_ = [here.column(c).to_numpy() for c in ("a", "b")], np.ones(here.num_rows, bool)
        at = []
        for x in ends:
            k = order[np.minimum(np.searchsorted(node[order], x), len(node) - 1)] if len(node) else np.zeros(len(x), np.int64)
            there_ &= node[k] == x if len(node) else False
            at.append(k)
        mask = np.zeros(here.num_rows, bool)
        mask[there_] = keep(held, at[0][there_], at[1][there_]) if there_.any() else False
        del held
        give_back()
        return here.filter(pa.array(mask, pa.bool_()))

    kept = checkpoint(dealt.groupBy("i", "j").cogroup(cells.join(_small(need), "node").groupBy("i", "j")).applyInArrow(run, "a bigint, b bigint"))
    release(need)
    return kept


def near_sets(percent: int) -> Callable[[dict[str, pa.Array], np.ndarray, np.ndarray], np.ndarray]:
    """Whether the sets of pairs, ascending 64-bit numbers in the column cells, are that similar. The pairs of one a are looked
    up in its set together."""

    def near(held: dict[str, pa.Array], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cells = held["cells"].to_pylist()
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cells), np.int64, len(cells)) // 8)])
        flat = np.frombuffer(b"".join(cells), np.uint64)
        out = np.zeros(len(a), bool)
        edges = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            own = flat[starts[a[x]] : starts[a[x] + 1]]
            for u in range(x, y, 256):
                some = b[u : min(y, u + 256)]
                sizes = starts[some + 1] - starts[some]
                if not len(own) or not sizes.all():
                    continue  # an empty set is linked with nothing
                theirs = np.concatenate([flat[p:q] for p, q in zip(starts[some].tolist(), starts[some + 1].tolist(), strict=True)])
                hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                out[u : u + len(some)] = both * 100 >= (len(own) + sizes - both) * percent
        return out

    return near


def jaccard_links(nodes: DataFrame, docs: DataFrame, text_col: str, key_col: str, shingle: int = SHINGLE, percent: int = SIMILAR, missed: float = MISSED) -> DataFrame:
    """Pairs (a < b) of nodes whose sets' similarity is percent or more: enough of them that the components are those of all
    that are found.

    nodes: (node, size, fp, row), one row a set; row is the key of a row of docs that has the set.
    """
    sample = [r.fp for r in nodes.select("fp").orderBy("node").limit(SAMPLE).collect()]
    if len(sample) < 2:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    n, width, word = nodes.count(), 8 * len(sample[0]), [f"word{k}" for k in range(CHECKED)]
    parts, limits = plan_parts(_bits(sample).astype(np.float32), n, percent, missed)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                bits = _bits(some.column("fp").to_pylist())
                checked = [pa.array(np.ascontiguousarray(np.packbits(bits[:, 64 * k : 64 * k + 64], axis=1)).view(np.int64).ravel()) for k in range(CHECKED)]
                for key, own in bucket_rows(bits, parts, limits):
                    yield pa.RecordBatch.from_arrays([pa.array(key), some.column("node"), pa.array(np.full(len(key), own)), some.column("size"), *checked, some.column("component"), some.column("grouped")], names=["key", "node", "own", "size", *word, "component", "grouped"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text_col):
            own = [shingle_set(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in own], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "cells"])

    def near_prints(held: dict[str, pa.Array], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fp, sizes, out = _numbers(held["fp"].to_pylist()), held["size"].to_numpy(), np.zeros(len(a), bool)
        for x in range(0, len(a), 1 << 16):
            p, q = a[x : x + (1 << 16)], b[x : x + (1 << 16)]
            out[x : x + len(p)] = _possible(_apart(fp[p], fp[q]), sizes[p], sizes[q], width, percent)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that are links: by their whole fingerprints first, then by their sets."""
        maybe = kept_pairs(pairs, nodes.select("node", "fp", "size"), n * width // 8, near_prints)
        met = maybe.select(F.col("a").alias("node")).distinct().unionByName(maybe.select(F.col("b").alias("node")).distinct()).distinct()
        wanted = checkpoint(met.join(nodes.select("node", "row", "size"), "node"))
        again = docs.join(_small(wanted.select(F.col("row").alias("__row"))), F.col(key_col) == F.col("__row"), "left_semi").select(text_col)
        bytes_ = 8 * (wanted.agg(F.sum("size")).first()[0] or 0)
        out = kept_pairs(maybe, again.mapInArrow(whole, "node bigint, cells binary"), bytes_, near_sets(percent))
        release(pairs, maybe, wanted)
        return out

    def crowds(rows: DataFrame) -> DataFrame:
        """Possible pairs of different components in crowded buckets. A bucket's rows are dealt into blocks, and each pair of
        blocks is compared as arrays; a pair that shares the values of an earlier part too is left to that part's bucket."""
        own = rows.select("key", "node", "component").distinct()
        deal = own.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("number"))
        dealt = own.join(_small(checkpoint(deal)), "key").withColumn("at", F.pmod(F.xxhash64("node"), F.col("number")).cast("int"))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
        placed = met.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "node", "component")
        full = placed.join(nodes.select("node", "size", "fp"), "node")
        used = [(k, part) for k, (part, t) in enumerate(zip(parts, limits, strict=True)) if t >= 0]

        def compare(key: tuple, some: pa.Table) -> pa.Table:
            bucket, i, j = (k.as_py() for k in key)
            node, component, at, sizes = (some.column(c).to_numpy() for c in ("node", "component", "at", "size"))
            prints = some.column("fp").to_pylist()
            words_ = _numbers(prints)
            group, members = np.unique(component, return_counts=True)
            largest = group[members.argmax()]
            a_side, b_side = np.flatnonzero(component != largest), np.arange(len(node))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for p in np.array_split(a_side, max(1, len(a_side) // 256)):
                if not len(p):
                    continue
                good = _possible(_apart(words_[p][:, None], words_[None]), sizes[p][:, None], sizes[None], width, percent)
                good &= component[p][:, None] != component[None]
                good &= (component[None] == largest) | (node[p][:, None] < node[None])
                if i != j:  # pairs within one block meet where that block is compared with itself
                    good &= at[p][:, None] != at[None]
                x, y = np.nonzero(good)
                out.append((p[x], b_side[y]))
            x, y = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            fresh = np.ones(len(x), bool)
            if len(x):
                bits = _bits(prints)
                for k, part in used:
                    if k == bucket >> 48:
                        break
                    value = part_values(bits, part)
                    fresh &= value[x] != value[y]
            u, v = node[x[fresh]], node[y[fresh]]
            return pa.table({"a": pa.array(np.minimum(u, v)), "b": pa.array(np.maximum(u, v))})

        return full.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")

    def near(p: str, q: str) -> Column:
        m, k = F.col(p + "size"), F.col(q + "size")
        limit = F.when(F.least(m, k) < FEW, most_apart(64 * CHECKED, percent, WORD_SLACK, True)).otherwise(most_apart(64 * CHECKED, percent, WORD_SLACK, False))
        off = sum((F.bit_count(F.col(p + w).bitwiseXOR(F.col(q + w))) for w in word), F.lit(0))
        return (F.least(m, k) * 100 >= F.greatest(m, k) * percent) & (off <= limit)

    index = lambda some: some.mapInArrow(indexed, "key bigint, node bigint, own boolean, size int, " + ", ".join(f"{w} bigint" for w in word) + ", component bigint, grouped boolean")
    return bucket_links(nodes.select("node", "size", "fp"), index, ("size", *word), near, crowd(parts, limits, n), verify, crowds)


def jaccard_components(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """(id, key, root) for every row; rows share a root if their sets are linked, directly or over other rows' sets.

    Rows of equal sets are one node, texts without words (nulls too) among them. key_col: a bigint column, equal only in equal
    rows.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for some, texts in slices(batches, text_col):
            own = [shingle_set(t, shingle) for t in texts]
            node = np.array([_node(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(id_col), some.column(key_col), pa.array(node), pa.array(list(map(len, own)), pa.int32()), pa.array([wide_fingerprint(x) for x in own], pa.binary())], names=[id_col, key_col, "node", "size", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    prints = checkpoint(docs.select(id_col, key_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{key_col}` bigint, node bigint, size int, fp binary"))
    nodes = checkpoint(prints.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.min(key_col).alias("row")))
    part = connected_components(jaccard_links(nodes, docs, text_col, key_col, shingle, percent), "a", "b")
    return prints.select(id_col, key_col, "node").join(_small(part), "node", "left").select(id_col, key_col, F.coalesce("component", "node").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows without all but one of each component of near duplicates, which are rows linked by Jaccard similarity 0.8 or
    more of their sets of five-word shingles; first_of_each says which one stays. Null and empty texts are equal; an empty
    table gives no rows."""
    plain, (row_id, text), named = neutral(docs, id_col, text_col)
    keyed = plain.withColumn("__key", F.xxhash64(*plain.columns))
    return named(first_of_each(keyed, jaccard_components(keyed, "__key", row_id, text), row_id))
