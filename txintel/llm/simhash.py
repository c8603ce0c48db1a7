"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance by the generalised pigeonhole principle.

The 64 bits are dealt into m parts, correlated bits together. With thresholds T_i of sum r - m + 1, two fingerprints at
distance r or less differ in at most T_i bits of some part i. Every fingerprint is indexed under its value of each part and
probes, in part i, all values within T_i of its own. A dynamic program picks m and the T_i that cost least, from candidate
counts estimated on a bounded sample; the plan decides the work only, every plan finds the same components.

Not all links are listed: a crowded bucket first links its rows to one of them, and then only fingerprints that these links
leave in different components are compared. So a large group of near copies costs a star and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.text import neutral, slices, words
from txintel.operators.components import connected_components
from txintel.runtime import checkpoint, release, ship_package, table

BITS = 64
#: Fingerprints in the sample behind the cost estimates, and the cost of a probe row against comparing one candidate.
SAMPLE, PROBE_COST, CANDIDATE_COST = 3000, 1.0, 0.03
#: Rows broadcast at most, always counted before.
BROADCAST = 200_000
_ROWS = 1 << 14


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a text: a bit is 1 if set in over half of the shingles' XXH64, repeats included.

    A text of fewer words than a shingle is one shingle; a text without words has fingerprint zero.
    """
    counts, n, held = np.zeros(BITS, np.int64), 0, []
    for some in words(text):
        held += some
        for at in range(0, max(1, len(held) - shingle + 1), _ROWS):
            run = held[at : at + _ROWS + shingle - 1]
            if len(run) < shingle:
                break
            hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(run[k:] for k in range(shingle)), strict=False)), repeat(seed))
            h = np.fromiter(hashes, np.uint64, len(run) - shingle + 1)
            counts += _ones(h)
            n += len(h)
        if len(held) >= shingle:
            held = held[len(held) - shingle + 1 :]
    if not n:
        if not held:
            return 0
        counts, n = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fp) for every row, fp as a signed 64-bit integer."""
    ship_package(docs.sparkSession)
    rest = [id_col, *keep]
    out = docs.select(*rest, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col, 2048):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(fps)], names=[*rest, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*rest).schema) + ", fp bigint"
    return out.mapInArrow(run, schema)


def parts_by_correlation(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deals bit positions into m parts of near-equal size, each grown from a free bit by those most correlated with it."""
    spread, width = bits.std(axis=0), bits.shape[1]
    z = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    c = np.abs(z.T @ z) / max(1, len(bits))
    free, parts = np.ones(width, bool), []
    for k in range(m):
        grown, near = [int(np.argmax(free))], np.zeros(width)
        free[grown[0]] = False
        while len(grown) < (width * (k + 1)) // m - (width * k) // m:
            near += c[:, grown[-1]]
            grown.append(int(np.argmax(np.where(free, near, -1.0))))
            free[grown[-1]] = False
        parts.append(sorted(grown))
    return parts


def _ball(n: int, t: int) -> int:
    """Values within t bits of an n-bit value."""
    return sum(comb(n, k) for k in range(t + 1))


def part_costs(bits: np.ndarray, parts: list[list[int]], n: int, most: int) -> list[list[float]]:
    """For each part, the cost of n fingerprints at thresholds -1 (left out, free), 0, ... most: rows that probe, and
    candidates as estimated from the sample's pairs."""
    pairs, out = max(1, len(bits) * (len(bits) - 1) // 2), []
    upper = np.triu_indices(len(bits), 1)
    for part in parts:
        own = bits[:, part]
        apart = own @ (1 - own.T)
        seen = np.bincount((apart + apart.T)[upper].astype(np.int64), minlength=len(part) + 1).cumsum() if len(bits) > 1 else np.zeros(len(part) + 1)
        row = [0.0]
        for t in range(most + 1):
            ball = _ball(len(part), t)
            share = (seen[min(t, len(part))] + ball / 2.0 ** len(part)) / (pairs + 1)
            row.append(PROBE_COST * n * (ball + 1) + CANDIDATE_COST * n * n * share if t <= len(part) else float("inf"))
        out.append(row)
    return out


def allocate(costs: list[list[float]], units: list[list[int]], need: int) -> tuple[float, list[int]]:
    """The least cost, and each part's threshold for it, such that the units of the thresholds chosen reach need. costs and
    units: for each part, at thresholds -1, 0, ..."""
    least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for cost, unit in zip(costs, units, strict=True):
        new: list[tuple[float, list[int]]] = [(float("inf"), [])] * (need + 1)
        for s, (so_far, chosen) in enumerate(least):
            if so_far < float("inf"):
                for t, (c, u) in enumerate(zip(cost, unit, strict=True)):
                    at = min(need, s + u)
                    if so_far + c < new[at][0]:
                        new[at] = (so_far + c, [*chosen, t - 1])
        least = new
    return least[need]


def plan_probes(sample: np.ndarray, n: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost for n fingerprints; -1 leaves a part out. Thresholds and 1 each sum to
    radius + 1, so no pair within the radius exceeds all of them."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in range(1, radius + 2):
        if (BITS + m - 1) // m > 40 and m < radius + 1 and m > 1 or m == 1 and radius > 2:
            continue  # balls of so many values in one part never pay
        parts = parts_by_correlation(bits, m)
        cost, limits = allocate(part_costs(bits, parts, n, radius), [list(range(radius + 2))] * m, radius + 1)
        if best is None or cost < best[0]:
            best = (cost, parts, limits)
    assert best is not None
    return best[1], best[2]


def part_values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """Each row's bits of the part as one integer. bits: one column a bit, 0 or 1."""
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def bucket_rows(bits: np.ndarray, parts: list[list[int]], limits: list[int]) -> Iterator[tuple[np.ndarray, bool]]:
    """(bucket of each row, whether it is the row's own value) for each part and each of the values it probes."""
    for i, (part, t) in enumerate(zip(parts, limits, strict=True)):
        own = part_values(bits, part) + (i << 48) if t >= 0 else None
        for r in range(t + 1):
            for some in combinations(range(len(part)), r):
                yield own ^ sum(1 << b for b in some), r == 0


def crowd(parts: list[list[int]], limits: list[int], n: int) -> float:
    """Nodes with one value of a part beyond which its bucket is crowded: many more than chance would bring."""
    return 32 + 8 * max((n / 2.0 ** len(p) for p, t in zip(parts, limits, strict=True) if t >= 0), default=0.0)


def bucket_links(nodes: DataFrame, index: Callable[[DataFrame], DataFrame], payload: tuple[str, ...], near: Callable[[str, str], Column], crowded: float, verify: Callable[[DataFrame], DataFrame], crowds: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a < b) of nodes that are links: enough of them that the components are those of all links.

    nodes: (node, ...), one row each; index: their rows (key, node, own, payload..., component, grouped), a node's own buckets and
    those it probes, from nodes with component and grouped, which it hands on; near(p, q): a condition on the columns of two
    rows, named with these prefixes, that every link fulfils; verify: keeps the links of a checkpointed table of pairs (a, b).
    crowds: where given, finds the possible pairs of different components in crowded buckets, from rows with their component and
    whether others share it; else they are joined like those of other buckets.
    """
    cols, rows = ("node", *payload), index(nodes.withColumns({"component": F.col("node"), "grouped": F.lit(False)}))
    side = lambda df, p, *more: df.select("key", *(F.col(c).alias(p + c) for c in (*cols, *more)))
    pair = [F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")]
    homes = rows.filter("own")
    many = checkpoint(homes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("key"))
    keys = _small(many)
    inside = checkpoint(homes.join(keys, "key"))
    # the centre of a bucket is its node that most crowded buckets hold: near copies gather around what they copy
    often = inside.groupBy("node").agg(F.count("*").alias("w"))
    centre = inside.join(often, "node").groupBy("key").agg(F.max(F.struct("w", *cols)).alias("c"))
    centres = checkpoint(centre.select("key", *(F.col("c")[c].alias("q_" + c) for c in cols)))
    stars = side(inside, "p_").join(_small(centres), "key").filter((F.col("p_node") != F.col("q_node")) & near("p_", "q_"))
    links = verify(checkpoint(stars.select(*pair).distinct()))
    release(inside, centres)

    parts = connected_components(links, "a", "b")
    part = _small(parts)
    # nodes are labelled, not their buckets, which are many times as many rows, and once, as labelled is read by every search below
    labels = checkpoint(nodes.join(part, "node", "left").withColumn("grouped", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node")))
    labelled = index(labels)
    told = labelled if crowds is None else labelled.join(keys, "key", "left_anti")
    # left: all that a node probes, right: own buckets only; a pair within reach meets in either direction
    right = side(told.filter("own and not grouped"), "q_")
    one = side(told, "p_", "grouped").join(right, "key").filter((F.col("p_grouped") | (F.col("p_node") < F.col("q_node"))) & near("p_", "q_")).select(*pair)
    several = told.filter("grouped")
    mine, theirs = several.select("key", F.col("component").alias("u")).distinct(), several.filter("own").select("key", F.col("component").alias("v")).distinct()
    across = mine.join(theirs, "key").filter("u < v")
    members = side(several, "p_", "component").withColumnRenamed("p_component", "u")
    others = side(several.filter("own"), "q_", "component").withColumnRenamed("q_component", "v")
    two = across.join(members, ["key", "u"]).join(others, ["key", "v"]).filter(near("p_", "q_")).select(*pair)
    found = one.unionByName(two)
    if crowds is not None:
        found = found.unionByName(crowds(labelled.join(keys, "key", "left_semi")))
    out = links.unionByName(verify(checkpoint(found.distinct())))
    release(many, parts)
    return out


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def hamming_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a < b, signed order) of different fingerprints at most radius bits apart, enough of them that the components are
    those of all. fps: one row each in column fp. Fewer than two fingerprints have no links."""
    ship_package(fps.sparkSession)
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if len(sample) < 2:
        return fps.sparkSession.createDataFrame([], "a bigint, b bigint")
    n = fps.count()
    parts, limits = plan_probes(sample, n, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("node").to_numpy().view(np.uint64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            for key, own in bucket_rows(bits, parts, limits):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), pa.array(np.full(len(key), own)), batch.column("component"), batch.column("grouped")], names=["key", "node", "own", "component", "grouped"])

    near = lambda p, q: F.bit_count(F.col(p + "node").bitwiseXOR(F.col(q + "node"))) <= radius
    index = lambda nodes: nodes.mapInArrow(run, "key bigint, node bigint, own boolean, component bigint, grouped boolean")
    return bucket_links(fps.select(F.col("fp").alias("node")), index, (), near, crowd(parts, limits, n), lambda pairs: pairs)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fp, root, component_id) for every row; component_id is the least id reachable over links, root the
    component's least fingerprint.

    Equal fingerprints share one node, so a group of copies of any size is one row to the search. A null text has no words
    (fingerprint zero); rows with a null id get a component but can't name it unless all of it is null; repeated rows stay.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, keep))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = hamming_links(nodes, radius)
    member = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    linked = nodes.join(member, "fp")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id")
    found = F.col("component").isNotNull()
    # a table of its own, so that the join below can split the rows of a very common fingerprint
    label = checkpoint(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.when(found, F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    return prints.join(label, "fp", "left")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows without all but one of each component of simhash_components; first_of_each says which one stays."""
    plain, (row_id, text), named = neutral(docs, id_col, text_col)
    keyed = plain.withColumn("__key", F.xxhash64(*plain.columns))
    return named(first_of_each(keyed, simhash_components(keyed, row_id, text, keep=("__key",)), row_id))


def first_of_each(keyed: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """keyed's rows without all but one of each root: the one of least id, nulls last, and of rows that share it the one of
    least __key. found: (id, __key, root) for every row."""
    found = found.withColumn("__id", F.col(id_col))
    alike = found.groupBy("root", "__id", "__key").agg(F.count("*").alias("copies"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__key", "copies")).alias("x"))
    kept = checkpoint(first.select("x.__id", "x.__key", "x.copies"))

    def rows(some: DataFrame) -> DataFrame:
        some = some.withColumnsRenamed({"__id": "__kept_id", "__key": "__kept_key"})
        return keyed.join(some, (F.col("__key") == F.col("__kept_key")) & F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")

    out = rows(kept.filter("copies = 1"))
    if kept.filter("copies > 1").head(1):
        out = out.unionByName(rows(kept.filter("copies > 1")).dropDuplicates(["__key"]))
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of the whole table; simhash_components says what odd rows give."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
