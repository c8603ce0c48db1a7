"""Importance resampling towards a target: documents drawn by hashed word features, ranked by parallel sorting.

Two passes over the texts: the first counts features by bucket, of the documents and of the target, in arrays of fixed size
that tasks sum up themselves; from these every bucket has a gain, the logarithm of target share over document share. The second
pass scores each document by its mean gain and a Gumbel value drawn from its id, so that the highest scores are a weighted
sample without replacement.

Scores are ranked by regular sampling: runs are sorted where they are, rows at regular places of all runs give the splitters,
each run sends its segments to their buckets, a bucket merges the sorted segments it gets, and the counts of the buckets before
it say where its ranks begin. Every row has a number of its own, so ties of any size are split like other rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.text import chunks, forget, slices
from txintel.runtime import checkpoint, ship_package, table

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Sorted runs at most, rows that a bucket of the sort should hold, buckets at most, and sampled rows for each of them.
RUNS, BUCKET_ROWS, MOST_BUCKETS, SAMPLES = 2048, 1 << 22, 1024, 32
#: A-Z lower-cased, letters, digits and bytes beyond ASCII kept, all else a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLACE = (1 << 33) - 1


def features(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of each feature) of the text, piece by piece. Features are the words and pairs of neighbouring words
    joined by a space, repeats included."""
    last = None
    for piece in chunks(text or b""):
        own = piece.translate(_WORDS).split()
        if not own:
            continue
        single = list(map(crc32, own))
        before = ([] if last is None else [last]) + single[:-1]
        # the checksum of "a b" continues that of "a"
        pairs = map(crc32, map(b" ".__add__, own[len(own) - len(before) :]), before)
        yield len(own), np.fromiter((*single, *pairs), np.int64, len(own) + len(before))
        last = single[-1]


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; null and empty texts have none."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = np.zeros(buckets, np.int64)
        for _, some in slices(batches, text_col):
            for text in some:
                for _, found in features(text):
                    held += np.bincount(found % buckets, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: object, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln(u))) for u in (0, 1) from the sha256 of seed and id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """(id, n_features, weight, score, drawable) of every row, drawable if it has at least that many words."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            n, weight, score, enough = [], [], [], []
            for doc_id, text in zip(part.column("id").to_pylist(), texts, strict=True):
                words = count = total = 0
                for w, found in features(text):
                    words, count, total = words + w, count + len(found), total + int(gain[found % len(gain)].sum())
                n.append(count), weight.append(total // count if count else 0), enough.append(words >= least)
                score.append(weight[-1] + gumbel(doc_id, seed))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, pa.int64()) for x in (n, weight, score)), pa.array(enough, pa.bool_())], names=["id", "n_features", "weight", "score", "drawable"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_features bigint, weight bigint, score bigint, drawable boolean")


def _order(score: np.ndarray, ids: pa.Array, row: np.ndarray) -> list[np.ndarray]:
    """Keys for lexsort, the last one first: falling scores, then ids (nulls last), then row numbers."""
    gone = np.asarray(ids.is_null())
    return [row, ids.fill_null(0).to_numpy(zero_copy_only=False), gone, -score]


def ranked(rows: DataFrame, runs: int = RUNS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (id bigint, score bigint, ...more) with rank, from 1: falling scores, ties to the smaller id, nulls last; equal pairs
    get different ranks.

    No task holds more than a bucket, whose rows Spark sorts and spills: at most twice its share but for as many rows as runs
    have between two sampled ones. The driver gets the sample, SAMPLES rows a bucket and one a run, and a count a bucket.
    """
    spark = rows.sparkSession
    ship_package(spark)
    key = [F.desc("score"), F.asc_nulls_last("id")]
    held = checkpoint(rows)
    # sorted runs; a row's number has its run in the high bits and its place there in the low ones
    local = checkpoint(held.coalesce(runs).sortWithinPartitions(*key).withColumn("row", F.monotonically_increasing_id()))
    n = local.count()
    number = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_rows)))
    step = max(1, n // (number * SAMPLES))
    sample = local.filter((F.col("row").bitwiseAND(_PLACE)) % step == 0).select("score", "id", "row").toArrow()
    keys = _order(*_columns(sample))
    place = np.lexsort(keys)
    at = place[np.unique(np.arange(1, number) * len(place) // number)] if len(place) else place
    splitters = [k[at] for k in keys]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _order(*_columns(batch))
            both = np.lexsort([np.concatenate(x) for x in zip(splitters, own, strict=True)])
            bucket = np.zeros(len(both), np.int64)
            bucket[both] = np.cumsum(both < len(at)) if len(both) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket[len(at) :].astype(np.int32))], names=[*batch.schema.names, "bucket"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in local.schema)
    dealt = local.mapInArrow(deal, schema + ", bucket int")
    counts = np.zeros(len(at) + 1, np.int64)
    for r in dealt.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = -1, 0
        for batch in batches:
            bucket, out = batch.column("bucket").to_numpy(), np.zeros(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if bucket[a] != now:
                    now, seen = int(bucket[a]), 0
                out[a:b] = before[now] + seen + np.arange(1, b - a + 1)
                seen += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "rank"])

    merged = dealt.repartitionById(len(at) + 1, "bucket").sortWithinPartitions("bucket", *key, "row")
    return merged.mapInArrow(number_rows, schema + ", bucket int, rank bigint").drop("row", "bucket")


def _columns(some: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return whole(some.column("score")).to_numpy(), whole(some.column("id")), whole(some.column("row")).to_numpy()


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; the percent highest scores of those with at least least
    words are drawn and have a rank, 1 the highest.

    Null and empty texts have no features and weight 0. A null id counts as an empty one for its random value and comes last
    among equal scores. Repeated rows have equal scores and ranks of their own. An empty target or table of documents changes
    nothing else; without documents there are no rows. Extra columns play no part, whatever their names.
    """
    gain = gains(feature_counts(docs, text_col), feature_counts(target, target_col))
    held = checkpoint(scores(docs, gain, id_col, text_col, seed, least))
    most = held.filter("drawable").count() * percent // 100
    drawn = ranked(held.filter("drawable")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = held.filter("not drawable").withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents drawn towards the benchmark's texts; resample says what odd rows give."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: that of each distinct feature is folded byte by byte over the table of the polynomial 0xEDB88320.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b : list_reduce([b::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z : CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), said AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', 0, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), cut AS (
  SELECT side, row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM said
), every AS (
  SELECT side, row, doc_id, unnest(w || list_transform(list_zip(w[1 : len(w) - 1], w[2 :]), lambda z : z[1] || ' ' || z[2])) AS f FROM cut
), feature AS (
  SELECT f, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h : ('0x' || h)::BIGINT), lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM every), crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM every JOIN feature USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM counted)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM counted)::DOUBLE + 10000))))::BIGINT AS gain FROM counted
), summed AS (
  SELECT row, count(*) AS n, floor(sum(gain) / count(*)) AS m FROM every JOIN feature USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(m, 0)::BIGINT AS weight,
    coalesce(m, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256(concat('7:', doc_id))[:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN summed USING (row) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
