"""Blocks of vectors, and streams of blocks of queries past blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txintel.runtime import checkpoint, ship_package

#: Rows of a block of candidates and of queries, and how many blocks of queries pass one candidate block in one go.
CANDIDATES, QUERIES, STREAM = 8192, 1024, 16
#: Partitions of a stream at most; beyond, a task takes several blocks one after the other.
MOST_PARTITIONS = 20_000


def finite(v: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def usable(rows: DataFrame, id_col: str, vec_col: str, empty: bool = False) -> DataFrame:
    """(row, id, vec) of every row whose vector has no null or non-finite component; row tells rows of one id apart.

    Null vectors, rows with a null id and, unless asked for, empty vectors are left out; repeated ids and repeated rows stay.
    The rows are written to the checkpoint folder, so their numbers hold for all that reads them.
    """
    fine = finite(F.col(vec_col)) & F.col(id_col).isNotNull()
    if not empty:
        fine &= F.size(vec_col) > 0
    return checkpoint(rows.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec")))


def home(row: str, number: int) -> Column:
    """The block of a row among number blocks."""
    return F.pmod(F.xxhash64(row), F.lit(number)).cast("int")


def blocks(rows: DataFrame, number: int) -> DataFrame:
    """(dim, block, rows, ids, cells): rows (row long, id long, vec array<double>) packed into number blocks, vectors of each
    length by themselves, a block's ids ascending; rows, ids and cells are the raw little-endian numbers of a block."""
    ship_package(rows.sparkSession)
    placed = rows.select(F.size("vec").alias("dim"), home("row", number).alias("block"), "row", "id", "vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> pa.RecordBatch:
            raw = [np.concatenate([x(b) for b in held]).tobytes() for x in (lambda b: b.column("row").to_numpy(), lambda b: b.column("id").to_numpy(), lambda b: b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64))]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["dim", "block", "rows", "ids", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            dim, block = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dim) | np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (int(dim[a]), int(block[a]))
                if key != at and held:
                    yield done()
                    held = []
                at = key
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return placed.repartition("dim", "block").sortWithinPartitions("dim", "block", "id", "row").mapInArrow(pack, "dim int, block int, rows binary, ids binary, cells binary")


def block_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def past_blocks(candidates: DataFrame, queries: DataFrame, number: int, q_number: int, prepare: Callable[..., Any], found: Callable[..., Iterator[pa.RecordBatch]], schema: str, state: DataFrame | None = None) -> DataFrame:
    """found(prepared, query rows, query ids, query cells, state) over every one of the q_number blocks of queries with every
    one of the number blocks of candidates of its dimension; prepared is prepare(rows, ids, cells) of the candidates.

    A candidate block and the query blocks sent to it arrive sorted, the candidates first: they are prepared once for STREAM
    blocks of queries, and a task holds one block of each at a time. A stated set of queries against all rows costs that many
    pairs of blocks by its nature. state: rows (query_row, ...long columns); each block gets its own queries' rows, ascending,
    as one array a column.
    """
    names = [c for c in state.columns if c != "query_row"] if state is not None else []
    groups = block_count(q_number, STREAM)
    packed = [F.col("state")[n].alias(n) for n in ("query_row", *names)] if names else []
    q = queries.withColumnRenamed("block", "q_block")
    if names:
        own = state.groupBy(home("query_row", q_number).alias("q_block")).agg(F.array_sort(F.collect_list(F.struct("query_row", *names))).alias("state"))
        q = q.join(own, "q_block")
    sent = q.select("dim", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block"), F.floor(F.col("q_block") / STREAM).cast("int").alias("part"), F.lit(1).alias("kind"), "rows", "ids", "cells", *packed)
    there = candidates.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), "rows", "ids", "cells", *(F.lit(None).cast("array<bigint>").alias(n) for n in (("query_row", *names) if names else ())))
    both = there.unionByName(sent).repartition(min(number * groups, MOST_PARTITIONS), "dim", "block", "part").sortWithinPartitions("dim", "block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None
        for batch in batches:
            for k in range(batch.num_rows):
                dim, block, part, kind, rows, ids, cells = (batch.column(c)[k].as_py() for c in ("dim", "block", "part", "kind", "rows", "ids", "cells"))
                if not kind:
                    at, held = (dim, block, part), None
                    held = prepare(*unpack(rows, ids, cells, dim))
                elif at == (dim, block, part):
                    own = {n: batch.column(n)[k].values.to_numpy() for n in ("query_row", *names)} if names else {}
                    yield from found(held, *unpack(rows, ids, cells, dim), own)

    return both.mapInArrow(run, schema)


def unpack(rows: bytes, ids: bytes, cells: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return np.frombuffer(rows, np.int64), numbers, np.frombuffer(cells, np.float64).reshape(-1, dim) if dim else np.zeros((len(numbers), 0))


def is_query(every: int) -> Column:
    return F.col("id") % every == 0
