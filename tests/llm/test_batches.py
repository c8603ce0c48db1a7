"""Words go through the lattice in batches as large as asked for."""

import pyarrow as pa

from txintel.llm.lm import batched


def test_batches_are_joined_and_cut():
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], names=["x"]) for a, b in ((0, 3), (3, 3), (3, 11), (11, 12))]
    got = [b.column("x").to_pylist() for b in batched(iter(parts), 5)]
    assert got == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]] and list(batched(iter(parts[1:2]), 5)) == []
