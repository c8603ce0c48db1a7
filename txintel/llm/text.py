"""Small helpers for tasks that go through whole texts as UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: White space of the contracts, [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
CHUNK = 1 << 20


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in pieces of about size bytes that end at white space, so that very long texts need little memory."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """Lists of words: A-Z lower-cased, cut at [\x20\x09-\x0D]."""
    for piece in chunks(text or b""):
        yield piece.lower().split()


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches with their texts as UTF-8 bytes. After the last one the worker, which waits for other tasks then,
    gives back what memory it can."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(text).cast(pa.binary()).to_pylist()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, which the allocators of Arrow and C would keep for this process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def neutral(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with column names that clash with nothing, the new names of cols, and what gives such rows their names back."""
    names = [f"c{k}_" for k in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in cols], lambda rows: rows.select(*names).toDF(*docs.columns)


_REMEMBERED: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks under the key. It keeps one thing at a time: a worker serves many operators in turn,
    and their memories would add up. Those that keep nothing call forget()."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    _REMEMBERED.clear()
