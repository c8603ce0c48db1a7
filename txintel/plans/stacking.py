"""Several captures as one, so that all go through each plan together.

Transactions, addresses and announcers of capture k become "k:" and their name. Captures then share no key, and whatever
operators group or join by these keys they do for each capture by itself; names within a capture keep their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txintel.sources.files import Capture

SIDES = ("input_addresses", "output_addresses")


def _named(k: int, c: Column) -> Column:
    return F.concat(F.lit(f"{k}:"), c.cast("string"))


def _all_named(k: int, array: str) -> Column:
    return F.transform(array, lambda a: _named(k, a))


def under(tables: list[DataFrame], *keys: str, start: int = 0) -> DataFrame:
    """Tables of several captures under each other, with the capture's number, from start, in front of the keys."""
    return reduce(DataFrame.unionByName, (df.withColumns({c: _named(k, F.col(c)) for c in keys}) for k, df in enumerate(tables, start)))


def stack(captures: list[Capture], start: int = 0) -> Capture:
    """The captures as one; sources keep their names. An announcement or record without a key keeps none."""
    sided = [c.transactions.withColumns({s: _all_named(k, s) for s in SIDES}) for k, c in enumerate(captures, start)]
    return Capture(under([c.observations for c in captures], "txid", "src_ip", start=start), under(sided, "txid", start=start), reduce(DataFrame.unionByName, (c.sources for c in captures)))


def number(key: str = "txid") -> Column:
    """The number of a key's capture."""
    return F.substring_index(F.col(key), ":", 1).cast("int")


def name(key: str = "txid") -> Column:
    """A key as its own capture has it; addresses with colons keep theirs."""
    return F.regexp_replace(F.col(key), r"^\d+:", "")


def bare(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with their capture's number and its own keys."""
    return rows.withColumn("capture", number(keys[0])).withColumns({c: name(c) for c in keys})
