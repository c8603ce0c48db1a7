"""Plain versions of the contracts' words, hashes and folds."""

import zlib

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out = lower(text)
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


ODD = [(None, "A  null id"), (-1, None), (-2, ""), (-3, "word " * 60000), (-4, "\x1c   x\n\n\t y"), (-5, "Same text here"), (-5, "Same text here"), (-6, "w" * 200000), (-7, "\U0001f600 <|endoftext|> 漢字 123 MIT  license"), (-8, "!!! ??? 123")]


def odd_docs(spark, more=True):
    """The smallest table with odd rows and extra columns whose names clash with what operators add."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in ODD], docs.schema)
    both = docs.unionByName(odd) if more else odd
    return both.selectExpr("*", "1 AS fp", "'s' AS score", "2.5D AS size", "'k' AS key", "0 AS shard", "1 AS ids", "false AS rejected", "3 AS copies", "'w' AS word", "7 AS component_id")


def empty_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(0)
