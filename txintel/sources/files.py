"""Reading captures: JSON, JSON Lines, CSV and XML files into two layers and a manifest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txintel.functions.expressions import list_items, whole_number

# The fields of both layers, and the files that are read.
NETWORK = ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid")
LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
LEDGER = ("txid", *LISTS, "fee", "script_type")
SUFFIXES = (".json", ".jsonl", ".ndjson", ".csv", ".xml")
ROW_TAGS = ("record", "transaction", "observation")

#: Every field as text; a list keeps its JSON, or its parts between |.
RAW = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys((*NETWORK, *LEDGER))])


@dataclass
class Capture:
    """observations: network layer; transactions: ledger layer; sources: file, sha256, records. columnar: observations come from
    columns or checkpoints, so that reading them again costs less than a copy of them."""

    observations: DataFrame
    transactions: DataFrame
    sources: DataFrame
    columnar: bool = False


def _json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, an object with records or transactions, or one record."""
    text = spark.read.text(path, wholetext=True)
    rows = T.ArrayType(RAW).simpleString()
    whole = F.trim(F.col("value"))
    inside = F.coalesce(F.get_json_object("value", "$.records"), F.get_json_object("value", "$.transactions"), F.concat(F.lit("["), whole, F.lit("]")))
    found = F.from_json(F.when(whole.startswith("["), whole).otherwise(inside), rows, {"mode": "FAILFAST"})
    return text.select(F.posexplode(found).alias("_row", "r")).select("_row", "r.*")


def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema(RAW).option("mode", "FAILFAST").json(path)
    return lines.withColumn("_row", F.monotonically_increasing_id())


def _csv(spark: SparkSession, path: str, quoted_breaks: bool = False) -> DataFrame:
    """A header names the fields. A record is a line, so large files are read by many tasks; with quoted_breaks a quoted field may
    have line breaks, and a file is read by one task. A field of the header is there in every record, with an empty cell as an
    empty text."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=quoted_breaks)
    known = [F.coalesce(F.col(n), F.lit("")).alias(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in RAW.names]
    return rows.select(*known).withColumn("_row", F.monotonically_increasing_id())


def _xml(spark: SparkSession, path: str) -> DataFrame:
    """Records under any of the row tags; documents that declare a type or entities are refused."""
    declared = F.upper("value").rlike(r"<!(DOCTYPE|ENTITY)")
    spark.read.text(path, wholetext=True).select(F.assert_true(~declared, F.lit("document types and entities are not read"))).collect()
    items = T.StructType([T.StructField("item", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField(n, items if n in LISTS else T.StringType()) for n in RAW.names])
    parts = []
    for k, tag in enumerate(ROW_TAGS):
        rows = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)
        flat = [F.to_json(F.col(n)["item"]).alias(n) if n in LISTS else F.col(n) for n in RAW.names]
        parts.append(rows.select(*flat).withColumn("_row", F.monotonically_increasing_id() + F.lit(k << 58)))
    return reduce(DataFrame.unionByName, parts)


READERS = {".json": _json, ".jsonl": _jsonl, ".ndjson": _jsonl, ".csv": _csv, ".xml": _xml}


def expand(spark: SparkSession, source: str | list[str]) -> list[str]:
    """Files of a source, sorted by name: a folder's supported files, a file, or each of several files."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for one in [source] if isinstance(source, str) else source:
        path = jvm.org.apache.hadoop.fs.Path(one)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(one)
        if not fs.getFileStatus(path).isDirectory():
            out.append(one)
            continue
        names = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().lower().endswith(SUFFIXES))
        if not names:
            raise ValueError(f"no supported files in {one}")
        out += names
    return out


def read_file(spark: SparkSession, path: str, quoted_breaks: bool = False) -> DataFrame:
    """The raw records of one file, by its suffix, each field as text. quoted_breaks: for CSV files whose quoted fields have line
    breaks."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in READERS:
        raise ValueError(f"unsupported file type {suffix or path}")
    return _csv(spark, path, quoted_breaks) if suffix == ".csv" else READERS[suffix](spark, path)


def normalise(raw: DataFrame) -> DataFrame:
    """Typed fields; a number that can't be read fails the load."""
    number = lambda n: F.when(F.trim(n) == "", None).otherwise(F.col(n)).cast("double")
    return raw.withColumns({
        "timestamp": number("timestamp"), "fee": number("fee"), "src_port": whole_number("src_port"), "dst_port": whole_number("dst_port"),
        **{n: F.when(F.col(n).isNotNull(), list_items(n)) for n in LISTS[:2]},
        **{n: F.when(F.col(n).isNotNull(), F.transform(list_items(n), lambda v: v.cast("double"))) for n in LISTS[2:]},
    })


def load(spark: SparkSession, source: str | list[str], quoted_breaks: bool = False) -> Capture:
    """Both layers of a source. quoted_breaks: whether quoted fields of CSV files may have line breaks.

    A record without txid is only counted. With src_ip and timestamp it is an observation; with any input or output it adds to
    its transaction, whose fields each come from the first record, by file name and place, that has them.
    """
    files = expand(spark, source)
    parts = [normalise(read_file(spark, f, quoted_breaks)).withColumn("_file", F.lit(k)).withColumn("_name", F.lit(f)) for k, f in enumerate(files)]
    rows = reduce(DataFrame.unionByName, parts).withColumn("seq", F.struct("_file", "_row"))
    named = rows.filter(F.coalesce(F.col("txid"), F.lit("")) != "")
    observations = named.filter((F.coalesce(F.col("src_ip"), F.lit("")) != "") & F.col("timestamp").isNotNull()).select(*NETWORK, "seq")
    ledger = named.filter((F.coalesce(F.size("input_addresses"), F.lit(0)) > 0) | (F.coalesce(F.size("output_addresses"), F.lit(0)) > 0))
    transactions = ledger.groupBy("txid").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in LEDGER if n != "txid"))
    sums = spark.read.format("binaryFile").load(files).select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    counts = rows.groupBy(F.substring_index("_name", "/", -1).alias("file")).agg(F.count("*").alias("records"))
    sources = sums.join(counts, "file", "left").fillna(0, ["records"])
    return Capture(observations, transactions, sources)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(txid, label, typology, scenario, origin_ip, timestamp) from a document {seed, transactions: {txid: ...}}."""
    kind = "map<string, struct<label: int, typology: string, scenario: string, origin_ip: string, timestamp: double>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.transactions"), kind).alias("m"))
    return text.select(F.explode("m").alias("txid", "t")).select("txid", "t.*")
