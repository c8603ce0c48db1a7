"""A labelled transaction graph from its three CSV files: features without header, classes and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time steps: models fit on the first, tune on the next, and are tested on the last.
FIT, TUNE, TEST = (1, 25), (30, 34), (35, 49)


@dataclass
class Graph:
    """rows: id, step, y (1, 0, or null where unknown), x; edges: src, dst."""

    rows: DataFrame
    edges: DataFrame

    def between(self, first: int, last: int) -> Graph:
        """The subgraph of some steps: rows in them, and edges with both ends there."""
        rows = self.rows.filter(F.col("step").between(first, last))
        ids = rows.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(rows, edges)


def load(spark: SparkSession, features: str, classes: str, edges: str, width: int = 165) -> Graph:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("step", T.IntegerType()), *(T.StructField(f"f{k}", T.DoubleType()) for k in range(width))])
    wide = spark.read.csv(features, schema=schema, mode="FAILFAST")
    said = spark.read.csv(classes, header=True, schema="id long, class string")
    y = F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0)
    rows = wide.join(said, "id").select("id", "step", y.alias("y"), F.array(*(f"f{k}" for k in range(width))).alias("x"))
    links = spark.read.csv(edges, header=True, schema="src long, dst long")
    known = rows.select("id")
    both = links.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(rows, both)
