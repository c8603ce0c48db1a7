"""Session helpers shared by all operators: checkpoint folder, table reading, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the session names in spark.checkpoint.dir. Where none is set, a local session gets one of its own, and
    a cluster, whose executors couldn't share it, an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="txintel-checkpoint-"))


#: Has Spark remove the shuffle files of a query once it has ended; read when a DataFrame is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there.

    The shuffle files behind it go once it is written, as nothing reads them again. What loops have written and nobody reads any
    more goes by release(); so disks hold what is in use only, with no need for the driver's garbage to be collected.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def release(*tables: DataFrame) -> None:
    """Deletes the files of checkpointed tables, which nothing may read afterwards; other tables are left alone."""
    for df in tables:
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        path = plan.rdd().getCheckpointFile()
        if path.isDefined():
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path.get())
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a query's largest table for each task of its shuffles, and bytes up to which Spark puts small ones together: its own 64
#: MB of compressed narrow rows are over 1 GB in a task that sorts and groups them.
TASK_ROWS, TASK_BYTES = 1 << 18, 8 << 20


@contextmanager
def shuffles(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Plans that are executed within have that many tasks a shuffle, or the session's number where that is more, and tasks of
    TASK_BYTES where Spark joins them; the session's settings are back afterwards."""
    number, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k) for k in (number, joined)}
    spark.conf.set(number, str(max(tasks, int(before[number]))))
    spark.conf.set(joined, str(TASK_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sized(query: Callable[[SparkSession, str], DataFrame], name: str, rows_each: int = 1, task_rows: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The query with as many tasks a shuffle as its input needs, so that a task's memory stays as it is while tables grow.

    name: its largest table, rows_each: rows that one of this table's becomes. Where that is no more tasks than there are cores,
    nothing changes; beyond, the result is checkpointed, so that its last shuffles are planned in the same way.
    """

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tasks = -(-table(spark, sf_dir, name).count() * rows_each // (task_rows or TASK_ROWS))
        if tasks <= spark.sparkContext.defaultParallelism:
            return query(spark, sf_dir)
        with shuffles(spark, tasks):
            return checkpoint(query(spark, sf_dir))

    return run


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_txintel_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="txintel-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._txintel_shipped = True
