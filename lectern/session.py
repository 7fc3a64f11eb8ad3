"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config(PLAN_KEY, str(PLAN_SIGNS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of an Arrow batch unless the session says otherwise than Spark's default: texts may be long, and a worker holds a batch or two.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: Bytes of an Arrow batch likewise: what Python makes of a text may take many times its room, so batches of long texts are of few rows.
BYTES_KEY, BYTES_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Signs of a plan's description, likewise: tables of words are literals, and the driver describes a plan anew at each of its stages.
PLAN_KEY, PLAN_SIGNS = "spark.sql.maxPlanStringLength", 100_000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver started, and hand them texts in batches that fit."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if BYTES_KEY not in _asked(spark):
        spark.conf.set(BYTES_KEY, str(BYTES_MOST))
    if PLAN_KEY not in _asked(spark):
        spark.conf.set(PLAN_KEY, str(PLAN_SIGNS))
    return spark


def _asked(spark: SparkSession) -> dict[str, str]:
    """Settings that were given to the session."""
    return spark.conf.getAll


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as run at once, if it is too small to fill them by itself: one file of one row group would be one task.

    The size is the optimiser's estimate; nothing is run for it, and larger tables are not shuffled.
    """
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(tasks) if size < tasks * most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all run on one machine, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    Nothing reads the shuffles of the write again, so their files go when it ends.
    """
    path = fresh_path(df.sparkSession, name)
    _write(df, path)
    return _stored(df, path)


def settle_parts(df: DataFrame, column: str, values: list[str], name: str = "table") -> list[DataFrame]:
    """As settle(), but a table of its own for the rows of each value of a column, so that each can be deleted by itself; all tables lack the column."""
    path = fresh_path(df.sparkSession, name)
    _write(df, path, column)
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for value in values:  # a value without rows has no folder yet
        folder = fs_path(f"{path}/{column}={value}")
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)
    return [_stored(df.drop(column), f"{path}/{column}={value}") for value in values]


def _write(df: DataFrame, path: str, *by: str) -> None:
    with clearing(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run meanwhile go when each ends."""
    before = spark.conf.get(CLEAN_KEY, None)
    spark.conf.set(CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_KEY) if before is None else spark.conf.set(CLEAN_KEY, before)


def _stored(df: DataFrame, path: str) -> DataFrame:
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _SETTLED[table] = path
    return table


#: Folders of the tables that settle() returned.
_SETTLED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        if path := _SETTLED.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
