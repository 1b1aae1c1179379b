"""Shared scratch space: where lineage is cut so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one where that is unset is for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_drop_all)
    _left[path] = spark
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system API, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _left.pop(path, None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops what is materialized inside the block when it ends: for callers that have written their own result by then."""
    before = set(_left)
    try:
        yield
    finally:
        for path in [p for p in _left if p not in before]:
            drop(spark, path)


def _drop_all() -> None:
    for path, spark in list(_left.items()):
        try:
            drop(spark, path)
        except Exception:  # the JVM may have gone first
            return


def materialize(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back: (table, path)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def start_of(spark: SparkSession) -> int:
    """With how many partitions shuffles start in a session."""
    start = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(start or spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str = "t") -> tuple[DataFrame, Callable[[], None]]:
    """Writes df in buckets by key into the shared folder: (table, what drops it). Joins by key read it as it lies.

    There are as many buckets as shuffles start with partitions, so one shuffle puts a file in each.
    """
    spark = df.sparkSession
    n = start_of(spark)
    path = scratch_path(spark, name)
    table = f"skein_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table, format="parquet")

    def gone() -> None:
        spark.sql(f"drop table if exists {table}")
        drop(spark, path)

    return spark.table(table), gone
