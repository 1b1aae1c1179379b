"""Execution histories of process engines as process logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The activity history of common process engines, column by column.
HISTORY = {"case_id": "PROC_INST_ID_", "process": "PROC_DEF_ID_", "activity": "ACT_ID_", "started_at": "START_TIME_", "ended_at": "END_TIME_"}


def read_history(spark: SparkSession, url: str, table: str = "ACT_HI_ACTINST", partitions: int = 16, **options: str) -> DataFrame:
    """The activity history in a JDBC database, read in ranges of its start time."""
    bounds = spark.read.format("jdbc").options(url=url, query=f"select min(START_TIME_) a, max(START_TIME_) b from {table}", **options).load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds and bounds["a"] is not None:
        reader = reader.options(partitionColumn="START_TIME_", lowerBound=str(bounds["a"]), upperBound=str(bounds["b"]), numPartitions=str(partitions))
    return process_log(reader.load())


def process_log(history: DataFrame) -> DataFrame:
    """(case_id, process, activity, started_at, ended_at) of an engine's activity history; the process is its definition's key, without version."""
    named = history.select(*[F.col(column).alias(name) for name, column in HISTORY.items()])
    return named.withColumn("process", F.substring_index("process", ":", 1)).where("activity is not null")
