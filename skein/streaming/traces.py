"""Traces as they arrive: spans assembled by trace as sessions, calls by a join of two streams, results appended as they close.

Files may come in any order within the watermark. What comes later than that is dropped and counted. State holds open
traces, windows and spans still to be joined, nothing that the watermark has passed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import drop, materialize, scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def span_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int, late: str) -> DataFrame:
    """The spans (span_id, ts and others) under path as they arrive, each span_id once within the watermark.

    Rows without a span_id only carry time (see `close_input`): they move the watermark and go no further.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["span_id"]).where("span_id is not null")


def assembled_traces(spans: DataFrame, idle_ms: int) -> DataFrame:
    """A row for each trace once it is complete: spans, errors, services (sorted), duration, start and end.

    A trace is a session of its spans: it is given out and forgotten once the watermark is `idle_ms` behind its last span,
    and spans further apart than that are two rows. State is one row of partial aggregates for each open trace.
    """
    session = F.session_window("ts", f"{idle_ms} milliseconds")
    made = spans.where("trace_id is not null").groupBy("trace_id", session).agg(
        F.count("*").alias("spans"), F.count_if(F.coalesce(F.col("status") == "ERROR", F.lit(False))).alias("errors"), F.array_join(F.array_sort(F.collect_set("service_name")), ",").alias("services"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )
    return made.select("trace_id", "spans", "errors", "services", "duration_ms", "started_at", "ended_at")


def calls(children: DataFrame, parents: DataFrame, within: str) -> DataFrame:
    """(caller, callee, status, ts) of spans whose parent is of another service and began at most `within` before, as soon as both are there."""
    p = parents.select(F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("caller"), F.col("ts").alias("parent_ts"))
    both = children.where("parent_span_id is not null").join(p, "parent_span_id").where(f"ts >= parent_ts and ts <= parent_ts + interval {within}")
    return both.where("caller <> service_name").select("caller", F.col("service_name").alias("callee"), "status", "ts")


@dataclass(frozen=True)
class Drained:
    """What a stream gave, and what its progress says: rows dropped as late, most rows of state after a batch, batches."""

    rows: DataFrame
    late: int
    most_state: int
    batches: int


def appended(result: DataFrame, name: str) -> Drained:
    """Runs a stream to the end of what is there, batch by batch in append mode, into files in the shared folder.

    State is kept by RocksDB in the executors' working space and in the shared folder's checkpoint. Each batch is written once,
    by the file sink's log, so a batch that runs again after a loss adds nothing.
    """
    spark = result.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    path = scratch_path(spark, name)
    spark.conf.set(key, ROCKS)
    try:
        run = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}-offsets")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    states = [p["stateOperators"] for p in run.recentProgress]
    late = sum(op["numRowsDroppedByWatermark"] for ops in states for op in ops)
    most = max((sum(op["numRowsTotal"] for op in ops) for ops in states), default=0)
    return Drained(spark.read.schema(result.schema).parquet(path), late, most, len(states))


def arrive(rows: DataFrame, path: str, files: int, order: str = "ts", per_file: int = 500_000) -> int:
    """Puts rows into a folder in `files` arrivals one after the other, by time but for one row in eight, which is an arrival late.

    An arrival is one file for each `per_file` rows of its share; returns how many that are. Rows are made once, whatever
    the number of arrivals, and no task sees more than it would without.
    """
    bounds = rows.agg(F.min(order).alias("a"), F.max(order).alias("b"))
    part = F.floor((F.unix_micros(order) - F.unix_micros("a")) * files / (F.unix_micros("b") - F.unix_micros("a") + 1))
    late = F.when(F.pmod(F.xxhash64("span_id"), F.lit(8)) == 0, 1).otherwise(0)
    placed, at = materialize(rows.crossJoin(F.broadcast(bounds)).withColumn("_file", F.least(part + late, F.lit(files - 1))).drop("a", "b"), "placed")
    per = max(1, -(-placed.count() // (files * per_file)))
    for i in range(files):
        now = placed.where(F.col("_file") == i).drop("_file")
        (now.coalesce(1) if per == 1 else now.repartition(per)).write.mode("append").parquet(path)
    drop(rows.sparkSession, at)
    return per


def close_input(spark: SparkSession, path: str, schema: str, ts: str, per: int = 1) -> None:
    """Ends a folder's input: twice `per` files with nothing but a time far ahead, so that all that is open closes."""
    for n in (0, 1):
        for _ in range(per):
            spark.createDataFrame([(ts,)], "ts string").selectExpr(f"timestamp(ts) + interval {n} second as ts").coalesce(1).write.mode("append").parquet(path)
