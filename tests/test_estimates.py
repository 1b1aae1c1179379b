"""What Spark takes tables for: files hold rising ids in a few bytes, memory does not."""

from pyspark.sql import functions as F

from skein.sources import derive
from skein.sources.derive import Derived


def test_many_ids_are_not_broadcast(spark, tmp_path):
    """Ids of 3 million rows take under 1 MB as a file and some 400 MB as a broadcast table."""
    ids = spark.range(3_000_000).select(F.concat(F.lit("sql:"), F.col("id").cast("string")).alias("id"), F.lit("SqlStatement").alias("node_type"))
    ids.write.option("compression", "zstd").parquet(f"file://{tmp_path}/ids")
    Derived(spark, str(tmp_path))
    known = spark.read.parquet(f"file://{tmp_path}/ids")
    estimate = int(str(known.select("id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate > 10 << 20


def test_shuffles_start_with_the_tables(spark, tmp_path, monkeypatch):
    """Partitions that shuffles start with grow with the base tables, never under the session's own."""
    spark.range(200_000).write.parquet(f"file://{tmp_path}/orders.parquet")
    monkeypatch.setattr(derive, "PARTITION", 10_000)
    Derived(spark, str(tmp_path))
    start = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    assert start >= 40
    monkeypatch.setattr(derive, "PARTITION", 1 << 40)
    Derived(spark, f"{tmp_path}/orders.parquet")
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == spark.conf.get("spark.sql.shuffle.partitions")


def test_own_number_of_partitions_stays(spark, tmp_path):
    spark.range(10).write.parquet(f"file://{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "17")
    Derived(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "17"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    if before is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", before)
