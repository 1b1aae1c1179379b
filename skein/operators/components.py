"""Connected components by large-star / small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import drop, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every vertex that has an edge.

    edges: (src, dst) of one orderable type; direction, repeats, loops and rows with a null end do
    not matter (such rows are ignored). Returns (id, component), component being the smallest id
    that can be reached. Vertices without edges do not appear: callers left-join and coalesce.

    Each round turns every vertex towards the smallest neighbour it knows, so a chain of n
    vertices takes O(log^2 n) rounds. A round is two equi-joins with a table of one row per
    vertex, whose large side Spark splits where a vertex has very many edges; no vertex's
    neighbours are collected. Rounds are written to the shared folder and the previous one dropped.
    """
    spark = edges.sparkSession
    current, path = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct(),
        "cc",
    )
    last = None
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u points to the least vertex next to u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new, new_path = materialize(small.distinct(), "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        current, path = new, new_path
        if tuple(state) == last:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        last = tuple(state)
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
