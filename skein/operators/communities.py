"""Communities of a graph by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import drop, materialize


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label) of nodes (id) after at most `rounds` synchronous rounds over undirected edges (src, dst).

    Each node takes its neighbours' commonest label, its own where that is as common, else the smallest of
    them; nodes without neighbours keep their id. A round counts labels before they meet, so a hub's
    neighbours are never collected. Rounds are written to the shared folder; no change ends the loop early.
    Labels and votes grow with the nodes, so they meet by sorted merges and never pass through the driver.
    """
    both = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.where("src <> dst").select("dst", "src")).distinct()
    both, both_at = materialize(both.join(nodes.select("id").hint("merge"), "id", "left_semi").join(nodes.select(F.col("id").alias("other")).hint("merge"), "other", "left_semi"), "links")
    now, at = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = both.join(now.select(F.col("id").alias("other"), F.col("label").alias("vote")).hint("merge"), "other").groupBy("id", "vote").agg(F.count("*").alias("n"))
        own = votes.join(now.hint("merge"), "id").withColumn("mine", (F.col("vote") == F.col("label")).cast("int"))
        best = own.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("mine"), "vote"))).where("r = 1").select("id", "vote")
        new, new_at = materialize(now.join(best.hint("merge"), "id", "left").select("id", F.coalesce("vote", "label").alias("label"), (F.coalesce("vote", "label") != F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop(nodes.sparkSession, at)
        now, at = new.select("id", "label"), new_at
        if not moved:
            break
    drop(nodes.sparkSession, both_at)
    return now


def summaries(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, members, summary): how many nodes of which types each community has, as 'Type: n, ...'."""
    per = labels.hint("merge").join(nodes.select("id", "node_type"), "id").groupBy("label", "node_type").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "node_type"))), lambda x: F.concat(x["node_type"], F.lit(": "), (-x["m"]).cast("string"))), ", ")
    return per.groupBy("label").agg(F.sum("n").alias("members"), text.alias("summary"))
