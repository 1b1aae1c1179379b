"""Aggregates over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.scans import disconnected

CONFIRMED, PENDING = ("CONFIRMED", "APPROVED"), ("PENDING", "PENDING_CONFIRM")
AI_NODES, AI_EDGES = ("AI_INFERENCE", "DOC_AI"), ("AI_INFERENCE", "AI_FEATURE_MAPPING", "DOC_AI")


def _in(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def _evidence() -> Column:
    return F.col("evidence_ids").isNotNull() & (F.col("evidence_ids") != "")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of conditional counts for a graph; each table is read once."""
    n = nodes.agg(
        F.count("*").alias("total_nodes"), F.count_if(_in("status", CONFIRMED)).alias("confirmed_nodes"), F.count_if(_in("status", PENDING)).alias("pending_nodes"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count_if(_evidence()).alias("with_evidence"), F.count_if(~F.coalesce(_evidence(), F.lit(False))).alias("no_evidence_nodes"),
        F.count_if(_in("source_type", AI_NODES)).alias("ai_only_nodes"), F.count_if(F.coalesce("verified_score", F.lit(0.0)) > 0).alias("runtime_verified"),
    )
    e = edges.agg(
        F.count("*").alias("total_edges"), F.count_if(_in("status", CONFIRMED)).alias("confirmed_edges"), F.count_if(_in("status", PENDING)).alias("pending_edges"),
        F.count_if(~F.coalesce(_evidence(), F.lit(False))).alias("no_evidence_edges"), F.count_if(_in("source_type", AI_EDGES)).alias("ai_only_edges"), F.count_if(F.col("source_type") == "RUNTIME_TRACE").alias("runtime_only_edges"),
    )
    return n.join(e, F.lit(True))


def type_stats(nodes: DataFrame, by: str = "node_type") -> DataFrame:
    return nodes.groupBy(by).agg(F.count("*").alias("total"), F.count_if(_in("status", CONFIRMED)).alias("confirmed"), F.avg("confidence").alias("avg_confidence")).orderBy(F.desc("total"), by)


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def daily_trend(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.to_date("created_at").alias("day")).agg(F.avg("confidence").alias("avg_confidence"), F.count("*").alias("new_nodes"), F.count_if(_in("status", CONFIRMED)).alias("confirmed"))


def confidence_bins(nodes: DataFrame) -> DataFrame:
    """Five bins [0, .2) ... [.8, 1]; values outside and nulls are left out, empty bins count 0."""
    c = F.col("confidence")
    bins = [((c >= i / 5) & (c < (i + 1) / 5)) if i < 4 else ((c >= 0.8) & (c <= 1)) for i in range(5)]
    one = nodes.agg(*[F.count_if(b).alias(f"b{i}") for i, b in enumerate(bins)])
    return one.select(F.posexplode(F.array(*[F.col(f"b{i}") for i in range(5)])).alias("bin", "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of every node with an edge; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """avg_degree_connected over nodes with an edge, avg_degree_all over all."""
    d = degrees(edges).join(nodes.select("id"), "id", "left_semi").agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree_connected"), F.coalesce(F.sum("degree"), F.lit(0)).alias("s"))
    n = nodes.agg(F.count("*").alias("n"))
    return d.join(n, F.lit(True)).select(F.round("avg_degree_connected", 6).alias("avg_degree_connected"), F.round(F.coalesce(F.try_divide("s", "n"), F.lit(0.0)), 6).alias("avg_degree_all"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids, each once; an end's lookup is an equi-join."""
    i = ids.select("id").distinct()
    hit = edges.select("id", F.explode(F.array("src", "dst")).alias("end")).join(i.withColumnRenamed("id", "end"), "end", "left_semi")
    return hit.select("id").distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing, blank or no node."""
    n = nodes.select("id")
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_anti").select("id").union(edges.join(n.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id")).distinct()


def duplicates(nodes: DataFrame, *key: str) -> DataFrame:
    """duplicate_members: rows in groups of equal key with more than one; surplus: those beyond the first."""
    g = nodes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def sample(df: DataFrame, n: int) -> DataFrame:
    """n rows by the digest of their id: the same rows each time."""
    return df.orderBy(F.md5("id"), "id").limit(n)


def support_rate(sampled: DataFrame) -> DataFrame:
    return sampled.agg(F.count("*").alias("sampled"), F.coalesce(F.avg(_evidence().cast("double")), F.lit(0.0)).alias("support_rate"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rate = lambda name: F.coalesce(F.avg(_evidence().cast("double")), F.lit(0.0)).alias(name)
    return nodes.agg(rate("node_coverage")).join(edges.agg(rate("edge_coverage")), F.lit(True))


def calibration(nodes: DataFrame) -> DataFrame:
    out = nodes.groupBy("source_type").pivot("status", ["CONFIRMED", "PENDING_CONFIRM", "REJECTED"]).agg(F.count(F.lit(1)))
    return out.select("source_type", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("CONFIRMED", "PENDING_CONFIRM", "REJECTED")])


#: Labels and the edge types of which a node needs one, whichever way it points.
CONSTRAINTS = {"Method": ("BELONGS_TO", "CONTAINS"), "Column": ("HAS_COLUMN",), "ApiEndpoint": ("HANDLED_BY",), "SqlStatement": ("READS", "WRITES")}


def violations(nodes: DataFrame, edges: DataFrame, rules: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(node_type, id) of nodes without any edge of the types their label needs: one anti-join for all rules."""
    rules = CONSTRAINTS if rules is None else rules
    pairs = F.create_map(*[x for t, es in rules.items() for e in es for x in (F.lit(f"{t}|{e}"), F.lit(t))])
    ends = edges.select("edge_type", F.explode(F.array("src", "dst")).alias("id"))
    ends = ends.select("id", F.explode(F.array(*[F.element_at(pairs, F.concat(F.lit(f"{t}|"), "edge_type")) for t in rules])).alias("node_type")).where("node_type is not null").distinct()
    return nodes.where(F.col("node_type").isin(*rules)).join(ends, ["id", "node_type"], "left_anti").select("node_type", "id")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = dangling(edges, nodes).agg(F.count("*").alias("dangling"))
    return one.join(duplicates(nodes, "node_type", "node_key").select("duplicate_members"), F.lit(True)).join(violations(nodes, edges).agg(F.count("*").alias("violations")), F.lit(True))


def task_rollup(tasks: DataFrame, key: str) -> DataFrame:
    """tasks: key, stage, status. Totals, successes, failures, and the first stage that runs or failed."""
    stuck = F.when(F.col("status").isin("RUNNING", "FAILED"), F.col("stage"))
    return tasks.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("SUCCESS", "WARNING", "SKIPPED")).alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.min(stuck).alias("stuck_stage"))


def subtask_rollup(tasks: DataFrame, key: str) -> DataFrame:
    """tasks: key, status, started, finished, items. Span, items, and the status that takes precedence."""
    status = F.when(F.bool_or(F.col("status") == "RUNNING"), "RUNNING").when(F.bool_or(F.col("status") == "FAILED"), "FAILED").when(F.bool_and(F.col("status") == "SKIPPED"), "SKIPPED").when(F.bool_or(F.col("status") == "WARNING"), "WARNING").otherwise("SUCCESS")
    return tasks.groupBy(key).agg(F.min("started").alias("started"), F.max("finished").alias("finished"), F.sum("items").alias("items"), status.alias("status"))


#: Fixed values. Name endings that tell what a reused component is, first match first.
REUSE = (("BASE_ENTITY", "Base|Abstract"), ("UTIL", "Util|Utils|Helper"), ("RESULT_WRAPPER", "Result|Response|Page"), ("CONFIG", "Config|Properties"))


def reused(edges: DataFrame, nodes: DataFrame, edge_type: str, threshold: int = 2) -> DataFrame:
    """Nodes with at least `threshold` incoming edges of a type: usage_count, the first five users by id, reuse_type by name."""
    use = edges.where(F.col("edge_type") == edge_type).groupBy("dst").agg(F.count("*").alias("usage_count"), F.slice(F.sort_array(F.collect_set("src")), 1, 5).alias("users")).where(F.col("usage_count") >= threshold)
    kind = F.lit(None)
    for name, pattern in REUSE:
        kind = F.coalesce(kind, F.when(F.col("node_name").rlike(pattern), name))
    return use.join(nodes.select(F.col("id").alias("dst"), "node_name"), "dst").select(F.col("dst").alias("id"), "usage_count", F.array_join("users", ",").alias("users"), F.coalesce(kind, F.lit("COMPONENT")).alias("reuse_type"))


def grouped(df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """Rows of each group: n, the sums of columns (sum_x) and the counts of their distinct values (distinct_x)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct])
