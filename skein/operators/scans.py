"""Filtered scans, lookups, projections and pages over node and edge tables.

nodes: id, node_type, node_key, node_name, source_type, source_path, confidence, status, ...
edges: id, src, dst, edge_type, confidence, status, ... Null filters do not filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import materialize

#: Ids up to which a list becomes an IN; longer lists join.
LITERAL_IDS = 200


def limited(df: DataFrame, limit: int | None, *order: str | Column) -> DataFrame:
    """The first `limit` rows in a total order; none or at most 0 means all."""
    return df.orderBy(*order).limit(limit) if limit and limit > 0 else df


def where(df: DataFrame, least_confidence: float | None = None, **equal) -> DataFrame:
    """Rows that equal every given value (a list: any of it; None: no filter) and reach the confidence."""
    for name, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(list(value)))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df if least_confidence is None else df.where(F.col("confidence") >= least_confidence)


def scan_nodes(nodes: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    return limited(where(nodes, **filters), limit, "node_key", "id")


def by_ids(df: DataFrame, ids: Sequence[str] | DataFrame, column: str = "id") -> DataFrame:
    """Rows whose column is in a list or in the first column of a table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    if len(ids) <= LITERAL_IDS:
        return df.where(F.col(column).isin(list(ids)))
    table = df.sparkSession.createDataFrame([(i,) for i in ids], [column])
    return df.join(table.distinct(), column, "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str] = ("node_type", "node_key", "node_name")) -> DataFrame:
    """Edges with the columns of both end nodes, as src_* and dst_*; edges without both are left out."""
    end = lambda p: nodes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def scan_edges(edges: DataFrame, nodes: DataFrame, connected: str | None = None, limit: int | None = None, **filters) -> DataFrame:
    """Edges with their ends; connected: an id that either end has."""
    found = where(edges, **filters)
    if connected is not None:
        found = found.where((F.col("src") == connected) | (F.col("dst") == connected))
    return limited(with_ends(found, nodes), limit, "id")


def find_edge(edges: DataFrame, src: str, dst: str, edge_type: str) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst) & (F.col("edge_type") == edge_type)).limit(1)


def low_confidence(nodes: DataFrame, threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    return limited(nodes.where(F.coalesce("confidence", F.lit(0.0)) < threshold), limit, F.asc_nulls_last("confidence"), "id")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def disconnected(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes that no edge touches."""
    return limited(nodes.join(endpoints(edges), "id", "left_anti"), limit, "node_key", "id")


def keys_by_source(df: DataFrame, source_types: Sequence[str], key: str) -> DataFrame:
    """Distinct keys (the id where there is none) of rows of some sources; blank ones are left out."""
    k = F.coalesce(key, "id") if key != "id" else F.col("id")
    return where(df, source_type=list(source_types)).select(k.alias("key")).where(F.trim("key") != "").distinct()


def window_page(nodes: DataFrame, cursor: str | None, limit: int, **filters) -> DataFrame:
    """Keyset page: the `limit` nodes whose key follows the cursor; a scan with the key filter pushed down, not an offset."""
    found = where(nodes, **filters)
    return limited(found if cursor is None else found.where(F.col("node_key") > cursor), limit, "node_key", "id")


#: Nodes that one page of a unified graph holds at most.
PAGE = 2000


def page_envelope(nodes: DataFrame, edges: DataFrame, cursor: str | None, limit: int, **filters) -> DataFrame:
    """One row for a page of `limit` nodes, at most PAGE: has_more, next_cursor, n_nodes, n_edges (inside the page), total."""
    limit = min(limit, PAGE)
    probe = window_page(nodes, cursor, limit + 1, **filters)
    page = limited(probe, limit, "node_key", "id")
    ends = page.agg(F.count("*").alias("n_nodes"), F.max("node_key").alias("last"))
    inner = induced_edges(edges, page).agg(F.count("*").alias("n_edges"))
    total = where(nodes, **filters).agg(F.count("*").alias("total"))
    more = probe.agg((F.count("*") > limit).alias("has_more"))
    joined = ends.join(inner, F.lit(True)).join(total, F.lit(True)).join(more, F.lit(True))
    return joined.select("n_nodes", "n_edges", "total", "has_more", F.when(F.col("has_more"), F.col("last")).alias("next_cursor"))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids (its column id)."""
    return by_ids(by_ids(edges, ids.select("id"), "src"), ids.select("id"), "dst")


def outgoing(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src")


def incoming(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return edges.join(frontier.select(F.col("id").alias("dst")).distinct(), "dst")


def reverse_dependents(edges: DataFrame, targets: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    return incoming(where(edges, edge_type=list(edge_types)), targets).select("src", "dst", "edge_type").distinct()


def typed_view(nodes: DataFrame, edges: DataFrame, types: Sequence[str], contains: str, per_type: int = 200, max_edges: int = 500) -> DataFrame:
    """Nodes of some types whose name contains a word, at most per_type of each by key, and the edges among them, as rows (kind, id)."""
    rank = F.row_number().over(Window.partitionBy("node_type").orderBy("node_key", "id"))
    some = where(nodes, node_type=list(types)).where(F.col("node_name").contains(contains)).withColumn("r", rank).where(F.col("r") <= per_type)
    inner = limited(induced_edges(edges, some), max_edges, "id")
    return some.select(F.lit("node").alias("kind"), "id").union(inner.select(F.lit("edge"), "id"))


def released(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are not rejected, and the edges whose both ends survive."""
    kept = nodes.where(~F.col("status").eqNullSafe("REJECTED"))
    return kept, induced_edges(edges, kept)


def unified(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as rows of one table: kind, id, type, status."""
    return nodes.select(F.lit("node").alias("kind"), "id", F.col("node_type").alias("type"), "status").union(edges.select(F.lit("edge"), "id", "edge_type", "status"))


def empty_reasons(nodes: DataFrame, least_confidence: float, status: str) -> DataFrame:
    """Why a filtered graph is empty: rows in all, that reach the confidence, that have the status, that do both."""
    good, right = F.col("confidence") >= least_confidence, F.col("status") == status
    return nodes.agg(F.count("*").alias("total"), F.count_if(good).alias("confident"), F.count_if(right).alias("of_status"), F.count_if(good & right).alias("both"))


def drift_queue(nodes: DataFrame, edges: DataFrame, cap: int = 200) -> DataFrame:
    """What static and runtime evidence disagree on: (kind, drift, id), at most cap of each by id."""
    static = edges.where(F.col("source_type").isin("CODE_AST", "SQL_PARSE") & (F.col("verified_score") == 0)).select(F.lit("edge").alias("kind"), F.lit("static_only").alias("drift"), "id")
    dynamic = edges.where("source_type = 'RUNTIME_TRACE'").select(F.lit("edge"), F.lit("dynamic_only"), "id")
    doc = nodes.where("source_type = 'DOC_AI'").select(F.lit("node"), F.lit("doc_only"), "id")
    low = nodes.where("confidence < 0.5").select(F.lit("node"), F.lit("low_confidence"), "id")
    found = static.union(dynamic).union(doc).union(low)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("drift").orderBy("id"))).where(F.col("r") <= cap).drop("r")


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df in a total order with each row's place in it (from 1), without one task that sees all rows.

    Rows are range-partitioned by the order and written; a partition's rows are numbered in it, and the
    sizes of the partitions before it, one number each, are added.
    """
    sorted_, _ = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def offset_page(df: DataFrame, page: int, size: int, *order: str | Column) -> DataFrame:
    """Page `page` (from 1) of a table in a total order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def run_sql(spark, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Free-form SQL over named tables, with parameters."""
    return spark.sql(text, args=args, **tables)


def run_write(spark, text: str, path: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Free-form SQL whose result replaces the table at path; gives the table as it then is."""
    made = spark.sql(text, args=args, **tables)
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def version_statistics(versions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(version_id, cached, live, stale) of versions (version_id, cached) against the nodes (version_id) that are there now."""
    live = nodes.groupBy("version_id").agg(F.count("*").alias("live"))
    out = versions.join(live, "version_id", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    return out.select("version_id", "cached", "live", (~F.col("cached").eqNullSafe(F.col("live"))).alias("stale"))
