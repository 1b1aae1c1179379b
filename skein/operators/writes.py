"""Writing graphs: keyed upserts, property updates, deletes with their edges, and builders that turn facts into nodes and edges.

Every operator gives the new table; `rewrite` puts it in place of a stored one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import drop, materialize


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order: str | None = None, partial: bool = False) -> DataFrame:
    """stored with the rows of incoming put in by key: one row per key.

    Of several incoming rows of a key the last by `order` counts (without it they must be unique). `partial`
    keeps the stored value where the incoming one is null; else the row is replaced. A null key matches a null key.
    """
    if order:
        last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
        incoming = incoming.withColumn("_r", last).where("_r = 1").drop("_r")
    rest = [c for c in stored.columns if c not in key]
    names = [c for c in rest if c in incoming.columns]
    new = incoming.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*names).alias("_new"), F.lit(True).alias("_in"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = stored.withColumn("_was", F.lit(True)).join(new, on, "full")
    value = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) if partial else F.when(F.col("_in"), F.col(f"_new.{c}")).otherwise(F.col(c))
    keys = [F.when(F.col("_was"), F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)]
    return both.select(*keys, *[value(c).alias(c) if c in names else F.col(c) for c in rest]).select(*stored.columns)


def with_properties(rows: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """rows with columns set where the id is among ids."""
    hit = rows.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of gone (id) and the edges at them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def rewrite(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Replaces the table at path, of which df may be made: written aside first, so that a failure leaves the old one."""
    aside, at = materialize(df, "rewrite")
    out = aside.write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)
    drop(df.sparkSession, at)


def incomplete_writes(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, id, problem): nodes and edges whose evidence (id, evidence) is missing, and edges without their ends."""
    have = evidence.select("id").distinct()
    n = nodes.join(have, "id", "left_anti").select(F.lit("node").alias("kind"), "id", F.lit("no_evidence").alias("problem"))
    e = edges.join(have, "id", "left_anti").select(F.lit("edge"), "id", F.lit("no_evidence"))
    ends = edges.select("id", F.explode(F.array("src", "dst")).alias("end")).join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct()
    return n.union(e).union(ends.select(F.lit("edge"), "id", F.lit("no_end")))


def built(facts: DataFrame, nodes: Sequence[tuple[str, str, str]], edges: Sequence[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that facts stand for.

    nodes: (fact_type, node_type, expression of the key); edges: (fact_type, edge_type, expressions of the two
    keys). Facts are read once for each table; keys that are null make nothing, equal rows are one.
    """
    n = F.array_compact(F.array(*[F.when(F.col("fact_type") == f, F.struct(F.lit(t).alias("node_type"), F.expr(k).alias("node_key"))) for f, t, k in nodes]))
    e = F.array_compact(F.array(*[F.when(F.col("fact_type") == f, F.struct(F.expr(a).alias("src"), F.expr(b).alias("dst"), F.lit(t).alias("edge_type"))) for f, t, a, b in edges]))
    return facts.select(F.explode(n).alias("n")).select("n.*").where("node_key is not null").distinct(), facts.select(F.explode(e).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


def backfilled(rows: DataFrame, column: str, by: str, templates: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """rows whose map `column` has its type's template entries where it lacks them."""
    found = F.lit(None).cast("map<string,string>")
    for kind, entries in templates.items():
        found = F.coalesce(found, F.when(F.col(by) == kind, F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])))
    own = F.coalesce(column, F.create_map().cast("map<string,string>"))
    missing = F.map_filter(F.coalesce(found, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    return rows.withColumn(column, F.map_concat(own, missing))


# external graphs


#: What an external graph's relations, confidences and labels mean here.
RELATIONS = {
    "calls": "CALLS", "invokes": "CALLS", "extends": "IMPLEMENTED_BY", "inherits": "IMPLEMENTED_BY", "implements": "IMPLEMENTED_BY", "imports": "USES", "uses": "USES", "depends_on": "USES",
    "reads_from": "READS", "reads": "READS", "writes_to": "WRITES", "writes": "WRITES", "contains": "CONTAINS", "has": "CONTAINS",
}


def mapped_edges(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of external links (source, target, relation, confidence, score).

    Edges have edge_type, confidence and status; equal (source, target, edge_type) keep the most confident.
    warnings: (source, target, problem) of links without their ends.
    """
    kind, sure = F.lower("relation"), F.upper("confidence")
    edge_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), kind), F.lit("USES"))
    value = F.when(F.coalesce(sure, F.lit("EXTRACTED")) == "EXTRACTED", 0.95).when(sure == "INFERRED", F.coalesce("score", F.lit(0.75))).when(sure == "AMBIGUOUS", 0.45).otherwise(0.75)
    status = F.when(F.coalesce(sure, F.lit("")).isin("INFERRED", "AMBIGUOUS"), "PENDING_CONFIRM").otherwise("CONFIRMED")
    made = links.select("source", "target", edge_type.alias("edge_type"), value.alias("confidence"), status.alias("status"))
    known = nodes.select("id").distinct()
    ends = known.withColumnRenamed("id", "source"), known.withColumnRenamed("id", "target")
    sound = made.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")
    best = sound.groupBy("source", "target", "edge_type").agg(F.max(F.struct("confidence", "status")).alias("m")).select("source", "target", "edge_type", "m.confidence", "m.status")
    lost = made.join(ends[0], "source", "left_anti").select("source", "target", F.lit("no source").alias("problem")).union(made.join(ends[1], "target", "left_anti").select("source", "target", F.lit("no target")))
    return best, lost.distinct()


def external_node_type(file_type: Column, label: Column) -> Column:
    """Node type of an external node by the kind of its file, for code by its label."""
    low = F.lower(label)
    by_label = (
        F.when(label.isNull(), "Feature").when(low.contains("controller"), "Controller").when(low.contains("service"), "Service").when(low.rlike("repository|mapper"), "Mapper")
        .when(low.rlike("entity|model"), "BusinessObject").when(low.contains("config"), "ConfigItem").otherwise("Method")
    )
    kind = F.lower(file_type)
    return F.when(kind.isNull() | (kind == "code"), by_label).when(kind == "sql", "Table").when(kind.isin("vue", "jsx", "tsx"), "Page").otherwise("Feature")


def field_report(columns: Sequence[str], required: Sequence[str], known: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing required fields, unknown fields) of a table's columns, sorted."""
    return sorted(set(required) - set(columns)), sorted(set(columns) - set(required) - set(known))
