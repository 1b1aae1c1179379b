"""Queries of skein.operators.diffs."""

from pyspark.sql import functions as F

from skein.operators import diffs as D
from skein.plans.registry import query

_FILES = "files_old files_new"
_O, _N = "files_old", "files_new"


@query(
    "S1_version_diff",
    """select 'node' kind, 'added' change, node_key as "key" from nodes where in_v2 and not in_v1 union all select 'node', 'removed', node_key from nodes where in_v1 and not in_v2
    union all select 'edge', 'added', id from edges where in_v2 and not in_v1 union all select 'edge', 'removed', id from edges where in_v1 and not in_v2""",
    "nodes edges",
)
def _(d):
    of = lambda t, key, kind: D.changes(t.where("in_v1").withColumnRenamed(key, "key"), t.where("in_v2").withColumnRenamed(key, "key"), ["key"]).withColumn("kind", F.lit(kind))
    return of(d.nodes, "node_key", "node").union(of(d.edges.drop("key"), "id", "edge")).select("kind", "change", "key")


@query(
    "S2_snapshot_drift",
    f"""with c as (select (select count(*) from {_N} join {_O} using (file_path) where {_N}.file_hash <> {_O}.file_hash) > 0 source, (select count(*) from {_N} n join {_O} o using (file_path) where n.extractor_version <> o.extractor_version) > 0 tool)
    select case when source and tool then 'BOTH_CHANGED' when source then 'SOURCE_CODE_CHANGE' when tool then 'TOOL_UPGRADE' else 'NONE' end drift from c""",
    _FILES,
)
def _(d):
    both = d.files_new.alias("n").join(d.files_old.alias("o"), "file_path")
    c = both.agg(F.coalesce(F.bool_or(F.col("n.file_hash") != F.col("o.file_hash")), F.lit(False)).alias("source"), F.coalesce(F.bool_or(F.col("n.extractor_version") != F.col("o.extractor_version")), F.lit(False)).alias("tool"))
    return c.select(F.when(F.col("source") & F.col("tool"), "BOTH_CHANGED").when(F.col("source"), "SOURCE_CODE_CHANGE").when(F.col("tool"), "TOOL_UPGRADE").otherwise("NONE").alias("drift"))


@query(
    "S3_alignment",
    "with a as (select distinct node_key from nodes where in_v1), b as (select distinct node_key from nodes where in_v2), n as (select (select count(*) from a join b using (node_key)) shared, (select count(*) from a where node_key not in (select node_key from b)) left_only, (select count(*) from b where node_key not in (select node_key from a)) right_only) select *, round(shared / (shared + left_only + right_only), 6) rate from n",
    "nodes",
)
def _(d):
    return D.alignment(d.v1_nodes, d.nodes.where("in_v2"), "node_key")


@query("S4_set_operations", "(select node_name from nodes where in_v1 intersect select node_name from nodes where in_v2) except select node_name from nodes where status = 'REJECTED'", "nodes")
def _(d):
    return d.v1_nodes.select("node_name").intersect(d.nodes.where("in_v2").select("node_name")).subtract(d.nodes.where("status = 'REJECTED'").select("node_name"))


@query("S5_changed_files", f"select n.file_path, n.file_hash from {_N} n left join {_O} o using (file_path) where o.file_hash is distinct from n.file_hash", _FILES)
def _(d):
    return D.changed_files(d.files_old, d.files_new)


@query(
    "S6_renames",
    f"""with g as (select *, row_number() over (partition by file_hash order by file_path) r from {_O} where file_path not in (select file_path from {_N})), c as (select *, row_number() over (partition by file_hash order by file_path) r from {_N} where file_path not in (select file_path from {_O}))
    select g.file_path old_path, c.file_path new_path from g join c on g.file_hash = c.file_hash and g.r = c.r""",
    _FILES,
)
def _(d):
    return D.renames(d.files_old, d.files_new)


@query("S7_logic_rescan", f"select n.file_path from {_N} n join {_O} o using (file_path) where n.extractor_version is distinct from o.extractor_version", _FILES)
def _(d):
    return D.logic_rescans(d.files_old, d.files_new, ["extractor_version"])


@query("S8_unchanged_files", f"select file_path from {_N} n where exists (select 1 from {_O} o where o.file_path = n.file_path and o.file_hash = n.file_hash)", _FILES)
def _(d):
    return D.unchanged_files(d.files_old, d.files_new)


@query("S8_recorded_snapshot", f"select file_path, file_hash from {_O} where file_path not in (select file_path from {_N}) union all select file_path, file_hash from {_N}", _FILES)
def _(d):
    return D.recorded(d.files_old, d.files_new).select("file_path", "file_hash")


@query("S9_chunk_actions", f"select file_hash, case when max(s) = 1 then 'delete' when min(s) = 2 then 'insert' else 'keep' end as \"action\" from (select file_hash, 1 s from {_O} union all select file_hash, 2 from {_N}) x group by file_hash", _FILES)
def _(d):
    return D.chunk_actions(d.files_old, d.files_new, "file_hash")


@query("S10_tombstones", "select id, cast(source_path not in (select source_path from nodes where k % 3 = 0) as integer) deleted from nodes", "nodes")
def _(d):
    return D.tombstoned(d.nodes, d.nodes.where("k % 3 = 0")).select("id", "deleted")


@query("S11_version_clone", "select node_key from nodes where in_v1 or in_v2", "nodes")
def _(d):
    return D.cloned(d.v1_nodes, d.nodes.where("in_v2"), "node_key").select("node_key")


@query(
    "S12_schema_fingerprints",
    """select "table", sha256(string_agg("table" || ':' || name || ':' || source_type || ':' || case when k % 2 = 0 then 'Y' else 'N' end, ',' order by name)) fingerprint from (select regexp_extract(id, '[0-9]+') as "table", node_name as name, source_type, k from nodes where node_type = 'Column') c group by "table\"""",
    "nodes",
)
def _(d):
    c = d.nodes.where("node_type = 'Column'")
    return D.schema_fingerprints(c.select(F.regexp_extract("id", "[0-9]+", 0).alias("table"), F.col("node_name").alias("name"), F.col("source_type").alias("type"), (F.col("k") % 2 == 0).alias("nullable")))


@query("S13_included_tables", "select id from nodes where node_type = 'Table' and (id like 'tbl:1%' or id like 'tbl:2_') and not id like '%5'", "nodes")
def _(d):
    return D.included(d.nodes.where("node_type = 'Table'"), "id", ["tbl:1*", "tbl:2?"], ["*5"]).select("id")
