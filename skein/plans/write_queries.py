"""Queries of skein.operators.writes, of incremental scans, and of sources."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import writes as W
from skein.plans.registry import query
from skein.sources import requirements as Q
from skein.sources.buckets import BucketTable
from skein.storage import scratch_path
from skein.streaming.traces import appended

_STORED = "select id, node_type, confidence, status from nodes where in_v1"
_NEW = "select id, node_type, case when k % 3 = 0 then null else 0.5e0 end confidence, 'PENDING' status from nodes where in_v2 and k % 2 = 0"


def _stored(d):
    return d.v1_nodes.select("id", "node_type", "confidence", "status")


def _new(d):
    return d.nodes.where("in_v2 and k % 2 = 0").select("id", "node_type", F.when(F.col("k") % 3 != 0, 0.5).alias("confidence"), F.lit("PENDING").alias("status"))


@query("W1_replaced_nodes", f"with s as ({_STORED}), n as ({_NEW}) select * from n union all select s.* from s anti join n using (id)", "nodes")
def _(d):
    return W.upsert(_stored(d), _new(d), ["id"])


@query("W1_patched_nodes", f"with s as ({_STORED}), n as ({_NEW}) select coalesce(n.id, s.id) id, coalesce(n.node_type, s.node_type) node_type, coalesce(n.confidence, s.confidence) confidence, coalesce(n.status, s.status) status from s full join n on n.id = s.id", "nodes")
def _(d):
    return W.upsert(_stored(d), _new(d), ["id"], partial=True)


def _merged(stored, new, key, **how):
    table = BucketTable.create(stored, scratch_path(stored.sparkSession, "buckets"), key, 32)
    table.merge(new, **how)
    return table.read()


@query("W1_delta_replaced_nodes", f"with s as ({_STORED}), n as ({_NEW}) select * from n union all select s.* from s anti join n using (id)", "nodes")
def _(d):
    return _merged(_stored(d), _new(d), ["id"])


@query("W1_delta_patched_nodes", f"with s as ({_STORED}), n as ({_NEW}) select coalesce(n.id, s.id) id, coalesce(n.node_type, s.node_type) node_type, coalesce(n.confidence, s.confidence) confidence, coalesce(n.status, s.status) status from s full join n on n.id = s.id", "nodes")
def _(d):
    return _merged(_stored(d), _new(d), ["id"], partial=True)


@query("W4_delta_deleted_nodes", f"with s as ({_STORED}) select * from s where id not in (select id from nodes where k % 10 = 0)", "nodes")
def _(d):
    table = BucketTable.create(_stored(d), scratch_path(d.spark, "buckets"), ["id"], 32)
    table.delete(d.nodes.where("k % 10 = 0").select("id"))
    return table.read()


@query("W2_merged_edges", "with s as (select src, dst, edge_type, min(confidence) confidence from edges where in_v1 group by 1, 2, 3), n as (select src, dst, edge_type, max(k) k from edges where in_v2 and k % 3 = 0 group by 1, 2, 3) select coalesce(n.src, s.src) src, coalesce(n.dst, s.dst) dst, coalesce(n.edge_type, s.edge_type) edge_type, case when n.src is not null then n.k / 1e3 else confidence end confidence from s full join n on n.src = s.src and n.dst = s.dst and n.edge_type = s.edge_type", "edges")
def _(d):
    stored = d.v1_edges.groupBy("src", "dst", "edge_type").agg(F.min("confidence").alias("confidence"))
    new = d.edges.where("in_v2 and k % 3 = 0").select("src", "dst", "edge_type", (F.col("k") / 1e3).alias("confidence"), "k")
    return W.upsert(stored, new, ["src", "dst", "edge_type"], order="k")


@query("W2_delta_edges", "with s as (select src, dst, edge_type, min(confidence) confidence from edges where in_v1 group by 1, 2, 3), n as (select src, dst, edge_type, max(k) k from edges where in_v2 and k % 3 = 0 group by 1, 2, 3) select coalesce(n.src, s.src) src, coalesce(n.dst, s.dst) dst, coalesce(n.edge_type, s.edge_type) edge_type, case when n.src is not null then n.k / 1e3 else confidence end confidence from s full join n on n.src = s.src and n.dst = s.dst and n.edge_type = s.edge_type", "edges")
def _(d):
    stored = d.v1_edges.groupBy("src", "dst", "edge_type").agg(F.min("confidence").alias("confidence"))
    new = d.edges.where("in_v2 and k % 3 = 0").select("src", "dst", "edge_type", (F.col("k") / 1e3).alias("confidence"), "k")
    return _merged(stored, new, ["src", "dst", "edge_type"], order="k")


@query("W3_set_properties", "select id, case when node_type = 'Service' then 'AFFECTED' else status end status, case when node_type = 'Service' then 1.0 else verified_score end verified_score from nodes", "nodes")
def _(d):
    rows = d.nodes.select("id", "status", "verified_score")
    return W.with_properties(rows, d.nodes.where("node_type = 'Service'"), status=F.lit("AFFECTED"), verified_score=F.lit(1.0))


_GONE = "select id from nodes where source_path in ('src/m2/Table.java', 'src/m3/Service.java') or source_type = 'DOC_AI'"


@query("W4_nodes_left", f"select id from nodes where id not in ({_GONE})", "nodes")
def _(d):
    return W.without_nodes(d.nodes, d.edges, d.nodes.where("source_path in ('src/m2/Table.java', 'src/m3/Service.java') or source_type = 'DOC_AI'"))[0].select("id")


@query("W4_edges_left", f"with g as materialized ({_GONE}) select e.id from edges e anti join g x on x.id = e.src anti join g y on y.id = e.dst", "nodes edges")
def _(d):
    return W.without_nodes(d.nodes, d.edges, d.nodes.where("source_path in ('src/m2/Table.java', 'src/m3/Service.java') or source_type = 'DOC_AI'"))[1].select("id")


@query("W5_fact_upsert", "with a as (select l_orderkey, l_partkey, max(l_linenumber) n from lineitem group by 1, 2), f as (select l_orderkey fact_key, l_partkey part, n, row_number() over (partition by l_orderkey order by n desc, l_partkey desc) r from a) select fact_key, part, cast(n as bigint) n from f where r = 1")
def _(d):
    rows = d.lineitem.select(F.col("l_orderkey").alias("fact_key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("long").alias("n"))
    ordered = rows.withColumn("at", F.struct("n", "part"))
    return W.upsert(rows.limit(0), ordered, ["fact_key"], order="at")


@query("W5_delta_facts", "with a as (select l_orderkey, l_partkey, max(l_linenumber) n from lineitem group by 1, 2), f as (select l_orderkey fact_key, l_partkey part, n, row_number() over (partition by l_orderkey order by n desc, l_partkey desc) r from a) select fact_key, part, cast(n as bigint) n from f where r = 1")
def _(d):
    rows = d.lineitem.select(F.col("l_orderkey").alias("fact_key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("long").alias("n"))
    return _merged(rows.limit(0), rows.withColumn("at", F.struct("n", "part")), ["fact_key"], order="at")


@query("W6_incomplete_writes", "select 'node' kind, id, 'no_evidence' problem from nodes where evidence_ids = '' union all select 'edge', id, 'no_evidence' from edges where evidence_ids = '' union all select distinct 'edge', e.id, 'no_end' from edges e left join nodes a on a.id = e.src left join nodes b on b.id = e.dst where a.id is null or b.id is null", "nodes edges")
def _(d):
    evidence = lambda t: t.where("evidence_ids <> ''").select("id", F.explode(F.split("evidence_ids", ",")).alias("evidence"))
    return W.incomplete_writes(d.nodes, d.edges, evidence(d.nodes).union(evidence(d.edges)))


_FACTS = "select case o_orderstatus when 'O' then 'API' when 'F' then 'SQL' else 'JOB' end fact_type, concat('k', cast(o_custkey as string)) a, concat('t', cast(o_orderkey % 50 as string)) b from {orders}"


def _built(d):
    facts = d.spark.sql(_FACTS, orders=d.orders)
    nodes = [("API", "ApiEndpoint", "a"), ("API", "Method", "b"), ("SQL", "SqlStatement", "a"), ("SQL", "Table", "b"), ("JOB", "ScheduledJob", "a")]
    return W.built(facts, nodes, [("API", "HANDLED_BY", "a", "b"), ("SQL", "READS", "a", "b"), ("JOB", "TRIGGERS", "a", "b")])


@query("W7_built_nodes", f"with f as ({_FACTS.format(orders='orders')}) select distinct case fact_type when 'API' then 'ApiEndpoint' when 'SQL' then 'SqlStatement' else 'ScheduledJob' end node_type, a node_key from f union select case fact_type when 'API' then 'Method' else 'Table' end, b from f where fact_type <> 'JOB'")
def _(d):
    return _built(d)[0]


@query("W7_built_edges", f"select distinct a src, b dst, case fact_type when 'API' then 'HANDLED_BY' when 'SQL' then 'READS' else 'TRIGGERS' end edge_type from ({_FACTS.format(orders='orders')}) f")
def _(d):
    return _built(d)[1]


@query("W8_backfilled", "select id, case node_type when 'Service' then 'core' when 'Table' then 'dba' end \"owner\", case when k % 2 = 0 then status when node_type = 'Service' then 'none' end state from nodes", "nodes")
def _(d):
    rows = d.nodes.select("id", "node_type", F.when(F.col("k") % 2 == 0, F.create_map(F.lit("state"), F.col("status"))).alias("props"))
    out = W.backfilled(rows, "props", "node_type", {"Service": {"owner": "core", "state": "none"}, "Table": {"owner": "dba"}})
    return out.select("id", F.try_element_at("props", F.lit("owner")).alias("owner"), F.try_element_at("props", F.lit("state")).alias("state"))


@query("W9_exported_report", "select node_type, count(*) n, count(*) filter (where status = 'CONFIRMED') confirmed from nodes group by 1", "nodes")
def _(d):
    path = scratch_path(d.spark, "report")
    d.nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed")).write.option("header", True).csv(path)
    return d.spark.read.option("header", True).schema("node_type string, n long, confirmed long").csv(path)


@query("W10_added_columns", "select concat('col:', cast(p_partkey as varchar), '.new') id, 'Column' node_type, concat('tbl:', cast(p_partkey as varchar)) parent from part where p_size > 40 union all select dst, 'Column', src from edges where edge_type = 'HAS_COLUMN'", "edges")
def _(d):
    added = d.part.where("p_size > 40").select(F.concat(F.lit("col:"), F.col("p_partkey").cast("string"), F.lit(".new")).alias("id"), F.lit("Column").alias("node_type"), F.concat(F.lit("tbl:"), F.col("p_partkey").cast("string")).alias("parent"))
    have = d.edges.where("edge_type = 'HAS_COLUMN'").select(F.col("dst").alias("id"), F.lit("Column").alias("node_type"), F.col("src").alias("parent"))
    return have.union(added.join(have.select("id"), "id", "left_anti"))


@query("W2_rewritten_table", "select edge_type, count(*) n from edges where edge_type <> 'CALLS' group by 1", "edges")
def _(d):
    path = scratch_path(d.spark, "edges")
    d.edges.select("id", "edge_type").write.parquet(path)
    stored = d.spark.read.parquet(path)
    W.rewrite(stored.where("edge_type <> 'CALLS'"), path, ["edge_type"])
    return d.spark.read.parquet(path).groupBy("edge_type").agg(F.count("*").alias("n"))


# incremental scans


@query(
    "S14_changed_by_stamp",
    "select coalesce(n.file_path, o.file_path) file_path, case when n.file_path is null then 'deleted' when o.file_path is null then 'added' when n.file_size <> o.file_size then 'changed' else 'same' end state from files_new n full join files_old o on o.file_path = n.file_path",
    "files_old files_new",
)
def _(d):
    o = d.files_old.select("file_path", F.struct("file_size").alias("a"))
    both = d.files_new.select("file_path", F.struct("file_size").alias("b")).join(o, "file_path", "full")
    return both.select("file_path", F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same").alias("state"))


@query("S15_stale_nodes", "select id from nodes where regexp_extract(source_path, '[^/]+/[^/]+$') in (select concat('m', cast(p_size as varchar), '/Service.java') from part where p_size % 9 = 0)", "nodes")
def _(d):
    changed = d.part.where("p_size % 9 = 0").select(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("/Service.java")).alias("tail")).distinct()
    return d.nodes.withColumn("tail", F.substring_index("source_path", "/", -2)).join(changed, "tail", "left_semi").select("id")


@query("S16_incremental_skips", "select n.file_path from files_new n join files_old o on o.file_path = n.file_path and o.file_hash = n.file_hash and o.extractor_version = n.extractor_version", "files_old files_new")
def _(d):
    return d.files_new.join(d.files_old.select("file_path", "file_hash", "extractor_version"), ["file_path", "file_hash", "extractor_version"], "left_semi").select("file_path")


@query("S17_limited_assets", "with a as (select source, lang, doc_id, row_number() over (partition by lang order by source, doc_id) r from (select source, lang, min(doc_id) doc_id from documents group by source, lang, n_chars) x) select lang, source, doc_id from a where r <= 20")
def _(d):
    from pyspark.sql import Window

    one = d.documents.groupBy("source", "lang", "n_chars").agg(F.min("doc_id").alias("doc_id"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id"))).where("r <= 20").select("lang", "source", "doc_id")


@query("S18_snapshots_by_type", "select split_part(file_path, '/', 1) source, count(*) n, sum(file_size) bytes from files_old group by 1".replace("sum(file_size)", "cast(sum(file_size) as bigint)"), "files_old")
def _(d):
    d.files_old.createOrReplaceTempView("file_snapshot_archive")
    return d.spark.table("file_snapshot_archive").groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("source")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("S19_resolved_scope", "select 'repo' kind, n_nationkey id from nation where n_nationkey in (1, 3, 5) union all select 'db', r_regionkey from region")
def _(d):
    available = d.nation.select(F.lit("repo").alias("kind"), F.col("n_nationkey").alias("id")).union(d.region.select(F.lit("db"), "r_regionkey"))
    asked = d.spark.createDataFrame([("repo", 1), ("repo", 3), ("repo", 5), ("repo", 999)], "kind string, id long")
    named = available.join(F.broadcast(asked), ["kind", "id"], "left_semi")
    return named.union(available.join(F.broadcast(asked.select("kind").distinct()), "kind", "left_anti"))


@query("S8_cleared_snapshot", "select file_path from files_old where file_path not like 'src1/%'", "files_old")
def _(d):
    return d.files_old.where(~F.col("file_path").startswith("src1/")).select("file_path")


# sources


@query("L1_table_metadata", None)
def _(d):
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable) for t in ("nation", "orders", "part") for i, f in enumerate(getattr(d, t).schema.fields)]
    return d.spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, nullable boolean")


@query("L2_inferred_keys", "select 'nation' child, 'n_regionkey' \"column\", 'region' parent, (select count(*) from nation where n_regionkey not in (select r_regionkey from region)) orphans union all select 'orders', 'o_custkey', 'customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer))")
def _(d):
    def row(child, column, parent, key):
        lost = getattr(d, child).select(F.col(column).alias(key)).join(getattr(d, parent).select(key), key, "left_anti")
        return lost.agg(F.count("*").alias("orphans")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "orphans")

    return row("nation", "n_regionkey", "region", "r_regionkey").union(row("orders", "o_custkey", "customer", "c_custkey"))


_LINKS = "select src source, dst target, case edge_type when 'CALLS' then 'invokes' when 'READS' then 'reads_from' when 'CONTAINS' then 'has' else 'other' end relation, case k % 4 when 0 then 'EXTRACTED' when 1 then 'INFERRED' when 2 then 'AMBIGUOUS' end confidence, case when k % 8 = 1 then 0.6e0 end score from {edges}"
_KNOWN = "select id from nodes where k % 13 <> 0"


def _external(d):
    """The external graph written as JSON lines and read back."""
    path = scratch_path(d.spark, "external")
    d.spark.sql(_LINKS, edges=d.edges).write.json(path)
    return d.spark.read.schema("source string, target string, relation string, confidence string, score double").json(path)


_MAPPED = f"""m as (select source, target, case relation when 'invokes' then 'CALLS' when 'reads_from' then 'READS' when 'has' then 'CONTAINS' else 'USES' end edge_type, case coalesce(confidence, 'EXTRACTED') when 'EXTRACTED' then 0.95 when 'INFERRED' then coalesce(score, 0.75) else 0.45 end confidence,
    case when confidence in ('INFERRED', 'AMBIGUOUS') then 'PENDING_CONFIRM' else 'CONFIRMED' end status from ({_LINKS.format(edges='edges')}) l), k as materialized ({_KNOWN})"""


@query("K21_mapped_edges", f"with {_MAPPED} select source, target, edge_type, max(m.confidence) confidence, arg_max(m.status, m.confidence) status from m semi join k x on x.id = m.source semi join k y on y.id = m.target group by 1, 2, 3", "nodes edges")
def _(d):
    return W.mapped_edges(_external(d), d.nodes.where("k % 13 <> 0"))[0]


@query("K32_import_warnings", f"with {_MAPPED} select distinct source, target, 'no source' problem from m anti join k x on x.id = m.source union all select distinct source, target, 'no target' from m anti join k x on x.id = m.target", "nodes edges")
def _(d):
    return W.mapped_edges(_external(d), d.nodes.where("k % 13 <> 0"))[1]


@query("L7_external_nodes", "select page_id, case when page_id % 5 = 0 then 'Table' when page_id % 5 = 1 then 'Page' when page_id % 5 = 2 then 'Feature' when contains(url, 'config') then 'ConfigItem' else 'Method' end node_type from pages".replace("when contains(url, 'config') then 'ConfigItem' else 'Method'", "when page_id % 2 = 0 then 'Service' else 'Mapper'"))
def _(d):
    kind = F.element_at(F.lit(["sql", "VUE", "md", "code", "code"]), (F.col("page_id") % 5 + 1).cast("int"))
    label = F.when(F.col("page_id") % 2 == 0, "OrderService").otherwise("orderMapper")
    return d.pages.select("page_id", W.external_node_type(kind, label).alias("node_type"))


@query("K22_field_report", "select 'missing' problem, 'relation' field union all select 'unknown', 'score'")
def _(d):
    missing, unknown = W.field_report(["source", "target", "confidence", "score"], ["source", "target", "relation"], ["confidence"])
    return d.spark.createDataFrame([("missing", f) for f in missing] + [("unknown", f) for f in unknown], "problem string, field string")


def _feed(d):
    """What users said, as a folder of JSON lines in shards that a connector reads."""
    path = scratch_path(d.spark, "requirements")
    said = d.conversations.where("role = 'user' and conv_id is not null and turn is not null")
    seq = F.row_number().over(Window.partitionBy("shard").orderBy("conv_id", "turn")) * 8 + F.col("shard") + 1
    rows = said.withColumn("shard", F.pmod("conv_id", F.lit(8))).select(
        "shard", seq.alias("seq"), F.concat_ws(".", "conv_id", "turn").alias("item_id"), F.concat(F.lit("p"), "shard").alias("project_id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("body"), F.lit("OPEN").alias("status"),
    )
    rows.repartition(8, "shard").write.partitionBy("shard").json(path)
    Q.register(d.spark)
    return path


_ITEMS = "select concat_ws('.', conv_id, turn) item_id, concat('p', conv_id % 8) project_id, substring(text, 1, 20) title, status from (select *, 'OPEN' status from conversations where role = 'user') x"


@query("L8_sourced_requirements", _ITEMS)
def _(d):
    return d.spark.read.format("requirements").option("path", _feed(d)).load().select("item_id", "project_id", "title", "status")


@query("L8_streamed_requirements", _ITEMS)
def _(d):
    stream = d.spark.readStream.format("requirements").option("path", _feed(d)).load()
    return appended(stream.select("item_id", "project_id", "title", "status"), "requirements").rows


@query("L8_pulled_requirements", "select doc_id requirement_id, split_part(trim(text), '.', 1) title from documents where source in ('src1', 'src2') and text is not null")
def _(d):
    return d.documents.where("source in ('src1', 'src2') and text is not null").select(F.col("doc_id").alias("requirement_id"), F.split_part(F.trim("text"), F.lit("."), F.lit(1)).alias("title"))
