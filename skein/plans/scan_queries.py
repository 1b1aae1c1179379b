"""Queries of skein.operators.scans."""

from pyspark.sql import functions as F

from skein.operators import scans as S
from skein.plans.registry import query
from skein.sources import layout as L
from skein.storage import scratch_path

_N = "id, node_type, confidence, status"


def _n(df):
    return df.select("id", "node_type", "confidence", "status")


@query("G1_filtered_nodes", f"select {_N} from nodes where in_v1 and node_type = 'Mapper' and source_type = 'CODE_AST' and confidence >= 0.3 and status = 'CONFIRMED' order by node_key, id limit 50", "nodes")
def _(d):
    return _n(S.scan_nodes(d.v1_nodes, 50, node_type="Mapper", source_type="CODE_AST", least_confidence=0.3, status="CONFIRMED"))


@query("G2_nodes_by_key", f"select {_N} from nodes where node_key = 'Table#tbl:7'", "nodes")
def _(d):
    return _n(S.scan_nodes(d.nodes, node_type="Table", node_key="Table#tbl:7"))


def _clustered(d, rows, by, **how):
    path = scratch_path(d.spark, "clustered")
    L.cluster(rows, path, by, **how)
    return path


@query("G2_skipping_key_lookup", f"select {_N} from nodes where node_key = 'Table#tbl:7' and node_type = 'Table'", "nodes")
def _(d):
    path = _clustered(d, d.nodes, ["node_key"], zones=["node_type"])
    return _n(L.pruned(d.spark, path, [("node_key", "=", "Table#tbl:7"), ("node_type", "=", "Table")]))


@query("G6_skipping_edge_scan", "select id, src, dst, edge_type from edges where src in ('svc:1', 'svc:2', 'api:10') and k < 100000", "edges")
def _(d):
    path = _clustered(d, d.edges, ["src", "dst"], zones=["k"], bloom=["dst"])
    return L.pruned(d.spark, path, [("src", "in", ["svc:1", "svc:2", "api:10"]), ("k", "<", 100000)]).select("id", "src", "dst", "edge_type")


@query("G17_skipping_window", "select node_key from nodes where node_key > 'Method#mth:5' order by node_key limit 25", "nodes")
def _(d):
    return L.window(d.spark, _clustered(d, d.nodes, ["node_key"]), "node_key", "Method#mth:5", 25).select("node_key")


@query("G3_node_by_natural_key", f"select {_N} from nodes where in_v1 and node_type = 'Service' and node_key = 'Service#svc:3' order by id limit 1", "nodes")
def _(d):
    return _n(S.scan_nodes(d.v1_nodes, 1, node_type="Service", node_key="Service#svc:3"))


@query("G4_node_by_id", f"select {_N} from nodes where id = 'mth:10'", "nodes")
def _(d):
    return _n(S.by_ids(d.nodes, ["mth:10"]))


@query("G5_nodes_by_ids", f"select {_N} from nodes where id in (select concat('mth:', cast(o_custkey as string)) from orders where o_totalprice > 200000)", "nodes")
def _(d):
    return _n(S.by_ids(d.nodes, d.orders.where("o_totalprice > 200000").select(F.concat(F.lit("mth:"), F.col("o_custkey").cast("string")))))


_ENDS = "join nodes a on a.id = e.src join nodes b on b.id = e.dst"


@query("G6_edges_with_endpoints", f"select e.id, a.node_type src_node_type, b.node_type dst_node_type from edges e {_ENDS} where e.confidence >= 0.9 and e.status = 'CONFIRMED'", "nodes edges")
def _(d):
    return S.scan_edges(d.edges, d.nodes, least_confidence=0.9, status="CONFIRMED").select("id", "src_node_type", "dst_node_type")


@query("G7_connected_edges", f"select e.id, a.node_key src_node_key, b.node_key dst_node_key from edges e {_ENDS} where e.edge_type = 'CALLS' and (e.src = 'svc:1' or e.dst = 'svc:1')", "nodes edges")
def _(d):
    return S.scan_edges(d.edges, d.nodes, connected="svc:1", edge_type="CALLS").select("id", "src_node_key", "dst_node_key")


@query("G8_edge_by_composite_key", "select id, confidence from edges where src = 'dom:0' and edge_type = 'CONTAINS' order by id limit 1", "edges")
def _(d):
    return S.limited(S.where(d.edges, src="dom:0", edge_type="CONTAINS"), 1, "id").select("id", "confidence")


@query("G9_edge_by_id", "select id, edge_type from edges where id = 'map:1->contains->mth:1' or id = 'dom:0->contains->ctl:0'", "edges")
def _(d):
    return S.by_ids(d.edges, ["map:1->contains->mth:1", "dom:0->contains->ctl:0"]).select("id", "edge_type")


@query("G10_low_confidence_nodes", "select id, confidence from nodes where coalesce(confidence, 0) < 0.5 order by confidence asc nulls last, id limit 100", "nodes")
def _(d):
    return S.low_confidence(d.nodes, 0.5, 100).select("id", "confidence")


@query("G11_disconnected_nodes", "select id, node_type from nodes anti join (select src id from edges union select dst from edges) x using (id)", "nodes edges")
def _(d):
    return S.disconnected(d.nodes, d.edges).select("id", "node_type")


@query("G12_affected_nodes", "select id from nodes where node_type = 'Method' and verified_score > 0", "nodes")
def _(d):
    return S.where(d.nodes, node_type="Method").where("verified_score > 0").select("id")


@query("G13_node_keys_by_source", "select distinct coalesce(node_key, id) as \"key\" from nodes where source_type in ('CODE_AST', 'SQL_PARSE') and trim(coalesce(node_key, id)) <> ''", "nodes")
def _(d):
    return S.keys_by_source(d.nodes, ["CODE_AST", "SQL_PARSE"], "node_key")


@query("G14_edge_keys_by_source", "select distinct id as \"key\" from edges where source_type in ('DB_METADATA')", "edges")
def _(d):
    return S.keys_by_source(d.edges, ["DB_METADATA"], "id")


@query("G15_node_projection", f"select {_N}, node_name, source_type from nodes where in_v1 and confidence >= 0.8 and status = 'APPROVED'", "nodes")
def _(d):
    return S.where(d.v1_nodes, 0.8, status="APPROVED").select("id", "node_type", "confidence", "status", "node_name", "source_type").orderBy(F.desc_nulls_first("confidence"))


@query("G16_edge_projection", "select id, src, dst, edge_type, confidence, status from edges where in_v1 and confidence >= 0.95", "edges")
def _(d):
    return S.where(d.v1_edges, 0.95).select("id", "src", "dst", "edge_type", "confidence", "status")


@query("G17_keyset_window", "select node_key from nodes where in_v1 and node_type in ('Method', 'Table') and node_key > 'Method#mth:5' order by node_key, id limit 25", "nodes")
def _(d):
    return S.window_page(d.v1_nodes, "Method#mth:5", 25, node_type=["Method", "Table"]).select("node_key")


@query(
    "G18_window_envelope",
    """with f as (select * from nodes where node_type in ('Service', 'Mapper')), p as (select * from f where node_key > 'Mapper#map:2' order by node_key, id limit 101), q as (select * from p order by node_key, id limit 100)
    select (select count(*) from q) n_nodes, (select count(*) from edges where src in (select id from q) and dst in (select id from q)) n_edges, (select count(*) from f) total,
    (select count(*) > 100 from p) has_more, case when (select count(*) > 100 from p) then (select max(node_key) from q) end next_cursor""",
    "nodes edges",
)
def _(d):
    return S.page_envelope(d.nodes, d.edges, "Mapper#map:2", 100, node_type=["Service", "Mapper"])


@query("G19_induced_edges", "select id from edges where src in (select id from nodes where k % 3 = 0) and dst in (select id from nodes where k % 3 = 0)", "nodes edges")
def _(d):
    return S.induced_edges(d.edges, d.nodes.where("k % 3 = 0")).select("id")


@query("G20_outgoing_edges", "select e.id, n.node_type from edges e join nodes n on n.id = e.dst where e.src in (select id from nodes where node_type = 'Controller')", "nodes edges")
def _(d):
    return S.outgoing(d.edges, S.where(d.nodes, node_type="Controller")).join(d.nodes.select(F.col("id").alias("dst"), "node_type"), "dst").select("id", "node_type")


@query("G21_incoming_edges", "select e.id, n.node_type from edges e join nodes n on n.id = e.src where e.dst in (select id from nodes where node_type = 'Service')", "nodes edges")
def _(d):
    return S.incoming(d.edges, S.where(d.nodes, node_type="Service")).join(d.nodes.select(F.col("id").alias("src"), "node_type"), "src").select("id", "node_type")


@query("G22_nodes_by_source_path", "select id from nodes where source_path = 'src/m3/Method.java'", "nodes")
def _(d):
    return S.where(d.nodes, source_path="src/m3/Method.java").select("id")


@query("G23_reverse_dependents", "select distinct src, dst, edge_type from edges where edge_type in ('CALLS', 'READS', 'WRITES') and dst in (select id from nodes where source_path = 'src/m1/Table.java')", "nodes edges")
def _(d):
    return S.reverse_dependents(d.edges, S.where(d.nodes, source_path="src/m1/Table.java"), ["CALLS", "READS", "WRITES"])


@query("G24_free_sql", "select edge_type, count(*) n from edges where confidence >= 0.5 group by edge_type", "edges")
def _(d):
    return S.run_sql(d.spark, "select edge_type, count(*) n from {edges} where confidence >= :least group by edge_type", {"least": 0.5}, edges=d.edges)


@query("G25_unified_graph", "select 'node' kind, id, node_type as \"type\", status from nodes where in_v1 union all select 'edge', id, edge_type, status from edges where in_v1", "nodes edges")
def _(d):
    return S.unified(d.v1_nodes, d.v1_edges)


@query("G25_empty_reasons", "select count(*) total, count(*) filter (where confidence >= 0.9) confident, count(*) filter (where status = 'PENDING') of_status, count(*) filter (where confidence >= 0.9 and status = 'PENDING') both_ from nodes".replace("both_", '"both"'), "nodes")
def _(d):
    return S.empty_reasons(d.nodes, 0.9, "PENDING")


@query("G26_release_filter", "with k as (select id from nodes where status <> 'REJECTED') select id from edges where src in (select id from k) and dst in (select id from k)", "nodes edges")
def _(d):
    return S.released(d.nodes, d.edges)[1].select("id")


_VIEW = """with r as (select id, row_number() over (partition by node_type order by node_key, id) r from nodes where node_type in ({t}) and contains(node_name, '{w}')), k as (select id from r where r <= {n}),
    e as (select id from edges where src in (select id from k) and dst in (select id from k) order by id limit 500) select 'node' kind, id from k union all select 'edge', id from e"""


@query("G27_feature_view", _VIEW.format(t="'ApiEndpoint', 'Method', 'Mapper', 'Controller', 'Service'", w="1", n=200), "nodes edges")
def _(d):
    return S.typed_view(d.nodes, d.edges, ["ApiEndpoint", "Method", "Mapper", "Controller", "Service"], "1")


@query("G28_business_view", _VIEW.format(t="'BusinessDomain', 'Controller', 'Table', 'Package'", w="A", n=50), "nodes edges")
def _(d):
    return S.typed_view(d.nodes, d.edges, ["BusinessDomain", "Controller", "Table", "Package"], "A", 50)


@query("G29_api_listing", "select id, coalesce(nullif(node_name, ''), node_key) label from nodes where node_type = 'ApiEndpoint'", "nodes")
def _(d):
    return S.where(d.nodes, node_type="ApiEndpoint").select("id", F.coalesce(F.nullif("node_name", F.lit("")), "node_key").alias("label"))


@query(
    "G30_drift_queue",
    """with f as (select 'edge' kind, 'static_only' drift, id from edges where source_type in ('CODE_AST', 'SQL_PARSE') and verified_score = 0
    union all select 'edge', 'dynamic_only', id from edges where source_type = 'RUNTIME_TRACE' union all select 'node', 'doc_only', id from nodes where source_type = 'DOC_AI' union all select 'node', 'low_confidence', id from nodes where confidence < 0.5),
    r as (select *, row_number() over (partition by drift order by id) r from f) select kind, drift, id from r where r <= 200""",
    "nodes edges",
)
def _(d):
    return S.drift_queue(d.nodes, d.edges)


@query(
    "G31_version_page",
    """with v as (select created_at, count(*) nodes_n, count(*) filter (where status = 'CONFIRMED') confirmed from nodes group by created_at), e as (select created_at, count(*) edges_n from edges group by created_at)
    select created_at, nodes_n, confirmed, coalesce(edges_n, 0) edges_n from v left join e using (created_at) order by created_at desc limit 5 offset 5""",
    "nodes edges",
)
def _(d):
    v = d.nodes.groupBy("created_at").agg(F.count("*").alias("nodes_n"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"))
    e = d.edges.groupBy("created_at").agg(F.count("*").alias("edges_n"))
    return S.offset_page(v.join(e, "created_at", "left").withColumn("edges_n", F.coalesce("edges_n", F.lit(0))), 2, 5, F.desc("created_at"))


@query("G32_filter_sort_page", "select o_orderkey, o_totalprice from orders where (o_orderpriority like '1%' or o_orderstatus in ('O', 'P')) and o_totalprice >= 100000 and o_orderdate is not null order by o_totalprice desc, o_orderkey limit 20 offset 40")
def _(d):
    found = d.orders.where((F.col("o_orderpriority").like("1%") | F.col("o_orderstatus").isin("O", "P")) & (F.col("o_totalprice") >= 100000) & F.col("o_orderdate").isNotNull())
    return S.offset_page(found.select("o_orderkey", "o_totalprice"), 3, 20, F.desc("o_totalprice"), "o_orderkey")


@query("G33_fact_page", "select id, source_type, confidence from nodes where node_type = 'SqlStatement' and source_type = 'DB_METADATA' and confidence >= 0.2 order by created_at desc, id limit 30", "nodes")
def _(d):
    return S.limited(S.where(d.nodes, 0.2, node_type="SqlStatement", source_type="DB_METADATA"), 30, F.desc("created_at"), "id").select("id", "source_type", "confidence")


@query("G33_evidence_by_node", "select id, unnest(string_split(evidence_ids, ',')) evidence_id from nodes where node_type = 'Service' and evidence_ids <> ''", "nodes")
def _(d):
    return S.where(d.nodes, node_type="Service").where("evidence_ids <> ''").select("id", F.explode(F.split("evidence_ids", ",")).alias("evidence_id"))


@query("G34_review_queue", "select id, status, confidence from edges where status in ('PENDING', 'PENDING_CONFIRM') order by confidence desc nulls last, id limit 20 offset 20", "edges")
def _(d):
    return S.offset_page(S.where(d.edges, status=["PENDING", "PENDING_CONFIRM"]).select("id", "status", "confidence"), 2, 20, F.desc_nulls_last("confidence"), "id")
