"""Queries of skein.operators.stats, and of windows and top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import stats as A
from skein.operators.scans import limited, low_confidence, numbered
from skein.plans.registry import query

_STATS = """select * from (select count(*) total_nodes, count(*) filter (where status in ('CONFIRMED', 'APPROVED')) confirmed_nodes, count(*) filter (where status in ('PENDING', 'PENDING_CONFIRM')) pending_nodes,
    coalesce(avg(confidence), 0) avg_confidence, count(*) filter (where evidence_ids <> '') with_evidence, count(*) filter (where coalesce(evidence_ids, '') = '') no_evidence_nodes,
    count(*) filter (where source_type in ('AI_INFERENCE', 'DOC_AI')) ai_only_nodes, count(*) filter (where verified_score > 0) runtime_verified from nodes {w}) n,
    (select count(*) total_edges, count(*) filter (where status in ('CONFIRMED', 'APPROVED')) confirmed_edges, count(*) filter (where status in ('PENDING', 'PENDING_CONFIRM')) pending_edges,
    count(*) filter (where coalesce(evidence_ids, '') = '') no_evidence_edges, count(*) filter (where source_type in ('AI_INFERENCE', 'AI_FEATURE_MAPPING', 'DOC_AI')) ai_only_edges, count(*) filter (where source_type = 'RUNTIME_TRACE') runtime_only_edges from edges {w}) e"""


@query("A1_counts", "select (select count(*) from nodes where in_v1 and status = 'CONFIRMED') n_nodes, (select count(*) from edges where in_v1) n_edges", "nodes edges")
def _(d):
    return d.v1_nodes.where("status = 'CONFIRMED'").agg(F.count("*").alias("n_nodes")).join(d.v1_edges.agg(F.count("*").alias("n_edges")), F.lit(True))


@query("A2_project_graph_stats", _STATS.format(w=""), "nodes edges")
def _(d):
    return A.graph_stats(d.nodes, d.edges)


@query("A3_version_graph_stats", _STATS.format(w="where in_v1"), "nodes edges")
def _(d):
    return A.graph_stats(d.v1_nodes, d.v1_edges)


@query("A4_node_type_stats", "select node_type, count(*) total, count(*) filter (where status in ('CONFIRMED', 'APPROVED')) confirmed, avg(confidence) avg_confidence from nodes group by node_type", "nodes")
def _(d):
    return A.type_stats(d.nodes)


@query("A5_edge_type_distribution", "select edge_type, count(*) n from edges group by edge_type", "edges")
def _(d):
    return A.distribution(d.edges, "edge_type")


@query("A6_daily_trend", "select created_at as \"day\", avg(confidence) avg_confidence, count(*) new_nodes, count(*) filter (where status in ('CONFIRMED', 'APPROVED')) confirmed from nodes group by created_at", "nodes")
def _(d):
    return A.daily_trend(d.nodes)


@query("A7_confidence_bins", "select cast(b.i as integer) bin, count(n.id) n from (values (0), (1), (2), (3), (4)) b(i) left join nodes n on n.confidence >= b.i / 5.0 and (n.confidence < (b.i + 1) / 5.0 or b.i = 4 and n.confidence <= 1) group by b.i", "nodes")
def _(d):
    return A.confidence_bins(d.nodes)


@query("A8_average_degree", "with g as (select id, count(*) degree from (select src id from edges union all select dst from edges) x group by id) select round(avg(degree), 6) avg_degree_connected, round(cast(sum(degree) as double) / (select count(*) from nodes), 6) avg_degree_all from g", "nodes edges")
def _(d):
    return A.average_degree(d.nodes, d.edges)


@query("A9_isolated_nodes", "select count(*) n from nodes anti join (select src id from edges union select dst from edges) x using (id)", "nodes edges")
def _(d):
    return A.disconnected(d.nodes, d.edges).agg(F.count("*").alias("n"))


@query("A10_edges_touching", "with i as (select id from nodes where node_type = 'Service') select count(*) n from edges e left join i a on a.id = e.src left join i b on b.id = e.dst where a.id is not null or b.id is not null", "nodes edges")
def _(d):
    return A.touching(d.edges, d.nodes.where("node_type = 'Service'")).agg(F.count("*").alias("n"))


@query("A11_dangling_edges", "with k as (select id from nodes where in_v2) select e.id from edges e left join k a on a.id = e.src left join k b on b.id = e.dst where a.id is null or b.id is null", "nodes edges")
def _(d):
    return A.dangling(d.edges, d.nodes.where("in_v2"))


@query("A12_duplicates", "select cast(coalesce(sum(n), 0) as bigint) duplicate_members, cast(coalesce(sum(n - 1), 0) as bigint) surplus from (select count(*) n from nodes group by node_type, node_name having count(*) > 1) g", "nodes")
def _(d):
    return A.duplicates(d.nodes, "node_type", "node_name")


@query("A13_edge_sample", "select id, edge_type from edges order by md5(id), id limit 50", "edges")
def _(d):
    return A.sample(d.edges, 50).select("id", "edge_type")


@query("A14_support_rate", "select count(*) sampled, avg(case when evidence_ids <> '' then 1.0e0 else 0.0e0 end) support_rate from (select * from edges order by md5(id), id limit 500) s", "edges")
def _(d):
    return A.support_rate(A.sample(d.edges, 500))


@query("A15_evidence_coverage", "select (select avg(case when evidence_ids <> '' then 1.0e0 else 0.0e0 end) from nodes) node_coverage, (select avg(case when evidence_ids <> '' then 1.0e0 else 0.0e0 end) from edges) edge_coverage", "nodes edges")
def _(d):
    return A.coverage(d.nodes, d.edges)


@query("A16_calibration", "select source_type, count(*) filter (where status = 'CONFIRMED') confirmed, count(*) filter (where status = 'PENDING_CONFIRM') pending_confirm, count(*) filter (where status = 'REJECTED') rejected from nodes group by source_type", "nodes")
def _(d):
    return A.calibration(d.nodes)


_LACK = """select node_type, id from nodes n where node_type = 'Method' and not exists (select 1 from edges e where e.edge_type in ('BELONGS_TO', 'CONTAINS') and e.src = n.id) and not exists (select 1 from edges e where e.edge_type in ('BELONGS_TO', 'CONTAINS') and e.dst = n.id)
    union all select node_type, id from nodes n where node_type = 'Column' and not exists (select 1 from edges e where e.edge_type = 'HAS_COLUMN' and e.dst = n.id)
    union all select node_type, id from nodes n where node_type = 'ApiEndpoint' and not exists (select 1 from edges e where e.edge_type = 'HANDLED_BY' and e.src = n.id)
    union all select node_type, id from nodes n where node_type = 'SqlStatement' and not exists (select 1 from edges e where e.edge_type in ('READS', 'WRITES') and e.src = n.id)"""


@query("A17_structural_integrity", f"with v as ({_LACK}) select (select count(*) from edges e left join nodes a on a.id = e.src left join nodes b on b.id = e.dst where a.id is null or b.id is null) dangling, (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) n from nodes group by node_type, node_key having count(*) > 1) g) duplicate_members, (select count(*) from v) violations", "nodes edges")
def _(d):
    return A.integrity(d.nodes, d.edges)


@query("J8_constraint_violations", _LACK, "nodes edges")
def _(d):
    return A.violations(d.nodes, d.edges)


_TASKS = "select o_custkey version, o_orderpriority stage, case o_orderkey % 5 when 0 then 'FAILED' when 1 then 'RUNNING' when 2 then 'SKIPPED' else 'SUCCESS' end status, o_orderdate started, o_orderdate finished, o_orderkey % 7 items from orders"


def _tasks(d):
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "FAILED").when(k == 1, "RUNNING").when(k == 2, "SKIPPED").otherwise("SUCCESS")
    return d.orders.select(F.col("o_custkey").alias("version"), F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_orderdate").alias("started"), F.col("o_orderdate").alias("finished"), (F.col("o_orderkey") % 7).alias("items"))


@query("A18_task_rollup", f"select version, count(*) total, count(*) filter (where status in ('SUCCESS', 'WARNING', 'SKIPPED')) success, count(*) filter (where status = 'FAILED') failed, min(case when status in ('RUNNING', 'FAILED') then stage end) stuck_stage from ({_TASKS}) t group by version")
def _(d):
    return A.task_rollup(_tasks(d), "version")


@query("A19_counts_by_version", "select created_at, count(*) n from nodes group by created_at", "nodes")
def _(d):
    return A.distribution(d.nodes, "created_at")


@query("A20_subtask_rollup", f"select version, min(started) started, max(finished) finished, cast(sum(items) as bigint) items, case when bool_or(status = 'RUNNING') then 'RUNNING' when bool_or(status = 'FAILED') then 'FAILED' when bool_and(status = 'SKIPPED') then 'SKIPPED' when bool_or(status = 'WARNING') then 'WARNING' else 'SUCCESS' end status from ({_TASKS}) t group by version")
def _(d):
    return A.subtask_rollup(_tasks(d), "version")


@query("A21_claims_by_predicate_source", "select predicate, source_type, count(*) n from claims group by predicate, source_type", "claims")
def _(d):
    return A.distribution(d.claims, "predicate", "source_type")


@query("A22_ai_only_claims", "select count(*) n from claims where source_type like '%AI%'", "claims")
def _(d):
    return d.claims.where(F.col("source_type").like("%AI%")).agg(F.count("*").alias("n"))


@query("A23_claims_by_predicate", "select predicate, count(*) n from claims group by predicate order by predicate", "claims")
def _(d):
    return A.distribution(d.claims, "predicate").orderBy("predicate")


@query(
    "A24_reused_components",
    """with u as (select dst, count(*) usage_count, array_to_string(list_slice(list_sort(list(distinct src)), 1, 5), ',') users from edges where edge_type = 'CALLS' group by dst having count(*) >= 3)
    select dst id, usage_count, users, case when regexp_matches(node_name, 'Base|Abstract') then 'BASE_ENTITY' when regexp_matches(node_name, 'Util|Utils|Helper') then 'UTIL' when regexp_matches(node_name, 'Result|Response|Page') then 'RESULT_WRAPPER' when regexp_matches(node_name, 'Config|Properties') then 'CONFIG' else 'COMPONENT' end reuse_type from u join nodes n on n.id = u.dst""",
    "nodes edges",
)
def _(d):
    return A.reused(d.edges, d.nodes, "CALLS", 3)


@query("A25_source_status", "select count(*) total, count(*) filter (where c_acctbal > 0) ready, count(*) filter (where c_acctbal < 0) failed from customer")
def _(d):
    return d.customer.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("ready"), F.count_if(F.col("c_acctbal") < 0).alias("failed"))


@query("A26_confirmation_rates", "select node_type, round(100.0 * count(*) filter (where status in ('CONFIRMED', 'APPROVED')) / count(*), 1) rate from nodes group by node_type", "nodes")
def _(d):
    return d.nodes.groupBy("node_type").agg(F.round(F.lit(100.0) * F.count_if(F.col("status").isin(*A.CONFIRMED)) / F.count("*"), 1).alias("rate"))


@query("A27_messages_per_conversation", "select conv_id, count(*) n from conversations group by conv_id")
def _(d):
    return A.distribution(d.conversations, "conv_id")


@query("A28_grouping_sum", "select l_returnflag, count(*) n, count(distinct l_partkey) parts, cast(sum(l_quantity) as double) qty from lineitem group by l_returnflag")
def _(d):
    return d.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.sum("l_quantity").cast("double").alias("qty"))


@query("A29_repeated_activities", "select activity, count(*) cases, round(avg(n), 6) avg_n from (select case_id, activity, count(*) n from process_log group by case_id, activity having count(*) > 1) g group by activity", "process_log")
def _(d):
    g = d.process_log.groupBy("case_id", "activity").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("activity").agg(F.count("*").alias("cases"), F.round(F.avg("n"), 6).alias("avg_n"))


@query("N1_top3_per_group", "select src, id, confidence from (select *, row_number() over (partition by src order by confidence desc nulls last, id) r from edges where edge_type = 'CALLS') x where r <= 3", "edges")
def _(d):
    w = Window.partitionBy("src").orderBy(F.desc_nulls_last("confidence"), "id")
    return d.edges.where("edge_type = 'CALLS'").withColumn("r", F.row_number().over(w)).where("r <= 3").select("src", "id", "confidence")


@query("N2_transitions", "select case_id, event_id, lag(activity) over (partition by case_id order by started_at, event_id) previous from process_log", "process_log")
def _(d):
    return d.process_log.select("case_id", "event_id", F.lag("activity").over(Window.partitionBy("case_id").orderBy("started_at", "event_id")).alias("previous"))


@query("N3_rank_positions", "select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as integer) pos from lineitem")
def _(d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return d.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("pos"))


@query("N4_latest_per_group", "select node_type, max(created_at) created_at, arg_max(id, concat(cast(created_at as string), id)) id from nodes group by node_type", "nodes")
def _(d):
    return d.nodes.groupBy("node_type").agg(F.max("created_at").alias("created_at"), F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query(
    "N5_recent_messages",
    """with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) r from conversations), k as (select *, case when r <= 4 then text else left(text, 100) end shown from r where r <= 10)
    select conv_id, left(coalesce(string_agg(case when r > 4 then shown end, ' | ' order by turn), ''), 500) summary, string_agg(case when r <= 4 then shown end, ' | ' order by turn) recent from k group by conv_id""",
)
def _(d):
    r = d.conversations.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 10")
    joined = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("turn", F.when(F.col("r") <= 4, F.col("text")).otherwise(F.substring("text", 1, 100)).alias("t"))))), lambda x: x["t"]), " | ")
    return r.groupBy("conv_id").agg(F.substring(joined(F.col("r") > 4), 1, 500).alias("summary"), joined(F.col("r") <= 4).alias("recent"))


@query("N6_first_per_key", "select source_path, id from (select *, row_number() over (partition by source_path order by k, id) r from nodes) x where r = 1", "nodes")
def _(d):
    return d.nodes.withColumn("r", F.row_number().over(Window.partitionBy("source_path").orderBy("k", "id"))).where("r = 1").select("source_path", "id")


@query("N7_trend_direction", "with t as (select created_at, avg(confidence) c from nodes group by created_at), x as (select arg_min(c, created_at) a, arg_max(c, created_at) b from t) select a first_value, b last_value, case when b - a > 0.05 then 'UP' when b - a < -0.05 then 'DOWN' else 'FLAT' end direction from x", "nodes")
def _(d):
    t = d.nodes.groupBy("created_at").agg(F.avg("confidence").alias("c")).agg(F.min_by("c", "created_at").alias("a"), F.max_by("c", "created_at").alias("b"))
    step = F.col("b") - F.col("a")
    return t.select(F.col("a").alias("first_value"), F.col("b").alias("last_value"), F.when(step > 0.05, "UP").when(step < -0.05, "DOWN").otherwise("FLAT").alias("direction"))


@query("N8_conflict_with_first", "select seq, subject_key, predicate, object_key from (select *, first_value(object_key) over (partition by subject_key, predicate order by seq, object_key) f from claims) x where object_key <> f", "claims")
def _(d):
    w = Window.partitionBy("subject_key", "predicate").orderBy("seq", "object_key")
    return d.claims.withColumn("f", F.first("object_key").over(w)).where("object_key <> f").select("seq", "subject_key", "predicate", "object_key")


@query("N9_stable_multi_key_sort", "select o_orderkey, cast(row_number() over (order by o_totalprice desc, o_orderkey) as integer) pos from orders")
def _(d):
    return numbered(d.orders.select("o_orderkey", "o_totalprice"), "pos", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", F.col("pos").cast("int").alias("pos"))


@query("N10_global_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(d):
    return limited(d.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query(
    "R5_quality_report",
    """with s as (select coalesce(avg(confidence), 0) a from nodes), i as (select (select count(*) from (select 1 from nodes where coalesce(confidence, 0) < 0.3 limit 200) x) + (select count(*) from (select 1 from nodes anti join (select src id from edges union select dst from edges) x using (id) limit 200) y) n)
    select n issues, 100 * a - 2 * n score, case when 100 * a - 2 * n >= 80 then 'A' when 100 * a - 2 * n >= 60 then 'B' when 100 * a - 2 * n >= 40 then 'C' else 'D' end rating from s, i""",
    "nodes edges",
)
def quality_report(d):
    low = low_confidence(d.nodes, 0.3, 200).select("id")
    n = low.union(A.disconnected(d.nodes, d.edges, 200).select("id")).agg(F.count("*").alias("issues"))
    score = 100 * F.col("a") - 2 * F.col("issues")
    rating = F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")
    return n.join(d.nodes.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("a")), F.lit(True)).select("issues", score.alias("score"), rating.alias("rating"))
