"""Queries of skein.operators.traces."""

from pyspark.sql import functions as F

from skein.operators import conformance as C
from skein.operators import traces as T
from skein.plans.registry import query


@query("T2_runtime_verified", "select n.id, count(*) trace_count, max(ts) last_seen from nodes n join events e on n.k = e.user_id where n.node_type = 'Method' group by n.id", "nodes")
def _(d):
    return T.verified_nodes(d.nodes.where("node_type = 'Method'"), d.events.select(F.col("user_id").cast("long").alias("operation"), "ts"), "k")


@query("T4_service_stats", "select service_name, count(*) spans, count(distinct trace_id) traces, count(*) filter (where status = 'ERROR') errors, round(avg(duration_ms), 6) avg_duration from spans group by service_name", "spans")
def _(d):
    return T.service_stats(d.spans)


@query("T4_call_edges", "select p.service_name caller, c.service_name callee, count(*) calls, count(*) filter (where c.status = 'ERROR') errors from spans c join spans p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id where p.service_name <> c.service_name group by 1, 2", "spans")
def _(d):
    return T.call_edges(d.spans)


@query("T1_ingested_spans", "select event_id span_id, case event_type when 'error' then 'ERROR' else 'OK' end status, cast(ts as date) \"day\" from events")
def _(d):
    raw = d.events.select(F.col("event_id").alias("span_id"), "user_id", F.when(F.col("event_type") == "error", "ERROR").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"))
    return T.ingested(raw).select("span_id", "status", F.to_date("started_at").alias("day"))


@query(
    "T3_trace_alignment",
    "with t as (select concat('GET /c/', cast(user_id * 7 as varchar)) name, count(*) n from events group by 1), a as (select id, node_name from nodes where node_type = 'ApiEndpoint') select name, id, n from t left join a on a.node_name = t.name",
    "nodes",
)
def _(d):
    spans = d.events.select(F.concat(F.lit("get  /c/"), (F.col("user_id") * 7).cast("string"), F.lit("?x=1")).alias("operation"))
    return T.aligned(spans, d.nodes.where("node_type = 'ApiEndpoint'").select("id", F.col("node_name").alias("name")))


@query("T3_static_only_edges", "select id from edges e where edge_type = 'HANDLED_BY' and src not in (select concat('api:', cast(user_id as varchar)) from events) order by id limit 100", "edges")
def _(d):
    seen = d.events.select(F.concat(F.lit("api:"), F.col("user_id").cast("string")).alias("src")).distinct()
    return d.edges.where("edge_type = 'HANDLED_BY'").join(seen, "src", "left_anti").orderBy("id").limit(100).select("id")


@query("T14_test_cases", "select concat(n.id, ':', s) case_id, node_type from nodes n join (values ('ApiEndpoint', 'success'), ('ApiEndpoint', 'bad_request'), ('ApiEndpoint', 'forbidden'), ('Table', 'insert'), ('Table', 'constraint')) v(t, s) on t = node_type", "nodes")
def _(d):
    return T.test_cases(d.nodes)


@query("T5_recent_traces", "select trace_id, max(ts) last_seen from spans group by trace_id order by last_seen desc, trace_id limit 20", "spans")
def _(d):
    return d.spans.groupBy("trace_id").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "trace_id").limit(20)


@query("T6_task_counts", "select activity, count(*) executions from process_log where started_at >= (select max(started_at) from process_log) - interval 10 day group by activity", "process_log")
def _(d):
    return T.task_counts(d.process_log, 10)


@query("T7_average_durations", "select service_name, round(avg(duration_ms), 6) avg_duration from spans where status = 'OK' group by service_name", "spans")
def _(d):
    return d.spans.where("status = 'OK'").groupBy("service_name").agg(F.round(F.avg("duration_ms"), 6).alias("avg_duration"))


@query("T8_rework_rates", "select activity, round(least(1.0, count(*) filter (where n > 1) / sum(n)), 6) rate from (select activity, case_id, count(*) n from process_log group by all) x group by activity", "process_log")
def _(d):
    return T.rework_rates(d.process_log)


_FOLLOWS = "f as (select lag(activity) over (partition by case_id order by started_at, event_id) \"before\", activity \"after\" from process_log)"


@query("T9_transitions", f"with {_FOLLOWS} select \"before\", \"after\", count(*) n from f where \"before\" is not null group by 1, 2", "process_log")
def _(d):
    return T.transitions(d.process_log)


@query("T10_runtime_only_flows", f"with {_FOLLOWS} select distinct \"before\", \"after\", 0.85e0 confidence from f where \"before\" is not null and not (\"before\" = 'view' and \"after\" = 'click') and not (\"before\" = 'click' and \"after\" = 'purchase')", "process_log")
def _(d):
    defined = d.spark.createDataFrame([("view", "click"), ("click", "purchase")], "before string, after string")
    return T.runtime_only(T.transitions(d.process_log), defined).select("before", "after", "confidence")


@query("T12_event_log", "select cast(case_id as string) \"case\", activity, started_at from process_log", "process_log")
def _(d):
    return d.process_log.select(F.col("case_id").cast("string").alias("case"), "activity", "started_at").orderBy(F.asc_nulls_last("started_at"), "case", "activity")


@query("T13_activity_coverage", "with m as (select * from (values ('view'), ('click'), ('refund')) v(a)), s as (select distinct activity a from process_log) select round((select count(*) from m semi join s using (a)) / (select cast(count(*) as double) from m), 6) fitness, (select count(*) from s anti join m using (a)) deviations", "process_log")
def _(d):
    return T.coverage(d.process_log, d.spark.createDataFrame([("view",), ("click",), ("refund",)], "activity string"))


#: The model 'chain' is sequential, so every place has one activity that fills it and one that takes from it: a running sum for each place.
_CHAIN = """l as (select cast(case_id as varchar) case_id, activity, row_number() over (partition by case_id order by started_at, event_id) pos from process_log where case_id is not null),
    fe as (select substr(src, 5) a, substr(dst, 5) b from flows where process_key = 'chain'), m0 as (select a activity, 1 i from fe where a not in (select b from fe)),
    m1 as (select * from m0 union all select b, 2 from fe join m0 on a = m0.activity), m2 as (select * from m1 union all select b, 3 from fe join m1 on a = m1.activity and m1.i = 2),
    m as (select * from m2 union all select b, 4 from fe join m2 on a = m2.activity and m2.i = 3), last as (select max(i) k from m),
    d as (select case_id, i place, pos, -1 d from l join m using (activity) union all select case_id, i - 1, pos, 1 from l join m using (activity)
        union all select distinct case_id, 0, 0, -1 from l union all select distinct case_id, k, 1000000000, 1 from l cross join last),
    s as (select *, sum(d) over (partition by case_id, place order by pos rows between unbounded preceding and current row) open from d),
    p as (select case_id, place, count(*) filter (where d = -1) produced, count(*) filter (where d = 1) consumed, greatest(0, max(open)) missing from s group by 1, 2),
    c as (select case_id, cast(sum(produced) as bigint) produced, cast(sum(consumed) as bigint) consumed, cast(sum(missing) as bigint) missing, cast(sum(produced - consumed + missing) as bigint) remaining from p group by 1),
    n as (select case_id, count(*) events, count(*) filter (where activity not in (select activity from m)) unknown from l group by 1)"""


def _net(d, process):
    return C.net_of(C.model(d.flows.where(F.col("process_key") == process)))


@query("T13_token_replay", f"with {_CHAIN} select case_id, events, unknown, produced, consumed, missing, remaining, round((1 - missing / consumed) / 2 + (1 - remaining / produced) / 2, 6) fitness from c join n using (case_id)", "process_log flows")
def _(d):
    return C.replayed(d.process_log, _net(d, "chain"))


@query("T13_conformance", f"""with {_CHAIN},
    o as (select case_id, pos, l.activity, m.i, bool_and(coalesce(m.i = pos, false)) over (partition by case_id order by pos rows between unbounded preceding and 1 preceding) before from l left join m using (activity)),
    st as (select pos, count(*) w, max(case when i = pos then 1 else 0 end) used from o where coalesce(before, true) and pos <= (select k from last) group by pos),
    g as (select 1 - avg(1 / sqrt(coalesce(n, 1))) g from m left join (select activity, count(*) n from l group by 1) x using (activity))
    select count(*) cases, count(*) filter (where missing = 0 and remaining = 0 and unknown = 0) fitting, round((1 - sum(missing) / sum(consumed)) / 2 + (1 - sum(remaining) / sum(produced)) / 2, 6) fitness,
    (select round(coalesce(sum(w * used) / sum(w), 1.0), 6) from st) "precision", (select round(g, 6) from g) generalization, (select count(distinct activity) from l where activity not in (select activity from m)) deviations from c join n using (case_id)""", "process_log flows")
def _(d):
    return C.conformance(d.process_log, _net(d, "chain"))


@query("T13_branching_conformance")
def _(d):
    return C.conformance(d.process_log, _net(d, "pairs"))


@query("T13_deviations", "with m as (select substr(src, 5) a from flows where process_key = 'chain' union select substr(dst, 5) from flows where process_key = 'chain') select activity, count(*) events from process_log where case_id is not null and activity not in (select a from m) group by 1", "process_log flows")
def _(d):
    return C.deviations(d.process_log, _net(d, "chain"))
