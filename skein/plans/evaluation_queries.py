"""Queries of skein.operators.evaluation: answers, graphs and reports."""

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import evaluation as Q
from skein.operators import stats as A
from skein.operators.scans import disconnected, low_confidence
from skein.plans.registry import query

_QA = "x as (select conv_id, turn, question, answer, [question, coalesce(answer, '')] ctx, list_filter(regexp_split_to_array(coalesce(answer, ''), '[^A-Za-z]+'), lambda w: length(w) > 6) ents from qa where question is not null and answer is not null)"


def _qa(d):
    words = F.filter(F.split("answer", "[^A-Za-z]+"), lambda w: F.length(w) > 6)
    return d.qa.where("question is not null and answer is not null").select("conv_id", "turn", "question", "answer", F.array("question").alias("contexts"), words.alias("entities"))


_HELD = "len(list_filter(ents, lambda e: contains(lower(question), lower(e))))"


@query("Q1_context_precision", f"with {_QA} select conv_id, turn, case when len(ents) = 0 then 1.0 else cast({_HELD} as double) / len(ents) end \"precision\" from x", "qa")
def _(d):
    return _qa(d).select("conv_id", "turn", Q.context_precision(F.col("contexts"), F.concat("entities", F.array(F.lit(" ")))).alias("precision"))


@query("Q2_context_recall", f"with {_QA} select conv_id, turn, cast({_HELD} as double) / (len(ents) + 1) recall from x", "qa")
def _(d):
    return _qa(d).select("conv_id", "turn", Q.context_recall(F.col("contexts"), F.concat("entities", F.array(F.lit(" ")))).alias("recall"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOKENS = f"list_filter(list_distinct(regexp_split_to_array(lower(s), '[^a-z0-9]+')), lambda w: length(w) >= 2 and not list_contains({_STOP}, w))"


@query(
    "Q3_faithfulness",
    f"""with {_QA}, s as (select conv_id, turn, lower(concat(question, ' ', left(answer, 300))) low, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[。？！.?!;；\\n]+'), lambda s: trim(s)), lambda s: length(s) > 2)) s from x), g as (select *, {_TOKENS} t from s), h as (select *, len(t) > 0 and len(list_filter(t, lambda w: contains(low, w))) * 2 >= len(t) ok from g)
    select x.conv_id, x.turn, coalesce(avg(case when ok then 1.0 else 0.0 end), 1.0) faithfulness from x left join h on h.conv_id = x.conv_id and h.turn = x.turn group by 1, 2""",
    "qa",
)
def _(d):
    contexts = F.array(F.concat("question", F.lit(" "), F.substring("answer", 1, 300)))
    return _qa(d).select("conv_id", "turn", Q.faithfulness(F.col("answer"), contexts).alias("faithfulness"))


_CASES = "select user_id % 7 + 1 entities, event_id % (user_id % 7 + 1) + 1 found, 4 evidence, case when event_type = 'error' then 2 else 4 end used, 5 keywords, event_id % 6 hit, event_type = 'error' must_abstain, value < 2 abstained from {events}"


@query(
    "Q5_qa_run",
    f"""with c as ({_CASES.format(events='events')}), s as (select cast(sum(found) as double) / sum(entities) entity_recall, cast(sum(used) as double) / sum(evidence) evidence_precision, cast(sum(hit) as double) / sum(keywords) keyword_coverage, avg(case when must_abstain = abstained then 1.0 else 0.0 end) abstention_accuracy from c)
    select *, entity_recall >= 0.85 and evidence_precision >= 0.9 and abstention_accuracy >= 0.95 passed from s""",
)
def _(d):
    return Q.qa_run(d.spark.sql(_CASES, events=d.events))


@query(
    "Q7_benchmark_score",
    """with e as (select 'node' kind, id "key" from nodes where k % 2 = 0 union all select 'edge', id from edges where k % 2 = 0), f as (select 'node' kind, id "key" from nodes where in_v1 union all select 'edge', id from edges where in_v1), b as (select distinct id "key" from edges where k % 31 = 0),
    r as (select (select count(*) from e semi join f using (kind, "key") where kind = 'node') / (select count(distinct "key") from e where kind = 'node') node_recall, (select count(distinct "key") from e semi join f using (kind, "key") where kind = 'edge') / (select count(distinct "key") from e where kind = 'edge') edge_recall, (select count(distinct "key") from f semi join b using ("key") where kind = 'edge') / (select count(distinct "key") from f where kind = 'edge') forbidden_rate)
    select *, node_recall >= 0.9 and edge_recall >= 0.85 and forbidden_rate <= 0.02 passed from r""",
    "nodes edges",
)
def _(d):
    keys = lambda n, e: n.select(F.lit("node").alias("kind"), F.col("id").alias("key")).union(e.select(F.lit("edge"), "id"))
    return Q.benchmark_score(keys(d.nodes.where("k % 2 = 0"), d.edges.where("k % 2 = 0")), keys(d.v1_nodes, d.v1_edges), d.edges.where("k % 31 = 0").select(F.col("id").alias("key")))


@query("Q8_quality", "with r as (select (select avg(case when in_v1 then 1.0 else 0 end) from nodes) n, (select avg(case when in_v1 then 1.0 else 0 end) from edges) e) select 50 * (n + e) quality, n >= 0.9 and e >= 0.9 passed from r", "nodes edges")
def _(d):
    share = lambda t, c: t.agg(F.avg(F.col("in_v1").cast("double")).alias(c))
    return share(d.nodes, "n").join(share(d.edges, "e"), F.lit(True)).select((50 * (F.col("n") + F.col("e"))).alias("quality"), ((F.col("n") >= 0.9) & (F.col("e") >= 0.9)).alias("passed"))


@query(
    "Q9_completeness_audit",
    """with i as (select distinct dst id from edges), o as (select distinct src id from edges), m as (select (select 100.0 * count(i.id) / count(*) from nodes n left join i on i.id = n.id where node_type <> 'BusinessDomain') inbound, (select 100.0 * count(distinct n.id) filter (where e.src is not null) / count(distinct n.id) from nodes n left join edges e on e.src = n.id and e.edge_type = 'CALLS' where node_type = 'Method') calls,
    (select 100.0 * count(*) filter (where i.id is null and o.id is null) / count(*) from nodes n left join i on i.id = n.id left join o on o.id = n.id) orphans, (select 100.0 * count(distinct n.id) filter (where e.src is not null) / count(distinct n.id) from nodes n left join edges e on e.src = n.id and e.edge_type = 'CONTAINS' where node_type = 'BusinessDomain') domains,
    (select 100.0 * count(*) filter (where coalesce(confidence, 0) < 0.5) / count(*) from nodes) low, (select 100.0 * count(distinct n.id) filter (where e.src is not null) / count(distinct n.id) from nodes n left join edges e on e.src = n.id and e.edge_type in ('READS', 'WRITES', 'JOINS') where node_type = 'SqlStatement') statements)
    select * from (select 'inbound_coverage' metric, inbound "value", 95.0 target, inbound >= 95 passed from m union all select 'call_resolution', calls, 60, calls >= 60 from m union all select 'orphans', orphans, 15, orphans <= 15 from m union all select 'domain_connectivity', domains, 50, domains >= 50 from m union all select 'low_confidence', low, 30, low <= 30 from m union all select 'statement_coverage', statements, 90, statements >= 90 from m) x""",
    "nodes edges",
)
def _(d):
    ends = lambda c, flag, where=None: (d.edges.where(where) if where else d.edges).select(F.col(c).alias("id"), F.lit(True).alias(flag)).distinct()
    n = d.nodes.select("id", "node_type", "confidence").join(ends("dst", "into"), "id", "left").join(ends("src", "out"), "id", "left").join(ends("src", "calls", "edge_type = 'CALLS'"), "id", "left")
    n = n.join(ends("src", "holds", "edge_type = 'CONTAINS'"), "id", "left").join(ends("src", "touches", "edge_type in ('READS', 'WRITES', 'JOINS')"), "id", "left")
    of = lambda kind, flag: 100 * F.count_if((F.col("node_type") == kind) & F.col(flag)) / F.count_if(F.col("node_type") == kind)
    inner = F.col("node_type") != "BusinessDomain"
    one = n.agg(
        (100 * F.count_if(inner & F.col("into")) / F.count_if(inner)).alias("a"), of("Method", "calls").alias("b"), (100 * F.count_if(F.col("into").isNull() & F.col("out").isNull()) / F.count("*")).alias("c"), of("BusinessDomain", "holds").alias("d"),
        (100 * F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.5) / F.count("*")).alias("e"), of("SqlStatement", "touches").alias("f"),
    )
    c = F.col
    return Q.stacked(one, {"inbound_coverage": (c("a"), 95, True), "call_resolution": (c("b"), 60, True), "orphans": (c("c"), 15, False), "domain_connectivity": (c("d"), 50, True), "low_confidence": (c("e"), 30, False), "statement_coverage": (c("f"), 90, True)})


_T = "case when user_id % 5 = 0 then 0.5 when event_id % 40 <= 1 then 1.0 when event_id % 40 <= 24 then 1 - (event_id % 40 - 1) * 0.5 / 23 else 0.5 end"


@query("Q10_confidence_scores", f"select event_id, least(0.3 * least(value / 50, 1) + 0.25 * 0.8 + 0.2 * 0.5 + 0.15 * (user_id % 10) / 10.0 + 0.1 * {_T}, 1) score, least(0.2 * least(value / 50, 1) + 0.25 * 0.8 + 0.2 * 0.5 + 0.35 * (user_id % 10) / 10.0, 1) risky from events")
def _(d):
    age = F.when(F.col("user_id") % 5 != 0, F.col("event_id") % 40)
    parts = [F.col("value") / 50, F.lit(0.8), F.lit(0.5), F.col("user_id") % 10 / 10, Q.timeliness(age)]
    return d.events.select("event_id", Q.confidence_score(parts).alias("score"), Q.confidence_score(parts, "high_risk").alias("risky"))


_FEED = "select event_id, case when value < 3 then 'short' else 'a long enough answer text' end answer, case event_type when 'view' then 'wrong result' when 'click' then 'no source given' when 'signup' then 'Incomplete' when 'error' then 'unrelated' else '' end complaint, case when event_id % 2 = 0 then 'e1' else '' end evidence from {events}"


@query(
    "Q12_issue_distribution",
    f"""with f as ({_FEED.format(events='events')}), k as (select case when length(answer) < 20 then 'NO_ANSWER' when complaint = 'no source given' and evidence = '' then 'MISSING_EVIDENCE' when complaint = 'unrelated' then 'IRRELEVANT_ANSWER' when complaint = 'wrong result' then 'WRONG_ANSWER' when complaint = 'Incomplete' then 'INCOMPLETE_ANSWER' else 'OTHER' end issue from f)
    select v.issue, count(k.issue) n from (values ('NO_ANSWER'), ('MISSING_EVIDENCE'), ('IRRELEVANT_ANSWER'), ('WRONG_ANSWER'), ('INCOMPLETE_ANSWER'), ('OTHER')) v(issue) left join k on k.issue = v.issue group by 1""",
)
def _(d):
    return Q.issue_distribution(d.spark.sql(_FEED, events=d.events))


@query("R1_risk_scores", "select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'A' then 0.7 else 1.0 end / log2(l_linenumber % 5 + 2) * case l_returnflag when 'R' then 1.5 when 'A' then 1.4 else 0.6 end * case when l_quantity > 25 then 1.0 else 1.5 end risk, concat('L', cast(least(l_linenumber, 4) as varchar)) \"level\" from lineitem")
def _(d):
    f = F.col("l_returnflag")
    risk = Q.risk_score(F.when(f == "A", 0.7).otherwise(1.0), F.col("l_linenumber") % 5, F.when(f == "R", "schema_change").when(f == "A", "API_CONTRACT").otherwise("READ_ONLY"), F.col("l_quantity") > 25)
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", risk.alias("risk"), Q.impact_name(F.col("l_linenumber")).alias("level"))


_CONF = "count(*) filter (where status in ('CONFIRMED', 'APPROVED'))"


@query(
    "R2_migration_readiness",
    f"""with m as (select (select 100.0 * {_CONF} / count(*) from nodes where node_type not in ('BusinessDomain', 'ApiEndpoint')) arch, (select 100.0 * {_CONF} / count(*) from nodes where node_type in ('BusinessDomain', 'ApiEndpoint')) biz, (select 100.0 * count(*) filter (where verified_score > 0) / count(*) from nodes) tested)
    select arch, biz, 0.4 * arch + 0.4 * biz + 0.2 * tested overall, (select count(*) from nodes where coalesce(confidence, 0) < 0.3) + (select count(*) from nodes anti join (select src id from edges union select dst from edges) x using (id)) risks from m""",
    "nodes edges",
)
def _(d):
    sure, biz = F.col("status").isin(*A.CONFIRMED), F.col("node_type").isin("BusinessDomain", "ApiEndpoint")
    one = d.nodes.agg((100 * F.count_if(sure & ~biz) / F.count_if(~biz)).alias("arch"), (100 * F.count_if(sure & biz) / F.count_if(biz)).alias("biz"), (100 * F.count_if(F.col("verified_score") > 0) / F.count("*")).alias("tested"))
    risks = low_confidence(d.nodes, 0.3).select("id").union(disconnected(d.nodes, d.edges).select("id")).agg(F.count("*").alias("risks"))
    return one.join(risks, F.lit(True)).select("arch", "biz", (0.4 * F.col("arch") + 0.4 * F.col("biz") + 0.2 * F.col("tested")).alias("overall"), "risks")


@query("R3_confidence_trend", "with t as (select created_at, avg(confidence) c, count(*) n from nodes group by 1) select created_at \"day\", c avg_confidence, n new_nodes, sum(n) over (order by created_at) total from t".replace("sum(n) over (order by created_at)", "cast(sum(n) over (order by created_at) as bigint)"), "nodes")
def _(d):
    from pyspark.sql import Window

    t = A.daily_trend(d.nodes).select("day", "avg_confidence", "new_nodes")  # a row a day
    return t.withColumn("total", F.sum("new_nodes").over(Window.partitionBy(F.lit(0)).orderBy("day")))


@query(
    "R4_test_coverage",
    """with c as (select distinct concat('mth:', cast(user_id as varchar)) id from events where event_type <> 'error') select (select 100.0 * count(c.id) / count(*) from nodes n left join c on c.id = n.id where node_type = 'Method') node_pct, (select 100.0 * count(distinct e.id) filter (where a.id is not null or b.id is not null) / count(distinct e.id) from edges e left join c a on a.id = e.src left join c b on b.id = e.dst where edge_type = 'HANDLED_BY') edge_pct,
    (select count(*) from nodes anti join c using (id) where node_type = 'Method' and confidence >= 0.8) uncovered""",
    "nodes edges",
)
def _(d):
    c = d.events.where("event_type <> 'error'").select(F.concat(F.lit("mth:"), F.col("user_id").cast("string")).alias("id")).distinct()
    n = d.nodes.where("node_type = 'Method'").join(c.withColumn("hit", F.lit(1)), "id", "left").agg((100 * F.count("hit") / F.count("*")).alias("node_pct"), F.count_if(F.col("hit").isNull() & (F.col("confidence") >= 0.8)).alias("uncovered"))
    touched = A.touching(d.edges.where("edge_type = 'HANDLED_BY'"), c).agg(F.count("*").alias("t")).join(d.edges.where("edge_type = 'HANDLED_BY'").agg(F.count_distinct("id").alias("e")), F.lit(True))
    return n.join(touched, F.lit(True)).select("node_pct", (100 * F.col("t") / F.col("e")).alias("edge_pct"), "uncovered")


@query(
    "R6_graph_metrics",
    f"""select (select round({_CONF} / count(*), 4) from nodes) confirmed_ratio, (select round(count(*) filter (where evidence_ids <> '') / count(*), 4) from nodes) evidence_ratio, (select round(count(*) filter (where source_type in ('AI_INFERENCE', 'DOC_AI')) / count(*), 4) from nodes) ai_ratio, (select round(count(*) filter (where verified_score > 0) / count(*), 4) from nodes) runtime_ratio, (select round({_CONF} / count(*), 4) from edges) edge_ratio""".replace("/ count(*)", "/ cast(count(*) as double)"),
    "nodes edges",
)
def _(d):
    n = d.nodes.agg(
        X.ratio(F.count_if(F.col("status").isin(*A.CONFIRMED)), F.count("*")).alias("confirmed_ratio"), X.ratio(F.count_if(F.col("evidence_ids") != ""), F.count("*")).alias("evidence_ratio"),
        X.ratio(F.count_if(F.col("source_type").isin(*A.AI_NODES)), F.count("*")).alias("ai_ratio"), X.ratio(F.count_if(F.col("verified_score") > 0), F.count("*")).alias("runtime_ratio"),
    )
    return n.join(d.edges.agg(X.ratio(F.count_if(F.col("status").isin(*A.CONFIRMED)), F.count("*")).alias("edge_ratio")), F.lit(True))


@query("R7_test_pass_ratio", "select user_id, avg(case when event_type <> 'error' then 1.0 else 0.0 end) pass_ratio from events group by 1")
def _(d):
    return d.events.groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("pass_ratio"))


@query(
    "R8_insight_actions",
    """with c as (select (select count(*) from nodes where coalesce(confidence, 0) < 0.5) low, (select count(*) from nodes anti join (select src id from edges union select dst from edges) x using (id)) alone, (select count(*) from edges where coalesce(evidence_ids, '') = '') bare)
    select 'review low-confidence nodes' "action", low n from c where low > 0 union all select 'connect isolated nodes', alone from c where alone > 0 union all select 'add evidence to edges', bare from c where bare > 0""",
    "nodes edges",
)
def _(d):
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("action"), "n")
    found = count(low_confidence(d.nodes, 0.5), "review low-confidence nodes").union(count(disconnected(d.nodes, d.edges), "connect isolated nodes")).union(count(d.edges.where("coalesce(evidence_ids, '') = ''"), "add evidence to edges"))
    return found.where("n > 0")


@query("R9_build_stats", "select (select count(*) from nodes where in_v1) n_nodes, (select count(*) from edges where in_v1) n_edges, (select count(distinct node_type) from nodes where in_v1) node_types, (select count(distinct edge_type) from edges where in_v1) edge_types, (select cast(count(*) as double) from edges where in_v1) / (select count(*) from nodes where in_v1) ratio", "nodes edges")
def _(d):
    n = d.v1_nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("node_type").alias("node_types"))
    return n.join(d.v1_edges.agg(F.count("*").alias("n_edges"), F.count_distinct("edge_type").alias("edge_types")), F.lit(True)).withColumn("ratio", F.col("n_edges") / F.col("n_nodes"))


@query(
    "R10_quality_assessment",
    """with d as (select id, count(*) degree from (select src id from edges union all select dst from edges) x group by id), m as (select (select count(*) from nodes anti join d using (id)) / (select count(*) from nodes) isolated, (select avg(degree) from d) degree, (select count(*) from edges) / (select count(*) from nodes) ratio, (select avg(case when evidence_ids <> '' then 1.0 else 0 end) from nodes) evidence)
    select isolated, degree, case when isolated <= 0.05 and degree >= 2 then 'good' when isolated <= 0.15 and degree >= 1 then 'fair' else 'poor' end grade, concat_ws(',', case when ratio < 1 then 'edges' end, case when isolated > 0.15 then 'isolated' end, case when degree < 1 then 'degree' end, case when evidence < 0.5 then 'evidence' end) suggestions from m""",
    "nodes edges",
)
def _(d):
    n = d.nodes.agg(F.count("*").alias("n"), F.avg((F.col("evidence_ids") != "").cast("double")).alias("evidence"))
    one = n.join(disconnected(d.nodes, d.edges).agg(F.count("*").alias("i")), F.lit(True)).join(A.degrees(d.edges).agg(F.avg("degree").alias("degree")), F.lit(True)).join(d.edges.agg(F.count("*").alias("e")), F.lit(True))
    one = one.withColumns({"isolated": F.col("i") / F.col("n"), "ratio": F.col("e") / F.col("n")})
    c = F.col
    said = F.array_compact(F.array(F.when(c("ratio") < 1, "edges"), F.when(c("isolated") > 0.15, "isolated"), F.when(c("degree") < 1, "degree"), F.when(c("evidence") < 0.5, "evidence")))
    return one.select("isolated", "degree", Q.graded(c("isolated"), c("degree")).alias("grade"), F.array_join(said, ",").alias("suggestions"))


@query("R11_scan_performance", "select event_type phase, count(*) tasks, cast(sum(floor(value)) as bigint) \"seconds\", count(*) filter (where value > 90) warnings, count(*) filter (where event_type = 'error') failed from events group by 1")
def _(d):
    return d.events.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("tasks"), F.sum(F.floor("value")).alias("seconds"), F.count_if(F.col("value") > 90).alias("warnings"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("R12_overview_table", "with t as (select node_type, count(*) n from nodes group by 1) select concat('| node_type | n |\n|---|---|\n', string_agg(concat('| ', node_type, ' | ', cast(n as varchar), ' |'), '\n' order by n desc, node_type)) \"text\" from t", "nodes")
def _(d):
    return Q.markdown_table(A.distribution(d.nodes, "node_type"), ["node_type", "n"], F.desc("n"), "node_type")


@query("R13_dependency_diagram", "select concat('graph TD\n', string_agg(concat(src, ' --> ', dst), '\n' order by src, dst)) diagram from (select distinct src, dst from edges where edge_type = 'DEPENDS_ON' order by src, dst limit 200) x", "edges")
def _(d):
    some = d.edges.where("edge_type = 'DEPENDS_ON'").select("src", "dst").distinct().orderBy("src", "dst").limit(200)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda x: F.concat(x["src"], F.lit(" --> "), x["dst"]))
    return some.agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("diagram"))


@query("R14_closure_report", "select c_mktsegment requirement, count(*) total, count(*) filter (where o_orderstatus = 'F') accepted, count(*) filter (where o_orderstatus = 'O') open_, count(*) filter (where o_orderstatus = 'F') = count(*) closed from orders join customer on c_custkey = o_custkey group by 1")
def _(d):
    s = F.col("o_orderstatus")
    joined = d.orders.join(d.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return joined.groupBy(F.col("c_mktsegment").alias("requirement")).agg(F.count("*").alias("total"), F.count_if(s == "F").alias("accepted"), F.count_if(s == "O").alias("open_"), (F.count_if(s == "F") == F.count("*")).alias("closed"))


@query("R15_project_overview", "select n.project_id, count(*) n_nodes, (select count(*) from edges e where e.project_id = n.project_id) n_edges, max(n.created_at) last_created from nodes n group by 1", "nodes edges")
def _(d):
    n = d.nodes.groupBy("project_id").agg(F.count("*").alias("n_nodes"), F.max("created_at").alias("last_created"))
    return n.join(d.edges.groupBy("project_id").agg(F.count("*").alias("n_edges")), "project_id", "left")


@query("R16_assertions", "select 'nation has rows' name, true passed union all select 'no negative sizes', true union all select 'orders within 5 %', (select abs(count(*) - 1500) <= 75 from orders) union all select 'first region', (select min(r_name) = 'AFRICA' from region)")
def _(d):
    count = lambda df: df.agg(F.count("*").alias("n"))
    rows = [
        count(d.nation).select(F.lit("nation has rows").alias("name"), (F.col("n") > 0).alias("passed")), count(d.part.where("p_size < 0").limit(1)).select(F.lit("no negative sizes"), F.col("n") == 0),
        count(d.orders).select(F.lit("orders within 5 %"), F.abs(F.col("n") - 1500) <= 75), d.region.agg(F.min("r_name").alias("v")).select(F.lit("first region"), F.col("v") == "AFRICA"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
