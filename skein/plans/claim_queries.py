"""Queries of skein.operators.claims."""

from decimal import Decimal

from pyspark.sql import functions as F

from skein.operators import claims as K
from skein.operators.stats import disconnected
from skein.plans.registry import query

_CUT = ["EXPOSED_BY", "READS"]
_STATUS = "case when source_type in ('CODE', 'DB', 'RUNTIME', 'TEST') and coalesce(confidence, 0.5) >= 0.85 then 'CONFIRMED' else 'PENDING_CONFIRM' end"
_S = f"s as (select *, {_STATUS} status from claims)"


def _claims(d):
    return d.claims.withColumn("status", K.claim_status(F.col("source_type"), F.col("confidence")))


@query(
    "K1_merged_claims",
    f"""with r as (select *, case when seq % 3 = 0 then 0 else 1 end draft from claims), e as (select subject_key, predicate, object_type, object_key, evidence_id, min(draft * 1000000000000 + seq) o from r group by all), l as (select subject_key, predicate, object_type, object_key, string_agg(evidence_id, ',' order by o) evidence from e group by all),
    m as (select subject_key, predicate, object_type, object_key, max(confidence) confidence, first(source_type order by source_type like '%AI', confidence desc, draft, seq, source_type) source_type from r group by all)
    select subject_key, predicate, object_key, evidence, confidence, source_type, {_STATUS} status from m join l using (subject_key, predicate, object_type, object_key)""",
    "claims",
)
def _(d):
    out = K.merge_claims(d.claims.where("seq % 3 = 0"), d.claims.where("seq % 3 <> 0"))
    return out.select("subject_key", "predicate", "object_key", F.array_join("evidence", ",").alias("evidence"), "confidence", "source_type", "status")


@query("K2_claim_status", f"select seq, {_STATUS} status from claims", "claims")
def _(d):
    return d.claims.select("seq", K.claim_status(F.col("source_type"), F.col("confidence")).alias("status"))


_FACTS = "select concat('k', cast(k as string)) fact_key, case k % 5 when 0 then 'FEATURE' when 1 then 'BUSINESS_OBJECT' when 2 then 'BUSINESS_RULE' when 3 then 'STATUS_TRANSITION' else 'METHOD' end fact_type, source_type, confidence from nodes where node_type = 'Method'"


def _facts(d):
    kind = F.element_at(F.lit(["FEATURE", "BUSINESS_OBJECT", "BUSINESS_RULE", "STATUS_TRANSITION", "METHOD"]), (F.col("k") % 5 + 1).cast("int"))
    return d.nodes.where("node_type = 'Method'").select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("fact_key"), kind.alias("fact_type"), "source_type", "confidence")


@query("K3_claims_from_facts", f"select case fact_type when 'FEATURE' then 'Feature' when 'BUSINESS_OBJECT' then 'BusinessObject' when 'BUSINESS_RULE' then 'BusinessRule' else 'StatusTransition' end subject_type, fact_key subject_key, case when fact_type = 'FEATURE' then 'DESCRIBED_BY' else 'MENTIONED_IN' end predicate, confidence from ({_FACTS}) f where fact_type <> 'METHOD'", "nodes")
def _(d):
    return K.claims_from_facts(_facts(d)).select("subject_type", "subject_key", "predicate", "confidence")


@query("K4_claim_listing", "select seq, confidence from claims where predicate = 'READS' and confidence >= 0.5 order by confidence desc nulls last, seq limit 100", "claims")
def _(d):
    return K.list_claims(d.claims, predicate="READS", min_confidence=0.5).select("seq", "confidence")


@query("K5_claims_by_subjects", "select seq from claims where subject_key in (select concat('f:', cast(n_nationkey as varchar)) from nation) and confidence >= 0.7", "claims")
def _(d):
    subjects = d.nation.select(F.concat(F.lit("f:"), F.col("n_nationkey").cast("string")).alias("subject_key"))
    return d.claims.where("confidence >= 0.7").join(subjects, "subject_key", "left_semi").select("seq")


@query("K6_compiled_nodes", f"with {_S}, u as (select * from s where status = 'CONFIRMED') select node_type, node_key, max(confidence) confidence from (select subject_type node_type, subject_key node_key, confidence from u union all select object_type, object_key, confidence from u) x group by 1, 2", "claims")
def _(d):
    return K.compiled(_claims(d))[0]


@query("K6_compiled_edges", f"with {_S} select subject_key src_key, object_key dst_key, predicate edge_type, max(confidence) confidence from s where status = 'CONFIRMED' group by 1, 2, 3", "claims")
def _(d):
    return K.compiled(_claims(d))[1]


_TWISTED = "case when seq % 11 = 0 then 'BusinessObject' else subject_type end"


@query("K7_type_mismatches", f"select \"key\", string_agg(type, ',' order by type) types from (select distinct subject_key \"key\", {_TWISTED} type from claims union select object_key, object_type from claims) x group by 1 having count(*) > 1", "claims")
def _(d):
    return K.type_mismatches(d.claims.withColumn("subject_type", F.expr(_TWISTED)))


@query("K8_claim_conflicts", f"with {_S} select seq, subject_key, predicate, f first_object, object_key from (select *, first_value(object_key) over (partition by subject_key, predicate order by seq, object_key) f from s) x where object_key <> f", "claims")
def _(d):
    return K.conflicts(_claims(d))


_SUBJ = "case when seq % 3 = 0 then 'BusinessObject' when seq % 3 = 1 then 'BusinessRule' else 'Feature' end"
_G = f"""g as (select {_SUBJ} subject_type, concat(subject_key, '/', cast(seq % 40 as varchar)) subject_key, predicate, source_type, object_type from claims), p as (select subject_type, subject_key, bool_or(predicate in ('EXPOSED_BY', 'IMPLEMENTS', 'HANDLED_BY')) entry, bool_or(predicate = 'EXPOSED_BY') exposed, bool_or(predicate in ('READS', 'WRITES', 'MATERIALIZED_AS')) effect,
    bool_or(predicate = 'ENFORCED_BY') enforced, bool_or(contains(source_type, 'DOC')) doc, bool_or(contains(source_type, 'CODE')) code, bool_or(predicate = 'MATERIALIZED_AS' and object_type = 'Table') tab from g group by 1, 2),
    found as (select 'doc_only_feature' gap_type, subject_key, 'HIGH' severity from p where subject_type = 'Feature' and doc and not entry union all select 'code_only_feature', subject_key, 'MEDIUM' from p where subject_type = 'Feature' and code and not doc union all select 'feature_without_entry', subject_key, 'HIGH' from p where subject_type = 'Feature' and not exposed
    union all select 'feature_without_data_effect', subject_key, 'MEDIUM' from p where subject_type = 'Feature' and not effect union all select 'business_object_without_table', subject_key, 'MEDIUM' from p where subject_type = 'BusinessObject' and not tab union all select 'rule_without_enforcement', subject_key, 'MEDIUM' from p where subject_type = 'BusinessRule' and not enforced)"""


def _gaps(d):
    key = F.concat("subject_key", F.lit("/"), (F.col("seq") % 40).cast("string"))
    return K.gaps(d.claims.withColumn("subject_type", F.expr(_SUBJ)).withColumn("subject_key", key))


@query("K9_gaps", f"with {_G} select * from found", "claims")
def _(d):
    return _gaps(d)


_RUNS = "select event_id run_id, case event_type when 'error' then 'FAILED' when 'view' then 'TIMEOUT' else 'OK' end status, event_id % 10 = 0 stale from {events}"


@query("K9_tool_gaps", f"select 'tool_evidence_insufficient' gap_type, cast(run_id as varchar) subject_key, 'MEDIUM' severity from ({_RUNS.format(events='events')}) r where status in ('FAILED', 'TIMEOUT') or stale")
def _(d):
    return K.tool_gaps(d.spark.sql(_RUNS, events=d.events))


@query(
    "K10_upserted_gaps",
    f"""with {_G}, old as (select gap_type, subject_key, 'LOW' severity, case when length(subject_key) % 2 = 0 then 'RESOLVED' else 'OPEN' end status from found where length(subject_key) <> 4 union all select 'feature_without_entry', 'gone', 'HIGH', 'OPEN')
    select coalesce(f.gap_type, o.gap_type) gap_type, coalesce(f.subject_key, o.subject_key) subject_key, coalesce(f.severity, o.severity) severity, case when o.status is null or o.status = 'RESOLVED' then 'OPEN' else o.status end status,
    case when o.status is null then 'created' when f.severity is null then 'kept' when o.status = 'RESOLVED' then 'reopened' else 'refreshed' end "action" from found f full join old o on o.gap_type = f.gap_type and o.subject_key = f.subject_key""",
    "claims",
)
def _(d):
    found = _gaps(d)
    old = found.where("length(subject_key) <> 4").select("gap_type", "subject_key", F.lit("LOW").alias("severity"), F.when(F.length("subject_key") % 2 == 0, "RESOLVED").otherwise("OPEN").alias("status"))
    gone = d.spark.createDataFrame([("feature_without_entry", "gone", "HIGH", "OPEN")], old.schema)
    return K.upsert_gaps(old.union(gone), found)


@query("K11_gap_listing", f"with {_G} select * from found order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, gap_type, subject_key limit 50", "claims")
def _(d):
    return K.by_severity(_gaps(d), 50)


@query("A21_gaps_by_type", f"with {_G} select gap_type, severity, count(*) n from found group by 1, 2", "claims")
def _(d):
    return _gaps(d).groupBy("gap_type", "severity").agg(F.count("*").alias("n"))


_VERDICT = "case k % 3 when 0 then 'confirmed' when 1 then 'missing' else 'suspicious' end"


@query(
    "K12_fused_results",
    f"""with a as (select id, confidence, status from edges where k % 2 = 0), r as (select id, {_VERDICT} verdict from edges where k % 5 < 3) select id, case when verdict = 'confirmed' then 1.0 when verdict = 'missing' and status is null then 0.85 else confidence end confidence,
    case when verdict = 'confirmed' then 'CONFIRMED' when verdict = 'missing' and status is null then 'PENDING_CONFIRM' when verdict = 'suspicious' then 'PENDING_CONFIRM' else status end status from a full join r using (id) where status is not null or verdict is not null""",
    "edges",
)
def _(d):
    return K.fused_results(d.edges.where("k % 2 = 0"), d.edges.where("k % 5 < 3").select("id", F.expr(_VERDICT).alias("verdict")))


@query(
    "K13_verified_evidence",
    """with e as (select o_orderkey answer_id, concat('svc:', cast(l_suppkey + l_linenumber % 2 * 1000000 as varchar)) id, case when l_partkey % 3 = 0 then '' when l_partkey % 3 = 1 then 'alice' else 'bob,carol' end acl, l_quantity / 50 source_weight from orders join lineitem on o_orderkey = l_orderkey),
    p as (select answer_id, n.id is not null and (acl = '' or contains(acl, 'bob')) ok, source_weight from e left join nodes n on n.id = e.id and n.project_id = 'p1')
    select answer_id, count(*) filter (where ok) passed, count(*) n, 0.6 * count(*) filter (where ok) / count(*) + 0.4 * coalesce(avg(source_weight) filter (where ok), 0) reliability, count(*) filter (where ok) / count(*) >= 0.6 and count(*) filter (where ok) >= 1 verified from p group by answer_id""",
    "nodes",
)
def _(d):
    e = d.lineitem.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("svc:"), (F.col("l_suppkey") + F.col("l_linenumber") % 2 * 1000000).cast("string")).alias("id"), F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 3 == 1, "alice").otherwise("bob,carol").alias("acl"), (F.col("l_quantity") / 50).alias("source_weight"))
    e = e.join(d.orders.select(F.col("o_orderkey").alias("answer_id")), "answer_id", "left_semi")
    return K.verified_evidence(e, d.nodes, "p1", ["Bob"])


@query("K14_first_rules", "select id, case when edge_type = 'CALLS' and source_type = 'CODE_AST' and confidence >= 0.5 then 'AUTO_CONFIRM' when source_type = 'DOC_AI' and confidence >= 0 then 'REJECT' when edge_type = 'READS' and confidence >= 0.9 then 'AUTO_CONFIRM' else 'REQUIRE_MANUAL_REVIEW' end decision from edges", "edges")
def _(d):
    return K.first_rule(d.edges, [("CALLS", "CODE_AST", 0.5, "AUTO_CONFIRM"), ("*", "DOC_AI", 0.0, "REJECT"), ("READS", "*", 0.9, "AUTO_CONFIRM")]).select("id", "decision")


@query(
    "K15_test_feedback",
    """with recursive r as (select concat('mth:', cast(user_id as varchar)) id, event_type = 'purchase' or event_type = 'view' passed, case event_type when 'error' then 'API' when 'click' then 'DB' else 'PERMISSION' end kind, row_number() over (partition by user_id order by ts, event_id) i from events),
    x as (select n.id, coalesce(confidence, 0.5) c, status, false seen, cast(0 as bigint) i from nodes n where n.id in (select id from r) union all select x.id, round(least(greatest(c + case when passed then 0.05 when kind = 'API' then -0.1 when kind = 'DB' then -0.15 else -0.2 end, 0), 1), 4), status, seen or passed, r.i from x join r on r.id = x.id and r.i = x.i + 1)
    select id, c confidence, case when seen and c >= 0.8 then 'CONFIRMED' else status end status from x where i = (select max(i) from r where r.id = x.id)""",
    "nodes",
)
def _(d):
    results = d.events.select(F.concat(F.lit("mth:"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("event_type") == "error", "API").when(F.col("event_type") == "click", "DB").otherwise("PERMISSION").alias("kind"), F.col("event_type").isin("purchase", "view").alias("passed"), F.col("ts").alias("executed_at"), F.col("event_id").alias("result_id"))
    return K.fed_back(d.nodes, results)


@query("K16_verified_scores", "with f as (select concat('mth:', cast(user_id as varchar)) id, count(*) filter (where event_type <> 'error') p, count(*) filter (where event_type = 'error') e from events group by 1) select n.id, least(greatest(verified_score + 0.05 * p - 0.2 * e, 0), 1) verified_score, least(greatest(verified_score + 0.05 * p - 0.2 * e, 0), 1) >= 0.85 verified from nodes n join f on f.id = n.id", "nodes")
def _(d):
    f = d.events.groupBy(F.concat(F.lit("mth:"), F.col("user_id").cast("string")).alias("id")).agg(F.count_if(F.col("event_type") != "error").alias("p"), F.count_if(F.col("event_type") == "error").alias("e"))
    # counts times exact decimals, as in SQL: 3 x 0.05 in doubles is above 0.15
    times = lambda step, n: (F.lit(Decimal(step)) * F.col(n)).cast("double")
    score = F.least(F.greatest(F.col("verified_score") + times("0.05", "p") - times("0.2", "e"), F.lit(0.0)), F.lit(1.0))
    return d.nodes.join(f, "id").select("id", score.alias("verified_score"), (score >= 0.85).alias("verified"))


@query("K17_evidence_scores", "with f as (select concat('mth:', cast(user_id as varchar)) id, sum(case when event_type = 'error' then -1 else 1 end) d from events group by 1) select n.id, cast(greatest(-10, k % 5 - 8 + d) as bigint) evidence_score from nodes n join f on f.id = n.id", "nodes")
def _(d):
    f = d.events.select(F.concat(F.lit("mth:"), F.col("user_id").cast("string")).alias("id"), (F.col("event_type") != "error").alias("helpful"))
    return K.evidence_scores(d.nodes.withColumn("evidence_score", F.col("k") % 5 - 8), f)


@query("K18_batch_confirmed", "select id, case when id in ('svc:1', 'svc:2') then 'CONFIRMED' when id = 'svc:3' then 'REJECTED' else status end status from nodes where node_type = 'Service'", "nodes")
def _(d):
    decided = d.spark.createDataFrame([("svc:1", "CONFIRMED"), ("svc:2", "CONFIRMED"), ("svc:3", "REJECTED")], "id string, decision string")
    return d.nodes.where("node_type = 'Service'").join(F.broadcast(decided), "id", "left").select("id", F.coalesce("decision", "status").alias("status"))


@query("K19_written_status", "select id, case when source_type in ('DOC_AI', 'AI_INFERENCE') then 'PENDING_CONFIRM' when k % 7 = 0 then 'APPROVED' when coalesce(confidence, 1) < 0.5 then 'PENDING_CONFIRM' else 'CONFIRMED' end status from nodes", "nodes")
def _(d):
    return d.nodes.select("id", K.written_status(F.col("source_type"), F.col("confidence"), F.when(F.col("k") % 7 == 0, "APPROVED").otherwise(" ")).alias("status"))


@query("K20_evidence_conflicts", f"with {_S} select subject_key, predicate, count(distinct object_key) objects, bool_or(status = 'CONFIRMED') resolved from s group by 1, 2 having count(distinct object_key) > 1", "claims")
def _(d):
    return _claims(d).groupBy("subject_key", "predicate").agg(F.count_distinct("object_key").alias("objects"), F.bool_or(F.col("status") == "CONFIRMED").alias("resolved")).where("objects > 1")


@query("K23_anomalies", "select 'API_NO_HANDLER' anomaly, id from nodes where node_type = 'ApiEndpoint' and id not in (select src from edges where edge_type = 'HANDLED_BY') union all select 'TABLE_NO_COLUMN', id from nodes where node_type = 'Table' and id not in (select src from edges where edge_type = 'HAS_COLUMN') union all select 'PACKAGE_ALONE', id from nodes where node_type = 'Package' and id not in (select src from edges where edge_type = 'DEPENDS_ON')", "nodes edges")
def _(d):
    return K.anomalies(d.nodes, d.edges, {"API_NO_HANDLER": ("ApiEndpoint", "HANDLED_BY"), "TABLE_NO_COLUMN": ("Table", "HAS_COLUMN"), "PACKAGE_ALONE": ("Package", "DEPENDS_ON")})


@query("K24_dead_code", "select id from nodes anti join (select src id from edges union select dst from edges) x using (id) where node_type in ('Method', 'Service', 'Controller', 'Mapper')", "nodes edges")
def _(d):
    return disconnected(d.nodes.where(F.col("node_type").isin("Method", "Service", "Controller", "Mapper")), d.edges).select("id")


@query(
    "K25_quality_gate",
    """with c as (select (select count(*) from nodes) n, (select count(*) from edges) e, (select count(*) from nodes anti join (select src id from edges union select dst from edges) x using (id)) i, (select avg(case when evidence_ids <> '' then 1.0 else 0.0 end) from nodes) v,
    (select count(*) from nodes anti join (select src id, edge_type from edges where edge_type = 'HANDLED_BY' union select dst, edge_type from edges where edge_type = 'HANDLED_BY') x using (id) where node_type = 'ApiEndpoint') b)
    select case when e >= n and i <= 0.1 * n and b = 0 and v >= 0.95 then 'PASSED' else 'FAILED' end decision, concat_ws(',', case when e < n then 'edge_node_ratio' end, case when i > 0.1 * n then 'isolated' end, case when b > 0 then 'constraints' end, case when v < 0.95 then 'evidence' end) violated from c""",
    "nodes edges",
)
def _(d):
    return K.quality_gate(d.nodes, d.edges, disconnected(d.nodes, d.edges))


@query("K26_release_states", "with s as (select o_custkey release_id, o_orderkey seq, case o_orderstatus when 'O' then 'validate' when 'F' then 'publish' else 'fail' end event from orders), v as (select release_id, min(seq) since from s where event = 'validate' group by 1), e as (select s.release_id, arg_min(event, seq) said from s join v on v.release_id = s.release_id and seq > since where event <> 'validate' group by 1) select c_custkey release_id, case when v.since is null then 'DRAFT' when said = 'publish' then 'PUBLISHED' when said = 'fail' then 'FAILED' else 'VALIDATING' end state from customer left join v on v.release_id = c_custkey left join e on e.release_id = c_custkey")
def _(d):
    events = d.orders.select(F.col("o_custkey").alias("release_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "validate").when(F.col("o_orderstatus") == "F", "publish").otherwise("fail").alias("event"))
    return K.released_state(d.customer.select(F.col("c_custkey").alias("release_id")), events)


@query("K27_endpoint_drift", "with a as (select k, k % 3 p from nodes where node_type = 'ApiEndpoint' and k % 4 <> 0), b as (select k, k % 3 + case when k % 10 = 0 then 1 else 0 end p from nodes where node_type = 'ApiEndpoint' and k % 7 <> 0) select concat('GET /c/', cast(coalesce(a.k, b.k) as varchar)) endpoint, case when b.k is null then 'missing' when a.k is null then 'undocumented' when a.p = b.p then 'confirmed' else 'suspicious' end verdict from a full join b on a.k = b.k", "nodes")
def _(d):
    api = d.nodes.where("node_type = 'ApiEndpoint'").select(F.concat(F.lit("GET /c/"), F.col("k").cast("string")).alias("endpoint"), "k")
    return K.endpoint_drift(api.where("k % 4 <> 0").withColumn("params", F.col("k") % 3), api.where("k % 7 <> 0").withColumn("params", F.col("k") % 3 + F.when(F.col("k") % 10 == 0, 1).otherwise(0)))


@query("K28_external_targets", "select e.id, case when n.id is null then 'missing' else 'confirmed' end verdict from (select concat('call', cast(l_orderkey as varchar), '.', cast(l_linenumber as varchar)) id, concat('svc:', cast(l_suppkey + case when l_returnflag = 'R' then 500000 else 0 end as varchar)) target from lineitem) e left join nodes n on n.id = target and n.node_type = 'Service'", "nodes")
def _(d):
    calls = d.lineitem.select(F.concat(F.lit("call"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("call"), F.concat(F.lit("svc:"), (F.col("l_suppkey") + F.when(F.col("l_returnflag") == "R", 500000).otherwise(0)).cast("string")).alias("id"))
    known = d.nodes.where("node_type = 'Service'").select("id", F.lit("confirmed").alias("verdict"))
    return calls.join(known, "id", "left").select(F.col("call").alias("id"), F.coalesce("verdict", F.lit("missing")).alias("verdict"))


@query("K30_tool_claims", "select event_id, case event_type when 'error' then 'RUNTIME' when 'view' then 'TOOL' else 'CODE' end source_type, case event_type when 'error' then 'REJECTED' else 'PENDING_CONFIRM' end status, concat('u:', cast(user_id as varchar)) subject_key, case when value > 50 then 'CALLS' else 'READS' end predicate from events")
def _(d):
    kind = F.col("event_type")
    return d.events.select("event_id", F.when(kind == "error", "RUNTIME").when(kind == "view", "TOOL").otherwise("CODE").alias("source_type"), F.when(kind == "error", "REJECTED").otherwise("PENDING_CONFIRM").alias("status"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("subject_key"), F.when(F.col("value") > 50, "CALLS").otherwise("READS").alias("predicate"))
