"""Queries of resolution of calls, layers, requirements and impact: more of skein.operators.patterns and traverse."""

from pyspark.sql import functions as F

from skein.functions.text import entity_name, split_words
from skein.operators import evaluation as Q
from skein.operators import patterns as J
from skein.operators import resolution as E
from skein.operators import traverse as P
from skein.operators.retrieval import cosine, nearest
from skein.plans.pattern_queries import _of
from skein.operators.similarity import similar_sets
from skein.plans.registry import query
from skein.plans.retrieval_queries import _Q, _SIM, _query

_CALLED = "c as (select k call_id, class_name name, concat('com.brand', cast(k % 26 as varchar)) package, params % 3 params from classes), t as (select id target_id, class_name name, package tp, params % 3 ptp from classes)"


def _called(d):
    calls = d.classes.select(F.col("k").alias("call_id"), F.col("class_name").alias("name"), F.concat(F.lit("com.brand"), (F.col("k") % 26).cast("string")).alias("package"), (F.col("params") % 3).alias("params"))
    return calls, d.classes.select(F.col("id").alias("target_id"), F.col("class_name").alias("name"), F.col("package").alias("tp"), (F.col("params") % 3).alias("tpp"))


_BEST = "s as (select call_id, target_id, {score} score from c join t using (name)), b as (select *, max(score) over (partition by call_id) m from s), u as (select *, count(*) over (partition by call_id) n from b where score = m) select call_id, target_id from u where n = 1"


@query("J14_member_calls", f"with {_CALLED}, {_BEST.format(score='case when package = tp then 2 else 0 end + case when params = ptp then 1 else 0 end')}", "classes")
def _(d):
    calls, targets = _called(d)
    return J.interface_matches(calls, targets, [(F.col("package") == F.col("tp")).cast("int"), (F.col("params") == F.col("tpp")).cast("int")])


@query("J15_inheritance", f"with {_CALLED}, {_BEST.format(score='case when package = tp then 1 else 0 end')}", "classes")
def _(d):
    calls, targets = _called(d)
    return J.interface_matches(calls, targets, [(F.col("package") == F.col("tp")).cast("int")])


_T = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(node_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2))"
_SIMS = f"""t as (select id, node_type, {_T} t from entities), w as (select id, node_type, unnest(t) w from t), p as (select distinct x.id a, y.id b from w x join w y on x.w = y.w where x.node_type = 'Entity' and y.node_type <> 'Entity'),
    s as (select a, b, y.node_type, cast(len(list_intersect(x.t, y.t)) as double) i, least(len(x.t), len(y.t)) m from p join t x on x.id = a join t y on y.id = b), q as (select a, b, node_type, case when m < 2 then 1.0 when i <> m and m < 3 then 0.0 else i / m end score from s)"""


def _similar(d):
    t = d.entities.select("id", "node_type", split_words(F.col("node_name")).alias("tokens"))
    found = similar_sets(t.where("node_type = 'Entity'"), t.where("node_type <> 'Entity'"), 0.5, small=3, least_length=4)
    return found.join(t.select(F.col("id").alias("b"), "node_type"), "b")


@query("J18_object_similarity", f"with {_SIMS} select a, b, score from q where score > case when node_type = 'Service' then 0.6 else 0.65 end", "classes entities")
def _(d):
    return _similar(d).where(F.col("score") > F.when(F.col("node_type") == "Service", 0.6).otherwise(0.65)).select("a", "b", "score")


@query("J19_object_links", f"with {_SIMS} select a, b, case when score >= 0.75 then 'CONFIRMED' else 'PENDING_CONFIRM' end status from q where score > 0.55", "classes entities")
def _(d):
    return _similar(d).where("score > 0.55").select("a", "b", F.when(F.col("score") >= 0.75, "CONFIRMED").otherwise("PENDING_CONFIRM").alias("status"))


@query("J20_merged_features", None)
def _(d):
    v = d.embeddings.withColumn("block", F.col("vec_id") % 20)
    a, b = v.where("label = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "block"), v.where("label = 1").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "block")
    scored = a.join(b, "block").select("a", "b", cosine(F.col("x"), F.col("y")).alias("score"))
    return J.greedy_matches(scored, 0.1).select("a", "b", F.round("score", 6).alias("score"))


_ENDS = "c as (select o_orderkey, case o_orderkey % 2 when 0 then 'GET' else 'POST' end m, concat('/c/', cast(o_custkey as varchar)) p, o_orderkey % 3 n from orders), a as (select id, 'GET' m, case when k % 4 = 0 then '/c/{id}' else concat('/c/', cast(k as varchar)) end p, k % 3 n, k from nodes where node_type = 'ApiEndpoint')"


@query("J21_call_match_scores", f"with {_ENDS} select c.o_orderkey, a.id, case when c.m = a.m and c.p = a.p then 1.0 else case when c.m = a.m then 0.3 else 0 end + case when c.p = a.p then 0.5 else 0.4 end + case when c.n = a.n then 0.1 else 0 end end score from c join orders o on o.o_orderkey = c.o_orderkey join a on a.k = o.o_custkey", "nodes")
def _(d):
    c = d.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("POST").alias("m"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("p"), (F.col("o_orderkey") % 3).alias("n"))
    a = _of(d, "ApiEndpoint").select("id", "k", F.lit("GET").alias("am"), F.when(F.col("k") % 4 == 0, "/c/{id}").otherwise(F.concat(F.lit("/c/"), F.col("k").cast("string"))).alias("ap"), (F.col("k") % 3).alias("an"))
    return c.join(a, "k").select("o_orderkey", "id", J.call_match_score(F.col("m"), F.col("am"), F.col("p"), F.col("ap"), F.col("n"), F.col("an")).alias("score"))


_V = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"


@query(
    "J28_linked_requirements",
    f"""with x as (select p_partkey item, concat('tbl:', cast(p_partkey as varchar)) node, 'exact' matcher, 0 pr, 1.0e0 score from part where p_partkey % 3 = 0 union all select p.p_partkey, n.id, 'term', 1, 0.9e0 from part p join nodes n on n.node_type = 'Table' and n.node_name = p.p_name and n.k % 5 = p.p_partkey % 5 and n.k % 10 = p.p_size % 10
    union all select a.vec_id, concat('tbl:', cast(b.vec_id as varchar)), 'semantic', 2, {_V} from embeddings a join embeddings b on b.vec_id = a.vec_id - a.vec_id % 2 where {_V} >= 0.8) select item, node, matcher, score from (select *, row_number() over (partition by item, node order by pr, score desc) r from x) y where r = 1""",
    "nodes",
)
def _(d):
    exact = d.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"), F.concat(F.lit("tbl:"), F.col("p_partkey").cast("string")).alias("node"))
    n = _of(d, "Table").select(F.col("id").alias("node"), F.col("node_name").alias("p_name"), (F.col("k") % 5).alias("g"), (F.col("k") % 10).alias("h"))
    terms = d.part.select(F.col("p_partkey").alias("item"), "p_name", (F.col("p_partkey") % 5).cast("long").alias("g"), (F.col("p_size") % 10).cast("long").alias("h"))
    b = d.embeddings.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    a = d.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("x"), (F.col("vec_id") - F.col("vec_id") % 2).alias("other"))
    semantic = a.join(b, "other").select("item", F.concat(F.lit("tbl:"), F.col("other").cast("string")).alias("node"), cosine(F.col("x"), F.col("y")).alias("score"))
    return J.linked_requirements(exact, terms, n, ["p_name", "g", "h"], semantic)


@query("J29_layer_rows", "with h as (select src api, dst mth from edges where edge_type = 'HANDLED_BY'), c as (select dst mth, min(src) ctl from edges where edge_type = 'CONTAINS' and src like 'ctl:%' group by 1), m as (select dst ctl, min(src) domain from edges where edge_type = 'CONTAINS' and src like 'dom:%' group by 1) select api, ctl, coalesce(domain, 'unclassified') domain from h left join c using (mth) left join m using (ctl)", "edges")
def _(d):
    owners = J.hop(d.edges, "CONTAINS", "owner", "member")
    ctl = J.of_type(owners, "owner", "Controller", d.nodes).groupBy(F.col("member").alias("mth")).agg(F.min("owner").alias("ctl"))
    dom = J.of_type(owners, "owner", "BusinessDomain", d.nodes).groupBy(F.col("member").alias("ctl")).agg(F.min("owner").alias("domain"))
    return J.hop(d.edges, "HANDLED_BY", "api", "mth").join(ctl, "mth", "left").join(dom, "ctl", "left").select("api", "ctl", F.coalesce("domain", F.lit("unclassified")).alias("domain"))


@query("J30_scaffolds", "with e as (select regexp_replace(class_name, '(ServiceImpl|Controller|Service|Mapper|Repository|Entity|Impl)$', '') entity, node_type from classes where node_type in ('Controller', 'Service', 'Mapper')) select entity, count(*) classes from e group by 1 having count(distinct node_type) = 3", "classes")
def _(d):
    return J.layered_entities(d.classes.select(entity_name(F.col("class_name")).alias("entity"), "node_type"), ["Controller", "Service", "Mapper"])


_CLAIMED = "select * from (values ('file', 'src/m2/Table.java'), ('file', 'src/none.java'), ('symbol', 'Service#svc:1'), ('symbol', 'Service#svc:x'), ('evidence', 'e7'), ('evidence', 'zz')) v(kind, \"value\")"


@query("J31_checked_claims", f"with c as ({_CLAIMED}) select kind, \"value\", case kind when 'file' then \"value\" in (select source_path from nodes) when 'symbol' then \"value\" in (select node_key from nodes) else \"value\" in (select unnest(string_split(evidence_ids, ',')) from nodes) end \"exists\" from c", "nodes")
def _(d):
    return J.checked(d.spark.sql(_CLAIMED.replace('"value"', "value")), d.nodes)


# requirements and impact


_TARGETS = "select r_regionkey requirement_id, concat('tbl:', cast(n_nationkey * 3 as string)) id from {region} join {nation} on n_regionkey = r_regionkey union all select r_regionkey, concat('svc:', cast(n_nationkey as string)) from {region} join {nation} on n_regionkey = r_regionkey"
_BACK = ["CALLS", "READS", "WRITES", "JOINS", "EXECUTES", "CONTAINS", "HANDLED_BY", "REFERENCES", "HAS_COLUMN", "DEPENDS_ON", "IMPLEMENTS", "EXPOSED_BY"]
_IN = ", ".join(f"'{t}'" for t in _BACK)


def _targets(d):
    return d.spark.sql(_TARGETS, region=d.region, nation=d.nation)


_WALK = f"with recursive s as materialized (select src, dst from edges where edge_type in ({_IN})), g as ({_TARGETS.format(region='region', nation='nation')}), w as (select requirement_id, id, 0 lvl from g union select requirement_id, src, lvl + 1 from w join s on dst = w.id where lvl < {{depth}}), m as (select requirement_id, id, min(lvl) lvl from w group by 1, 2)"


@query("P14_requirement_lineage", _WALK.format(depth=4) + ", c as (select src id, count(*) n from edges where edge_type = 'HAS_COLUMN' group by 1) select requirement_id, m.id, case when lvl = 0 then 1.0 else 0.7 end risk, coalesce(n, 0) \"columns\" from m left join c on c.id = m.id where m.id in (select id from nodes where node_type = 'Table')", "nodes edges")
def _(d):
    return P.lineage(_targets(d), d.nodes, d.edges, _BACK)


@query("P15_requirement_impact", _WALK.format(depth=3) + " select id, min(lvl) depth, 1.5 / log2(min(lvl) + 2) risk from m where requirement_id = 2 group by id", "nodes edges")
def _(d):
    found = P.reach(_targets(d).where("requirement_id = 2").select("id"), d.edges, 3, "in", _BACK)
    return found.select("id", F.col("level").alias("depth"), Q.risk_score(F.lit(1.0), F.col("level"), F.lit("INTERNAL_ONLY"), F.lit(False)).alias("risk"))


@query("P25_impacted_in_order", _WALK.format(depth=3) + " select id, lvl depth from m where requirement_id = 1 and lvl > 0 order by lvl, id limit 50", "nodes edges")
def _(d):
    found = P.reach(_targets(d).where("requirement_id = 1").select("id"), d.edges, 3, "in", _BACK)
    return found.where("level > 0").orderBy("level", "id").limit(50).select("id", F.col("level").alias("depth"))


@query("P16_incident_edges", "select id, edge_type from edges where src in ('svc:1', 'tbl:5') or dst in ('svc:1', 'tbl:5') order by id limit 200", "edges")
def _(d):
    return P.incident(d.edges, d.nodes.where("id in ('svc:1', 'tbl:5')")).select("id", "edge_type")


@query("P16_impacted_files", "with e as (select src, dst from edges where src = 'svc:1' or dst = 'svc:1' order by id limit 200), i as (select src id from e union select dst from e) select source_path, count(*) n from nodes semi join i using (id) group by 1", "nodes edges")
def _(d):
    e = P.incident(d.edges, d.nodes.where("id = 'svc:1'"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return d.nodes.join(ids, "id", "left_semi").groupBy("source_path").agg(F.count("*").alias("n"))


@query(
    "P17_plan_cards",
    """with recursive c as (select concat('claim:', cast(seq as varchar)) card, confidence score from claims where subject_key = 'f:7' order by confidence desc, seq limit 10), p as (select [id] ns, id e, 0 depth from nodes where id = 'api:1' union all select list_append(ns, dst), dst, depth + 1 from p join edges on src = e where depth < 2),
    q as (select array_to_string(ns, '>') card from p where depth > 0) select card from c union all (select card from q order by card limit 10)""",
    "claims nodes edges",
)
def _(d):
    cards = d.claims.where("subject_key = 'f:7'").orderBy(F.desc("confidence"), "seq").limit(10).select(F.concat(F.lit("claim:"), F.col("seq").cast("string")).alias("card"))
    found = P.paths(d.nodes.where("id = 'api:1'"), d.edges, 2).select(F.array_join("nodes", ">").alias("card")).orderBy("card").limit(10)
    return cards.union(found)


@query(
    "P18_expanded_seeds",
    f"""with recursive {_Q}, v as (select vec_id from vectors, q order by {_SIM} desc, vec_id limit 5), s as (select id from nodes where node_type = 'Service' and k in (select vec_id % 10 from v)), b as materialized (select src, dst from edges union select dst, src from edges), l1 as materialized (select distinct o id from (select b.src, b.dst o, row_number() over (partition by b.src order by b.dst) r from b where b.src in (select id from s)) x where r <= 20)
    select n.id, cast(floor(coalesce(confidence, 0) * 100 + 1e-9) as bigint) score from nodes n where n.id in (select id from s union select id from l1) order by 2 desc, 1 limit 100""",
    "vectors nodes edges",
)
def _(d):
    near = nearest(d.vectors, _query(d), 5).select((F.col("vec_id") % 10).alias("k")).distinct()
    seeds = _of(d, "Service").join(F.broadcast(near), "k", "left_semi").select("id")
    score = F.floor(F.coalesce("confidence", F.lit(0.0)) * 100 + 1e-9)
    return d.nodes.join(P.neighbourhood(d.edges, seeds, 1).select("id"), "id", "left_semi").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query("P20_core_paths", "with p as (select concat(a.src, ' -> ', a.dst, ' -> ', b.dst) \"path\" from edges a join edges b on b.src = a.dst and a.id <> b.id where a.src like 'api:%' union all select concat(src, ' -> ', dst) from edges where src like 'api:%') select \"path\" from p where contains(\"path\", 'svc:1') order by 1 limit 100", "edges")
def _(d):
    found = P.paths(_of(d, "ApiEndpoint"), d.edges, 2).select(F.array_join("nodes", " -> ").alias("path"))
    return found.where(F.contains("path", F.lit("svc:1"))).orderBy("path").limit(100)


_LAYERS = [("EXPOSED_BY",), ("IMPLEMENTED_BY", "HANDLED_BY"), ("READS", "WRITES"), ("VERIFIED_BY",), ("CALLS",)]


@query(
    "P22_claim_slices",
    "with s as (select concat(subject_key, '/', cast(seq % 40 as varchar)) f, (max(case when predicate = 'EXPOSED_BY' then 1 else 0 end) + max(case when predicate in ('IMPLEMENTED_BY', 'HANDLED_BY') then 1 else 0 end) + max(case when predicate in ('READS', 'WRITES') then 1 else 0 end) + max(case when predicate = 'VERIFIED_BY' then 1 else 0 end) + max(case when predicate = 'CALLS' then 1 else 0 end)) / 5.0e0 c from claims group by 1) select f feature, c coverage, case when c >= 0.8 then 'COVERED' when c >= 0.3 then 'PARTIAL' else 'MISSING' end status, case when c < 0.5 then 'HIGH' when c < 0.8 then 'MEDIUM' else 'LOW' end risk, round(c * 0.9, 2) confidence from s",
    "claims",
)
def _(d):
    hit = sum(F.max(F.when(F.col("predicate").isin(*p), 1).otherwise(0)) for p in _LAYERS)
    s = d.claims.groupBy(F.concat("subject_key", F.lit("/"), (F.col("seq") % 40).cast("string")).alias("feature")).agg((hit / 5.0).alias("coverage"))
    c = F.col("coverage")
    return s.select("feature", "coverage", P.covered_status(c).alias("status"), P.coverage_risk(c).alias("risk"), F.round(c * 0.9, 2).alias("confidence"))


@query("P23_scenarios", "with h as (select distinct src api from edges where edge_type = 'HANDLED_BY'), t as (select distinct dst tbl from edges where edge_type in ('READS', 'WRITES')) select concat('API ', api, ' ', s) scenario from h, (values ('success'), ('forbidden')) v(s) union all select concat('DB ', tbl, ' persisted') from t", "edges")
def _(d):
    api = J.hop(d.edges, "HANDLED_BY", "api", "m").select("api").distinct().select(F.explode(F.transform(F.lit(["success", "forbidden"]), lambda s: F.concat(F.lit("API "), F.col("api"), F.lit(" "), s))).alias("scenario"))
    return api.union(J.hop(d.edges, ["READS", "WRITES"], "s", "tbl").select("tbl").distinct().select(F.concat(F.lit("DB "), F.col("tbl"), F.lit(" persisted"))))


_ITEMS = "select concat('req:', cast(r_regionkey as varchar)) src, concat('item:', cast(n_nationkey as varchar)) dst, 'HAS_ITEM' edge_type from region join nation on n_regionkey = r_regionkey union all select concat('item:', cast(n_nationkey as varchar)), concat('crit:', cast(n_nationkey as varchar), '.', cast(i as varchar)), 'HAS_CRITERION' from nation, (values (1), (2)) v(i)"


@query("P26_requirement_graph", _ITEMS)
def _(d):
    items = d.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("item"), F.array(F.lit(1), F.lit(2)).alias("criteria"))).alias("items"))
    flat = items.select(F.concat(F.lit("req:"), F.col("n_regionkey").cast("string")).alias("req"), F.explode("items").alias("i")).select("req", F.concat(F.lit("item:"), F.col("i.item").cast("string")).alias("item"), F.col("i.item").alias("n"), "i.criteria")
    criteria = flat.select("item", "n", F.explode("criteria").alias("i")).select("item", F.concat(F.lit("crit:"), F.col("n").cast("string"), F.lit("."), F.col("i").cast("string")).alias("c"))
    return flat.select(F.col("req").alias("src"), F.col("item").alias("dst"), F.lit("HAS_ITEM").alias("edge_type")).union(criteria.select("item", "c", F.lit("HAS_CRITERION")))


@query("P21_slice_status", "with h as (select src api, dst mth from edges where edge_type = 'HANDLED_BY'), l as (select id, case when h.api is not null then 1 else 0 end + case when e.src is not null then 1 else 0 end c from nodes n left join h on h.api = n.id left join (select distinct src from edges where edge_type = 'CALLS') e on e.src = h.mth where node_type = 'ApiEndpoint') select id, case when max(c) / 2.0 >= 0.8 then 'COVERED' when max(c) / 2.0 >= 0.3 then 'PARTIAL' else 'MISSING' end status from l group by id", "nodes edges")
def _(d):
    c = P.chain_coverage(_of(d, "ApiEndpoint"), d.edges, [["HANDLED_BY"], ["CALLS"]])
    return c.select("id", P.covered_status(F.col("layers") / 2).alias("status"))


@query("P1_paths_between", "with recursive b as (select src, dst, id from edges where edge_type = 'REFERENCES' union all select dst, src, id from edges where edge_type = 'REFERENCES'), p as (select 'tbl:20' e, [''] used, ['tbl:20'] ns, 0 depth union all select dst, list_append(used, id), list_append(ns, dst), depth + 1 from p join b on b.src = e where depth < 5 and not list_contains(used, id)) select array_to_string(ns, '>') trail, depth from p where e = 'tbl:5' and depth > 0 order by depth, 1 limit 20", "edges")
def _(d):
    found = P.best_trails(d.nodes.where("id = 'tbl:20'"), d.edges, d.nodes, 5, 20, "both", ["REFERENCES"], d.nodes.where("id = 'tbl:5'"))
    return found.select("trail", "depth")


@query(
    "P2_first_paths",
    """with recursive p as (select id "end", 0 depth, id trail, [''] used, confidence from nodes where id in ('api:1', 'ctl:2') union all select dst, depth + 1, concat(trail, '>', dst), list_append(used, edges.id), least(p.confidence, coalesce(n.confidence, p.confidence)) from p join edges on src = p."end" join nodes n on n.id = dst where depth < 4 and not list_contains(used, edges.id))
    select trail, "end", depth, round(least(p.confidence, confidence), 6) confidence from p where depth > 0 order by depth, trail limit 300""",
    "nodes edges",
)
def _(d):
    found = P.best_trails(d.nodes.where("id in ('api:1', 'ctl:2')"), d.edges, d.nodes, 4, 300)
    return found.select("trail", "end", "depth", F.round("confidence", 6).alias("confidence"))
