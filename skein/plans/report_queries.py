"""Queries that complete families of the other modules: pages, counts by version, gates, reports, histories."""

from pyspark.sql import functions as F

from skein.operators import evaluation as Q
from skein.operators import patterns as J
from skein.operators import retrieval as V
from skein.operators import scans as S
from skein.operators import stats as A
from skein.operators import traverse as P
from skein.plans.pattern_queries import _REACH
from skein.operators.alike import alike_sets
from skein.operators.similarity import first_similar
from skein.plans.registry import query
from skein.plans.retrieval_queries import _Q, _SIM, _query
from skein.sources.process import process_log
from skein.storage import scratch_path


@query(
    "G18_capped_page",
    """with p as (select * from nodes order by node_key, id limit 2001), q as (select * from p order by node_key, id limit 2000), e as materialized (select src, dst from edges), i as materialized (select id from q) select (select count(*) from q) n_nodes, (select count(*) from e semi join i x on x.id = e.src semi join i y on y.id = e.dst) n_edges, (select count(*) from nodes) total,
    (select count(*) > 2000 from p) has_more, case when (select count(*) > 2000 from p) then (select max(node_key) from q) end next_cursor""",
    "nodes edges",
)
def _(d):
    return S.page_envelope(d.nodes, d.edges, None, 5000)


@query("G24_free_write", "select node_type, max(confidence) best from nodes where confidence >= 0.25 group by 1", "nodes")
def _(d):
    return S.run_write(d.spark, "select node_type, max(confidence) best from {n} where confidence >= :least group by 1", scratch_path(d.spark, "free"), {"least": 0.25}, n=d.nodes)


@query("G31_version_statistics", "with v as (select 'v1' version_id, (select count(*) from nodes where in_v1) live union all select 'v2', (select count(*) from nodes where in_v2) union all select 'v3', 0) select version_id, case version_id when 'v1' then live else 7 end cached, live, version_id <> 'v1' stale from v", "nodes")
def _(d):
    kept = d.v1_nodes.agg(F.count("*").alias("cached")).select(F.lit("v1").alias("version_id"), "cached").union(d.spark.createDataFrame([("v2", 7), ("v3", 7)], "version_id string, cached long"))
    live = d.v1_nodes.select(F.lit("v1").alias("version_id")).union(d.nodes.where("in_v2").select(F.lit("v2")))
    return S.version_statistics(kept, live)


_COS = "list_cosine_similarity(cast(v.embedding as double[]), cast(w.embedding as double[]))"


@query(
    "J17_feature_matches",
    f"""with t as (select p_partkey id, p_size, unnest(list_distinct(string_split(lower(p_name), ' '))) token from part), n as (select id, count(*) n from t group by 1), s as (select a.id a, b.id b, cast(count(*) as double) / least(min(x.n), min(y.n)) tok from t a join t b on a.token = b.token join n x on x.id = a.id join n y on y.id = b.id where a.p_size <= 3 and b.p_size > 45 group by 1, 2 having cast(count(*) as double) / least(min(x.n), min(y.n)) >= 0.25),
    c as (select a, b, greatest(tok, coalesce({_COS}, 0)) score from s left join embeddings v on v.vec_id = a left join embeddings w on w.vec_id = b), r as (select *, row_number() over (partition by a order by score desc, b) r from c where score > 0.6) select a, b, case when score >= 0.8 then 'CONFIRMED' else 'PENDING_CONFIRM' end status from r where r <= 3""",
)
def _(d):
    t = d.part.select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("tokens"), "p_size")
    a, b = t.where("p_size <= 3"), t.where("p_size > 45")
    # a vector only raises a score: what is among the first three is among them by tokens, or both its ends have vectors of a cosine over 0.6
    known = lambda rows: rows.select("id", "tokens").join(d.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")
    raised = alike_sets(known(a), known(b), 0.25, 0.6).select("a", "b", F.greatest("score", "cosine").alias("score"))
    scored = first_similar(a, b, 0.25, 3).union(raised).groupBy("a", "b").agg(F.max("score").alias("score")).where("score > 0.6")
    return J.top_per(scored, "a", 3, F.desc("score"), "b").select("a", "b", F.when(F.col("score") >= 0.8, "CONFIRMED").otherwise("PENDING_CONFIRM").alias("status"))


@query("J26_edge_evidence_coverage", "select edge_type, count(distinct id) n from (select edge_type, id, unnest(string_split(evidence_ids, ',')) e from edges where evidence_ids <> '') x where e in (select concat('e', cast(n_nationkey as varchar)) from nation) group by 1", "edges")
def _(d):
    x = d.edges.where("evidence_ids <> ''").select("edge_type", "id", F.explode(F.split("evidence_ids", ",")).alias("e"))
    return x.join(d.nation.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("e")), "e", "left_semi").groupBy("edge_type").agg(F.count_distinct("id").alias("n"))


_CHAIN = _REACH.format(seed="api:1", to="dst", on="src", depth=12, types=" and edge_type in ('HANDLED_BY', 'CALLS', 'EXECUTES', 'READS', 'WRITES', 'JOINS')")
_FOUND = _CHAIN.replace("select id, cast(min(lvl) as integer)", ", m as (select id, min(lvl) lvl").replace('as "level" from w group by id', "from w group by id)")


def _chain(d):
    return P.reach(d.nodes.where("id = 'api:1'"), d.edges, 12, "out", ["HANDLED_BY", "CALLS", "EXECUTES", "READS", "WRITES", "JOINS"])


@query("P4_chain_edges", _FOUND + " select m.id, min(e.id) via from m join edges e on e.dst = m.id and e.edge_type in ('HANDLED_BY', 'CALLS', 'EXECUTES', 'READS', 'WRITES', 'JOINS') join m p on p.id = e.src and p.lvl = m.lvl - 1 group by m.id", "nodes edges")
def _(d):
    return _chain(d).where("level > 0").select("id", "via")


@query("P4_chain_containers", _FOUND + " select distinct e.src id from m join edges e on e.dst = m.id and e.edge_type = 'CONTAINS' where m.id like 'mth:%' or m.id like 'sql:%'", "nodes edges")
def _(d):
    inner = _chain(d).where("id like 'mth:%' or id like 'sql:%'").select(F.col("id").alias("member"))
    return J.hop(d.edges, "CONTAINS", "id", "member").join(inner, "member", "left_semi").select("id").distinct()


@query("A19_edge_counts_by_version", "select 'v1' version_id, edge_type, count(*) n from edges where in_v1 group by 2 union all select 'v2', edge_type, count(*) from edges where in_v2 group by 2", "edges")
def _(d):
    versions = d.edges.select("edge_type", F.explode(F.array_compact(F.array(F.when(F.col("in_v1"), "v1"), F.when(F.col("in_v2"), "v2")))).alias("version_id"))
    return A.distribution(versions, "version_id", "edge_type")


@query("A23_domain_breakdown", "select src domain, n.node_type, count(*) n from edges e join nodes n on n.id = e.dst where edge_type = 'CONTAINS' and src like 'dom:%' group by 1, 2", "nodes edges")
def _(d):
    members = d.edges.where("edge_type = 'CONTAINS' and src like 'dom:%'").select(F.col("src").alias("domain"), F.col("dst").alias("id"))
    return A.distribution(members.join(d.nodes.select("id", "node_type"), "id"), "domain", "node_type")


@query("A28_grouped", "select l_returnflag, l_linestatus, count(*) n, sum(l_linenumber) sum_l_linenumber, count(distinct l_suppkey) distinct_l_suppkey from lineitem group by 1, 2".replace("sum(l_linenumber)", "cast(sum(l_linenumber) as bigint)"))
def _(d):
    return A.grouped(d.lineitem, ["l_returnflag", "l_linestatus"], ["l_linenumber"], ["l_suppkey"])


@query("V2_released_top_k", f"with {_Q} select vec_id from vectors, q where vec_id % 2 = 0 and (acl is null or list_has_any(string_split(acl, ','), ['carol'])) order by {_SIM} desc, vec_id limit 10", "vectors")
def _(d):
    v = d.vectors.withColumn("release", F.concat(F.lit("r"), (F.col("vec_id") % 2).cast("string")))
    return V.nearest(v.where((F.col("release") == "r0") & V.readable(F.col("acl"), ["Carol"])), _query(d), 10).select("vec_id")


@query("V12_channel_weights", f"with {_Q} select vec_id, 1 / (2 - {_SIM}) * case chunk_type when 'DOC' then 0.30 when 'CODE' then 0.15 when 'DB' then 0.40 when 'UI' then 0.10 else 0.05 end relevance from vectors, q", "vectors")
def _(d):
    w = dict(zip(V.CHANNELS, V.INTENT_WEIGHTS["DATA_LINEAGE"], strict=True))
    found = d.vectors.withColumn("distance", 1 - V.cosine(F.col("embedding"), V.vector(_query(d))))
    return V.intent_weighted(found, {"DOC": w["keyword"], "CODE": w["vector"], "DB": w["graph"], "UI": w["claim"]}, w["convention"]).select("vec_id", "relevance")


@query("V18_duplicate_neighbours", f"select v.vec_id, {_COS} >= 0.92 probable from embeddings v join embeddings w on w.vec_id = v.vec_id - v.vec_id % 5")
def _(d):
    w = d.embeddings.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    v = d.embeddings.withColumn("other", F.col("vec_id") - F.col("vec_id") % 5)
    return v.join(w, "other").select("vec_id", (V.cosine(F.col("embedding"), F.col("y")) >= 0.92).alias("probable"))


@query("R5_report_counts", "with b as (select case when confidence < 0.2 then 0 when confidence < 0.4 then 1 when confidence < 0.6 then 2 when confidence < 0.8 then 3 else 4 end bin, count(*) n from nodes where confidence between 0 and 1 group by 1) select concat('bin ', cast(bin as varchar)) item, n from b union all select 'claims', count(*) from claims union all select concat('claims ', predicate), count(*) from claims group by predicate", "nodes claims")
def _(d):
    bins = A.confidence_bins(d.nodes).where("n > 0").select(F.concat(F.lit("bin "), F.col("bin").cast("string")).alias("item"), "n")
    per = d.claims.groupBy("predicate").agg(F.count("*").alias("n")).select(F.concat(F.lit("claims "), "predicate").alias("item"), "n")
    return bins.union(d.claims.agg(F.count("*").alias("n")).select(F.lit("claims").alias("item"), "n")).union(per)


_KINDS = "case event_type when 'view' then 'ApiEndpoint' when 'click' then 'Method' else 'SqlStatement' end"


@query("T2_verified_by_kind", f"with s as (select user_id k, {_KINDS} node_type, count(*) n, max(ts) last_seen from events group by 1, 2) select n.id, case when s.n is null then n.verified_score else 1.0 end verified_score, coalesce(s.n, 0) trace_count from nodes n left join s on s.k = n.k and s.node_type = n.node_type where n.node_type in ('ApiEndpoint', 'Method')", "nodes")
def _(d):
    seen = d.events.groupBy(F.col("user_id").cast("long").alias("k"), F.expr(_KINDS).alias("node_type")).agg(F.count("*").alias("n"))
    both = d.nodes.where("node_type in ('ApiEndpoint', 'Method')").join(seen, ["k", "node_type"], "left")
    return both.select("id", F.when(F.col("n").isNull(), F.col("verified_score")).otherwise(1.0).alias("verified_score"), F.coalesce("n", F.lit(0)).alias("trace_count"))


@query("L3_process_history", "select user_id case_id, concat('flow', cast(user_id % 3 as varchar)) process, event_type activity, count(*) n from events group by 1, 2, 3")
def _(d):
    history = d.events.select(F.col("user_id").alias("PROC_INST_ID_"), F.concat(F.lit("flow"), (F.col("user_id") % 3).cast("string"), F.lit(":4:"), F.col("event_id").cast("string")).alias("PROC_DEF_ID_"), F.col("event_type").alias("ACT_ID_"), F.col("ts").alias("START_TIME_"), F.col("ts").alias("END_TIME_"))
    return process_log(history).groupBy("case_id", "process", "activity").agg(F.count("*").alias("n"))


@query("R17_change_report", "with t as (select o_orderpriority task, count(*) changes, count(*) filter (where o_orderstatus = 'F') done from orders group by 1) select concat('| task | changes | done |\n|---|---|---|\n', string_agg(concat('| ', task, ' | ', cast(changes as varchar), ' | ', cast(done as varchar), ' |'), '\n' order by task)) \"text\" from t")
def _(d):
    t = d.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("changes"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return Q.markdown_table(t, ["task", "changes", "done"], "task")
