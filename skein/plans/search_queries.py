"""More queries of skein.operators.retrieval: routing, hybrid search, caches and text similarity."""

from pyspark.sql import functions as F

from skein.functions.text import clamped
from skein.operators import retrieval as V
from skein.plans.registry import query
from skein.plans.retrieval_queries import _Q, _SIM, _query

_WORDS = ["impact of", "design a", "which code", "overview of", "the table", "hello", "调用链 of", "the business", "class of", "data flow of"]
_ASKED = "x as (select conv_id, turn, concat(case conv_id % 10 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end, ' it') q from qa)"


def _asked(d):
    return d.qa.select("conv_id", "turn", F.concat(F.element_at(F.lit(_WORDS), (F.col("conv_id") % 10 + 1).cast("int")), F.lit(" it")).alias("q"))


_INTENT = "case when regexp_matches(lower(q), '影响|变更|impact|change') then 'CHANGE_IMPACT' when regexp_matches(lower(q), '方案|设计|solution|design') then 'SOLUTION_DESIGN' when regexp_matches(lower(q), '代码|实现|code|function|method') then 'CODE_EXPLANATION' when regexp_matches(lower(q), '架构|结构|architecture|overview') then 'ARCHITECTURE_OVERVIEW' when regexp_matches(lower(q), '数据|表|字段|data|table|lineage') then 'DATA_LINEAGE' else 'REQUIREMENT_UNDERSTANDING' end"


@query("V13_intents", f"with {_ASKED} select conv_id, turn, {_INTENT} intent from x", "qa")
def _(d):
    return _asked(d).select("conv_id", "turn", V.intent(F.col("q")).alias("intent"))


@query(
    "V14_intent_channels",
    f"""with {_ASKED}, w as (select * from (values ('REQUIREMENT_UNDERSTANDING', 0.20, 0.15), ('CHANGE_IMPACT', 0.30, 0.25), ('SOLUTION_DESIGN', 0.15, 0.20), ('CODE_EXPLANATION', 0.25, 0.25), ('ARCHITECTURE_OVERVIEW', 0.05, 0.30), ('DATA_LINEAGE', 0.30, 0.40)) v(i, keyword, graph)) select conv_id, turn, keyword, graph from x join w on i = {_INTENT}""",
    "qa",
)
def _(d):
    w = V.weights_of(V.intent(F.col("q")), V.INTENT_WEIGHTS, V.CHANNELS)
    return _asked(d).select("conv_id", "turn", w["keyword"].alias("keyword"), w["graph"].alias("graph"))


@query(
    "V21_source_routes",
    f"""with {_ASKED}, y as (select *, case when regexp_matches(lower(q), '调用链|api chain|call chain') then 'API_CHAIN' when regexp_matches(lower(q), '影响|impact') then 'IMPACT_ANALYSIS' when regexp_matches(lower(q), '血缘|lineage|数据流|data flow') then 'DATA_LINEAGE' when regexp_matches(lower(q), '业务流程|business|功能|feature|流程') then 'BUSINESS_FLOW' when regexp_matches(lower(q), '类|class|方法|method|字段|field|接口|interface') then 'CODE_LOOKUP' else 'GENERAL' end intent from x)
    select conv_id, turn, intent, case intent when 'CODE_LOOKUP' then 0.7 when 'DATA_LINEAGE' then 0.3 when 'API_CHAIN' then 0.6 when 'BUSINESS_FLOW' then 0.3 when 'IMPACT_ANALYSIS' then 0.5 else 0.33 end code from y""",
    "qa",
)
def _(d):
    i = V.source_intent(F.col("q"))
    return _asked(d).select("conv_id", "turn", i.alias("intent"), V.weights_of(i, V.SOURCES, ("code", "document", "database"))["code"].alias("code"))


@query("V21_cited_answers", "select conv_id, turn, contains(concat(answer, case when conv_id % 2 = 0 then ' see svc:1' else '' end), 'svc:1') or contains(answer, 'tbl:2') cited from qa where answer is not null", "qa")
def _(d):
    answer = F.concat("answer", F.when(F.col("conv_id") % 2 == 0, " see svc:1").otherwise(""))
    return d.qa.where("answer is not null").select("conv_id", "turn", V.cites(answer, F.lit(["svc:1", "tbl:2"])).alias("cited"))


@query("V3_default_versions", "select p.project_id, coalesce(v, 'default') version_id from (values ('p1'), ('p2')) p(project_id) left join (select project_id, arg_max(case when in_v2 then 'v2' else 'v1' end, concat(cast(created_at as varchar), id)) v from nodes group by 1) n on n.project_id = p.project_id", "nodes")
def _(d):
    latest = d.nodes.groupBy("project_id").agg(F.max_by(F.when(F.col("in_v2"), "v2").otherwise("v1"), F.struct("created_at", "id")).alias("v"))
    return d.spark.createDataFrame([("p1",), ("p2",)], "project_id string").join(latest, "project_id", "left").select("project_id", F.coalesce("v", F.lit("default")).alias("version_id"))


_LISTS = f"""{_Q}, a as (select vec_id, row_number() over (order by {_SIM} desc, vec_id) r from vectors, q qualify r <= 20), b as (select vec_id, row_number() over (order by {_SIM} desc, vec_id) r from vectors, q where chunk_type = 'CODE' qualify r <= 10), c as (select vec_id, row_number() over (order by vec_id) r from vectors where source_uri = 'uri3' qualify r <= 10)"""


def _rankings(d):
    near = lambda t, k: V.ranked(V.nearest(t, _query(d), k), F.desc("similarity"), "vec_id").select(F.col("vec_id").alias("key"), "rank")
    words = V.ranked(d.vectors.where("source_uri = 'uri3'").orderBy("vec_id").limit(10), "vec_id").select(F.col("vec_id").alias("key"), "rank")
    return [("main", 1.0, near(d.vectors, 20)), ("variant", 0.8, near(d.vectors.where("chunk_type = 'CODE'"), 10)), ("keyword", 0.7, words)]


@query("V7_hybrid_retrieval", f"with {_LISTS}, x as (select vec_id, 1.0e0 w, r from a union all select vec_id, 0.8e0, r from b union all select vec_id, 0.7e0, r from c) select vec_id as \"key\", sum(w / (60 + r)) score from x group by 1 order by 2 desc, 1 limit 20", "vectors")
def _(d):
    return V.hybrid(_rankings(d), 20)


@query("V7_first_seen", f"with {_LISTS}, x as (select vec_id, 0 ch, r from a union all select vec_id, 1, r from b union all select vec_id, 2, r from c) select vec_id as \"key\" from x group by 1 order by min(ch * 1000 + r), 1 limit 25", "vectors")
def _(d):
    return V.hybrid(_rankings(d), 25, fuse=False).select("key")


@query("V10_reranked", "select doc_id from documents where text is not null order by case when contains(lower(text), 'the') then 1 else 0 end desc, doc_id limit 10")
def _(d):
    strategies = {"keyword": lambda t: F.contains(F.lower("text"), F.lit(t)).cast("int"), "none": lambda t: F.lit(0)}
    return d.documents.where("text is not null").orderBy(F.desc(strategies["keyword"]("the")), "doc_id").limit(10).select("doc_id")


@query("V15_claim_relevance", "select seq, (case when contains(lower(subject_key), 'f:1') then 3 else 0 end + case when contains(lower(object_key), 'f:1') then 2 else 0 end + case when contains(lower(predicate), 'f:1') then 1 else 0 end + case when contains(lower(subject_key), 'reads') then 3 else 0 end + case when contains(lower(object_key), 'reads') then 2 else 0 end + case when contains(lower(predicate), 'reads') then 1 else 0 end) * (0.5 + confidence) relevance from claims", "claims")
def _(d):
    return V.claim_relevance(d.claims, ["f:1", "reads"]).select("seq", "relevance")


@query("V16_cached_answer", f"with {_Q}, c as (select vec_id, embedding, case when vec_id % 2 = 0 then null else 'r1' end release, timestamp '2024-01-01 00:00:00' + to_hours(cast(vec_id % 48 as integer)) created_at from embeddings) select vec_id as \"key\" from c, q where release is null and created_at > timestamp '2024-01-01 12:00:00' - interval 24 hour and {_SIM} >= 0.95 order by {_SIM} desc, created_at desc, vec_id limit 1")
def _(d):
    cache = d.embeddings.select(F.col("vec_id").alias("key"), "embedding", F.when(F.col("vec_id") % 2 != 0, "r1").alias("release"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("vec_id") % 48).cast("int"))).alias("created_at"))
    return V.cached_answer(cache, _query(d), F.lit("2024-01-01 12:00:00").cast("timestamp"), None).select("key")


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)"
_HASH = "list_reduce(list_prepend(cast(0 as bigint), list_transform(range(1, length(t) + 1), lambda i: cast(ascii(substring(t, i, 1)) as bigint))), lambda h, c: (h * 31 + c) % 256)"


@query(
    "V17_similar_texts",
    f"""with t as (select doc_id id, unnest({_TOK}) t from documents where text is not null), b as (select id, {_HASH} bucket, count(*) n from t group by 1, 2), v as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) w from b),
    q as (select 'i' || item_id id, t from (select item_id, unnest({_TOK}) t from benchmark where text is not null) z), qb as (select id, {_HASH} bucket, count(*) n from q group by 1, 2), qv as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) w from qb),
    s as (select qv.id query, cast(v.id as varchar) id, sum(v.w * qv.w) s from v join qv using (bucket) group by 1, 2) select query, round(s, 6) similarity from (select *, row_number() over (partition by query order by s desc, id) r from s) y where r <= 3""",
)
def _(d):
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    docs = d.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), words.alias("tokens"))
    items = d.benchmark.where("text is not null").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("id"), words.alias("tokens"))
    return V.similar_texts(items, docs).select("query", F.round("similarity", 6).alias("similarity"))


@query("V19_keyword_nodes", "with s as (select id, confidence, node_key, case when contains(lower(concat_ws(' ', node_name, node_key, node_type)), 'ring') then 1 else 0 end + case when contains(lower(concat_ws(' ', node_name, node_key, node_type)), 'table') then 1 else 0 end + case when contains(lower(concat_ws(' ', node_name, node_key, node_type)), 'red') then 1 else 0 end score from nodes), k as (select * from s where score > 0 order by score desc, node_key limit 20) select id, score, (select least(greatest(coalesce(avg(confidence), 0.6), 0.1), 1) from k) answer_confidence from k", "nodes")
def _(d):
    found = V.keyword_nodes(d.nodes, ["Ring", "table", "red", "red"], 20)
    answer = found.agg(clamped(F.coalesce(F.avg("confidence"), F.lit(0.6)), 0.1, 1.0).alias("answer_confidence"))
    return found.select("id", "score").join(answer, F.lit(True))


@query("V20_upserted_vectors", "select source_uri, count(*) n from vectors where source_uri <> 'uri1' group by 1 union all select 'uri1', 3", "vectors")
def _(d):
    fresh = d.vectors.where("source_uri = 'uri1'").limit(0).select("source_uri", "vec_id").union(d.spark.createDataFrame([("uri1", 1), ("uri1", 2), ("uri1", 3)], "source_uri string, vec_id long"))
    kept = d.vectors.select("source_uri", "vec_id").join(fresh.select("source_uri").distinct(), "source_uri", "left_anti")
    return kept.union(fresh).groupBy("source_uri").agg(F.count("*").alias("n"))


@query("Q6_phrased_abstentions", "select conv_id, turn from (select conv_id, turn, concat(coalesce(answer, ''), case when conv_id % 4 = 0 then ' I cannot answer this.' else ' and that is all of it' end) a from qa) x where length(trim(a)) < 20 or regexp_matches(a, '(?i)(no evidence|not found|cannot answer|don''t know|insufficient)')", "qa")
def _(d):
    from skein.operators.evaluation import abstains

    a = F.concat(F.coalesce("answer", F.lit("")), F.when(F.col("conv_id") % 4 == 0, " I cannot answer this.").otherwise(" and that is all of it"))
    return d.qa.where(abstains(a)).select("conv_id", "turn")
