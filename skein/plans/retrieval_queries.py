"""Queries of skein.operators.retrieval, and of scores over answers."""

from pyspark.sql import functions as F

from skein.operators import retrieval as V
from skein.operators import trigrams as G
from skein.operators import vector_index as I
from skein.plans.registry import query

_SIM = "list_dot_product(cast(embedding as double[]), q) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(q, q)))"
_Q = "q as (select cast(embedding as double[]) q from embeddings where vec_id = 0)"


def _query(d):
    return d.embeddings.where("vec_id = 0").first()["embedding"]


@query("V1_cosine_top_k", f"with {_Q} select vec_id, round({_SIM}, 6) similarity from vectors, q where chunk_type = 'DOC' order by {_SIM} desc, vec_id limit 20", "vectors")
def _(d):
    return V.nearest(d.vectors.where("chunk_type = 'DOC'"), _query(d), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("V2_filtered_top_k", f"with {_Q} select vec_id, round({_SIM}, 6) similarity from vectors, q where acl is null or contains(acl, 'bob') order by {_SIM} desc, vec_id limit 10", "vectors")
def _(d):
    return V.nearest(d.vectors.where(F.col("acl").isNull() | F.col("acl").contains("bob")), _query(d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _index(d, cells=64):
    return I.build_index(d.vectors, cells)


@query("V1_indexed_top_k", f"with {_Q} select vec_id, round({_SIM}, 6) similarity from vectors, q where chunk_type = 'DOC' order by {_SIM} desc, vec_id limit 20", "vectors")
def _(d):
    return I.indexed_nearest(d.spark, _index(d), _query(d), 20, where=F.col("chunk_type") == "DOC").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("V2_indexed_filtered_top_k", f"with {_Q} select vec_id, round({_SIM}, 6) similarity from vectors, q where acl is null or contains(acl, 'bob') order by {_SIM} desc, vec_id limit 10", "vectors")
def _(d):
    return I.indexed_nearest(d.spark, _index(d), _query(d), 10, where=F.col("acl").isNull() | F.col("acl").contains("bob")).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("V16_indexed_cache_lookup", f"with {_Q} select vec_id, round({_SIM}, 6) similarity from vectors, q where {_SIM} >= 0.95 and vec_id > 0 order by {_SIM} desc, vec_id limit 1", "vectors")
def _(d):
    return I.indexed_nearest(d.spark, _index(d), _query(d), 1, where=F.col("vec_id") > 0, least=0.95).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "V4_indexed_similar_nodes",
    f"with {_Q}, t as (select source_uri, row_number() over (order by {_SIM} desc, vec_id) r from vectors, q qualify r <= 20), u as (select source_uri, min(r) place from t group by source_uri) select id, place from nodes join u on source_uri = concat('uri', cast(k % 40 as string)) where node_type = 'Service'",
    "vectors nodes",
)
def _(d):
    near = V.ranked(I.indexed_nearest(d.spark, _index(d), _query(d), 20), F.desc("similarity"), "vec_id")
    nodes = d.nodes.where("node_type = 'Service'").withColumn("source_uri", F.concat(F.lit("uri"), (F.col("k") % 40).cast("string")))
    return nodes.join(F.broadcast(V.sources_of(near)), "source_uri").select("id", "place")


@query(
    "V4_similar_nodes",
    f"with {_Q}, t as (select source_uri, row_number() over (order by {_SIM} desc, vec_id) r from vectors, q qualify r <= 20), u as (select source_uri, min(r) place from t group by source_uri) select id, place from nodes join u on source_uri = concat('uri', cast(k % 40 as string)) where node_type = 'Service'",
    "vectors nodes",
)
def _(d):
    near = V.ranked(V.nearest(d.vectors, _query(d), 20), F.desc("similarity"), "vec_id")
    nodes = d.nodes.where("node_type = 'Service'").withColumn("source_uri", F.concat(F.lit("uri"), (F.col("k") % 40).cast("string")))
    return nodes.join(F.broadcast(V.sources_of(near)), "source_uri").select("id", "place")


@query("V5_keyword_search", "select doc_id from documents where contains(text, 'the') or contains(text, 'und') order by doc_id limit 25")
def _(d):
    return V.keyword_search(d.documents, ["the", "x", "und"], 25).select("doc_id")


@query("V5_indexed_keyword_search", "select doc_id from documents where contains(text, 'Widerr') or contains(text, 'quar') order by doc_id limit 25")
def _(d):
    return G.containing(d.documents, G.build_trigrams(d.documents), ["Widerr", "quar"]).select("doc_id").orderBy("doc_id").limit(25)


_RANKS = f"""{_Q}, a as (select vec_id, row_number() over (order by {_SIM} desc, vec_id) r from vectors, q qualify r <= 30), b as (select vec_id, row_number() over (order by vec_id desc) r from vectors where chunk_type = 'CODE' qualify r <= 15),
    x as (select 'main' source, vec_id as "key", 1.0e0 weight, r from a union all select 'variant', vec_id, 0.8e0, r from b)"""


def _ranks(d):
    a = V.ranked(V.nearest(d.vectors, _query(d), 30), F.desc("similarity"), "vec_id").select(F.lit("main").alias("source"), F.col("vec_id").alias("key"), F.lit(1.0).alias("weight"), "rank")
    b = d.vectors.where("chunk_type = 'CODE'").select("vec_id").orderBy(F.desc("vec_id")).limit(15)
    b = V.ranked(b, F.desc("vec_id")).select(F.lit("variant"), "vec_id", F.lit(0.8), "rank")
    return a.union(b)


@query("V6_rank_fusion", f"with {_RANKS} select \"key\", round(sum(weight / (60 + r)), 9) score from x group by \"key\" order by sum(weight / (60 + r)) desc, \"key\" limit 10", "vectors")
def _(d):
    return V.fused(_ranks(d), 10).select("key", F.round("score", 9).alias("score"))


@query("Q11_retrieval_consistency", f"with {_RANKS} select round(avg(case when n > 1 then 1.0 else 0.0 end), 6) consistency from (select \"key\", count(distinct source) n from x group by \"key\") y", "vectors")
def _(d):
    return V.consistency(_ranks(d))


_TF = "ln(1 + (length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {n}) + case when length(text) > 200 and contains(substring(lower(text), 1, 200), '{t}') then 2 else 0 end"
_SCORE = f"case when contains(lower(text), 'the of') then 10 else 0 end + {_TF.format(t='the', n=3)} + {_TF.format(t='of', n=2)} + 5 * (case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'of') then 1 else 0 end) / 2.0"


@query("V8_keyword_rerank", f"select doc_id, round({_SCORE}, 6) score from documents where lang = 'en' and source is not null order by round({_SCORE}, 6) desc, doc_id limit 20")
def _(d):
    scored = d.documents.where("lang = 'en' and source is not null").withColumn("score", F.round(V.keyword_score(F.col("text"), "the of", ["the", "of"]), 6))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query("V11_readable", "select vec_id from vectors where acl is null or list_has_any(string_split(acl, ','), ['carol', 'dave'])", "vectors")
def _(d):
    return d.vectors.where(V.readable(F.col("acl"), ["Carol", "dave"])).select("vec_id")


@query("V12_intent_weights", f"with {_Q} select vec_id, round(1 / (2 - {_SIM}) * case chunk_type when 'CODE' then 1.5 when 'DB' then 0.5 else 1 end, 6) relevance from vectors, q", "vectors")
def _(d):
    found = d.vectors.withColumn("distance", 1 - V.cosine(F.col("embedding"), V.vector(_query(d))))
    return V.intent_weighted(found, {"CODE": 1.5, "DB": 0.5}).select("vec_id", F.round("relevance", 6).alias("relevance"))


_PAIR = "list_dot_product(cast(x.embedding as double[]), cast(y.embedding as double[])) / (sqrt(list_dot_product(cast(x.embedding as double[]), cast(x.embedding as double[]))) * sqrt(list_dot_product(cast(y.embedding as double[]), cast(y.embedding as double[]))))"


@query("V18_near_pairs", f"select x.vec_id a, y.vec_id b, round({_PAIR}, 6) similarity from embeddings x join embeddings y on x.vec_id < y.vec_id where {_PAIR} >= 0.4")
def _(d):
    found = I.near_pairs(d.embeddings, 0.4, copies=True)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("V18_probable_duplicates", f"with {_Q} select vec_id from vectors, q where {_SIM} >= 0.92", "vectors")
def _(d):
    return d.vectors.where(V.cosine(F.col("embedding"), V.vector(_query(d))) >= 0.92).select("vec_id")


@query("V20_count_by_source", "select source_uri, count(*) n from vectors group by source_uri", "vectors")
def _(d):
    return d.vectors.groupBy("source_uri").agg(F.count("*").alias("n"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query("Q4_answer_relevancy", f"select conv_id, turn, round(len(list_intersect({_SET.format(c='question')}, {_SET.format(c='answer')})) / len({_SET.format(c='question')}), 6) relevancy from qa where len({_SET.format(c='question')}) > 0", "qa")
def _(d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    q = words("question")
    return d.qa.where(F.size(q) > 0).select("conv_id", "turn", F.round(F.size(F.array_intersect(q, words("answer"))) / F.size(q), 6).alias("relevancy"))


@query("Q6_abstentions", "select conv_id, turn from qa where length(answer) < 20", "qa")
def _(d):
    return d.qa.where(F.length("answer") < 20).select("conv_id", "turn")
