"""Vector and keyword search, rank fusion, reranking and access filters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import materialize

#: The constant of reciprocal-rank fusion.
RRF = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays as doubles; the shorter one is filled with nulls, which make it null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(values: Sequence[float]) -> Column:
    return F.lit([float(x) for x in values])


def _similarities(column: pa.Array, query: np.ndarray) -> pa.Array:
    """Cosine of each vector with the query; null for a vector that is null, holds nulls, has another length or is of length zero."""
    values = column.flatten()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    fine = lengths == len(query)
    if values.null_count:
        of = np.repeat(np.arange(len(column)), lengths)
        fine[of[np.asarray(values.is_null())]] = False
    x = np.asarray(pc.fill_null(values, 0), dtype=float)
    x = x.reshape(-1, len(query)) if fine.all() else x[np.repeat(fine, lengths)].reshape(-1, len(query))
    out, norms = np.zeros(len(column)), np.zeros(len(column))
    out[fine], norms[fine] = x @ query, np.sqrt(np.einsum("ij,ij->i", x, x)) * np.linalg.norm(query)
    return pa.array(np.divide(out, norms, out=out, where=norms != 0), mask=~fine | (norms == 0))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, least: float | None = None) -> DataFrame:
    """The k rows of vectors (vec_id, embedding, ...) nearest to the query, with similarity; ties by vec_id.

    A scan that scores a block of rows at a time, with a per-task top k: only k rows a task are sent on.
    """
    asked = np.asarray(query, float)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _similarities(batch.column("embedding"), asked)], [*batch.schema.names, "similarity"])

    found = vectors.mapInArrow(scored, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "similarity double"]))
    if least is not None:
        found = found.where(F.col("similarity") >= least)
    return found.orderBy(F.desc_nulls_last("similarity"), "vec_id").limit(k)


def readable(acl: Column, principals: Sequence[str]) -> Column:
    """Whether a comma-separated list is empty or names one of the principals, in any case."""
    names = F.transform(F.split(F.lower(acl), r"\s*,\s*"), F.trim)
    return F.coalesce(F.trim(acl) == "", F.lit(True)) | F.arrays_overlap(names, F.lit([p.lower() for p in principals]))


def sources_of(ranked: DataFrame, source: str = "source_uri") -> DataFrame:
    """(source, place): the sources of ranked rows (rank), each at its first place."""
    return ranked.groupBy(source).agg(F.min("rank").alias("place"))


def ranked(found: DataFrame, *order: Column | str) -> DataFrame:
    """A short result list with its 1-based rank; for lists that are already cut to k."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def keyword_search(docs: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """Up to k documents (doc_id, text) that hold any of at most five terms of two or more letters, by doc_id."""
    used = [t for t in terms if len(t) >= 2][:5]
    hit = F.lit(False)
    for t in used:
        hit = hit | F.col("text").contains(t)
    return docs.where(hit).orderBy("doc_id").limit(k)


def fused(rankings: DataFrame, k: int) -> DataFrame:
    """Weighted reciprocal-rank fusion of (key, weight, rank): the k best keys with their score, ties by key."""
    score = F.sum(F.col("weight") / (RRF + F.col("rank")))
    return rankings.groupBy("key").agg(score.alias("score")).orderBy(F.desc("score"), "key").limit(k)


def query_terms(query: str) -> list[str]:
    """A query's terms in lower case, split at white space and at commas, full stops and marks of Chinese."""
    parts = re.split(r"[\s,，。？！]+", query.lower())
    while parts and not parts[-1]:
        parts.pop()
    return parts


def keyword_score(text: Column, query: str, terms: Sequence[str]) -> Column:
    """10 for the whole query; ln(1 + count) for each term; 5 x share of terms found; 2 for each term in the first 200 characters of longer texts.

    Terms of one character count as not found. A blank text scores 0.
    """
    low, used = F.lower(text), [t for t in terms if len(t) >= 2]
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in used]
    head = F.lower(F.substring(text, 1, 200))
    score = F.when(low.contains(query), 10.0).otherwise(0.0)
    for t, n in zip(used, counts, strict=True):
        score = score + F.log1p(n) + F.when((F.length(text) > 200) & head.contains(t), 2.0).otherwise(0.0)
    found = sum(((n > 0).cast("int") for n in counts), F.lit(0))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.0).otherwise(score + 5.0 * found / max(1, len(terms)))


def reranked(docs: DataFrame, query: str, k: int) -> DataFrame:
    """The k best of docs (doc_id, text) by keyword_score, ties by doc_id; no more than k docs keep their order by doc_id."""
    few = docs.limit(k + 1).count() <= k
    scored = docs.withColumn("score", keyword_score(F.col("text"), query.lower(), query_terms(query)))
    return scored.orderBy("doc_id") if few else scored.orderBy(F.desc("score"), "doc_id").limit(k)


def intent_weighted(found: DataFrame, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """found (distance, chunk_type) with relevance 1 / (1 + distance), one half where it is null, times its type's weight."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("chunk_type")], F.lit(default))
    return found.withColumn("relevance", F.coalesce(1 / (1 + F.col("distance")), F.lit(0.5)) * weight)


def consistency(rankings: DataFrame) -> DataFrame:
    """One row: the share of keys that more than one ranking has."""
    n = rankings.groupBy("key").agg(F.count_distinct("source").alias("n"))
    return n.agg(F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("consistency"))


#: Intents of questions by the words that tell them, the first that matches, and the weights of five channels.
INTENTS = (
    ("CHANGE_IMPACT", ("影响", "变更", "impact", "change")), ("SOLUTION_DESIGN", ("方案", "设计", "solution", "design")), ("CODE_EXPLANATION", ("代码", "实现", "code", "function", "method")),
    ("ARCHITECTURE_OVERVIEW", ("架构", "结构", "architecture", "overview")), ("DATA_LINEAGE", ("数据", "表", "字段", "data", "table", "lineage")),
)
CHANNELS = ("keyword", "vector", "graph", "claim", "convention")
INTENT_WEIGHTS = {
    "REQUIREMENT_UNDERSTANDING": (0.20, 0.35, 0.15, 0.25, 0.05), "CHANGE_IMPACT": (0.30, 0.20, 0.25, 0.10, 0.15), "SOLUTION_DESIGN": (0.15, 0.20, 0.20, 0.15, 0.30),
    "CODE_EXPLANATION": (0.25, 0.30, 0.25, 0.10, 0.10), "ARCHITECTURE_OVERVIEW": (0.05, 0.20, 0.30, 0.15, 0.30), "DATA_LINEAGE": (0.30, 0.15, 0.40, 0.10, 0.05),
}
#: Fixed values of the second router: intents, their words, and the weights of code, documents and database.
SOURCES = {"CODE_LOOKUP": (0.7, 0.2, 0.1), "DATA_LINEAGE": (0.3, 0.1, 0.6), "API_CHAIN": (0.6, 0.1, 0.3), "BUSINESS_FLOW": (0.3, 0.5, 0.2), "IMPACT_ANALYSIS": (0.5, 0.2, 0.3), "GENERAL": (0.33, 0.34, 0.33)}
SOURCE_WORDS = (
    ("API_CHAIN", ("调用链", "api chain", "call chain")), ("IMPACT_ANALYSIS", ("影响", "impact")), ("DATA_LINEAGE", ("血缘", "lineage", "数据流", "data flow")),
    ("BUSINESS_FLOW", ("业务流程", "business", "功能", "feature", "流程")), ("CODE_LOOKUP", ("类", "class", "方法", "method", "字段", "field", "接口", "interface")),
)


def _intent(query: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    low, found = F.lower(query), F.lit(None).cast("string")
    for name, words in rules:
        found = F.coalesce(found, F.when(low.rlike("|".join(words)), name))
    return F.coalesce(found, F.lit(default))


def intent(query: Column) -> Column:
    return _intent(query, INTENTS, "REQUIREMENT_UNDERSTANDING")


def source_intent(query: Column) -> Column:
    return _intent(query, SOURCE_WORDS, "GENERAL")


def weights_of(name: Column, table: dict[str, Sequence[float]], fields: Sequence[str]) -> Column:
    """Struct of an intent's weights."""
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.struct(*[F.lit(w).alias(f) for f, w in zip(fields, v, strict=True)]))])
    return F.try_element_at(entries, name)


def cites(answer: Column, ids: Column) -> Column:
    """Whether an answer names any of the ids."""
    return F.exists(ids, lambda i: F.contains(answer, i))


def hybrid(rankings: Sequence[tuple[str, float, DataFrame]], k: int, fuse: bool = True) -> DataFrame:
    """The k best keys of several short rankings (name, weight, (key, rank)), by rank fusion or, without it, by first occurrence."""
    rows = None
    for i, (name, weight, r) in enumerate(rankings):
        one = r.select(F.lit(name).alias("source"), F.lit(i).alias("channel"), F.lit(float(weight)).alias("weight"), "key", "rank")
        rows = one if rows is None else rows.union(one)
    if fuse:
        return fused(rows, k)
    first = rows.groupBy("key").agg(F.min(F.struct("channel", "rank")).alias("first"))
    return first.orderBy("first", "key").limit(k).select("key", (1 / (1.0 + F.col("first.channel") * 1000 + F.col("first.rank"))).alias("score"))


def claim_relevance(claims: DataFrame, terms: Sequence[str]) -> DataFrame:
    """claims with relevance: 3 for each term in the subject, 2 in the object, 1 in the predicate, times one half plus the confidence."""
    points = F.lit(0.0)
    for t in terms:
        for column, value in (("subject_key", 3.0), ("object_key", 2.0), ("predicate", 1.0)):
            points = points + F.when(F.contains(F.lower(column), F.lit(t.lower())), value).otherwise(0.0)
    return claims.withColumn("relevance", points * (0.5 + F.coalesce("confidence", F.lit(0.0))))


def cached_answer(cache: DataFrame, query: Sequence[float], now: Column, release: str | None, hours: int = 24, least: float = 0.95) -> DataFrame:
    """The nearest, then newest, unexpired entry of cache (key, embedding, release, created_at) of the same release (null equals null)."""
    live = cache.where(F.col("release").eqNullSafe(F.lit(release)) & (F.col("created_at") > now - F.make_dt_interval(F.lit(0), F.lit(hours))))
    near = live.withColumn("similarity", cosine(F.col("embedding"), vector(query))).where(F.col("similarity") >= least)
    return near.orderBy(F.desc("similarity"), F.desc("created_at"), "key").limit(1)


def hashed_bucket(token: Column, buckets: int = 256) -> Column:
    """Bucket of a token: its character codes as digits to base 31, modulo `buckets` (a divisor of 2^32)."""
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % buckets)


def hashed_vectors(docs: DataFrame, buckets: int = 256) -> DataFrame:
    """(id, bucket, weight) of docs (id, tokens): token counts by bucket, of length one; texts without tokens have no rows."""
    n = docs.select("id", F.explode("tokens").alias("t")).groupBy("id", hashed_bucket(F.col("t"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))
    return n.select("id", "bucket", (F.col("n") / norm).alias("weight"))


#: Pairs of a query and a doc that a task of `similar_texts` adds up at most, some 100 bytes each; rows of queries that it broadcasts at most.
PAIRS, HELD_ROWS = 1_000_000, 1_000_000


def similar_texts(queries: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(query, id, similarity): the k most similar docs for each query by hashed vectors, over 0; an equi-join on buckets.

    Docs are dealt by id, at most some PAIRS pairs a task, before they meet the queries, so a pair is added up where
    its doc is and never shuffled; only the k first of each task are. Queries of over HELD_ROWS rows are not broadcast.
    """
    q = hashed_vectors(queries).select(F.col("id").alias("query"), "bucket", F.col("weight").alias("w"))
    q, _ = materialize(q, "queries")
    held = q.agg(F.count("*").alias("rows"), F.count_distinct("query").alias("n")).first()
    parts = max(1, -(-docs.count() * held["n"] // PAIRS))
    dealt = hashed_vectors(docs.repartition(parts, "id"))
    met = dealt.join(F.broadcast(q) if held["rows"] <= HELD_ROWS else q, "bucket").where("id <> query")
    s = met.groupBy("query", "id").agg(F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("w"))).alias("similarity")).where("similarity > 0")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("r") <= k).drop("r")


def keyword_nodes(nodes: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """The k nodes whose text holds most of the terms, by score then key: id, node_key, score, confidence."""
    low = F.lower(F.concat_ws(" ", "node_name", "node_key", "node_type"))
    score = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in sorted(set(terms))), F.lit(0))
    return nodes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "node_key").limit(k).select("id", "node_key", "score", "confidence")
