"""A posting index of trigrams: texts that may hold a term, then the term itself is looked for in those only."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import scratch_path

#: Buckets of postings; a gram's list lies in one of them, a search reads the files of its grams' buckets.
BUCKETS = 64
#: Grams of a term that are intersected, the rarest ones.
GRAMS = 4


@dataclass(frozen=True)
class TrigramIndex:
    """postings: (bucket, gram, doc_id) by bucket, sorted by gram; counts: (gram, n); buckets: of how many."""

    postings: str
    counts: str
    buckets: int


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text, A-Z in lower case, none for shorter ones; one pass over its characters."""
    chars = F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), "")
    runs = lambda x: F.filter(F.transform(x, lambda c, i: F.concat(c, F.get(x, i + 1), F.get(x, i + 2))), lambda g: g.isNotNull())
    return F.array_distinct(F.get(F.transform(F.array(chars), runs), 0))  # bound once, see runs


def term_grams(term: str) -> list[str]:
    low = term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build_trigrams(docs: DataFrame, buckets: int = BUCKETS) -> TrigramIndex:
    """Indexes whole texts of docs (doc_id, text): a row for each gram and document that holds it.

    Rows are dealt by bucket and by document, so the list of a gram that all texts hold is written by several tasks. Texts
    that are null or shorter than three characters have no gram; repeated ids are one document here (see `containing`).
    """
    spark = docs.sparkSession
    each = docs.where("text is not null").select("doc_id", F.explode(grams_of(F.col("text"))).alias("gram"))
    index = TrigramIndex(scratch_path(spark, "postings"), scratch_path(spark, "grams"), buckets)
    rows = each.withColumn("bucket", _bucket(F.col("gram"), buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    rows.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").option("compression", "zstd").parquet(index.postings)
    spark.read.schema("gram string, doc_id long, bucket int").parquet(index.postings).groupBy("gram").agg(F.count("*").alias("n")).write.parquet(index.counts)
    return index


def postings_of(spark: SparkSession, index: TrigramIndex, gram: str) -> DataFrame:
    """(doc_id): a gram's list; the files of its bucket are read, of these the row groups that may hold it."""
    rows = spark.read.schema("gram string, doc_id long, bucket int").parquet(index.postings)
    return rows.where((F.col("bucket") == _bucket(F.lit(gram), index.buckets)) & (F.col("gram") == gram)).select("doc_id")


def candidates(spark: SparkSession, index: TrigramIndex, term: str) -> DataFrame | None:
    """(doc_id): documents that hold the term's rarest grams, the shortest list first; None for terms without a gram.

    A gram that no text holds gives no document.
    """
    grams = term_grams(term)
    if not grams:
        return None
    known = {r["gram"]: r["n"] for r in spark.read.parquet(index.counts).where(F.col("gram").isin(grams)).collect()}
    if len(known) < len(grams):
        return spark.createDataFrame([], "doc_id long")
    rare = sorted(grams, key=lambda g: (known[g], g))[:GRAMS]
    found = postings_of(spark, index, rare[0]).distinct()
    for g in rare[1:]:
        found = found.join(postings_of(spark, index, g), "doc_id", "left_semi")
    return found


def containing(docs: DataFrame, index: TrigramIndex, terms: Sequence[str]) -> DataFrame:
    """The rows of docs whose text holds any of the terms as it is, letter case included: the same as a scan.

    A term of under three characters has no gram, and then all texts are looked at.
    """
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.col("text").contains(t)
    lists = [candidates(docs.sparkSession, index, t) for t in terms]
    if not lists:
        return docs.where(hit)
    if any(c is None for c in lists):
        return docs.where(hit)
    some = lists[0]
    for c in lists[1:]:
        some = some.union(c)
    return docs.join(some.distinct(), "doc_id", "left_semi").where(hit)
