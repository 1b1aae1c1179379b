"""Training-data pipeline over `documents`: quality, near-duplicates, repeated passages, benchmark leaks, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.decontaminate import decontaminate
from skein.llm.mixing import mix
from skein.llm.quality import select_quality
from skein.llm.simhash import near_duplicate_components
from skein.llm.substring_dedup import substring_dedup
from skein.storage import drop, materialize, scratch, scratch_path

#: Words of a repeated passage. Shorter repeats, such as notices and idioms, stay.
PASSAGE_WORDS = 50
#: Shares of tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the best grade (neither toxic nor of low quality) is under one half.

    Without labelled documents all stay. Null and blank texts are judged by a feature of their own, repeated
    rows alike; an empty table gives an empty one; other columns play no part.
    """
    return select_quality(docs, _table(spark, sf_dir, "labels")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest doc_id, of its texts the first by hash, of its repeated rows one.

    SimHash finds candidates; a pair links when the Jaccard similarity of its sets of five-word
    shingles is 0.8 or more. Null and blank texts are one group. Documents without an id stay. An empty
    table gives an empty one; other columns play no part.
    """
    key = F.xxhash64("text")
    rows = near_duplicate_components(docs.select("doc_id", "text", key.alias("text_key")), width=5, least=0.8, also="text_key").where("doc_id is not null")
    per, _ = materialize(rows.groupBy("doc_id", "text_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "rows")
    first = per.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    lost = per.join(first, "component_id").where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key")
    again = per.where("n > 1").select("doc_id", "text_key")
    left = docs.withColumn("text_key", key).join(lost, ["doc_id", "text_key"], "left_anti")
    one = left.join(again, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.join(again, ["doc_id", "text_key"], "left_anti").unionByName(one).select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too; documents of which nothing stays go.

    Rows of one doc_id are no smaller than each other, a null doc_id is the largest. Null, blank and
    short texts stay as they are; in others the layout around what is cut stays. n_chars, where there is
    one, follows the text.
    """
    out = substring_dedup(docs, width=PASSAGE_WORDS, keep_layout=True).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", text).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or all but all of one.

    Null and blank texts stay, as do all without a benchmark; repeated rows go or stay together; other
    columns play no part.
    """
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's rate, by which the corpus meets TARGETS. Every document stays: its rate is the decision.

    n_tokens, posterior and rate replace columns of these names. Null and blank texts have 0 tokens; without
    labelled documents every rate is 1; an empty table gives an empty one.
    """
    labelled = docs.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", F.col("lang").alias("domain"))
    return mix(docs, labelled, TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
]

#: The fits, fingerprints and rates are not SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet in the shared folder and read again."""
    docs, last = _table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
