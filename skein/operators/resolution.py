"""Entity resolution: blocking, candidate pairs, scores by several kinds of evidence, decisions, and merging in the graph."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein.functions.text import bigrams, blocking_name, without_suffix
from skein.operators.alike import alike, classes_of
from skein.operators.components import connected_components
from skein.operators.retrieval import cosine
from skein.operators.scans import numbered
from skein.operators.similarity import ordered_sets
from skein.storage import materialize

#: Weights of the parts of a composite score, and the scores from which a pair merges or is reviewed.
WEIGHTS = {"name": 0.35, "struct": 0.25, "evidence": 0.20, "runtime": 0.10, "history": 0.10}
MERGE, REVIEW, KEEP = 0.85, 0.50, 0.15
#: Sources that are machine guesses.
AI = ("AI_INFERENCE", "DOC_AI")


def blocking_keys(nodes: DataFrame, suffixes: Sequence[str] = ("ServiceImpl", "Controller", "Service", "Mapper", "Entity"), aliases: str | None = None) -> DataFrame:
    """(id, key): prefix, bigrams, core name and aliases (an array column) of every named node, prefixed by its type."""
    name = F.trim("node_name")
    core = without_suffix(name, suffixes)
    prefix = F.substring(blocking_name(name), 1, 3)
    keys = [
        F.when(prefix != "", F.array(F.concat(F.lit("A:"), prefix))).otherwise(F.array().cast("array<string>")),
        F.transform(bigrams(name), lambda b: F.concat(F.lit("B:bi:"), b)),
        F.when(core != name, F.array(F.concat(F.lit("B:core:"), core))).otherwise(F.array().cast("array<string>")),
    ]
    if aliases:
        keys.append(F.transform(F.filter(aliases, lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("C:"), F.lower(F.trim(a)))))
    made = F.transform(F.array_distinct(F.concat(*keys)), lambda k: F.concat("node_type", F.lit(":"), k))
    return nodes.where(F.coalesce(name, F.lit("")) != "").select("id", F.explode(made).alias("key"))


def blocks(keys: DataFrame) -> DataFrame:
    """(key, members) of blocks with two or more members."""
    return keys.groupBy("key").agg(F.count_distinct("id").alias("members")).where("members > 1")


def minhash_signature(text: Column, size: int) -> Column:
    """Least of base * (i + 1) + 31 * i over a text's bigrams, for i < size; base is 31 * first + second character code."""
    base = F.transform(bigrams(text), lambda b: F.ascii(b) * 31 + F.ascii(F.substring(b, 2, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_min(F.transform(base, lambda h: h * (i + 1) + i * 31)))


def signature_similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): different nodes that share a block, a < b, each pair once: all pairs, as many as the square of a block. See `blocking` for bounded ones."""
    other = keys.select("key", F.col("id").alias("b"))
    return keys.withColumnRenamed("id", "a").join(other, "key").where("a < b").select("a", "b").distinct()


def window_pairs(nodes: DataFrame, reach: int = 50) -> DataFrame:
    """(a, b): nodes of one type and source within `reach` places of each other by name.

    Places count over all types and sources, range by range, as these stand together in the order. They are cut in runs of
    `reach`: a node meets its own run and the next, an equi-join, not a range join.
    """
    n = numbered(nodes.select("id", "node_type", "source_type", "node_name"), "p", "node_type", "source_type", "node_name", "id").drop("node_name").withColumn("run", F.floor(F.col("p") / reach))
    near = n.select(F.col("id").alias("b"), F.col("p").alias("q"), "node_type", "source_type", F.explode(F.array("run", F.col("run") - 1)).alias("run"))
    return n.withColumnRenamed("id", "a").join(near, ["node_type", "source_type", "run"]).where((F.col("q") > F.col("p")) & (F.col("q") < F.col("p") + reach)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    other = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(other) + 1, np.int64)
    for c in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], np.where(other == ord(c), row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    return int(row[-1])


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names in any case, 0 for a missing one, else .6 x common subsequence (Dice) + .25 x prefix + .15 x suffix, both by the shorter name."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    least = F.least(F.length(x), F.length(y))
    score = 0.6 * (2 * _common(x, y) / (F.length(x) + F.length(y))) + 0.25 * shared_prefix(x, y) / least + 0.15 * shared_prefix(F.reverse(x), F.reverse(y)) / least
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(x == y, 1.0).otherwise(score)


def set_overlap(pairs: DataFrame, members: DataFrame, both_empty: float, larger: bool) -> DataFrame:
    """pairs (a, b) with score: shared members over the union, or over the `larger` set; members: (id, member), distinct.

    Sets are not collected: sizes are counted by id, shared members by an equi-join. Only members of ids in
    pairs take part; they are written once.
    """
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    members, _ = materialize(members.join(used, "id", "left_semi"), "members")
    size = members.groupBy("id").agg(F.count("*").alias("n"))
    m = lambda end: members.select(F.col("id").alias(end), "member")
    shared = pairs.join(m("a"), "a").join(m("b"), ["b", "member"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = lambda end: size.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"))
    out = pairs.join(shared, ["a", "b"], "left").join(n("a"), "a", "left").join(n("b"), "b", "left")
    na, nb, s = (F.coalesce(c, F.lit(0)) for c in ("na", "nb", "shared"))
    whole = F.greatest(na, nb) if larger else na + nb - s
    return out.select("a", "b", F.when((na == 0) & (nb == 0), both_empty).when((na == 0) | (nb == 0), 0.0).otherwise(s / whole).alias("score"))


def neighbours_of(edges: DataFrame) -> DataFrame:
    """(id, member): each node's neighbours, whichever way edges point."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("member")).union(edges.select("dst", "src")).distinct()


def runtime_score(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(x & y, 0.5).when(x | y, 0.2).otherwise(0.0)


def scored_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """pairs (a, b) with name, struct, evidence, runtime, history, score and decision; scores up to KEEP are dropped.

    nodes: id, node_name, source_type, runtime_verified; evidence: (id, evidence). Two guesses, or nodes of different sources, never merge unseen.
    """
    of = lambda end: nodes.select(F.col("id").alias(end), F.struct("node_name", "source_type", "runtime_verified").alias(f"n{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("name", name_score(F.col("na.node_name"), F.col("nb.node_name")))
    struct = set_overlap(pairs, neighbours_of(edges), 1.0, False).withColumnRenamed("score", "struct")
    shared = set_overlap(pairs, evidence.select("id", F.col("evidence").alias("member")).distinct(), 0.0, True).withColumnRenamed("score", "evidence")
    out = both.join(struct, ["a", "b"]).join(shared, ["a", "b"]).withColumn("runtime", runtime_score(F.col("na.runtime_verified"), F.col("nb.runtime_verified")))
    out = out.withColumn("history", F.when(F.col("name") > 0.7, 0.3).otherwise(0.0)).withColumn("score", sum(w * F.col(c) for c, w in WEIGHTS.items())).where(F.col("score") > KEEP)
    guesses = F.col("na.source_type").isin(*AI) & F.col("nb.source_type").isin(*AI)
    sure = (F.col("score") >= MERGE) & ~guesses & F.col("na.source_type").eqNullSafe(F.col("nb.source_type"))
    return out.select("a", "b", *WEIGHTS, "score", decision(F.col("score"), sure).alias("decision"))


def decision(score: Column, sure: Column) -> Column:
    return F.when(sure, "AUTO_MERGE").when(score >= REVIEW, "REVIEW").otherwise("REJECT")


def merged_graph(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, lineage) after pairs (a, b) merge: each group of merged nodes becomes its smallest id.

    Edges follow their ends; loops that arise go, and of edges that become equal (src, dst, edge_type) the
    least id stays. lineage: (id, merged_into).
    """
    lineage = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).where("id <> component").select("id", F.col("component").alias("merged_into"))
    kept = nodes.join(lineage.select("id"), "id", "left_anti")
    to = lambda end: lineage.select(F.col("id").alias(end), F.col("merged_into").alias(f"new_{end}"))
    moved = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left").withColumn("was", F.struct("src", "dst"))
    moved = moved.withColumn("src", F.coalesce("new_src", "src")).withColumn("dst", F.coalesce("new_dst", "dst")).where((F.col("src") != F.col("dst")) | (F.col("was.src") == F.col("was.dst")))
    return kept, moved.groupBy("src", "dst", "edge_type").agg(F.min("id").alias("id")), lineage


def cross_type_candidates(nodes: DataFrame, evidence: DataFrame, vectors: DataFrame, type_pairs: Sequence[tuple[str, str]], shared: int = 2, least: float = 0.7) -> DataFrame:
    """(a, b, shared, similarity): nodes of paired types with enough evidence in common whose vectors are alike ((cosine + 1) / 2).

    evidence: (id, evidence), vectors: (id, embedding). Nodes with the same evidence are one class; classes come together by their
    rarer evidence, not by all that they share, and their nodes' vectors a block at a time (`alike`).
    Nodes without a vector are in no pair, so they are left out before any are made: pairs are bounded by the vectors.
    """
    lists = evidence.where("evidence is not null").join(vectors.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("evidence")).alias("tokens")).where(F.size("tokens") >= shared)
    lists, _ = materialize(lists, "evidence")
    classes = classes_of(lists)
    sets = ordered_sets(classes.select(F.lit(0).alias("side"), F.col("class").alias("id"), "tokens"))
    # sets that share enough share one of their n - shared + 1 rarest, so what most nodes have brings none together
    first = sets.select("id", "tokens", F.posexplode("tokens").alias("at", "x"), "n").where(F.col("at") <= F.col("n") - shared).withColumn("token", F.col("x.token"))
    end = lambda e: first.select("token", F.col("id").alias(e), F.col("tokens").alias(f"s{e}"))
    met = end("a").join(end("b"), "token").withColumn("common", F.array_intersect("sa", "sb"))
    meets = met.where((F.get("common", F.lit(0))["token"] == F.col("token")) & (F.size("common") >= shared)).select("a", "b", F.size("common").cast("long").alias("value"))
    types = sorted({t for p in type_pairs for t in p})
    kind = F.array_position(F.lit(types), F.col("node_type")).cast("int") - 1
    rows = lists.join(classes, "tokens").select("id", "class").join(nodes.where(F.col("node_type").isin(types)).select("id", kind.alias("kind")), "id").join(vectors, "id")
    side = lambda at: rows.where(F.col("kind").isin(sorted({types.index(p[at]) for p in type_pairs})))
    found = alike(side(0), side(1), meets, 2 * least - 1 - 1e-9, [(types.index(x), types.index(y)) for x, y in type_pairs])
    return found.select("a", "b", F.col("value").alias("shared"), ((F.col("cosine") + 1) / 2).alias("similarity")).where(F.col("similarity") >= least)


def semantic_similarity(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def token_similarity(a: Column, b: Column, least_length: int = 4, small: int = 3) -> Column:
    """Shared tokens over the smaller set. A single token must be equal and long enough; sets of fewer than `small` must be contained."""
    inner = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    one = F.when((inner == least) & (F.length(F.when(F.size(a) <= F.size(b), F.get(a, 0)).otherwise(F.get(b, 0))) >= least_length), 1.0).otherwise(0.0)
    return F.when(inner == 0, 0.0).when(least < 2, one).when((inner != least) & (least < small), 0.0).otherwise(inner / least)


def list_similarity(a: Column, b: Column) -> Column:
    """The larger of two lists' Jaccard similarity and their common subsequence over the longer length; lists must not hold over 55 000 fields."""
    every = F.array_distinct(F.concat(a, b))
    coded = lambda x: F.array_join(F.transform(x, lambda f: F.char(F.array_position(every, f).cast("long") + 32)), "")
    whole = F.size(F.array_union(a, b))
    return F.greatest(F.try_divide(F.size(F.array_intersect(a, b)), whole), F.try_divide(_common(coded(a), coded(b)), F.greatest(F.size(a), F.size(b))))


def derived_aliases(name: Column, suffixes: Sequence[str], synonyms: dict[str, str], initials: dict[str, str] | None = None) -> Column:
    """A name's aliases: itself, its core, the core with a synonym put in, and, given a table of letters, its initials; sorted, distinct."""
    core = without_suffix(name, suffixes)
    other = core
    for word, also in sorted(synonyms.items()):
        other = F.replace(other, F.lit(word), F.lit(also))
    found = F.array(name, core, other)
    if initials:
        table = F.create_map(*[F.lit(x) for kv in initials.items() for x in kv])
        letters = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(""))), "")
        found = F.concat(found, F.array(letters))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def camel_score(a: Column, b: Column) -> Column:
    """2 for a common beginning (one name starts with the other), 1 if one holds the other, 1 for a shared word."""
    low, other = F.lower(a), F.lower(b)
    starts = low.startswith(other) | other.startswith(low)
    words = lambda x: F.split(F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")), " ")
    return F.when(starts, 2).otherwise(0) + F.when(F.contains(low, other) | F.contains(other, low), 1).otherwise(0) + F.when(F.arrays_overlap(words(a), words(b)), 1).otherwise(0)
