"""Blocking for entity resolution: MinHash bands retrieve, crowded blocks split, a weighted graph of blocks is pruned by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import bigrams
from skein.storage import materialize

#: Prime modulus of the hash family x -> (a x + b) mod p, and the generators whose powers are its a and b.
PRIME, GENERATORS = 2_147_483_647, (48_271, 69_621)


def family(size: int) -> list[tuple[int, int]]:
    """(a, b) of `size` hash functions."""
    return [tuple(pow(g, i + 1, PRIME) for g in GENERATORS) for i in range(size)]


def signature(text: Column, size: int) -> Column:
    """Least hash of a text's bigrams under each of `size` functions; null for texts without bigrams."""
    base = F.transform(bigrams(text), lambda b: (F.ascii(b) * 31 + F.ascii(F.substring(b, 2, 1)) + 1).cast("long"))
    each = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in family(size)))
    return F.when(F.size(base) > 0, F.transform(each, lambda f: F.array_min(F.transform(base, lambda h: (h * f.a + f.b) % PRIME))))


def name_classes(nodes: DataFrame) -> DataFrame:
    """(id, node_type, name, rep): nodes with a name of two characters or more; rep is the least id of their type and name in any case."""
    name = F.lower(F.trim("node_name"))
    named = nodes.where(F.length(F.coalesce(name, F.lit(""))) >= 2).select("id", "node_type", name.alias("name"))
    least = named.groupBy("node_type", "name").agg(F.min("id").alias("rep"))
    return named.join(least, ["node_type", "name"])


def lsh_blocks(nodes: DataFrame, bands: int = 20, rows: int = 2, bound: int = 200) -> tuple[DataFrame, DataFrame]:
    """(blocks (key, id) of 2 to `bound` names, stars (key, a, b) of crowds that no hash tells apart).

    Only one node of each type and name takes part. A band is `rows` places of the signature; where more than `bound` names
    share one, they are told apart by three bands' places, then by the whole signature. Names that share even that (the same
    bigrams in another order) are tied to the least id of them, a star, instead of to each other.
    """
    size = bands * rows
    sig = signature(F.col("name"), size)
    twice = F.concat("sig", "sig")
    said = lambda b, n: F.concat_ws(":", "node_type", b.cast("string"), F.array_join(F.slice(twice, b * rows + 1, n), ","))
    reps = name_classes(nodes).where("id = rep").select("id", "node_type", sig.alias("sig")).where("sig is not null")
    at = reps.select("id", "node_type", "sig", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    keys, _ = materialize(at.select("id", *(said(F.col("band"), n).alias(f"k{i}") for i, n in enumerate((rows, min(3 * rows, size), size)))), "bands")
    found, rest = [], keys
    for level in ("k0", "k1", "k2"):
        counts = rest.groupBy(level).agg(F.count("*").alias("n")).where("n > 1")
        found.append(rest.join(counts.where(F.col("n") <= bound), level).select(F.col(level).alias("key"), "id"))
        rest = rest.join(counts.where(F.col("n") > bound), level, "left_semi")
    least = rest.groupBy("k2").agg(F.min("id").alias("a"))
    stars = rest.join(least, "k2").where("id <> a").select(F.col("k2").alias("key"), "a", F.col("id").alias("b"))
    return found[0].union(found[1]).union(found[2]), stars


def weighted_pairs(blocks: DataFrame, stars: DataFrame) -> DataFrame:
    """(a, b, weight): names that share blocks, a < b, with how many: each row of a block meets at most the block's bound."""
    other = blocks.select("key", F.col("id").alias("b"))
    inside = blocks.withColumnRenamed("id", "a").join(other, "key").where("a < b").select("a", "b")
    return inside.union(stars.select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


def pruned_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs whose weight is at least the mean weight of the pairs of either of their nodes (in whole numbers)."""
    ends = pairs.select(F.col("a").alias("id"), "weight").union(pairs.select("b", "weight"))
    mean = ends.groupBy("id").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    of = lambda end: mean.select(F.col("id").alias(end), F.col("total").alias(f"t{end}"), F.col("n").alias(f"n{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where((F.col("weight") * F.col("na") >= F.col("ta")) | (F.col("weight") * F.col("nb") >= F.col("tb"))).select("a", "b", "weight")


def resolution_pairs(nodes: DataFrame, bands: int = 20, rows: int = 2, bound: int = 200) -> DataFrame:
    """(a, b), a < b: nodes (id, node_type, node_name) of one type that may be one entity.

    Names whose bigrams have a Jaccard similarity of 0.5 or more meet with probability 0.99 and over before pruning (the test
    measures 0.9 of all such pairs after it). Nodes of one name are each tied to the least id of them. Pairs grow with the
    nodes: at most `bound` a node and band. Nodes without a name of two characters have no pair.
    """
    pairs, _ = materialize(weighted_pairs(*lsh_blocks(nodes, bands, rows, bound)), "pairs")
    same = name_classes(nodes).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return pruned_pairs(pairs).select("a", "b").union(same)
