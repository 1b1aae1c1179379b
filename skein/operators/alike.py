"""Pairs of rows that belong together by class and are alike by vector: classes meet once, their vectors a block at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.similarity import similar_sets
from skein.storage import materialize, start_of

#: Rows of a class in one tile, about: crowded classes are cut into tiles that meet pairwise.
TILE = 2_000
#: Rows of a task's group, about: small classes share one.
GROUP = 8_000


def classes_of(rows: DataFrame) -> DataFrame:
    """(class, tokens): the different token sets (sorted arrays) of rows by number; written once, so a number stays with its set."""
    return materialize(rows.select("tokens").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")[0]


def alike(a: DataFrame, b: DataFrame, meets: DataFrame, least: float, kinds: Sequence[tuple[int, int]] = ((0, 0),)) -> DataFrame:
    """(a, b, value, cosine): rows of a and b (class, id, kind, embedding) whose classes meet and whose cosine is `least` or more.

    meets: (a, b, value), pairs of classes, each once. kinds: the pairs of kinds that are wanted. A tile of a class meets a tile of the
    other in one product, so pairs are neither rows nor shuffled before their cosine is known; it is then put as the plain formula
    has it. A cosine that is no number counts as `least`, one of a vector of length zero, with nulls or of another dimension than the other's as none.
    """
    spark = a.sparkSession
    cut = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    held = lambda df, e: df.groupBy(F.col("class").alias(e)).agg(F.count("*").alias(f"n{e}"))
    met = meets.join(held(a, "a"), "a").join(held(b, "b"), "b").select("a", "b", "value", cut("na").alias("ta"), cut("nb").alias("tb"), (F.col("na") * cut("nb") + F.col("nb") * cut("na")).alias("sent"))
    met, _ = materialize(met.withColumn("meet", F.monotonically_increasing_id()), "meets")
    groups = max(start_of(spark), -(-(met.agg(F.sum("sent")).first()[0] or 0) // GROUP))

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        """Each row in its tile, for every tile of every class that its own meets."""
        at = {own: F.pmod(F.xxhash64("id"), F.col(f"t{own}")).cast("int").alias(f"i{own}"), other: F.explode(F.sequence(F.lit(0), F.col(f"t{other}") - 1)).alias(f"i{other}")}
        rows = df.withColumnRenamed("class", own).join(met.drop("value", "sent"), own)
        each = rows.select("meet", at["a"], at["b"], F.lit(side).alias("side"), F.col("id").alias(own), "kind", F.col("embedding").cast("array<double>").alias("embedding"))
        return each.select(F.pmod(F.xxhash64("meet", "ia", "ib"), F.lit(groups)).cast("int").alias("bucket"), "meet", "ia", "ib", "side", *[F.col(own).alias(own) if e == own else F.lit(None).cast(kind[e]).alias(e) for e in "ab"], "kind", "embedding")

    kind = {e: df.schema["id"].dataType.simpleString() for e, df in (("a", a), ("b", b))}
    usable = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null) and exists(embedding, x -> x <> 0)"
    wanted = np.zeros((max(k[0] for k in kinds) + 1, max(k[1] for k in kinds) + 1), bool)
    for i, j in kinds:
        wanted[i, j] = True
    pairs = dealt(a.where(usable), "a", "b", 0).unionByName(dealt(b.where(usable), "b", "a", 1))

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        meet, ia, ib, side, code = (np.asarray(table.column(c)) for c in ("meet", "ia", "ib", "side", "kind"))
        lists = table.column("embedding").combine_chunks()
        start, values = np.asarray(lists.offsets), np.asarray(lists.values)
        size = np.diff(start)
        order = np.lexsort((side, size, ib, ia, meet))
        new = np.any([v[order][1:] != v[order][:-1] for v in (meet, ia, ib, size)], axis=0) if len(order) else np.zeros(0, bool)
        left, right, cosines = [], [], []
        for block in np.split(order, np.flatnonzero(new) + 1):
            p, q = block[side[block] == 0], block[side[block] == 1]
            if not len(p) or not len(q) or not wanted[np.ix_(np.unique(code[p]), np.unique(code[q]))].any():
                continue
            u, v = (values[start[z][:, None] + np.arange(size[block[0]])] for z in (p, q))
            with np.errstate(all="ignore"):
                y = _unit(v).T
                for at in range(0, len(p), 500):
                    sim = _unit(u[at : at + 500]) @ y
                    i, j = np.nonzero(~(sim < least - 1e-9) & wanted[np.ix_(code[p[at : at + 500]], code[q])])
                    for some in range(0, len(i), 1 << 16):
                        m, n = at + i[some : some + (1 << 16)], j[some : some + (1 << 16)]
                        left.append(p[m]), right.append(q[n]), cosines.append(plain_cosine(u[m], v[n]))
        i, j, cosine = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((left, np.int64), (right, np.int64), (cosines, float)))
        keep = ~(cosine < least)
        i, j, cosine = i[keep], j[keep], cosine[keep]
        return pa.table({"a": table.column("a").take(pa.array(i)), "b": table.column("b").take(pa.array(j)), "meet": meet[i], "cosine": cosine})

    found = pairs.groupBy("bucket").applyInArrow(solve, f"a {kind['a']}, b {kind['b']}, meet long, cosine double")
    return found.join(met.select("meet", "value"), "meet").select("a", "b", "value", "cosine")


def alike_sets(a: DataFrame, b: DataFrame, share: float, least: float) -> DataFrame:
    """(a, b, score, cosine): pairs of sets (id, tokens, embedding) by `similar_sets`' share whose cosine is `least` or more, by `alike`."""
    tokens = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull()))).alias("tokens")
    x, y = (materialize(rows.select("id", tokens, "embedding").where("size(tokens) > 0"), "sets")[0] for rows in (a, b))
    classes = classes_of(x.select("tokens").union(y.select("tokens")))
    own = lambda rows: classes.join(rows.select("tokens").distinct(), "tokens", "left_semi").select(F.col("class").alias("id"), "tokens")
    meets = similar_sets(own(x), own(y), share).withColumnRenamed("score", "value")
    side = lambda rows: rows.join(classes, "tokens").select("class", "id", F.lit(0).alias("kind"), "embedding")
    return alike(side(x), side(y), meets, least).withColumnRenamed("value", "score")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def plain_cosine(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows, component after component, as `retrieval.cosine` adds them."""
    dot, uu, vv = (np.cumsum(z, axis=1)[:, -1] for z in (u * v, u * u, v * v))
    return dot / (np.sqrt(uu) * np.sqrt(vv))
