"""Similarity joins and blocking against all pairs: same rows, bounded joins, recall."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import blocking as B
from skein.operators import similarity as S


def plain(a, b, least, small=1, length=0):
    out = set()
    for (i, x), (j, y) in itertools.product(a, b):
        x, y = set(x) - {None}, set(y) - {None}
        m, n = min(len(x), len(y)), len(x & y)
        if not n or (m < small and n < m) or n / m < least - 1e-12 or (m == 1 and len(next(iter(x & y))) < length):
            continue
        out.add((i, j, round(n / m, 9)))
    return out


def sets(spark, rows):
    return spark.createDataFrame([(list(t), i, "x") for i, t in rows], "tokens array<string>, id long, n string")


@pytest.mark.parametrize("least,small,length", [(0.5, 1, 0), (0.55, 3, 4), (0.3, 1, 0), (1.0, 1, 2)])
def test_same_rows_as_all_pairs(spark, least, small, length):
    rng = np.random.default_rng(int(least * 100))
    words = [f"w{i}" if i % 2 else f"word{i}" for i in range(40)]
    draw = lambda: [str(w) for w in rng.choice(words, int(rng.integers(0, 8)), p=np.arange(40, 0, -1) / 820)]
    a, b = [(i, draw()) for i in range(70)], [(i, draw() + [None] * (i % 3 == 0)) for i in range(60)]
    got = S.similar_sets(sets(spark, a), sets(spark, b), least, small, length).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b, round(r.score, 9)) for r in got} == plain(a, b, least, small, length)
    own = S.similar_sets(sets(spark, a), None, least, small, length).collect()
    assert {(r.a, r.b, round(r.score, 9)) for r in own} == {x for x in plain(a, a, least, small, length) if x[0] < x[1]} and len(own) == len({(r.a, r.b) for r in own})


def test_a_token_in_every_row_joins_nothing_by_itself(spark):
    """2 000 sets that all hold one token: the join meets pairs of rare tokens only."""
    rows = [(i, ["common", f"a{i // 2}", f"b{i // 2}", f"c{i}"]) for i in range(2000)]
    ordered = S.ordered_sets(sets(spark, rows).selectExpr("0 as side", "id", "tokens"))
    least = 0.7
    first = ordered.selectExpr("id", "n", "posexplode(tokens) as (at, x)").where(f"at <= n - {math.ceil(4 * least)}")
    assert first.where("x.token = 'common'").count() == 0
    assert S.candidates(ordered, least, same=True).count() == 1000
    assert S.similar_sets(sets(spark, rows), None, least).count() == 1000


def test_empty_sets(spark):
    none = sets(spark, [])
    assert S.similar_sets(none, none, 0.5).collect() == [] and S.similar_sets(sets(spark, [(1, []), (2, [None])]), None, 0.5).collect() == []


def names(spark, rows):
    return spark.createDataFrame([(f"n{i:05d}", t, x, 5) for i, (t, x) in enumerate(rows)], "id string, node_type string, node_name string, key int")


def bigram_set(x):
    x = x.strip().lower()
    return {x[i : i + 2] for i in range(len(x) - 1)}


def test_recall_of_blocking(spark):
    """Of all pairs of names with a bigram similarity of 0.5 or more, 0.9 are left after pruning; far fewer pairs than all."""
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(4, 9)))).capitalize() for _ in range(150)]
    rows = []
    for _ in range(500):
        name = "".join(rng.choice(parts, 3))
        rows.append(("Service", name))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(name)))
            rows.append(("Service", name[:at] + str(rng.choice(list("xyz"))) + name[at + 1 :]))
    found = {(r.a, r.b) for r in B.resolution_pairs(names(spark, rows)).collect()}
    grams = [bigram_set(x) for _, x in rows]
    near = {(f"n{i:05d}", f"n{j:05d}") for i, j in itertools.combinations(range(len(rows)), 2) if len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])}
    assert len(near) > 300 and len(near & found) >= 0.9 * len(near)
    assert len(found) < 0.05 * len(rows) * (len(rows) - 1) / 2


def test_crowds_are_bounded(spark):
    """Names that share nearly all bigrams split; those that share all are tied to one; equal names as well."""
    rows = [("Table", f"order item number {i}") for i in range(300)] + [("Table", "ab" * (2 + i)) for i in range(60)] + [("Table", "same name")] * 50 + [("Page", "same name"), ("Table", "x"), ("Table", None), ("Table", "  ")]
    df = names(spark, rows)
    blocks, stars = B.lsh_blocks(df, bound=20)
    assert blocks.groupBy("key").count().agg({"count": "max"}).first()[0] <= 20
    tied = {r.b for r in stars.collect()}
    assert tied == {f"n{i:05d}" for i in range(301, 360)}
    pairs = {(r.a, r.b) for r in B.resolution_pairs(df, bound=20).collect()}
    assert {(f"n{360:05d}", f"n{i:05d}") for i in range(361, 410)} <= pairs
    ids = {x for p in pairs for x in p}
    assert not ids & {f"n{i:05d}" for i in range(410, 414)}
    assert len(pairs) < 20 * 20 * 360
    assert B.resolution_pairs(df.limit(0)).collect() == []


def test_first_of_many_copies(spark):
    """Copies on both sides: the first three of each set, ties to the smaller id, as of all pairs; copies are not compared with each other."""
    kinds = [["x", "y"], ["x", "z"], ["y", "x"], ["u"], ["x", "u", "z"], [], [None, "z"]]
    a, b = [(i, kinds[i % 7]) for i in range(35)], [(100 + i, kinds[(3 * i) % 7]) for i in range(70)]
    got = sorted((r.a, r.b, round(r.score, 9)) for r in S.first_similar(sets(spark, a), sets(spark, b), 0.5, 3).collect())
    want = []
    for i in {x[0] for x in a}:
        want += sorted((p for p in plain(a, b, 0.5) if p[0] == i), key=lambda p: (-p[2], p[1]))[:3]
    assert got == sorted(want)
    many = lambda start: spark.range(start, start + 30_000).select("id", F.array(F.lit("same"), F.lit("name")).alias("tokens"))
    assert S.first_similar(many(0), many(100_000), 0.5, 3).count() == 90_000  # all pairs are 900 million
