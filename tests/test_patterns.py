"""Patterns over rows of which many are alike, against rows by hand."""

import itertools

from pyspark.sql import functions as F

from skein.operators import patterns as J
from skein.plans.catalog import queries


def test_calls_resolve_by_kind(spark):
    """The one best target of a call, as of all pairs: nulls equal nothing, repeated call ids have the best of their rows."""
    calls = [(i, f"n{i % 2}", [None, "p", "q"][i % 3], i % 2) for i in range(12)] + [(3, "n0", "q", 1)]
    targets = [(f"t{i}", f"n{i % 2}", [None, "p", "q", "r"][i % 4], i % 3) for i in range(9)]
    made = J.interface_matches(
        spark.createDataFrame(calls, "call_id long, name string, package string, params long"),
        spark.createDataFrame(targets, "target_id string, name string, tp string, tpp long"),
        [F.coalesce((F.col("package") == F.col("tp")).cast("int"), F.lit(0)), (F.col("params") == F.col("tpp")).cast("int")],
    )
    met = [(c[0], (int(c[2] is not None and c[2] == t[2]), int(c[3] == t[3])), t[0]) for c, t in itertools.product(calls, targets) if c[1] == t[1]]
    want = []
    for i in {m[0] for m in met}:
        top = max(m[1] for m in met if m[0] == i)
        best = [m[2] for m in met if m[0] == i and m[1] == top]
        want += [(i, best[0])] * (len(best) == 1)
    assert want and sorted(map(tuple, made.collect())) == sorted(want)


def test_calls_of_one_name_do_not_meet_in_pairs(spark):
    """50 000 calls of one name and as many targets, one of them in the calls' package: 2.5 billion pairs."""
    calls = spark.range(50_000).select(F.col("id").alias("call_id"), F.lit("n").alias("name"), F.lit("p").alias("package"))
    targets = spark.range(50_000).select(F.col("id").cast("string").alias("target_id"), F.lit("n").alias("name"), F.when(F.col("id") == 7, "p").otherwise("q").alias("tp"))
    got = J.interface_matches(calls, targets, [(F.col("package") == F.col("tp")).cast("int")])
    assert got.agg(F.count("*"), F.min("target_id"), F.max("target_id")).first()[:] == (50_000, "7", "7")


def test_links_are_made_and_counted_once(spark):
    """Nodes with several keys, repeats and nulls: node_links and counted_links as of all pairs."""
    rows = lambda m: [(f"p{i % 3}" if i % 11 else None, i % 17, [None, "x", "y", "z"][(i * m) % 4]) for i in range(60)]
    a, b = rows(3), rows(5) + [("p0", 3, "x")]
    x, y = (spark.createDataFrame(r, "project string, node long, key string") for r in (a, b))
    keyed = {(s[0], s[1], t[0], t[1], s[2]) for s, t in itertools.product(a, b) if None not in (s[0], t[0], s[2]) and s[2] == t[2] and s[0] != t[0]}
    once = {k[:4] for k in keyed}
    assert sorted(map(tuple, J.node_links(x, y, "key", 3).collect())) == sorted(once)
    for by_key, links in ((True, keyed), (False, once)):
        want = {}
        for k in links:
            want[k[0], k[2]] = want.get((k[0], k[2]), 0) + 1
        assert {r[:2]: r.n for r in J.counted_links(x, y, "key", by_key).collect()} == want


def test_many_links_are_counted(spark):
    """A hundred thousand nodes on each side of one key: ten billion links are a number, not rows."""
    side = lambda p: spark.range(100_000).select(F.lit(p).alias("project"), F.col("id").alias("node"), F.lit("k").alias("key"))
    assert [r.n for r in J.counted_links(side("p"), side("q"), "key", False).collect()] == [10_000_000_000]


def test_crowded_links(spark):
    """As cross_links where no node is null; links of one key come from many tasks."""
    rows = lambda m: [(f"p{i % 3}" if i % 11 else None, i % 17, [None, "x", "y", "z"][(i * m) % 4]) for i in range(60)]
    x, y = (spark.createDataFrame(r, "project string, node long, key string") for r in (rows(3), rows(5) + [("p0", 3, "x")]))
    want = sorted(map(tuple, J.cross_links(x, y, "key", 0.5).select("key", "from_project", "from_node", "to_project", "to_node", "confidence").collect()))
    got = J.crowded_links(x, y.union(spark.createDataFrame([("p1", None, "x")], y.schema)), "key", 0.5).select("key", "from_project", "from_node", "to_project", "to_node", "confidence")
    assert want and sorted(map(tuple, got.collect())) == want


def test_links_of_one_topic_come_from_many_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id user_id", "'view' event_type", "if(id % 4 = 0, 95D, if(id % 4 = 1, 1D, 50D)) value").write.parquet(f"{tmp_path}/events.parquet")
    tasks = queries()["J24_cross_repo_topics"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == sum(a % 3 != b % 3 for a in range(0, 4000, 4) for b in range(1, 4000, 4))
    assert len(tasks) >= 4


def test_first_matcher_of_requirements(spark):
    """An exact reference hides a term and a similarity, a term a similarity; repeats give one row, the likest counts."""
    made = J.linked_requirements(
        spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "item long, node string"),
        spark.createDataFrame([(1, "t"), (1, "t"), (3, "u"), (4, None)], "item long, term string"),
        spark.createDataFrame([("a", "t"), ("c", "t"), ("c", "t"), ("d", "u"), ("e", None)], "node string, term string"),
        ["term"],
        spark.createDataFrame([(1, "a", 0.9), (1, "c", 0.95), (3, "e", 0.85), (3, "e", 0.8), (3, "d", 1.0), (4, "e", 0.7), (2, "a", 0.8)], "item long, node string, score double"),
    )
    want = [(1, "a", "exact", 1.0), (1, "c", "term", 0.9), (2, "a", "semantic", 0.8), (2, "b", "exact", 1.0), (3, "d", "term", 0.9), (3, "e", "semantic", 0.85)]
    assert sorted(map(tuple, made.collect())) == want
