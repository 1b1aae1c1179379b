"""Entity resolution against brute force in plain Python."""

import random

from pyspark.sql import functions as F

from skein.operators import communities as C
from skein.operators import resolution as E


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def run(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def score(a, b):
    if not a or not b:
        return 0.0
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    m = min(len(a), len(b))
    return 0.6 * 2 * lcs(a, b) / (len(a) + len(b)) + 0.25 * run(a, b) / m + 0.15 * run(a[::-1], b[::-1]) / m


NAMES = ["UserService", "UserServiceImpl", "userservice", "OrderMapper", "OrderController", "", None, "é", "Ordering"]


def test_name_scores(spark):
    pairs = [(a, b) for a in NAMES for b in NAMES]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", E.name_score(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert abs(r.s - score(r.a, r.b)) < 1e-9, r


def test_scores_and_decisions(spark):
    rng = random.Random(4)
    nodes = [(f"n{i}", rng.choice(NAMES[:5]), rng.choice(["CODE_AST", "DOC_AI"]), rng.random() < 0.5) for i in range(12)]
    edges = [(f"n{rng.randrange(10)}", f"p{rng.randrange(4)}") for _ in range(30)]
    evidence = [(f"n{rng.randrange(9)}", f"e{rng.randrange(4)}") for _ in range(25)]
    pairs = [(a[0], b[0]) for a in nodes for b in nodes if a[0] < b[0]]
    got = E.scored_pairs(
        spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(nodes, "id string, node_name string, source_type string, runtime_verified boolean"),
        spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(evidence, "id string, evidence string"),
    ).collect()
    near, ev = {}, {}
    for s, t in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    for i, e in evidence:
        ev.setdefault(i, set()).add(e)
    of = {n[0]: n for n in nodes}
    want = {}
    for a, b in pairs:
        x, y = near.get(a, set()), near.get(b, set())
        struct = 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)
        p, q = ev.get(a, set()), ev.get(b, set())
        shared = 0.0 if not p or not q else len(p & q) / max(len(p), len(q))
        name = score(of[a][1], of[b][1])
        runtime = {2: 0.5, 1: 0.2, 0: 0.0}[of[a][3] + of[b][3]]
        total = 0.35 * name + 0.25 * struct + 0.2 * shared + 0.1 * runtime + (0.03 if name > 0.7 else 0)
        if total > 0.15:
            ai = of[a][2] == of[b][2] == "DOC_AI"
            want[a, b] = total, "AUTO_MERGE" if total >= 0.85 and not ai and of[a][2] == of[b][2] else "REVIEW" if total >= 0.5 else "REJECT"
    assert {(r.a, r.b) for r in got} == set(want)
    for r in got:
        assert abs(r.score - want[r.a, r.b][0]) < 1e-9 and r.decision == want[r.a, r.b][1]


def test_list_similarity(spark):
    rows = [(["a", "b", "c"], ["a", "c", "d"]), (["x"], ["y"]), (["a", "b"], ["b", "a"]), ([], [])]
    got = [r.s for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(E.list_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:3] == [2 / 3, 0.0, 1.0] and got[3] is None


def test_merge_rewires_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("e1", "a", "c", "CALLS"), ("e2", "b", "c", "CALLS"), ("e3", "a", "b", "CALLS"), ("e4", "d", "d", "CALLS")], "id string, src string, dst string, edge_type string")
    kept, moved, lineage = E.merged_graph(nodes, edges, spark.createDataFrame([("b", "a")], "a string, b string"))
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "d"]
    assert sorted(tuple(r) for r in moved.collect()) == [("a", "c", "CALLS", "e1"), ("d", "d", "CALLS", "e4")]
    assert [tuple(r) for r in lineage.collect()] == [("b", "a")]


def test_greedy_matches(spark):
    from skein.operators.patterns import greedy_matches

    rng = random.Random(8)
    pairs = [(a, b, rng.randrange(20) / 20) for a in range(25) for b in range(25) if rng.random() < 0.5]
    got = {(r.a, r.b) for r in greedy_matches(spark.createDataFrame(pairs, "a int, b int, score double"), 0.3).collect()}
    want, used_a, used_b = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if s >= 0.3 and a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert got == want


def test_nodes_without_vectors_make_no_pairs(spark):
    """Two types of 60 000 nodes that share all their evidence would be 3.6 billion pairs; four of the nodes have vectors."""
    ids = spark.range(120_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("node_type"))
    evidence = ids.select("id", F.explode(F.lit(["x", "y"])).alias("evidence"))
    vectors = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [0.0, 1.0])], "id string, embedding array<float>")
    got = E.cross_type_candidates(ids, evidence, vectors, [("A", "B")])
    assert sorted((r.a, r.b, r.shared) for r in got.collect()) == [("0", "1", 2), ("2", "3", 2)]


def test_overlap_leaves_other_members_alone(spark, monkeypatch):
    """Only members of ids in pairs are shuffled and written."""
    written = []
    real = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name="t": written.append(real(df, name)) or written[-1])
    members = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("c", "z")], "id string, member string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "n"), ("n", "o")], "a string, b string")
    got = {(r.a, r.b): r.score for r in E.set_overlap(pairs, members, 1.0, False).collect()}
    assert got == {("a", "b"): 0.5, ("a", "n"): 0.0, ("n", "o"): 1.0}
    assert written[0][0].where("id = 'c'").count() == 0 and written[0][0].count() == 3


def test_summaries_of_communities_are_not_broadcast(spark):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, label string")
    nodes = spark.createDataFrame([("a", "Service"), ("b", "Mapper"), ("c", "Mapper")], "id string, node_type string")
    got = C.summaries(labels, nodes)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.members, r.summary) for r in got.collect()} == {("a", 2, "Mapper: 1, Service: 1"), ("c", 1, "Mapper: 1")}
