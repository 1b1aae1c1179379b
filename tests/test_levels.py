"""What traversals shuffle: nodes are looked up for the trails that are left, edges lie in buckets."""

import pytest

from skein.operators import traverse as P


@pytest.fixture
def plans(monkeypatch):
    """(name, plan) of what traversals write."""
    seen, keep = [], P.materialize

    def noted(df, name="t"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(P, "materialize", noted)
    return seen


def graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a"), ("e", "a")]
    e = spark.createDataFrame([(s, d, "CALLS", f"{s}{d}") for s, d in pairs], "src string, dst string, edge_type string, id string")
    return spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.2), ("d", 0.9), ("e", 0.1)], "id string, confidence double"), e


@pytest.mark.parametrize("end", ["d", None])
def test_trails_do_not_meet_all_nodes(spark, plans, end):
    n, e = graph(spark)
    got = P.best_trails(n.where("id = 'a'"), e, n, 3, 4, ends=n.where(n.id == end) if end else None).collect()
    want = [("a>b", 0.5), ("a>c", 0.2), ("a>b>c", 0.2), ("a>c>d", 0.2)] if end is None else [("a>c>d", 0.2), ("a>b>c>d", 0.2)]
    assert sorted((r.depth, r.trail, r.confidence) for r in got) == [(t.count(">"), t, c) for t, c in want]
    steps = [plan for name, plan in plans if name == "trails"]
    assert steps and not any("LeftOuter" in plan for plan in steps)
    assert ("left" in {name for name, _ in plans}) == (end is not None)


def test_levels_read_edges_in_buckets(spark, plans):
    n, e = graph(spark)
    got = P.reach(n.where("id in ('a', 'e')"), e, 5)
    assert sorted((r.id, r.level, r.parent, r.via) for r in got.collect()) == [("a", 0, None, None), ("b", 1, "a", "ab"), ("c", 1, "a", "ac"), ("d", 2, "c", "cd"), ("e", 0, None, None)]
    levels = [plan for name, plan in plans if name == "reach"][1:]
    assert len(levels) == 3 and all("Bucketed: true" in plan and plan.count("Exchange hashpartitioning(src") == 1 for plan in levels)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skein_")]
