"""The k first trails against all trails, on random graphs with hubs, parallel edges and loops."""

import numpy as np
import pytest

from skein.operators import traverse as P


def graph(spark, edges, confidence):
    e = spark.createDataFrame([(s, d, "CALLS", f"e{i:03d}", 1) for i, (s, d) in enumerate(edges)], "src string, dst string, edge_type string, id string, depth int")
    n = spark.createDataFrame(sorted(confidence.items()), "id string, confidence double")
    return e, n


def every(edges, starts, ends, depth, both):
    steps = [(s, d, f"e{i:03d}") for i, (s, d) in enumerate(edges)]
    steps += [(d, s, i) for s, d, i in steps] if both else []
    now, out = [(x, [x], []) for x in starts], []
    for n in range(1, depth + 1):
        now = [(d, ns + [d], es + [i]) for x, ns, es in now for s, d, i in steps if s == x and i not in es]
        out += [(n, ">".join(ns), tuple(es)) for x, ns, es in now if ends is None or x in ends]
    return sorted(out)


@pytest.mark.parametrize("seed,both,k", [(1, True, 7), (2, False, 3), (3, True, 2), (4, True, 400)])
def test_first_trails(spark, seed, both, k):
    rng = np.random.default_rng(seed)
    names = [f"n{i}" for i in range(7)]
    edges = [(str(a), str(b)) for a, b in rng.choice(names, (11, 2))] + [("n0", "n1"), ("n1", "n2"), ("n0", "n1")]
    conf = {x: (None if i == 3 else i / 10) for i, x in enumerate(names)}
    e, n = graph(spark, edges, conf)
    one = lambda x: n.where(n.id == x)
    got = P.best_trails(one("n0"), e, n, 4, k, "both" if both else "out", ["CALLS"], one("n2")).collect()
    want = every(edges, ["n0"], {"n2"}, 4, both)[:k]
    assert [(r.depth, r.trail) for r in sorted(got, key=lambda r: (r.depth, r.trail, r.path_edges))] == [w[:2] for w in want]
    for r in got:
        known = [conf[x] for x in r.trail.split(">") if conf[x] is not None]
        assert r.confidence == (min(known) if known else None) and len(set(r.path_edges)) == r.depth
    if seed == 2:
        free = P.best_trails(one("n0"), e, n, 3, 5).collect()
        assert sorted((r.depth, r.trail) for r in free) == [w[:2] for w in every(edges, ["n0"], None, 3, False)[:5]]


def test_hubs_do_not_enumerate(spark, monkeypatch):
    """Three layers of 40 nodes, all with all: 64 000 trails to the end; a limit of 5 writes thousands of rows, not those."""
    layers = [["a"], *[[f"{x}{i:02d}" for i in range(40)] for x in "bcd"], ["z"]]
    edges = [(s, d) for one, two in zip(layers, layers[1:], strict=False) for s in one for d in two]
    e, n = graph(spark, edges, {x: 0.5 for layer in layers for x in layer})
    written = []
    keep = P.materialize

    def counted(df, name="t"):
        out = keep(df, name)
        written.append((name, out[0].count()))
        return out

    monkeypatch.setattr(P, "materialize", counted)
    got = P.best_trails(n.where("id = 'a'"), e, n, 8, 5, "out", None, n.where("id = 'z'")).collect()
    assert sorted(r.trail for r in got) == [f"a>b00>c00>d{i:02d}>z" for i in range(5)]
    assert sum(c for name, c in written if name == "trails") < 25_000


def test_nothing_to_find(spark):
    e, n = graph(spark, [("a", "b")], {"a": 1.0, "b": 1.0, "c": 1.0})
    assert P.best_trails(n.where("id = 'a'"), e, n, 3, 5, "out", None, n.where("id = 'c'")).collect() == []
    assert P.best_trails(n.limit(0), e.limit(0), n, 2, 5).collect() == []
