"""Pairs by class and vector against all pairs, and classes whose pairs are too many to be rows."""

import itertools

import numpy as np
import pytest

from skein.operators import alike as A
from skein.operators import resolution as E
from skein.plans.catalog import queries


def plain(u, v):
    """The cosine as the definition has it; None where there is none."""
    if not u or not v or len(u) != len(v) or None in u or None in v or not any(u) or not any(v):
        return None
    x, y = np.array(u, float), np.array(v, float)
    return float(np.cumsum(x * y)[-1] / (np.sqrt(np.cumsum(x * x)[-1]) * np.sqrt(np.cumsum(y * y)[-1])))


@pytest.mark.parametrize("tile,group", [(2000, 8000), (7, 20)])
def test_as_all_pairs(spark, monkeypatch, tile, group):
    """Classes of several sizes, vectors of two dimensions, with nulls, of length zero and missing; kinds; negative thresholds."""
    monkeypatch.setattr(A, "TILE", tile)
    monkeypatch.setattr(A, "GROUP", group)
    rng = np.random.default_rng(4)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [2.0, 4.0]]
    draw = lambda n: [(int(rng.integers(0, 6)), f"n{i}", int(rng.integers(0, 3)), odd[i] if i < len(odd) else rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(n)]
    a, b = draw(90), draw(70)
    meets = [(x, y, x * 10 + y) for x, y in itertools.product(range(7), range(6)) if (x + 2 * y) % 3]
    x, y = (spark.createDataFrame(r, "class long, id string, kind int, embedding array<float>") for r in (a, b))
    for least in (0.6, 0.0, -0.5):
        want = {(p[1], q[1], v): plain(p[3], q[3]) for p, q in itertools.product(a, b) for m, n, v in meets if (p[0], q[0]) == (m, n) and (p[2], q[2]) in ((0, 1), (2, 2), (1, 0))}
        want = {k: c for k, c in want.items() if c is not None and c >= least}
        got = A.alike(x, y, spark.createDataFrame(meets, "a long, b long, value long"), least, [(0, 1), (2, 2), (1, 0)]).collect()
        assert want and len(got) == len(want) and {(r.a, r.b, r.value): r.cosine for r in got} == want
    assert A.alike(x.limit(0), y, spark.createDataFrame(meets, "a long, b long, value long"), 0.5).collect() == []


def test_nodes_of_one_evidence_do_not_meet_in_rows(spark):
    """8 000 nodes of each type with the same evidence: 64 million pairs, of which few are alike."""
    x = np.random.default_rng(1).standard_normal((16_000, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(8)
    nodes = spark.range(16_000).selectExpr("id", "if(id % 2 = 0, 'A', 'B') node_type")
    evidence = nodes.selectExpr("id", "explode(array('x', 'y', if(id % 3 = 0, 'z', 'y'))) evidence")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(u[::2] @ u[1::2].T >= 0.6)
    want = {(2 * a, 2 * b + 1): 3 if not 2 * a % 3 and not (2 * b + 1) % 3 else 2 for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    got = E.cross_type_candidates(nodes, evidence, vectors, [("A", "B")], least=0.8).collect()
    assert len(want) > 1000 and len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want


def test_features_of_one_name_do_not_meet_in_rows(spark, tmp_path):
    """J17_feature_matches over 6 000 features and 6 000 pages that share one of three tokens: 36 million pairs."""
    n = 12_000
    x = np.random.default_rng(6).standard_normal((n, 16)).astype(np.float32)
    spark.range(n).selectExpr("id p_partkey", "if(id % 2 = 0, 'a b c', 'c d e') p_name", "if(id % 2 = 0, 1, 46) p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for a, row in enumerate(u[::2] @ u[1::2].T):
        best = [b for b in np.argsort(-row, kind="stable")[:3] if row[b] > 0.6]
        want |= {(2 * a, 2 * int(b) + 1, "CONFIRMED" if row[b] >= 0.8 else "PENDING_CONFIRM") for b in best}
    got = queries()["J17_feature_matches"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.status) for r in got} == want
