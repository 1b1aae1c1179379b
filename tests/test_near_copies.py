"""V18_near_pairs against its SQL where vectors repeat, and pairs that lie on the threshold or in a rarer dimension."""

import duckdb
import numpy as np
import pytest

from skein.operators import vector_index as I
from skein.plans import catalog


@pytest.mark.parametrize("chunk", [1000, 3])
def test_every_pair_of_copies(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(I, "COPIES", chunk)
    x = np.random.default_rng(5).standard_normal((60, 16))
    of = [*range(60), *[7] * 12, *[8] * 5, 9, 2]
    spark.createDataFrame([((31 * i) % 97, [float(c) for c in x[k]], 0) for i, k in enumerate(of)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(db.execute(catalog.oracle_sql()["V18_near_pairs"]).fetchall())
    got = sorted(tuple(r) for r in catalog.queries()["V18_near_pairs"](spark, str(tmp_path)).select("a", "b", "similarity").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)
    assert len(want) > 13 * 12 / 2 + 6 * 5 / 2


def test_threshold_and_dimensions(spark):
    """A cosine of just the threshold counts however it is rounded; rarer dimensions pair within themselves."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (80, 5)).astype(float)
    x[:, 0] = 3
    norm = lambda v: np.sqrt(np.cumsum(v * v)[-1])
    cos = np.array([[np.cumsum(u * v)[-1] / (norm(u) * norm(v)) for v in x] for u in x])
    short = [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (202, [1.0, 2.1]), (203, [-1.0, 0.0]), (204, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + short + [(300, [1.0, 1.0, 1.0]), (301, [])], "vec_id long, embedding array<double>")
    for least in sorted(set(cos[cos > 0.9].tolist()))[::40][:4]:
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= least, 1)), strict=True) if (x[a] != x[b]).any()} | {(a, b) for a in range(80) for b in range(a + 1, 80) if (x[a] == x[b]).all()}
        got = [(r.a, r.b) for r in I.near_pairs(df, least, cells=5, copies=True).collect()]
        assert {p for p in got if p[0] < 80} == want and len(set(got)) == len(got)
        assert {p for p in got if p[0] >= 80} >= {(200, 201), (200, 204), (201, 204), (200, 202), (201, 202), (202, 204)}
