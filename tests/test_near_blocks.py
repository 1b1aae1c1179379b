"""near_pairs: what meets a tile comes in parts that do not grow with the cell."""

import numpy as np

from skein.operators import vector_index as I


def test_blocks_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(I, "TILE", 20)
    seen, solved = [], type(spark.range(1)).groupBy

    def noted(self, *cols):
        if "piece" in [c for c in cols if isinstance(c, str)]:
            seen.append(self)
        return solved(self, *cols)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", noted)
    x = np.random.default_rng(3).standard_normal((1200, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.a, r.b) for r in I.near_pairs(df, 0.97, cells=3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.97, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True))
    # a part has 20 rows or so by a hash; in PIECES parts of these cells it had some 50 to 100
    assert len(seen) == 1
    assert max(r["count"] for r in solved(seen[0].where("side = 0"), "cell", "y", "piece").count().collect()) <= 45
