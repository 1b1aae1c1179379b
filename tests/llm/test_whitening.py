"""Whitening against a dense local decomposition: flat and steep spectra, offsets, repeats, rows that take no part."""

import numpy as np
import pytest

from skein.llm import queries as llm
from skein.llm.whitening import fit_whitening, whiten_embeddings, whole_vectors


def table(spark, vectors, extra=()):
    rows = [(i, [float(c) for c in v], 0.0) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(5)


def dense(vectors):
    """(distinct x, their covariance's falling eigenvalues, eigenvectors) by exact integers."""
    x = np.unique(np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000, axis=0)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("steep", [False, True])
def test_against_dense(spark, steep):
    rng = np.random.default_rng(3)
    scale = 40.0 * 0.05 ** np.arange(40) if steep else np.linspace(2, 1, 40)
    vectors = rng.standard_normal((700, 40)) * scale + rng.standard_normal(40)
    if steep:
        vectors[:, 8:] = 0.25
    vectors = np.vstack([vectors, np.repeat(vectors[:1], 400, axis=0)])
    got = whiten_embeddings(table(spark, vectors)).collect()
    x, e, v = dense(vectors)
    n, s = len(x), x.sum(axis=0)
    k = int((e[:16] > e[0] * 40e-15).sum())
    assert k == (3 if steep else 16) or (steep and 1 <= k < 16)
    assert len(got) == len(vectors) * k and {r.component for r in got} == set(range(1, k + 1))
    every = np.floor(64 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    want = (every - s / n) @ v[:, :k] / np.sqrt(e[:k])
    mine = np.zeros((len(vectors), k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(every[r.vec_id], s, strict=True))
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-6
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-6


def test_range_finder_takes_the_whole_space_only_if_it_must(spark):
    """Few strong directions and nothing else converge in a small basis; a flat spectrum does not."""
    rng = np.random.default_rng(4)
    low = (rng.standard_normal((500, 5)) @ rng.standard_normal((5, 60)) * 50).astype(int)
    flat = rng.integers(-50, 50, (500, 60))
    for rows, full in ((low, None), (flat, True)):
        df = spark.createDataFrame([([int(c) for c in r],) for r in rows], "v array<bigint>")
        model = fit_whitening(df, k=4)
        x = np.unique(rows, axis=0)
        e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
        assert np.allclose(model.eigenvalues, e[:4], rtol=1e-9) and (full is None or model.full is full)
    exact = np.outer(rng.integers(-9, 9, 400), rng.integers(-9, 9, 60)) + np.outer(rng.integers(-900, 900, 400), np.arange(60))
    model = fit_whitening(spark.createDataFrame([([int(c) for c in r],) for r in exact], "v array<bigint>"), k=4)
    assert not model.full and len(model.eigenvalues) == 2 and model.error < 1e-9


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((30, 6))
    inf, nan = float("inf"), float("nan")
    bad = [(100, None, 1.0), (101, [], 1.0), (102, [0.0] * 5 + [None], 1.0), (103, [nan] * 6, 1.0), (104, [inf] * 6, 1.0), (105, [1e30] * 6, 1.0), (106, [1.0] * 7, 1.0)]
    got = whiten_embeddings(table(spark, vectors, [*bad, (None, [1.0] * 6, 1.0), (3, [2.0] * 6, 1.0)])).collect()
    assert {r.vec_id for r in got} == set(range(30)) | {None} and len(got) == 32 * 6
    assert whole_vectors(table(spark, vectors, bad), "vec_id", "embedding").count() == 30


def test_large_offsets_keep_their_digits(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((200, 5))
    near, far = (whiten_embeddings(table(spark, v.astype(np.float32).round(3) + at)).orderBy("vec_id", "component").collect() for at in (0, 16384))
    assert max(r.identity_error for r in far) < 1e-9
    assert np.allclose([abs(r.explained) for r in near], [abs(r.explained) for r in far], rtol=0.05)


def test_empty_and_constant(spark):
    assert whiten_embeddings(table(spark, [])).collect() == []
    assert whiten_embeddings(table(spark, [[1.0, 2.0]] * 5)).collect() == []


def test_registered(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((90, 20)).astype(np.float32)
    table(spark, v).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = llm.op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    z = np.zeros((90, 16))
    for r in got.collect():
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(z.T, bias=True) - np.eye(16)).max() < 1e-9
