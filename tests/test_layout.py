"""Clustered tables against plain filters, with the files that are read counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.sources import layout as L


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = [(f"k{int(x):05d}" if i % 50 else None, int(y), f"v{i}") for i, (x, y) in enumerate(zip(rng.integers(0, 20_000, 6000), rng.integers(0, 1000, 6000), strict=True))]
    rows += [("k00500", 7, f"again{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, n long, value string").repartition(4)
    path = f"file://{tmp_path_factory.mktemp('layout')}/t"
    L.cluster(df, path, ["key"], zones=["n"], files=16, bloom=["value"])
    return df, path


@pytest.mark.parametrize("conditions", [[("key", "=", "k00500")], [("key", ">=", "k19000"), ("n", "<", 30)], [("key", "in", ["k00001", "k10000", "zzz"])], [("key", "prefix", "k012")], [("key", "<", "a")], [("n", "=", 5)], [("value", "=", "v77")], [("key", "<=", "k00100"), ("key", ">", "k00050")]])
def test_same_rows_as_a_filter(spark, clustered, conditions):
    df, path = clustered
    want = df
    for c, op, v in conditions:
        want = want.where(F.col(c).isin(v) if op == "in" else F.col(c).startswith(v) if op == "prefix" else F.expr(f"{c} {op} {v!r}"))
    got = L.pruned(spark, path, conditions)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_files_left_unread(spark, clustered):
    _, path = clustered
    every = len(spark.read.parquet(path).inputFiles())
    assert every >= 12
    assert len(L.pruned(spark, path, [("key", "=", "k10000")]).inputFiles()) <= 2
    assert len(L.pruned(spark, path, [("key", "prefix", "k012")]).inputFiles()) <= 3
    assert len(L.pruned(spark, path, [("value", "=", "v77")]).inputFiles()) == every
    assert len(L.window(spark, path, "key", "k10000", 25).inputFiles()) <= 3


def test_pages_cover_the_table_in_order(spark, clustered):
    df, path = clustered
    want = [r.key for r in df.where("key is not null").select("key").distinct().orderBy("key").collect()]
    seen, after = [], None
    while len(seen) < 2000:
        page = [r.key for r in L.window(spark, path, "key", after, 700).collect()]
        assert page == sorted(page) and len(page) == 700
        seen += page
        after = page[-1]
    assert sorted(set(seen)) == [k for k in want if k <= after]


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    L.cluster(spark.createDataFrame([], "key string, n long"), path, ["key"])
    assert L.pruned(spark, path, [("key", "=", "a")]).collect() == [] and L.window(spark, path, "key", None, 5).collect() == []


def test_larger_tables_get_more_files(spark, tmp_path, monkeypatch):
    """A task sorts one file's rows, so their number is bounded."""
    monkeypatch.setattr(L, "ROWS", 100)
    path = f"file://{tmp_path}/t"
    L.cluster(spark.range(1000).toDF("key"), path, ["key"], files=2)
    assert spark.read.parquet(f"{path}-zones").count() >= 9
