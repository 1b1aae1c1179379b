"""Bucketed tables: what a merge touches, what readers see, failures and conflicts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.sources.buckets import BucketTable

SCHEMA = "id string, version long, value string, bucket int"


def rows(spark, ids, value, version=0):
    return spark.createDataFrame([(i, version, value, 1) for i in ids], SCHEMA)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable.create(rows(spark, [f"n{i}" for i in range(500)] + [None], "old"), f"file://{tmp_path}/t", ["id"], 16)


def state(df):
    return {r.id: r.value for r in df.collect()}


def test_untouched_buckets_are_not_written_again(spark, table):
    before = files(table.path[7:])
    stamps = {f: os.stat(f).st_mtime_ns for f in before}
    touched = table.merge(rows(spark, ["n3", "new"], "new"))
    assert 1 <= len(touched) <= 2
    old, now = table.manifest(1), table.manifest(2)
    assert {b for b in now.folders if now.folders[b] != old.folders.get(b)} == set(touched)
    assert all(os.stat(f).st_mtime_ns == stamps[f] for f in before)
    want = {f"n{i}": "old" for i in range(500)} | {None: "old", "n3": "new", "new": "new"}
    assert state(table.read()) == want
    assert state(table.read(1)) == {k: v for k, v in want.items() if k != "new"} | {"n3": "old"}


def test_random_merges_and_deletes(spark, table):
    rng = np.random.default_rng(3)
    want = state(table.read())
    for n in range(4):
        ids = [f"n{i}" for i in rng.integers(0, 700, 30)] + [None] * (n == 2)
        made = rows(spark, ids[:1], f"v{n}", 0)
        for v, i in enumerate(ids[1:], 1):
            made = made.union(rows(spark, [i], f"v{n}", v)) if v < 4 else made
        made = made.union(rows(spark, sorted(set(ids), key=str), f"v{n}", 9))
        table.merge(made, order="version")
        want |= {i: f"v{n}" for i in ids}
        gone = [f"n{i}" for i in rng.integers(0, 700, 10)]
        table.delete(rows(spark, gone, "x"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert state(table.read()) == want
    assert state(table.lookup(rows(spark, ["n1", "none", None], "x"))) == {k: want[k] for k in ("n1", None) if k in want}


def test_partial_merge_keeps_values(spark, table):
    table.merge(spark.createDataFrame([("n1", 5, None, 1), ("n2", None, "set", 1)], SCHEMA), partial=True)
    got = {r.id: (r.version, r.value) for r in table.lookup(rows(spark, ["n1", "n2"], "x")).collect()}
    assert got == {"n1": (5, "old"), "n2": (0, "set")}


def test_a_failed_write_leaves_the_old_version(spark, table):
    broken = rows(spark, [f"n{i}" for i in range(100)], "bad").withColumn("value", F.when(F.col("id") == "n77", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        table._commit(table.manifest(), table._written(broken, table.manifest(), [0]))
    assert table.versions() == [1] and set(state(table.read()).values()) == {"old"}
    table.merge(rows(spark, ["n1"], "new"))
    assert table.vacuum(keep=1) >= 1 and table.versions() == [2]
    assert state(table.read())["n1"] == "new" and len(state(table.read())) == 501


def test_the_second_of_two_writers_raises(spark, table):
    old = table.manifest()
    table.merge(rows(spark, ["n1"], "one"))
    with pytest.raises(RuntimeError, match="meanwhile"):
        table._commit(old, table._written(rows(spark, ["n2"], "two"), old, [0]))
    assert state(table.read())["n1"] == "one" and state(table.read())["n2"] == "old"


def test_empty(spark, tmp_path):
    empty = BucketTable.create(rows(spark, [], "x"), f"file://{tmp_path}/e", ["id"], 4)
    assert empty.read().collect() == [] and empty.merge(rows(spark, [], "x")) == [] and empty.delete(rows(spark, ["a"], "x")) == []
    empty.merge(rows(spark, ["a"], "x"))
    empty.delete(rows(spark, ["a"], "x"))
    assert empty.read().collect() == [] and empty.versions() == [1, 2, 3]
