"""The vector index against a scan: recall by probes, exact search that leaves cells unread, odd rows, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import vector_index as I
from skein.operators.retrieval import nearest

RNG = np.random.default_rng(17)


@pytest.fixture(scope="module")
def clustered(spark):
    """3 000 rows around 40 directions, and rows without a direction."""
    centres = RNG.standard_normal((40, 24))
    x = centres[RNG.integers(0, 40, 3000)] + 0.25 * RNG.standard_normal((3000, 24))
    rows = [(i, [float(c) for c in v], "DOC" if i % 3 else "CODE", 1) for i, v in enumerate(x)]
    odd = [(9000, None, "DOC", 1), (9001, [0.0] * 24, "DOC", 1), (9002, [1.0], "DOC", 1), (9003, [float("nan")] * 24, "DOC", 1), (9004, [None] * 24, "DOC", 1), (9005, [], "DOC", 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, chunk_type string, rank int").repartition(4)
    return df, x, I.build_index(df, 32)


def scan(df, x, q, k, where="true"):
    sim = lambda v: float(v @ q / np.linalg.norm(v) / np.linalg.norm(q))
    keep = {r.vec_id for r in df.where(where).select("vec_id").collect()}
    return sorted(((i, sim(v)) for i, v in enumerate(x) if i in keep), key=lambda r: (-r[1], r[0]))[:k]


def test_every_row_with_a_direction_is_indexed(spark, clustered):
    df, x, index = clustered
    assert spark.read.parquet(index.path).count() == len(x) == index.rows.sum()


def test_exact_search_equals_the_scan_and_leaves_cells_unread(spark, clustered, monkeypatch):
    df, x, index = clustered
    read, of = [], I.cells_of
    monkeypatch.setattr(I, "cells_of", lambda spark, index, cells: read.append(len(cells)) or of(spark, index, cells))
    for q in [*x[:5], RNG.standard_normal(24)]:
        got = I.indexed_nearest(spark, index, list(q), 10)
        want = scan(df, x, q, 10)
        rows = got.collect()
        assert [r.vec_id for r in rows] == [i for i, _ in want] and np.allclose([r.similarity for r in rows], [s for _, s in want])
        if any(q is v for v in x[:5]):
            assert max(read) < (index.rows > 0).sum() / 2
        read.clear()
    assert [r.vec_id for r in I.indexed_nearest(spark, index, list(x[7]), 10, where=F.col("chunk_type") == "CODE").collect()] == [i for i, _ in scan(df, x, x[7], 10, "chunk_type = 'CODE'")]


def test_other_cells_files_are_not_read(spark, clustered):
    _, _, index = clustered
    rows = I.cells_of(spark, index, [3, 5])
    assert {f.split("cell=")[1].split("/")[0] for (f,) in rows.select(F.input_file_name()).distinct().collect()} == {"3", "5"}
    assert "PartitionFilters: [cell#" in rows._jdf.queryExecution().executedPlan().toString()


def test_threshold_reads_only_cells_within_reach(spark, clustered):
    df, x, index = clustered
    got = I.indexed_nearest(spark, index, list(x[3]), 1, least=0.95)
    assert [r.vec_id for r in got.collect()] == [3]
    assert len(I.reachable(index, x[3] / np.linalg.norm(x[3]), 0.95)[0]) < 32 / 2
    assert I.indexed_nearest(spark, index, list(x[3]), 5, where=F.col("vec_id") < 0).collect() == []


def test_recall_by_probes(spark, clustered):
    """A quarter of the cells finds 0.9 and more of the ten nearest."""
    df, x, index = clustered
    hits = 0
    for q in x[::300]:
        got = {r.vec_id for r in I.indexed_nearest(spark, index, list(q), 10, probes=8).collect()}
        hits += len(got & {i for i, _ in scan(df, x, q, 10)})
    assert hits >= 0.9 * 100


def test_saved_index(spark, clustered):
    _, x, index = clustered
    I.save_index(spark, index)
    again = I.load_index(spark, index.path)
    assert np.allclose(again.centres, index.centres) and again.rows.tolist() == index.rows.tolist()
    assert [r.vec_id for r in I.indexed_nearest(spark, again, list(x[1]), 3).collect()] == [r.vec_id for r in I.indexed_nearest(spark, index, list(x[1]), 3).collect()]


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    empty = I.build_index(spark.createDataFrame([], schema), 8)
    assert I.indexed_nearest(spark, empty, [1.0, 2.0], 3).collect() == []
    same = I.build_index(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], schema), 8)
    assert [r.vec_id for r in I.indexed_nearest(spark, same, [2.0, 4.0], 3).collect()] == [0, 1, 2]
    table = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(60)], schema)
    assert [r.vec_id for r in I.indexed_nearest(spark, I.build_index(table, 8), [1.0, 0.1], 5).collect()] == [r.vec_id for r in nearest(table, [1.0, 0.1], 5).collect()]


@pytest.mark.parametrize("tile", [2000, 40])
def test_near_pairs(spark, clustered, monkeypatch, tile):
    """All pairs of at least 0.97 and no other, in whole cells and cut ones; copies are tied to the least id."""
    df, x, _ = clustered
    monkeypatch.setattr(I, "TILE", tile)
    x = x[:900]
    some = df.where("vec_id < 900 or vec_id >= 9000").select("vec_id", "embedding")
    copies = some.where("vec_id in (5, 6)").selectExpr("vec_id + 20000", "embedding").union(some.where("vec_id = 5").selectExpr("30000L", "embedding"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= 0.97), strict=True) if i < j} | {(5, 20005), (6, 20006), (5, 30000)}
    got = I.near_pairs(some.union(copies), 0.97, cells=12).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.similarity - sim[r.a, r.b]) < 1e-9 for r in got if r.b < 900)
    assert I.near_pairs(some.limit(0), 0.9).collect() == []
