"""Exact top-k inner products by MaxScore over shards of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import materialize

#: Rows of a block of queries and of a shard of candidates.
QUERIES, SHARD = 1024, 4096
#: Candidates that are scored between two looks at the thresholds.
STEP = 512


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, dim, ids, data): rows (id, v array<long>) packed by length, sorted by id inside a block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            nonlocal serial
            order = np.argsort(ids, kind="stable")
            serial += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + serial]), "dim": pa.array([dim], pa.int32()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([data[order].tobytes()], pa.binary()),
            })

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("v")
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
            starts = np.cumsum(ends) - ends
            for dim in np.unique(ends).tolist():
                at = np.flatnonzero(ends == dim)
                data = flat[starts[at][:, None] + np.arange(dim)]
                have = held.setdefault(dim, [])
                have.append((ids[at], data))
                if sum(len(i) for i, _ in have) >= size:
                    i, d = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
                    full = len(i) // size * size
                    for k in range(0, full, size):
                        yield out(dim, i[k : k + size], d[k : k + size])
                    held[dim] = [(i[full:], d[full:])]
        for dim, have in held.items():
            i, d = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
            if len(i):
                yield out(dim, i, d)

    return rows.mapInArrow(packed, "block long, dim int, ids binary, data binary")


def maxscore(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): the k best of one shard for each query; cid ascending.

    A dimension is a term. Its posting's impact is the distance of the component from the shard's
    least (for a positive query weight) or largest (for a negative one), so impacts are >= 0 and a
    query's score is a constant plus the sum of weight x impact; a term's bound is its weight times
    the largest impact in the shard. Terms are sorted by bound: the longest prefix whose bounds
    sum to less than the threshold is non-essential, and a candidate can only enter by the
    essential rest. The essential postings are traversed for all queries of the block at once;
    candidates that stay competitive with all non-essential bounds added are probed there.

    floor: for each query a score that k candidates of other shards are known to reach. Thresholds
    start there, so terms are non-essential from the first candidate on; what scores less is left out.
    """
    nq, dim = q.shape
    low, high = c.min(axis=0), c.max(axis=0)
    # int64 arithmetic is Java's; where sums fit a double exactly, the faster product is the same
    largest = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * 2 * dim
    exact = largest < 2**53
    kind = np.float32 if largest < 2**23 else np.float64 if exact else np.int64
    q, c = q.astype(kind), c.astype(kind)
    ref = np.where(q >= 0, low.astype(kind), high.astype(kind))
    constant = (q * ref).sum(axis=1)
    bounds = np.abs(q) * (high - low).astype(kind)
    order = np.argsort(bounds, axis=1, kind="stable")
    cumulated = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
    lowest = np.iinfo(np.int64).min if not exact else -np.inf
    # a candidate must exceed the threshold, so it starts below the floor; wrapped sums have no bounds to compare
    start = np.full(nq, lowest, kind) if floor is None or not exact else np.where(floor == np.iinfo(np.int64).min, lowest, floor - 1.0).astype(kind)
    best = np.repeat(start[:, None], k, axis=1)
    owner = np.full((nq, k), np.iinfo(np.int64).max, np.int64)
    rank = np.argsort(order, axis=1, kind="stable")
    for at in range(0, len(cid), STEP):
        part, ids = c[at : at + STEP], cid[at : at + STEP]
        threshold = best[:, -1]
        # a later candidate has a larger id: to enter it must exceed the threshold
        full = threshold > lowest if exact else owner[:, -1] != np.iinfo(np.int64).max
        room = np.where(full, threshold - constant, -1) if exact else np.where(full, threshold, 0) - constant
        skip = (cumulated <= room[:, None]).sum(axis=1) * full
        essential = np.where(rank >= skip[:, None], q, 0)
        slack = np.where(skip > 0, np.take_along_axis(cumulated, np.maximum(skip - 1, 0)[:, None], axis=1)[:, 0], 0)
        # constant part of essential terms is inside the product; of the others it is their reference
        offset = ((q - essential) * ref).sum(axis=1)
        partial = essential @ part.T + offset[:, None]
        rest = q - essential
        competitive = partial + slack[:, None] > threshold[:, None] if exact else ~full[:, None] | (partial + slack[:, None] > threshold[:, None])
        row, col = np.nonzero(competitive)
        if not len(row):
            continue
        score = partial[row, col] - offset[row]
        probed = skip[row] > 0
        for s in range(0, len(row), 1 << 16):
            m = s + np.flatnonzero(probed[s : s + (1 << 16)])
            score[m] += np.einsum("ij,ij->i", rest[row[m]], part[col[m]])
        good = ~full[row] | (score > threshold[row])
        row, col, score = row[good], col[good], score[good]
        if not len(row):
            continue
        touched = np.unique(row)
        place = np.searchsorted(touched, row)
        r = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        s = np.concatenate([best[touched].reshape(-1), score])
        i = np.concatenate([owner[touched].reshape(-1), ids[col]])
        sort = np.lexsort((i, -s if exact else ~s, r))
        r, s, i = r[sort], s[sort], i[sort]
        begin = np.searchsorted(r, np.arange(len(touched)))
        take = begin[:, None] + np.arange(k)
        best[touched], owner[touched] = s[take], i[take]
    row, col = np.nonzero(owner != np.iinfo(np.int64).max)
    return row, owner[row, col], np.rint(best[row, col]).astype(np.int64) if exact else best[row, col]


def topk_search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k largest inner products of every query with all candidates but those of its own id.

    queries, candidates: id long, v array<long>; other columns are ignored. Rows whose id or
    vector is null, empty or holds nulls take no part; vectors of different length do not meet.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Of repeated ids
    each row counts for itself (repeated query rows double their results' rows before ranking, so
    ids of queries should be unique). Arithmetic is that of 64-bit integers.

    Both sides are packed in blocks, which meet as tiles dealt evenly over tasks; a tile holds
    QUERIES x SHARD rows at most, whatever the tables' size. A first round of one shard a query block
    gives each query a threshold, which all other shards start from. Every tile gives its shard's
    best k per query that reach the threshold, and shards are merged by query: at most k rows a shard.
    A query id that stands in several rows of a block has no threshold of its own: the least counts.
    """
    clean = "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)"
    q, _ = materialize(_blocks(queries.select("id", "v").where(clean), QUERIES), "queries")
    c, _ = materialize(_blocks(candidates.select("id", "v").where(clean), SHARD), "shards")
    serial = lambda t: t.select("block", "dim").distinct()  # noqa: E731  block numbers only: one row for a thousand or more rows
    pairs = serial(q).withColumnRenamed("block", "qb").join(serial(c).withColumnRenamed("block", "cb"), "dim")
    first = pairs.groupBy("qb").agg(F.min_by("cb", F.xxhash64("qb", "cb")).alias("cb"))

    def scored(group: pa.Table) -> pa.Table:
        side = group.column("side").to_pylist()
        of = lambda s: next(i for i, x in enumerate(side) if x == s)
        dim, start = group.column("dim")[0].as_py(), group.column("floors")[of(0)].as_py()
        load = lambda i: (np.frombuffer(group.column("ids")[i].as_py(), np.int64), np.frombuffer(group.column("data")[i].as_py(), np.int64).reshape(-1, dim))
        (qid, qv), (cid, cv) = load(of(0)), load(of(1))
        # one more than k, as a query may meet its own row
        row, vec, score = maxscore(qv, qid, cv, cid, k + int(np.unique(cid, return_counts=True)[1].max()), None if start is None else np.frombuffer(start, np.int64))
        other = qid[row] != vec
        return pa.table({"qb": np.full(int(other.sum()), group.column("qb")[0].as_py(), np.int64), "query_id": qid[row][other], "vec_id": vec[other], "score": score[other]})

    def met(queries: DataFrame, of: DataFrame) -> DataFrame:
        tiles = (
            queries.withColumnRenamed("block", "qb").join(of, "qb").withColumn("side", F.lit(0))
            .unionByName(c.withColumnRenamed("block", "cb").join(of, "cb").withColumns({"side": F.lit(1), "floors": F.lit(None).cast("binary")}))
        )
        return tiles.groupBy("qb", "cb").applyInArrow(scored, "qb long, query_id long, vec_id long, score long")

    # each query block meets one shard first: the k-th score there is a threshold that all shards start from
    began, _ = materialize(met(q.withColumn("floors", F.lit(None).cast("binary")), first), "first")
    kth = began.withColumn("r", F.row_number().over(Window.partitionBy("qb", "query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k).select("qb", "query_id", "score")
    floors = kth.groupBy(F.col("qb").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("of"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, of in zip(batch.column("ids").to_pylist(), batch.column("of").to_pylist(), strict=True):
                known = dict(of or ())
                out.append(np.array([known.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("block", "dim", "ids", "data")], pa.array(out, pa.binary())], ["block", "dim", "ids", "data", "floors"])

    again = q.join(floors, "block", "left").select("block", "dim", "ids", "data", "of").mapInArrow(packed, "block long, dim int, ids binary, data binary, floors binary")
    rest = pairs.join(first, ["qb", "cb"], "left_anti").select("qb", "cb")
    found = began.union(met(again, rest)).drop("qb")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
