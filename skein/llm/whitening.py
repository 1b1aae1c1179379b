"""Embedding whitening: a randomised range finder over all centred rows, Rayleigh-Ritz components, checked whiteness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import drop, materialize

#: Partial sums that reach the driver: tasks' sums meet in this many tasks first.
PARTS = 8

#: Largest residual of a component, as a share of the largest eigenvalue.
TOLERANCE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums a dimension; components as columns, falling eigenvalues, the covariance's trace.

    full: whether the range finder had to take the whole space. error: largest absolute entry of the whitened fit list's
    covariance minus the identity, measured over all its rows.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    full: bool
    error: float


def _matrix(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Rows of a list column in blocks of about 8 MB."""
    step = max(1, (1 << 20) // d)
    for at in range(0, len(column), step):
        yield np.asarray(column.slice(at, step).flatten(), dtype=np.int64).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n, rounded once: whole parts are taken off as integers first."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - base) - rest


def _added(fit: DataFrame, d: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of rows of `of`, an array of one shape: added in tasks, then in PARTS tasks, then here."""
    size = int(np.prod(shape))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in _matrix(batch.column("v"), d):
                total += of(x)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in batch.column("sums"):
                total += np.frombuffer(row.as_py())
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = fit.select("v").mapInArrow(part, "sums binary").repartition(PARTS).mapInArrow(merged, "sums binary").collect()
    return np.sum([np.frombuffer(p["sums"]) for p in parts], axis=0).reshape(shape)


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """(rows, exact sum of every dimension)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for x in _matrix(batch.column("v"), d):
                n, total = n + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(t) for t in total])})

    rows = fit.select("v").mapInArrow(part, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (rows[0]["n"], tuple(int(r["s"]) for r in rows)) if rows else (0, ())


def fit_whitening(vectors: DataFrame, k: int = 16, oversample: int = 8, passes: int = 6, seed: int = 0) -> Whitening | None:
    """Components of the distinct vectors' covariance; None without vectors.

    vectors: v, arrays of whole numbers of one length, none null. Each distinct vector counts once. A random basis of
    k + oversample directions goes through power passes: each is one pass over all centred rows, gives V times the basis,
    hence Ritz pairs and their residuals, and is the next basis. A run ends when the k largest pairs' residuals are within
    TOLERANCE; when they fall too slowly to get there in `passes` passes the whole space is taken, where one pass gives V
    itself. Rows are centred before they are multiplied, whole parts as integers, so offsets cost no digits.

    Components without variance (an eigenvalue within rounding of zero) are left out: fewer than k remain then.
    The driver holds sums a dimension and PARTS arrays of dimension x basis, whatever the number of rows.
    """
    fit, at = materialize(vectors.select("v").distinct(), "vectors")
    first = fit.first()
    if first is None:
        drop(fit.sparkSession, at)
        return None
    d = len(first["v"])
    n, sums = _sums(fit, d)
    width = min(d, k + oversample)
    full = width == d
    basis = np.eye(d) if full else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    residual, trace = np.inf, None
    for left in range(passes, -1, -1):

        def product(x: np.ndarray, basis: np.ndarray = basis, full: bool = full) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.vstack([c.T @ (c if full else c @ basis), np.full((1, basis.shape[1]), np.sum(c * c))])

        out = _added(fit, d, (d + 1, basis.shape[1]), product) / n
        image, trace = out[:-1], float(out[-1, 0])
        small = basis.T @ image
        values, vectors_ = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:k]
        values, ritz = values[order], vectors_[:, order]
        components = basis @ ritz
        before, residual = residual, float(np.linalg.norm(image @ ritz - components * values, axis=0).max()) / max(float(values[0]), 1e-300)
        if full or residual <= TOLERANCE:
            break
        slow = np.isfinite(before) and residual * (residual / before) ** (left - 1) > TOLERANCE
        if slow or left <= 1:
            basis, full = np.eye(d), True
        else:
            basis = np.linalg.qr(image)[0]
    kept = values > max(float(values[0]), 0.0) * d * 1e-15
    components, values = components[:, kept], values[kept]
    m = len(values)
    error = 0.0
    if m:
        scaled = components / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            z = _centred(x, n, sums) @ scaled
            return np.vstack([z.T @ z, z.sum(axis=0)])

        out = _added(fit, d, (m + 1, m), moments) / n
        error = float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(m)).max())
    drop(fit.sparkSession, at)
    return Whitening(n, sums, components, values, trace, full, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    away = x - base
    most = n * (int(np.abs(away).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 62:
        return ((n * away - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (id, v): id, deviation, whitened (array of doubles, one for each component), a row for each row."""
    d, n, sums = len(model.sums), model.n, model.sums
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrix(batch.column("v"), d):
                z = _centred(x, n, sums) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(x)), pa.array(_deviations(x, n, sums), pa.int64()), lists], ["id", "deviation", "whitened"])
                at += len(x)

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whole_vectors(embeddings: DataFrame, id_column: str, vector_column: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """id, v: entries c as floor(scale c) + offset. Other columns are ignored, whatever their names.

    Rows take no part whose vector is null or empty, holds null, non-finite or larger entries than 2^40 (doubles are exact
    to there), or has another length than most vectors (of equally common ones the longer). Null and repeated ids stay.
    """
    fine = "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) > 1099511627776D)"
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long") + offset).alias("v"))


def whiten_embeddings(embeddings: DataFrame, k: int = 16) -> DataFrame:
    """Every vector of `embeddings` (vec_id, embedding) on the components of all distinct ones, one row a component.

    See `whole_vectors` for rows that take no part and `fit_whitening` for the components. Returns vec_id, component (from
    1 by falling eigenvalue), n, deviation (null if it exceeds a long), whitened, explained, identity_error; repeated rows
    give rows each. Without vectors, or if all are equal, there is no component and no row.
    """
    rows = whole_vectors(embeddings, "vec_id", "embedding")
    model = fit_whitening(rows, k)
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e) / model.trace) for e in model.eigenvalues))
    each = whitened(rows, model).select(F.col("id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(model.error).alias("identity_error")
    )
