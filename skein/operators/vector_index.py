"""An inverted-list index of vectors: cells around trained centres, residual codes, pruned and exact nearest neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.retrieval import cosine, vector
from skein.storage import scratch_path

#: Rows that centres are trained on, at most; every row is indexed whatever their number.
SAMPLE = 20_000
#: Rows of a cell in one file, about: a crowded cell is written by several tasks.
FILE_ROWS = 200_000


@dataclass(frozen=True)
class VectorIndex:
    """path: rows by cell as Parquet. centres: unit vectors; reach: largest angle of a row to its centre, by cell; step: of the codes."""

    path: str
    centres: np.ndarray
    reach: np.ndarray
    rows: np.ndarray
    step: float

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest cosine that a row of each cell can have with a unit query; -2 for cells without rows."""
        angle = np.arccos(np.clip(self.centres @ query, -1, 1))
        return np.where(self.rows > 0, np.cos(np.maximum(0.0, angle - self.reach)) + 1e-9, -2.0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])  # squares of very large or small numbers would be no numbers
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def trained(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of spherical k-means over unit rows; a centre that loses all rows moves to the row that is furthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, d)


def build_index(vectors: DataFrame, cells: int, path: str | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Indexes vectors (embedding and any other columns).

    Centres are trained on at most `sample` rows (the first by a hash of the vector, sample x dimension numbers on the driver).
    Every row goes to the cell of its nearest centre; its code is the rest in steps of a byte a dimension. Rows without a
    vector, with nulls or non-finite numbers in it, of length zero or of another dimension than most have no direction and
    are not indexed. Rows are written by cell, so that a search reads the files of some cells; other columns stay as they are.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vectors")
    fine = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.where(fine)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        rows.limit(0).selectExpr("*", "0 as cell", "0D as angle", "binary('') as code").write.parquet(path)
        return VectorIndex(path, np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), 1.0)
    d = common["d"]
    rows = rows.where(F.size("embedding") == d)
    some = rows.select(F.col("embedding").cast("array<double>").alias("e")).orderBy(F.xxhash64("embedding")).limit(sample).collect()
    centres = trained(_unit(np.array([r["e"] for r in some])), min(cells, len(some)))
    step = 2.0 / 127  # a rest between unit vectors is at most 2 in any dimension

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_vectors(batch.column("embedding"), d))
            near = x @ centres.T
            own = near.argmax(axis=1)
            code = np.round((x - centres[own]) / step).astype(np.int8)
            made = [pa.array(own, pa.int32()), pa.array(np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cell", "angle", "code"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "cell int, angle double, code binary"])
    made = rows.mapInArrow(coded, schema).repartition("cell", F.pmod(F.xxhash64("embedding"), F.lit(8)))
    made.write.partitionBy("cell").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
    spread = spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).collect()  # a row a cell
    reach, n = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in spread:
        reach[r["cell"]], n[r["cell"]] = r["reach"] + 1e-9, r["n"]
    return VectorIndex(path, centres, reach, n, step)


def save_index(spark: SparkSession, index: VectorIndex) -> None:
    """Puts the centres beside the rows, where `load_index` finds them."""
    said = json.dumps({"centres": index.centres.tolist(), "reach": index.reach.tolist(), "rows": index.rows.tolist(), "step": index.step})
    spark.createDataFrame([(said,)], "index string").coalesce(1).write.mode("overwrite").parquet(f"{index.path}-centres")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    said = json.loads(spark.read.parquet(f"{path}-centres").first()["index"])
    return VectorIndex(path, np.array(said["centres"]), np.array(said["reach"]), np.array(said["rows"], np.int64), said["step"])


def cells_of(spark: SparkSession, index: VectorIndex, cells: Sequence[int]) -> DataFrame:
    """The index's rows of some cells: the files of no other are read."""
    return spark.read.parquet(index.path).where(F.col("cell").isin([int(c) for c in cells]))


def _scored(rows: DataFrame, index: VectorIndex, query: np.ndarray) -> DataFrame:
    """rows with `near`: the cosine as the codes have it."""
    base, step = index.centres @ query, index.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
            near = base[np.asarray(batch.column("cell"))] + step * (code @ query)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "near"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "near double"]))


def _best(rows: DataFrame, index: VectorIndex, unit: np.ndarray, query: np.ndarray, k: int, key: str) -> DataFrame:
    """The k nearest of some cells' rows by exact cosine: codes tell which rows can be among them, only those are compared in full."""
    kth = _scored(rows.select("cell", "code"), index, unit).orderBy(F.desc("near")).select("near").limit(k).agg(F.min("near").alias("m"), F.count("*").alias("n")).first()
    wrong = index.step / 2 * float(np.abs(unit).sum()) + 1e-9  # of a cosine by codes, at most
    near = _scored(rows, index, unit)
    near = near.where(F.col("near") >= kth["m"] - 2 * wrong) if kth["n"] == k else near
    return near.withColumn("similarity", cosine(F.col("embedding"), vector(query.tolist()))).drop("near", "code", "angle", "cell").orderBy(F.desc("similarity"), key).limit(k)


def indexed_nearest(spark: SparkSession, index: VectorIndex, query: Sequence[float], k: int, probes: int | None = None, where: Column | None = None, least: float = -1.0, key: str = "vec_id") -> DataFrame:
    """The k indexed rows nearest to the query by cosine, with similarity, ties by `key`; those of at least `least` only.

    probes: so many cells are read, those with the nearest centres; rows of other cells are missed. None: exact. Cells are then
    read by falling bound (the angle to a centre less its cell's reach), first few, then more, until no cell left can hold a
    nearer row than the k found: cells out of reach are never read. where: a condition on other columns, met before ranking.
    """
    asked = np.asarray(query, float)
    unit = _unit(asked)
    if not index.rows.sum():
        return spark.read.parquet(index.path).drop("cell", "angle", "code").withColumn("similarity", F.lit(None).cast("double")).limit(0)
    of = lambda cells: (lambda rows: rows if where is None else rows.where(where))(cells_of(spark, index, cells))
    found = lambda cells: _best(of(cells), index, unit, asked, k, key).where(F.col("similarity") >= least)
    if probes is not None:
        return found(np.argsort(-(index.centres @ unit))[:probes])
    order, bounds = reachable(index, unit, least)
    seen = min(len(order), 4)
    while seen < len(order):
        best = found(order[:seen]).agg(F.min("similarity").alias("m"), F.count("*").alias("n")).first()
        if best["n"] == k and best["m"] > bounds[order[seen]]:
            break
        seen = min(len(order), 4 * seen)
        if best["n"] == k:  # no cell below this can hold a nearer one
            seen = max(1, min(len(order), int((bounds[order] >= best["m"]).sum())))
            break
    return found(order[:seen])


def reachable(index: VectorIndex, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells that can hold rows of at least `least`, by falling bound; bounds of all)."""
    bounds = index.bounds(unit)
    order = np.argsort(-bounds, kind="stable")
    return order[bounds[order] >= max(least, -1.5)], bounds


#: Rows of a cell that meet in one block: a crowded cell is cut into blocks that meet pairwise.
TILE = 2_000
#: Parts in which the rows that meet a tile come to it, at least; more where a part would have over TILE rows.
PIECES = 8


def pieces_of(met: np.ndarray) -> np.ndarray:
    """In how many parts the rows that meet a tile come, by cell: met rows at most, so a task's rows and pairs do not grow with them."""
    return np.maximum(PIECES, -(-met // TILE)).astype(np.int32)


def _blocks(held: DataFrame, met: DataFrame, pieces: np.ndarray) -> DataFrame:
    """Rows of (cell, y, piece): a tile's rows in every piece of its cell, those that meet it in one each."""
    n = F.get(F.lit(pieces.tolist()), F.col("cell"))
    each = held.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.unionByName(met.withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(1)), n).cast("int")))


#: Ids of one class in a chunk, about: pairs of copies are made chunk by chunk, so a large class is many tasks.
COPIES = 1_000
#: Angles to a centre may be wrong by this much: near 0 and pi a cosine's last digit is some 1e-8 of an angle.
SLACK = 1e-6


def near_pairs(vectors: DataFrame, least: float, cells: int = 64, sample: int = SAMPLE, copies: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: pairs of vectors (vec_id, a key, and embedding) with a cosine of at least `least` (0 or more), exact.

    Equal vectors are one class: its other ids are each tied to the least one with similarity 1, and pairs between classes are
    given for these. copies: every pair of ids instead, as many as the square of a class. Rows are dealt by the cell of their nearest centre, and to every later cell whose reach says that it may
    hold one near enough (the angle to its centre is at most the angle asked for and that reach). A cell's rows at home
    are cut into tiles; what meets a tile comes in PIECES parts or more, of some TILE rows at most, so a crowded cell is many tasks, each with two tiles' rows.
    Vectors of different dimensions pair within each. Rows without a direction pair with none.
    """
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy("d").collect()  # a row a dimension
    found = [_near_pairs(vectors.where(F.size("embedding") == r["d"]), least, cells, sample, copies) for r in sizes]
    out = vectors.sparkSession.createDataFrame([], "a long, b long, similarity double") if not found else found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _near_pairs(vectors: DataFrame, least: float, cells: int, sample: int, copies: bool) -> DataFrame:
    """`near_pairs` of vectors of one dimension."""
    spark = vectors.sparkSession
    classes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("held"))
    index = build_index(classes.select("vec_id", "embedding", "held"), cells, sample=sample)
    rows = spark.read.parquet(index.path)
    centres, reach, asked = index.centres, index.reach, float(np.arccos(np.clip(least, -1, 1))) + SLACK
    tiles = np.maximum(1, -(-index.rows // TILE))
    d = centres.shape[1]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row at home and as a visitor of later cells."""
        for batch in batches:
            x = _unit(_vectors(batch.column("embedding"), d))
            home = np.asarray(batch.column("cell"))
            near = np.arccos(np.clip(x @ centres.T, -1, 1)) <= asked + reach[None, :]
            near &= (np.arange(len(centres))[None, :] > home[:, None]) & (index.rows > 0)[None, :]
            near[np.arange(len(home)), home] = True
            of, cell = np.nonzero(near)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(home[of] == cell), pa.array(tiles[cell], pa.int32()), *(batch.column(c).take(take) for c in ("vec_id", "held", "embedding"))], ["cell", "home", "tiles", "vec_id", "held", "embedding"])

    placed = rows.select("vec_id", "held", "embedding", "cell").mapInArrow(homes, "cell int, home boolean, tiles int, vec_id long, held long, embedding array<double>") if len(index.rows) and index.rows.sum() else None
    chunks = F.ceil(F.col("held") / COPIES).cast("int")
    members = vectors.join(rows.where("held > 1").select(F.col("vec_id").alias("class"), "held", "embedding"), "embedding")
    members = members.select("class", "vec_id", chunks.alias("chunks"), F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("chunk"))
    ties = members.where("vec_id <> class").select(F.col("class").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    if placed is None:
        return ties.limit(0)
    # The rows at home hold one tile; all rows of the cell come to each tile, those of no earlier tile only.
    tile = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
    part = lambda df, side, y: df.select("cell", y.alias("y"), tile.alias("x"), F.lit(side).alias("side"), "home", "vec_id", "held", "embedding")
    held = part(placed.where("home"), 1, tile)
    met = part(placed, 0, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("not home or x <= y")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            p, q = (_vectors(t.column("embedding").combine_chunks(), d) for t in (left, right))
            x, y = _unit(p), _unit(q)
            i, j = (np.asarray(t.column("vec_id")) for t in (left, right))
            m, n = (np.asarray(t.column("held")) for t in (left, right))
            own, first = np.asarray(left.column("home")), np.asarray(left.column("x"))
            for at in range(0, len(i), TILE):
                sim = x[at : at + TILE] @ y.T
                a, b = np.nonzero(sim >= least - 1e-9)
                keep = ~own[at + a] | (first[at + a] < key[1].as_py()) | (i[at + a] < j[b])
                a, b = a[keep], b[keep]
                sim = sim[a, b]
                _settle(sim, p, q, at + a, b, least)
                a, b, sim = (v[sim >= least] for v in (a, b, sim))
                found.append((i[at + a], j[b], sim, m[at + a], n[b]))
        a, b, sim, m, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, float if k == 2 else np.int64) for k in range(5))
        back = a > b
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": sim, "na": np.where(back, n, m), "nb": np.where(back, m, n)})

    counts = np.zeros(len(index.rows), np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        counts[r["cell"]] = r["count"]
    pieces = _blocks(held, met, pieces_of(counts))
    pairs = pieces.groupBy("cell", "y", "piece").applyInArrow(solve, "a long, b long, similarity double, na long, nb long")
    if not copies:
        return pairs.select("a", "b", "similarity").union(ties)
    return _with_copies(pairs, members) if members.limit(1).count() else pairs.select("a", "b", "similarity")


def _settle(sim: np.ndarray, p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> None:
    """Where a cosine is too near to `least` to tell, it is put as the plain formula has it, component after component."""
    close = np.flatnonzero(np.abs(sim - least) < 1e-9)
    for at in range(0, len(close), 1 << 16):
        some = close[at : at + (1 << 16)]
        u, v = p[a[some]], q[b[some]]
        dot, uu, vv = (np.cumsum(z, axis=1)[:, -1] for z in (u * v, u * u, v * v))
        fine = (uu > 0) & (vv > 0) & np.isfinite(uu) & np.isfinite(vv)
        sim[some[fine]] = dot[fine] / (np.sqrt(uu[fine]) * np.sqrt(vv[fine]))


def _with_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids: of pairs (a, b, similarity, na, nb) between classes, and within members (class, vec_id, chunks, chunk) of a class.

    A class meets others a chunk of its ids at a time, so its pairs are dealt over tasks.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / COPIES).cast("int") - 1))
    of = lambda e: members.select(F.col("class").alias(e), F.col("chunk").alias(f"c{e}"), F.col("vec_id").alias(f"i{e}"))
    met = pairs.withColumn("ca", spread("na")).withColumn("cb", spread("nb")).join(of("a"), ["a", "ca"], "left").join(of("b"), ["b", "cb"], "left")
    x, y = F.coalesce("ia", "a"), F.coalesce("ib", "b")
    between = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity")
    other = members.select("class", F.col("vec_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    within = members.select("class", "chunk", F.col("vec_id").alias("a")).join(other, ["class", "chunk"]).where("a < b")
    return between.union(within.select("a", "b", F.lit(1.0)))
