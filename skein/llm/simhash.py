"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import Words, mixed, rolling, slices
from skein.operators.components import connected_components
from skein.storage import materialize

#: Reference fingerprints of the pivot table, drawn from a fixed seed.
REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, 32, dtype=np.uint64)
#: Coordinates compared at a time: most pairs fail in the first few.
COORDINATES = 8
#: Rows of one key that meet in one tile.
TILE = 512
#: Pairs held at once while a tile's rows are linked, and those that the groups compared at once may have.
HELD = 1 << 20

_LANES = np.zeros(256, np.uint64)
for _v in range(256):
    _LANES[_v] = sum(1 << (8 * _b) for _b in range(8) if _v >> _b & 1)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run offsets[i]:offsets[i+1] of 64-bit hashes the bits set in over half; 0 for an empty run."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    # counts of eight bits at a time, each in a byte of its own, over parts of at most 255 hashes
    parts = -(-n[full] // 255)
    first = np.zeros(len(full) + 1, np.int64)
    np.cumsum(parts, out=first[1:])
    begin = np.repeat(offsets[full], parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    data = np.ascontiguousarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[data[:, byte]], begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
        for bit in range(8):
            out[full] |= (2 * counts[:, bit] > n[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def shingle_runs(texts: pa.Array, width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: words, first and last word of every shingle, offsets by text; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    n = np.diff(words.offsets)
    first = words.full(width)
    short = words.offsets[:-1][(n > 0) & (n < width)]
    last = np.concatenate([first + width - 1, short + n[(n > 0) & (n < width)] - 1])
    first = np.concatenate([first, short])
    order = np.argsort(first, kind="stable")
    per = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=offsets[1:])
    return words, first[order], last[order], offsets


def _shingle_hashes(words: Words, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    one = words.hashes(42)
    h = rolling(one, first, 1)
    for j in range(1, width):
        inside = first + j <= last
        h[inside] = mixed(h[inside] * np.uint64(3) + one[first[inside] + j])
    return h


def _seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mixed(h + np.uint64(0x9E3779B97F4A7C15 * seed & (1 << 64) - 1))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles in order, and their offsets by text."""
    words, first, last, offsets = shingle_runs(texts, width)
    h = _shingle_hashes(words, first, last, width)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, owner))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1), out=out[1:])
    return h[new], out


def _set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every set; 0 for an empty one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_seeded(h, 0), out=total[1:])
    return mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fps array<long>): SimHash of the space-joined word shingles of every whole text.

    A-Z is lower-cased, repeats count; a shingle's hash is XXH64 of its UTF-8 bytes, seed 42. Null and
    blank texts have fingerprint zero. fps holds the one fingerprint.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words, first, last, offsets = shingle_runs(part.column("text"), width)
                joined = words.joined.tobytes()
                spans = zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True)
                fps = majority(np.fromiter((xx(joined[s:e], 42) for s, e in spans), np.uint64, len(first)), offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1), pa.int32()), pa.array(fps.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "fps"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, fps array<long>")


def pivot_table(classes: DataFrame) -> DataFrame:
    """(id, fp, pivots) of classes (id, fps): the Hamming distances of the fingerprint to all REFERENCES, computed once."""
    fp = F.col("fps")[0]
    signed = REFERENCES.view(np.int64).tolist()
    return classes.select("id", fp.alias("fp"), F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("tinyint") for r in signed]).alias("pivots"))


def kept_by_pivots(pivots: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b) those whose largest coordinate difference is within the radius; the rest differ by more bits."""
    for at in range(0, pivots.shape[1], COORDINATES):
        some = slice(at, at + COORDINATES)
        near = np.abs(pivots[a, some] - pivots[b, some]).max(axis=1, initial=0) <= radius
        a, b = a[near], b[near]
    return a, b


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b in root, in place; every row points to the least row of its tree."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _meetings(group: np.ndarray, side: np.ndarray, within: Callable[[np.ndarray, np.ndarray], np.ndarray], inner: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal group, nearest places first; rows are sorted by group and by what `within` compares, so none beyond it follows.

    Rows of the two tiles that meet (side 1 and 2) pair with each other only: each tile is paired within
    itself elsewhere (side 0). `inner` gives the pairs within each of the two as well.
    """
    at, shift = np.arange(len(group)), 1
    while True:
        at = at[at + shift < len(group)]
        at = at[(group[at] == group[at + shift]) & within(at, at + shift)]
        if not len(at):
            return
        met = at if inner else at[(side[at] != side[at + shift]) | (side[at] == 0)]
        yield met, met + shift
        shift += 1


def _dealt(dealt: DataFrame, order: str, columns: list[str], solve: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows of dealt (id, cut, key, columns) that share cut and key meet in tasks: solve(rows, group, side) sees whole groups.

    Keys with over TILE rows are cut into tiles, each pair of which meets as a group of its own: no
    task holds a whole hot key. Rows of a group come sorted by `order`.
    """
    hot = dealt.groupBy("cut", "key").count().where(F.col("count") > TILE).select("cut", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    hot, _ = materialize(hot, "hotkeys")
    if hot.count() <= 50_000:  # a bound checked here; beyond it the join is shuffled
        hot = F.broadcast(hot)
    tile = F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(1)))
    spread = (
        dealt.join(hot, ["cut", "key"], "left").withColumn("tile", tile.cast("int"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
        .select("id", *columns, "cut", "key", F.least("tile", "met").alias("t1"), F.greatest("tile", "met").alias("t2"),
                F.when(F.col("tile") == F.col("met"), 0).when(F.col("tile") < F.col("met"), 1).otherwise(2).cast("int").alias("side"))
    )
    keys = ["cut", "key", "t1", "t2"]
    spread = spread.repartition(*keys).sortWithinPartitions(*keys, order)

    def solved(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, which begin at 0 and `new`, some at a time: no more than may have HELD pairs, or one."""
        starts, ends = np.append(0, new), np.append(new, table.num_rows)
        most, at = np.cumsum((ends - starts) ** 2), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(most, HELD + (most[at - 1] if at else 0), side="right")))
            some = table.slice(starts[at], ends[to - 1] - starts[at])
            yield solve(some, np.repeat(np.arange(to - at), (ends - starts)[at:to]), some.column("side").to_numpy())
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            if not table.num_rows:
                continue
            group = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
            new = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0
            kept = table.slice(cut).combine_chunks()
            if cut:
                yield from solved(table.slice(0, cut), new[:-1])
        if kept is not None and kept.num_rows:
            yield from solved(kept, np.zeros(0, np.int64))

    return spread.mapInArrow(run, schema)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The elements of an array column, a row each."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten()).reshape(table.num_rows, -1)


def links(classes: DataFrame, radius: int) -> DataFrame:
    """(src, dst) between rows of classes (id, fps) that connect exactly what lies within the radius.

    The pivot table holds each fingerprint's Hamming distances to many references. A distance to a
    reference changes by at most d(x, y), so a pair is discarded when the largest coordinate
    difference exceeds the radius; survivors are verified by their Hamming distance.

    Comparing the table's rows all with all would be quadratic, so rows are dealt first: bits are
    cut in radius + 2 blocks, at most `radius` of which differ, so that two blocks of a linked pair
    agree. Each pair of blocks is a key (21 bits for radius 4); rows of a key are sorted by their
    first coordinate and compared while that is near. A group emits a spanning forest of its links,
    never all pairs.
    """
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    block = lambda i: F.shiftrightunsigned(F.col("fp"), cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    keys = [F.struct(F.lit(n).alias("cut"), F.shiftleft(block(i), 32).bitwiseOR(block(j)).alias("key")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    table, _ = materialize(pivot_table(classes), "pivots")
    dealt = table.withColumn("first", F.col("pivots")[0]).withColumn("k", F.explode(F.array(*keys))).select("id", "fp", "pivots", "first", "k.*")

    def solve(rows: pa.Table, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        ids, fp, pivots = rows.column("id").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), _flat(rows, "pivots")
        first, root = pivots[:, 0].astype(np.int16), np.arange(rows.num_rows)
        held, size = [], 0
        for a, b in _meetings(group, side, lambda a, b: first[b] - first[a] <= radius):
            a, b = kept_by_pivots(pivots, a, b, radius)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            held.append((a[near], b[near]))
            size += int(near.sum())
            if size > HELD:
                _unite(root, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                held, size = [], 0
        if held:
            _unite(root, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        member = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[member]), pa.array(ids[root[member]])], ["src", "dst"])

    return _dealt(dealt, "first", ["fp", "pivots", "first"], solve, "src long, dst long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate classes of documents by SimHash.

    docs: doc_id, text; other columns are ignored. Two texts link when their fingerprints differ in
    at most `radius` bits. Returns doc_id, fps (array<long>), component_id (smallest doc_id reachable over links,
    itself included), one row per input row.

    Equal fingerprints first become one class, whose id is their smallest doc_id, so copies are
    not compared with each other. Null and blank texts share fingerprint zero and one component;
    rows with a null doc_id return with null component_id and link nothing; repeated rows and ids
    return as often as they came.
    """
    prints, _ = materialize(fingerprints(docs, width), "fps")
    classes, _ = materialize(prints.where("doc_id is not null").groupBy("fps").agg(F.min("doc_id").alias("id")), "classes")
    found = connected_components(links(classes, radius))
    named = classes.join(found, "id", "left").select("fps", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fps", "left").select("doc_id", "fps", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Fingerprints of `near_duplicate_components`, those of its first pass, and the groups of bits each is dealt by.
SEEDS, FIRST_SEEDS, GROUPS = 12, 3, 5
#: Fingerprints that a dealt row carries; bits that the first of them may differ in, and all of them, for sets under SMALL shingles and others.
CARRIED, APART, SMALL, ALL_APART = 6, 20, 16, (101, 88)
#: Cells of a set's sketch, a byte each.
CELLS = 512
#: Bits by which two first fingerprints may differ to be linked through the pivot table before all else.
RADIUS = 4


def set_fingerprints(docs: DataFrame, width: int, seeds: int = SEEDS, also: str | None = None) -> DataFrame:
    """(doc_id, set_id, size, fps, and the long column `also`): SimHashes of each whole text's distinct shingles; equal sets share set_id, that of none is 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, offsets = shingle_sets(part.column("text"), width)
                flat = np.stack([majority(_seeded(h, s), offsets) for s in range(1, seeds + 1)], axis=1).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * seeds, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_set_ids(h, offsets)), pa.array(np.diff(offsets), pa.int32()), lists, *[part.column(c) for c in more]], ["doc_id", "set_id", "size", "fps", *more])

    more = [also] if also else []
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(made, ", ".join(["doc_id long, set_id long, size int, fps array<long>", *(f"`{c}` long" for c in more)]))


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) that, with what root joins already, make a spanning forest of least `apart`: in each round every tree takes its least pair."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    kept, live = np.zeros(len(a), bool), np.arange(len(a))
    while True:
        ra, rb = root[a[live]], root[b[live]]
        live, ra, rb = live[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(live):
            return order[kept]
        best = np.full(len(root), len(a))
        np.minimum.at(best, ra, live)
        np.minimum.at(best, rb, live)
        chosen = np.unique(best[best < len(a)])
        kept[chosen] = True
        _unite(root, a[chosen], b[chosen])


def _by_bits(classes: DataFrame, seeds: int) -> DataFrame:
    """classes (id, component, size, fps) dealt by groups of bits: cut (64 times the number of the fingerprint, plus the group's first bit), key, and CARRIED fingerprints."""
    dealt = classes.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(seeds * GROUPS - 1))))
    seed, lo, hi = f"at div {GROUPS}", f"(64 * (at % {GROUPS})) div {GROUPS}", f"(64 * (at % {GROUPS} + 1)) div {GROUPS}"
    key = f"shiftrightunsigned(fps[cast({seed} as int)], cast({lo} as int)) & (shiftleft(1L, cast({hi} - {lo} as int)) - 1)"
    dealt = dealt.select("id", "size", "component", "fps", F.expr(f"cast(64 * ({seed}) + {lo} as int)").alias("cut"), F.expr(key).alias("key"))
    return dealt.withColumn("fps", _carried())


def _carried() -> Column:
    """Of a row (cut, fps) CARRIED fingerprints from that of the cut on."""
    return F.slice(F.concat("fps", "fps"), F.expr("cast(cut div 64 as int)") + 1, CARRIED)


_DEALT = ["size", "component", "fps"]


def _near(rows: pa.Table, group: np.ndarray, side: np.ndarray, least: float, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bits apart): pairs of rows of a group, of different components, whose sizes and CARRIED fingerprints allow the similarity."""
    size, fps, label = rows.column("size").to_numpy(), _flat(rows, "fps").view(np.uint64), rows.column("component").to_numpy()
    limit = np.where(size < SMALL, *ALL_APART)
    held = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16))]
    for a, b in _meetings(group, side, lambda a, b: size[b] * least <= size[a], inner):
        other = label[a] != label[b]
        a, b = a[other], b[other]
        close = np.bitwise_count(fps[a, 0] ^ fps[b, 0]) <= APART
        a, b = a[close], b[close]
        apart = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int16)
        close = apart <= limit[a]
        held.append((a[close].astype(np.int32), b[close].astype(np.int32), apart[close]))
    return tuple(np.concatenate([x[i] for x in held]) for i in range(3))


def _pairs(rows: pa.Table, a: np.ndarray, b: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    """(src, dst, ca, cb, cut, key): the pairs (a, b) of rows, and a row of nulls with cut and key for each row of full."""
    ids, label, n, none = rows.column("id").to_numpy(), rows.column("component").to_numpy(), len(a), np.zeros(len(full), np.int64)
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    ends = [pa.array(np.concatenate([x, none])) for x in (ids[a], ids[b])]
    labels = [pa.array(np.concatenate([x, none]), mask=np.arange(n + len(full)) >= n) for x in (label[a], label[b])]
    cut = np.concatenate([np.zeros(n, np.int32), rows.column("cut").to_numpy()[full].astype(np.int32)])
    key = np.concatenate([np.zeros(n, np.int64), rows.column("key").to_numpy()[full].astype(np.int64)])
    return pa.RecordBatch.from_arrays([*ends, *labels, pa.array(cut), pa.array(key)], ["src", "dst", "ca", "cb", "cut", "key"])


_PAIRS = "src long, dst long, ca long, cb long, cut int, key long"


def candidate_pairs(classes: DataFrame, least: float, seeds: int) -> DataFrame:
    """(src, dst, ca, cb, cut, key): rows of classes (id, component, size, fps) that may be similar but are in different components ca, cb.

    They agree in a group of bits and nearly so in CARRIED fingerprints. Sets of Jaccard similarity 0.8
    differ in 16 % of SimHash bits (19 % where they are small), so each of the seeds * GROUPS groups
    agrees in a tenth of such pairs and more, and with 12 seeds all differ in one of some hundreds at
    most; APART and ALL_APART lie four deviations above what they then differ in. Rows of a group are
    sorted by size and compared while sizes allow the similarity.

    A group with more pairs than rows is dense: it gives a spanning forest of its nearest pairs, over
    components and over what each of two meeting tiles joins by itself, so a group of n rows gives some n
    pairs, and one row (0, 0, null, null, cut, key) that says so.
    """

    def solve(rows: pa.Table, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        a, b, apart = _near(rows, group, side, least, True)
        met = (side[a] != side[b]) | (side[a] == 0)
        count = np.bincount(group)
        many = np.bincount(group[a[met]], minlength=len(count)) > count
        dense = np.flatnonzero(many[group[a]])
        # rows of one component, and what one tile joins by itself, are joined before pairs are chosen
        _, root = np.unique(np.stack([group, rows.column("component").to_numpy()]), axis=1, return_inverse=True)
        first = np.full(root.max() + 1, len(group))
        np.minimum.at(first, root, np.arange(len(group)))
        root = first[root]
        own = dense[~met[dense]]
        _unite(root, a[own], b[own])
        other = dense[met[dense]]
        take = np.concatenate([np.flatnonzero(~many[group[a]] & met), other[_forest(a[other], b[other], apart[other], root)]])
        return _pairs(rows, a[take], b[take], np.searchsorted(group, np.flatnonzero(many)))

    return _dealt(_by_bits(classes, seeds), "size", _DEALT, solve, _PAIRS)


def live_rows(classes: DataFrame, least: float, keys: DataFrame) -> DataFrame:
    """(id, cut, key): rows of classes in the groups `keys` (cut, key) that have a candidate in another component there."""

    def solve(rows: pa.Table, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        a, b, _ = _near(rows, group, side, least)
        return pa.RecordBatch.from_struct_array(rows.select(["id", "cut", "key"]).take(np.union1d(a, b)).to_struct_array().combine_chunks())

    dealt = _by_bits(classes, SEEDS).join(keys, ["cut", "key"], "left_semi")
    return _dealt(dealt, "size", _DEALT, solve, "id long, cut int, key long").distinct()


def _sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many hashes of each set, 255 at most, fall in each of CELLS cells: two sets differ in no fewer hashes than their sketches do."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cells = np.bincount(owner * CELLS + (_seeded(h, 0) % np.uint64(CELLS)).astype(np.int64), minlength=(len(offsets) - 1) * CELLS)
    return np.minimum(cells, 255).astype(np.uint8).reshape(-1, CELLS)


def pairs_left(classes: DataFrame, least: float, live: DataFrame) -> DataFrame:
    """(src, dst, ca, cb, cut, key): all candidates of different components among live rows (id, cut, key) of classes, which have sketches, but those that cannot be similar.

    Sets with a and b hashes of which d are not in both have similarity (a + b - d) / (a + b + d), and d is no less than what their sketches differ by.
    """

    def solve(rows: pa.Table, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        a, b, _ = _near(rows, group, side, least)
        size = rows.column("size").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, CELLS)
        kept = []
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            apart = (np.maximum(sketch[x], sketch[y]) - np.minimum(sketch[x], sketch[y])).sum(axis=1, dtype=np.int64)
            both = size[x].astype(np.int64) + size[y]
            kept.append(at + np.flatnonzero(both - apart >= least * (both + apart) - 1e-6))
        kept = np.concatenate([*kept, np.zeros(0, np.int64)])
        return _pairs(rows, a[kept], b[kept], np.zeros(0, np.int64))

    dealt = live.join(classes, "id").withColumn("fps", _carried())
    return _dealt(dealt, "size", [*_DEALT, "sketch"], solve, _PAIRS)


def near_duplicate_components(docs: DataFrame, width: int = 5, least: float = 0.8, also: str | None = None) -> DataFrame:
    """Classes of documents linked by Jaccard similarity >= least of their sets of word shingles: doc_id, component_id.

    docs: doc_id, text; `also` names a long column that returns with its row; others are ignored. Texts of
    equal sets are one class; SimHash finds candidate pairs of classes (`links` by the pivot table, then `candidate_pairs`,
    made for similarity 0.8 and more) and the sets themselves, as 64-bit hashes, decide. A text of fewer words is
    one shingle. component_id is the smallest doc_id that links reach. Null and blank texts are one class;
    rows with a null doc_id return with null component_id and link nothing; repeated rows return as often
    as they came.

    A cluster of n versions has n^2 / 2 candidate pairs, of which a few a version decide. First come the
    links of the pivot table, within RADIUS bits of one fingerprint. What one fingerprint tells apart is
    looked for by more: a pass over few of them joins clusters by forests of their nearest pairs; one over
    all looks for pairs between different components, again by forests where groups are dense; the last
    gives all pairs between components that dense groups still hold, so that no candidate is lost, but for
    those that counts of their shingles in CELLS cells show to differ too much.
    """
    prints, _ = materialize(set_fingerprints(docs, width, also=also), "fps")
    made = prints.where("doc_id is not null").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fps").alias("fps"))
    classes, _ = materialize(made.withColumn("component", F.col("id")), "classes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, offsets = shingle_sets(part.column("text"), width)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(h, offsets)), lists], ["id", "shingles"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, offsets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(h, offsets)), pa.array([x.tobytes() for x in _sketches(h, offsets)], pa.binary())], ["id", "sketch"])

    def sets_of(used: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = sets, schema: str = "id long, shingles array<long>") -> DataFrame:
        """(id, shingles) of the classes used (id), or what else is made of their texts."""
        texts = docs.select(F.col("doc_id").cast("long"), "text").join(used.join(classes.select("id", "doc_id"), "id").select("doc_id").distinct(), "doc_id", "left_semi").select("text")
        return materialize(texts.mapInArrow(made, schema).join(used, "id", "left_semi").dropDuplicates(["id"]), "sets")[0]

    def joined(pairs: DataFrame) -> None:
        """Verifies pairs (src, dst, ca, cb) by their sets and joins the components of those that are similar."""
        nonlocal classes
        held = sets_of(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct())
        both = pairs.join(held.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src").join(held.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst")
        shared = F.size(F.array_intersect("a", "b"))
        near = both.where(shared / (F.size("a") + F.size("b") - shared) >= least).select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        to = connected_components(near).select(F.col("id").alias("component"), F.col("component").alias("into")).where("component <> into")
        classes, _ = materialize(classes.join(to, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into"), "classes")

    some = classes.where("id <> 0")
    near = links(some.select("id", F.slice("fps", 1, 1).alias("fps")), RADIUS).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs, _ = materialize(near.withColumns({"ca": F.col("src"), "cb": F.col("dst")}), "pairs")
    joined(pairs)
    done = pairs.select("src", "dst")
    for seeds in (FIRST_SEEDS, SEEDS):
        found, _ = materialize(candidate_pairs(classes.where("id <> 0"), least, seeds), "candidates")
        pairs = found.where("ca is not null").select("src", "dst", "ca", "cb").distinct()
        pairs, _ = materialize(pairs.join(done, ["src", "dst"], "left_anti"), "pairs")
        joined(pairs)
        done = done.union(pairs.select("src", "dst"))
    dense = found.where("ca is null").select("cut", "key").distinct()
    if dense.limit(1).count():
        live, _ = materialize(live_rows(classes.where("id <> 0"), least, dense), "live")
        counted = classes.join(sets_of(live.select("id").distinct(), sketches, "id long, sketch binary"), "id")
        rest = pairs_left(counted, least, live).select("src", "dst", "ca", "cb").distinct().join(done, ["src", "dst"], "left_anti")
        rest, _ = materialize(rest, "pairs")
        joined(rest)
    first = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = classes.select(F.col("id").alias("set_id"), "component").join(first, "component").select("set_id", "component_id")
    more = [also] if also else []
    return prints.join(of, "set_id", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *more)
