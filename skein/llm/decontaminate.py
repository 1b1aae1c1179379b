"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.words import Words, rolling, slices

#: Words of a shingle.
WIDTH = 5
#: Fingerprint bits that may differ, and the blocks they are cut in: with 7 blocks one of them differs in at most one bit.
RADIUS, BLOCKS = 13, 7
#: Items that one index holds; larger benchmarks take several, which one pass over the texts looks up.
ITEMS = 20_000
#: Window starts that are fingerprinted at a time: bounds memory in the length of a text.
STARTS = 16_384
_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_BITS = np.arange(64, dtype=np.uint64)


def _normal(word: bytes) -> bytes:
    return word.decode().strip(_MARKS).encode() or word


def _weights(distinct: list[bytes]) -> np.ndarray:
    """A word weighs as many units as it has letters: common words are short."""
    return np.array([len(w.decode()) for w in distinct], np.int64)


def _shingles(words: list[bytes]) -> dict[bytes, int]:
    """Weight of every distinct shingle: its letters, times its occurrences."""
    n = max(1, len(words) - WIDTH + 1)
    count = Counter(b" ".join(words[i : i + WIDTH]) for i in range(n))
    return {s: c * len(s.decode()) for s, c in count.items()}


def similarity(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Weighted Jaccard similarity."""
    least = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


class _Coded:
    """Normalised words of texts: codes, hashes, weights."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, lower=True)
        self.codes, distinct = self.words.encoded()
        self.distinct = [_normal(w) for w in distinct]
        h = np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in self.distinct), np.uint64, len(self.distinct))
        self.hash = h[self.codes] if len(h) else np.zeros(0, np.uint64)

    def list(self, a: int, b: int) -> list[bytes]:
        return [self.distinct[c] for c in self.codes[a:b]]

    def votes(self, a: int, b: int) -> np.ndarray:
        """Sums of weighted bit votes of words a..i, for i from a to b, with a row of zeros first."""
        w = np.array([len(self.distinct[c].decode()) for c in self.codes[a:b]], np.int32)
        out = np.zeros((b - a + 1, 64), np.int32)
        for bit in range(64):
            set_ = (self.hash[a:b] >> np.uint64(bit) & np.uint64(1)).astype(np.int32)
            np.cumsum(np.where(set_ == 1, w, -w), out=out[1:, bit])
        return out


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return ((votes > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Index:
    """Benchmark items by length: fingerprints, and for every block value the items within one bit of it."""

    def __init__(self, items: list[tuple[int, str]]):
        coded = _Coded(pa.array([t for _, t in items], pa.string()))
        off = coded.words.offsets
        self.ids = [i for i, _ in items]
        self.shingles = [_shingles(coded.list(off[k], off[k + 1])) for k in range(len(items))]
        lengths = np.diff(off)
        prints = np.array([_fingerprints(coded.votes(off[k], off[k + 1])[-1:])[0] for k in range(len(items))], np.uint64)
        self.cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        self.of: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == n)
            tables = []
            for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
                value = (prints[at] >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)).astype(np.int64)
                near = np.concatenate([value, *(value ^ 1 << b for b in range(hi - lo))])
                item = np.tile(at, hi - lo + 1)
                order = np.argsort(near, kind="stable")
                tables.append((np.searchsorted(near[order], np.arange((1 << hi - lo) + 1)), item[order]))
            self.of[n] = (at, prints, tables)
        starts = coded.words.full(WIDTH)
        short = np.flatnonzero((lengths > 0) & (lengths < WIDTH))
        #: Hashes of all shingles of items; items of fewer words by their first word.
        self.known = np.unique(rolling(coded.hash, starts, WIDTH))
        self.first = np.unique(coded.hash[off[short]])
        self.lengths = sorted(self.of)
        # by shingle hash: the items that hold it and its weight there, for texts of fewer words than an item
        owner = coded.words.text_of()[starts]
        letters = _weights(coded.distinct)[coded.codes] if coded.words.count else np.zeros(0, np.int64)
        sums = np.append(0, np.cumsum(letters))
        weight = sums[starts + WIDTH] - sums[starts] + WIDTH - 1
        h = rolling(coded.hash, starts, WIDTH)
        order = np.lexsort((owner, h))
        h, owner, weight = h[order], owner[order], weight[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)])
        self.holds = h[new], owner[new], np.add.reduceat(weight, new) if len(new) else weight
        self.words = lengths
        self.weight = np.array([sum(x.values()) for x in self.shingles], np.int64)
        self.shortest = len(short) > 0

    def within(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in prints, item) of all items of n words within RADIUS: every block's near values, then the distance."""
        _, own, tables = self.of[n]
        rows, items = [], []
        for (lo, hi), (bounds, item) in zip(zip(self.cuts, self.cuts[1:], strict=False), tables, strict=True):
            value = (prints >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)).astype(np.int64)
            size = bounds[value + 1] - bounds[value]
            row = np.repeat(np.arange(len(prints)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[value], size)
            rows.append(row)
            items.append(item[place])
        row, item = np.concatenate(rows), np.concatenate(items)
        near = np.bitwise_count(prints[row] ^ own[item]) <= RADIUS
        pair = np.unique(row[near] * len(self.ids) + item[near])
        return pair // len(self.ids), pair % len(self.ids)

    def longer(self, coded: _Coded, a: int, b: int, least: float) -> list[tuple[int, float]]:
        """(item, similarity) of all items of more words than the whole text a:b that are similar enough."""
        by, item, weight = self.holds
        if b - a < WIDTH or not len(by):
            return []
        h = np.unique(rolling(coded.hash, np.arange(a, b - WIDTH + 1), WIDTH))
        lo, hi = np.searchsorted(by, h), np.searchsorted(by, h, side="right")
        at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        at = at[self.words[item[at]] > b - a]
        if not len(at):
            return []
        # what text and item share weighs at most what the item's shingles in the text weigh in the item
        few, place = np.unique(item[at], return_inverse=True)
        few = few[np.bincount(place, weights=weight[at]) >= least * self.weight[few] * (1 - 1e-9)]
        if not len(few):
            return []
        own = _shingles(coded.list(a, b))
        return [(i, sim) for i in few.tolist() if (sim := similarity(own, self.shingles[i])) >= least]

    def matches(self, texts: pa.Array, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) for whole texts; of matches of one item that overlap, the best."""
        coded = _Coded(texts)
        off = coded.words.offsets
        starts = coded.words.full(WIDTH)
        hit = np.zeros(coded.words.count, bool)
        if len(self.known) and len(starts):
            h = rolling(coded.hash, starts, WIDTH)
            hit[starts] = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        if self.shortest:
            hit |= np.isin(coded.hash, self.first)
        where, owner = np.flatnonzero(hit), coded.words.text_of()
        out = []
        if not len(where):
            return out
        for t in np.unique(owner[where]).tolist():
            if off[t + 1] - off[t] < self.lengths[-1]:
                a, b = int(off[t]), int(off[t + 1])
                out += [(t, i, 0, b - a, sim) for i, sim in self.longer(coded, a, b, least)]
        # a window that is similar enough shares a shingle with its item, so only windows over a hit can be
        reach = self.lengths[-1]
        split = np.flatnonzero((np.diff(where) > 2 * reach) | (np.diff(owner[where]) != 0)) + 1
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for run in np.split(where, split):
            t = int(owner[run[0]])
            low, high = max(int(off[t]), int(run[0]) - reach), int(run[-1]) + 1
            for a in range(low, high, STARTS):
                self._windows(coded, run, a, min(a + STARTS, high), int(off[t + 1]), t, least, found)
        for (t, i), hits in found.items():
            n = int(self.words[i])
            group: list[tuple[int, float]] = []
            for s, sim in [*sorted(hits), (1 << 60, 0.0)]:
                if group and s >= group[0][0] + n:
                    s0, sim0 = max(group, key=lambda x: (x[1], -x[0]))
                    out.append((t, i, s0 - int(off[t]), n, sim0))
                    group = []
                group.append((s, sim))
        return out

    def _windows(self, coded: _Coded, run: np.ndarray, a: int, b: int, end: int, t: int, least: float, found: dict[tuple[int, int], list[tuple[int, float]]]) -> None:
        """Adds to found, by (text, item), the windows (start, similarity) that start at words a..b of text t, end by `end` and lie over a hit of run."""
        last_word = min(b + self.lengths[-1], end)
        votes = coded.votes(a, last_word)
        for n in self.lengths:
            last = min(b - 1, last_word - n) - a
            if last < 0:
                continue
            edge = np.zeros(last + 2, np.int64)
            np.add.at(edge, np.clip(run - a - n + min(n, WIDTH), 0, last + 1), 1)
            np.add.at(edge, np.clip(run - a + 1, 0, last + 1), -1)
            begin = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            row, item = self.within(n, _fingerprints(votes[begin + n] - votes[begin]))
            made: dict[int, dict[bytes, int]] = {}
            for r, i in zip(row.tolist(), item.tolist(), strict=True):
                s = a + int(begin[r])
                if s not in made:
                    made[s] = _shingles(coded.list(s, s + n))
                sim = similarity(made[s], self.shingles[i])
                if sim >= least:
                    found.setdefault((t, i), []).append((s, sim))


def _indexes(spark: SparkSession, benchmark: DataFrame):
    """Broadcast indexes of at most ITEMS items each; the driver holds one block of items at a time."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    block: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEMS:
            yield spark.sparkContext.broadcast(Index(block))
            block = []
    if block:
        yield spark.sparkContext.broadcast(Index(block))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """Windows of whole texts that are benchmark items: doc_id, item_id, first_word, n_words, similarity.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A-Z is lower-cased and
    marks at a word's ends are dropped. For an item of n words, windows of n words are
    fingerprinted (SimHash over words weighted by their letters); items within RADIUS bits come
    from an index of BLOCKS blocks, of which one differs in at most one bit, so none within the
    radius is missed; survivors are verified by the weighted Jaccard similarity of their five-word
    shingles (fewer words: the whole sequence), which must reach `least`. Only windows over a
    shingle that some item has are fingerprinted; all others have similarity zero.

    A text of fewer words than an item is compared as one window, whatever their fingerprints: the
    items that share shingles of enough weight with it are looked up by shingle and verified alike.

    Null texts and items without words match nothing; equal items each match; a null doc_id stays
    null; repeated rows each match. Texts do not move: each task looks them up in the indexes. Long
    texts are fingerprinted STARTS windows at a time, whatever their length.
    """
    indexes = list(_indexes(docs.sparkSession, benchmark))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for shared in indexes:
                    index = shared.value
                    got = index.matches(part.column("text"), least)
                    at = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(at), pa.array([index.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "similarity"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, "doc_id long, item_id long, first_word long, n_words long, similarity double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item (see `contaminated`)."""
    indexes = list(_indexes(docs.sparkSession, benchmark))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keep = np.ones(part.num_rows, bool)
                for shared in indexes:
                    keep[[g[0] for g in shared.value.matches(part.column("text"), least)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
