"""Line dedup: first occurrences of line hashes, streamed from a range partitioning, as keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import slices
from skein.storage import materialize

_BLANK = b" \t\n\v\f\r"
_LINES = "hi long, lo long, doc_id long, text_hash long, at array<int>"


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z in lower case."""
    return line.strip(_BLANK).lower()  # of bytes, these touch ASCII only


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                digests, owner, at, ends = bytearray(), [], [], [0]
                for i, text in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    found: dict[bytes, list[int]] = {}
                    for n, line in enumerate(text.split(b"\n")):
                        key = line_key(line)
                        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                    for digest, places in found.items():
                        digests += digest
                        owner.append(i)
                        at += places
                        ends.append(len(at))
                keys = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                of = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), part.column("doc_id").take(of), part.column("text_hash").take(of), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))],
                    ["hi", "lo", "doc_id", "text_hash", "at"],
                )

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, document and position: what is not in the first document of its hash, as far as this task sees.

    The task's first hash may have begun in an earlier task. All its rows come out, with the hash. Where a hash's rows
    begin in this task is said for its first and last hash only (`head`): no other hash is in several tasks.
    """
    names = ["hi", "lo", "doc_id", "first_id", "text_hash", "at", "head"]
    opening: tuple[int, int] | None = None
    last: tuple[tuple[int, int], int | None] | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo = np.asarray(batch.column("hi")), np.asarray(batch.column("lo"))
        begins = np.ones(n, bool)
        begins[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        if last is not None and last[0] == (hi[0], lo[0]):
            begins[0] = False
        run = np.cumsum(begins) - 1  # -1: the hash that the batch before ended with
        starts = np.flatnonzero(begins)
        docs = batch.column("doc_id")
        firsts = docs.take(pa.array(np.maximum(starts[np.maximum(run, 0)] if len(starts) else np.zeros(n, np.int64), 0)))
        if last is not None and (run < 0).any():
            firsts = pa.array([last[1] if r < 0 else f for r, f in zip(run.tolist(), firsts.to_pylist(), strict=True)], pa.int64())
        if opening is None:
            opening = (int(hi[0]), int(lo[0]))
            yield pa.RecordBatch.from_arrays([pa.array([opening[0]]), pa.array([opening[1]]), docs.slice(0, 1), docs.slice(0, 1), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([True])], names)
        last = ((int(hi[-1]), int(lo[-1])), firsts[-1].as_py())
        provisional = (hi == opening[0]) & (lo == opening[1])
        same = np.array([a == b for a, b in zip(docs.to_pylist(), firsts.to_pylist(), strict=True)])
        out = pa.array(provisional | ~same)
        kept = batch.filter(out)
        yield pa.RecordBatch.from_arrays([kept.column("hi"), kept.column("lo"), kept.column("doc_id"), firsts.filter(out), kept.column("text_hash"), kept.column("at"), pa.array(np.zeros(kept.num_rows, bool))], names)
    if last is not None and last[0] != opening:
        (hi, lo), doc = last
        yield pa.RecordBatch.from_pydict({"hi": pa.array([hi]), "lo": pa.array([lo]), "doc_id": pa.array([doc], pa.int64()), "first_id": pa.array([doc], pa.int64()), "text_hash": pa.array([None], pa.int64()), "at": pa.array([None], pa.list_(pa.int32())), "head": [True]})


def bitmap(n_lines: int, dropped: list[int]) -> bytes:
    """A bit a line, 1 where it stays, first line in the highest bit, compressed by zlib."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bits: bytes, n_lines: int) -> np.ndarray:
    """Which of n_lines lines a bitmap keeps."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines).astype(bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [bitmap(n, gone or []) for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        n = pa.array([len(gone or []) for gone in batch.column("gone").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "n_lines")), n, pa.array(made, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Which lines of every whole text stay, as bitmaps.

    docs: doc_id, text; other columns are ignored, whatever their names. Texts are split at \\n; a line's key is the line
    without [\\x20\\x09-\\x0D] at both ends, A-Z in lower case. Keys of at least min_chars code points that stand in two
    documents or more lose all their lines but those of the smallest doc_id that holds them, where repeats stay too.

    Keys of a document are hashed to 128 bits, one row for each distinct key with the line numbers, then range-partitioned
    and sorted by hash, document and first line. Ranges cut through a common key as well, so no key gathers in one task;
    each task streams its rows, and at most two rows a task say where its outer hashes begin: they are joined back, at most
    twice the tasks' number of rows. Only lines that may go leave that stage.

    Returns doc_id, text_hash (of the text, XXH64 as Spark has it), n_lines, n_dropped, keep (see `bitmap`), a row for each
    distinct (doc_id, text): repeated rows share it, rows of one doc_id with different texts are one document whose texts
    each have a bitmap. A null or empty text is one empty line. A null doc_id counts as one document after all others.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    lines = rows.where(F.length("text") >= min_chars).mapInArrow(_hashed(min_chars), _LINES)
    order = ("hi", "lo", F.col("doc_id").asc_nulls_last(), F.col("at")[0])
    sort = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    marked, _ = materialize(sort.mapInArrow(_streamed, "hi long, lo long, doc_id long, first_id long, text_hash long, at array<int>, head boolean"), "lines")
    firsts = marked.where("head").groupBy("hi", "lo").agg(F.min("first_id").alias("least"))
    gone = marked.where("not head").join(F.broadcast(firsts), ["hi", "lo"], "left")  # broadcast: two rows a task at most
    first = F.coalesce("least", "first_id")  # without either, only the null document holds the key
    gone = gone.where(first.isNotNull() & ~F.col("doc_id").eqNullSafe(first)).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.flatten(F.collect_set("at")).alias("gone"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    every = rows.select("doc_id", "text_hash", n_lines.alias("n_lines")).distinct()
    joined = every.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "text_hash", "n_lines", "gone").mapInArrow(_packed, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            kept = []
            for text, n, dropped, bits in zip(*(part.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep")), strict=True):
                kept.append("\n".join(x for x, stays in zip(text.split("\n"), kept_lines(bits, n), strict=True) if stays) if dropped else text)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Texts without the lines that `line_bitmaps` gives up: doc_id, n_lines, n_dropped, kept_text, one row per input row.

    Nulls, repeats and clashing columns as there; a null text gives one line and an empty text. Texts meet their bitmaps by a
    hash join that keeps the bitmaps, which are small, so texts are dealt once and never sorted.
    """
    bits = line_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "d", "text_hash": "h"}).hint("shuffle_hash")
    both = _rows(docs).join(bits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    return both.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_applied, "doc_id long, n_lines long, n_dropped long, kept_text string")
