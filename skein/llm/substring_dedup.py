"""Removal of repeated passages: Rabin-Karp hashes of every token window, counted in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import Words, rolling, slices
from skein.storage import materialize

#: Bytes of text in a chunk, and windows that a bucket should hold.
CHUNK_BYTES = 6 << 20
BUCKET_WINDOWS = 1 << 20
_LAST = np.iinfo(np.int64).max


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _chunked(docs: DataFrame, width: int) -> DataFrame:
    """(chunk, windows, blob): runs of neighbouring documents, compressed; what shuffles later is this, not rows of text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            n = np.diff(Words(batch.column("text")).offsets)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([base + serial]), "windows": pa.array([int(np.maximum(n - width + 1, 0).sum())]), "blob": pa.array([_packed(batch)], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES // 4):
                held.append(part)
                size += part.nbytes
                if size >= CHUNK_BYTES:
                    yield flush()
                    held, size, serial = [], 0, serial + 1
        if sum(x.num_rows for x in held):
            yield flush()

    return docs.mapInArrow(packed, "chunk long, windows long, blob binary")


class _Windows:
    """The windows of a chunk: distinct hashes in order, and for each the least document that has it."""

    def __init__(self, blob: bytes, width: int, bits: int):
        table = _unpacked(blob)
        self.rows = table.to_batches()[0]
        self.words = Words(self.rows.column("text"))
        order_of = np.asarray(pc.fill_null(self.rows.column("doc_id"), _LAST))
        self.starts = self.words.full(width)
        self.owner = order_of[self.words.text_of()[self.starts]]
        # the upper bits are the bucket; one low bit goes for each but the seventh
        hashes = rolling(self.words.hashes(), self.starts, width)
        self.values, self.which = np.unique(hashes, return_inverse=True)
        self.least = np.full(len(self.values), _LAST, np.int64)
        np.minimum.at(self.least, self.which, self.owner)
        self.bounds = np.searchsorted(self.values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


#: Entries from which a bucket's first bytes are sent as 256 counts, a table of 1 KiB, rather than each by itself.
COUNTED = 4096


def _encode(values: np.ndarray, least: np.ndarray, bits: int) -> tuple[bytes, bytes, bytes, bytes]:
    """56 bits of each hash below the bucket's, sorted (seven bytes each; in large buckets six, behind counts by the first byte), and the documents by table."""
    v = (values << np.uint64(bits)) >> np.uint64(8)
    many = len(v) >= COUNTED
    counts = np.bincount((v >> np.uint64(48)).astype(np.int64), minlength=256).astype(np.uint32).tobytes() if many else b""
    table, index = np.unique(least, return_inverse=True)
    kind = np.uint8 if len(table) <= 1 << 8 else np.uint16 if len(table) <= 1 << 16 else np.uint32
    return counts, v.view(np.uint8).reshape(-1, 8)[:, : 6 if many else 7].tobytes(), table.tobytes(), index.astype(kind).tobytes()


def _decode(counts: bytes, low: bytes, table: bytes, index: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = 6 if counts else 7
    n = len(low) // width
    v = np.zeros((n, 8), np.uint8)
    v[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    if counts:
        v[:, 6] = np.repeat(np.arange(256, dtype=np.uint8), np.frombuffer(counts, np.uint32))
    ids = np.frombuffer(table, np.int64)
    kind = np.uint8 if len(ids) <= 1 << 8 else np.uint16 if len(ids) <= 1 << 16 else np.uint32
    return v.view(np.uint64).reshape(-1), ids[np.frombuffer(index, kind)]


def substring_dedup(docs: DataFrame, width: int = 13, keep_layout: bool = False) -> DataFrame:
    """Removes the words of every window of `width` words that a document with a smaller id has too.

    docs: doc_id, text and any other columns, which stay (those named as the new ones are
    replaced). Words are [^\\x20\\x09-\\x0D]+, unchanged; all windows of whole texts are judged on the
    input. Adds n_words, n_removed, kept_text (kept words joined by one space; with keep_layout the
    text itself without the removed words and what separates each from the next), removed
    (array<struct<first, last>>: the maximal removal intervals by word number), one row per input row. Null, blank and short texts have no windows
    and lose nothing; rows of one doc_id do not count as smaller than each other; a null doc_id
    counts as the largest.

    Chunks of documents are hashed where they lie and send each distinct window hash once, packed
    by bucket with its least document: a passage that any number of documents share costs one
    entry a chunk. A bucket finds the least document of every hash over all chunks and answers
    with one bit for each entry; a chunk, joined with its answers, marks windows, merges them into
    intervals and cuts. Buckets grow in number with the windows, so each stays near BUCKET_WINDOWS
    entries. Hashes keep 56 bits besides the bucket's (at least 6), so the chance that any of n
    windows is removed wrongly is about n^2 / 2^(57 + bucket bits): 0.1 % at 10^8 windows.
    """
    new = "n_words long, n_removed long, kept_text string, removed array<struct<first:int,last:int>>"
    docs = docs.drop("n_words", "n_removed", "kept_text", "removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks, _ = materialize(_chunked(docs, width), "chunks")
    windows = chunks.agg(F.sum("windows")).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, windows / BUCKET_WINDOWS))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                w = _Windows(blob.as_py(), width, bits)
                rows: dict[str, list] = {k: [] for k in ("bucket", "chunk", "counts", "low", "ids", "index")}
                for b in np.flatnonzero(np.diff(w.bounds)).tolist():
                    lo, hi = w.bounds[b], w.bounds[b + 1]
                    for k, x in zip(rows, (b, chunk, *_encode(w.values[lo:hi], w.least[lo:hi], bits)), strict=True):
                        rows[k].append(x)
                yield pa.RecordBatch.from_pydict({k: pa.array(x, pa.int32() if k == "bucket" else pa.int64() if k == "chunk" else pa.binary()) for k, x in rows.items()})

    def answered(group: pa.Table) -> pa.Table:
        parts = [_decode(*row) for row in zip(*(group.column(k).to_pylist() for k in ("counts", "low", "ids", "index")), strict=True)]
        values, least = np.concatenate([v for v, _ in parts]), np.concatenate([d for _, d in parts])
        order = np.argsort(values, kind="stable")
        same = values[order]
        begin = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(order))))
        smaller = np.zeros(len(values), bool)
        smaller[order] = lowest < least[order]
        cuts = np.cumsum([len(v) for v, _ in parts])[:-1]
        flags = np.split(smaller, cuts)
        some = [i for i, f in enumerate(flags) if f.any()]
        return pa.table({
            "chunk": pa.array([group.column("chunk")[i].as_py() for i in some], pa.int64()),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(some), pa.int32()),
            "bits": pa.array([np.packbits(flags[i]).tobytes() for i in some], pa.binary()),
        })

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, answers in zip(batch.column("blob"), batch.column("answers"), strict=True):
                w = _Windows(blob.as_py(), width, bits)
                elsewhere = np.zeros(len(w.values), bool)
                for a in answers.as_py() or ():
                    lo, hi = w.bounds[a["bucket"]], w.bounds[a["bucket"] + 1]
                    elsewhere[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
                repeated = elsewhere[w.which] | (w.least[w.which] < w.owner)
                yield from _removed(w, w.starts[repeated], width, keep_layout)

    packed = chunks.select("chunk", "blob").mapInArrow(sent, "bucket int, chunk long, counts binary, low binary, ids binary, index binary")
    answers = packed.groupBy("bucket").applyInArrow(answered, "chunk long, bucket int, bits binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), new])
    return chunks.join(answers, "chunk", "left").select("blob", "answers").mapInArrow(cut, schema)


def _removed(w: _Windows, starts: np.ndarray, width: int, keep_layout: bool) -> Iterator[pa.RecordBatch]:
    words = w.words
    edge = np.zeros(words.count + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + width, words.count), 1)
    gone = np.cumsum(edge[:-1]) > 0
    n_removed = words.sums(gone.astype(np.int64))
    # maximal intervals: runs of removed words, broken where a text ends
    fresh = np.zeros(words.count + 1, bool)
    fresh[words.offsets] = True
    before = np.concatenate([[False], gone[:-1]]) & ~fresh[:-1]
    after = np.concatenate([gone[1:], [False]]) & ~fresh[1:]
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    base = words.offsets[:-1][words.text_of()[first]]
    runs = np.searchsorted(first, words.offsets).astype(np.int32)
    removed = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["first", "last"]))
    # kept words, each followed by its space but the last of a text
    keep = np.repeat(~gone, words.ends - words.starts + 1)
    text = words.joined[keep].tobytes()
    ends = np.zeros(words.count + 1, np.int64)
    np.cumsum(np.where(gone, 0, words.ends - words.starts + 1), out=ends[1:])
    at = ends[words.offsets]
    kept = [text[s : max(s, e - 1)].decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    if keep_layout:
        kept = w.rows.column("text").to_pylist()
        for i in np.flatnonzero(np.diff(runs)).tolist():
            data, edge = kept[i].encode(), np.append(words.begin[words.offsets[i] : words.offsets[i + 1]] - words.where[i], words.where[i + 1] - words.where[i])
            parts, at = [], 0
            for r in range(runs[i], runs[i + 1]):
                parts.append(data[at : edge[first[r] - base[r]]])
                at = edge[last[r] - base[r] + 1]
            kept[i] = b"".join([*parts, data[at:]]).decode()
        kept = [t or "" for t in kept]
    batch = pa.RecordBatch.from_arrays(
        [*w.rows.columns, pa.array(np.diff(words.offsets).astype(np.int64)), pa.array(n_removed), pa.array(kept, pa.string()), removed],
        [*w.rows.schema.names, "n_words", "n_removed", "kept_text", "removed"],
    )
    yield from slices(batch, "kept_text", 4 << 20)
