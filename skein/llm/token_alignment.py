"""Cross-tokenizer alignment: where the tokens of two tokenizers end together."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.words import slices
from skein.storage import materialize

#: Bytes of text in a slice, about; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20

#: Distinct id pairs up to which their counts are broadcast (64 bytes each or so); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

_SLICES = "chunks array<binary>, times array<int>, docs array<struct<doc_id: long, codes: array<int>>>"
_TOKENS = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"

#: Bytes before which texts are cut, and those after which they are not.
_CUT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A]] = True
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True

#: Texts with any of these are not cut: white space, or near it, of which tokenizers differ.
_ODD = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"


def cuttable(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut: before white space that follows something else. Pieces such as `;\\r` go on with a carriage return, so not before that."""
    out = _CUT[data]
    out[:1] = False
    out[1:] &= ~_BLANK[data[:-1]]
    return out


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A `tokenizers` file of byte-level BPE; special strings in texts are plain text, nothing is added."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content.decode())
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        said = json.loads(content)
        before = said.get("pre_tokenizer") or {}
        #: Its pre-tokens end wherever white space follows something else, so texts may be cut there.
        self.cuts = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A `sentencepiece` model that puts a space before its text."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes across a place where texts may be cut, so no merge does.
        self.cuts = not any(cuttable(np.frombuffer(p, np.uint8)).any() for p in self.bytes_of)
        self._before = self._model.encode("x")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with the space that the model adds."""
        return self._model.encode([t[1:] for t in texts], num_threads=1)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Of chunks that begin with white space, as they are encoded after other characters."""
        n = len(self._before)
        return [ids[n:] if ids[:n] == self._before else [] for ids in self._model.encode(["x" + c for c in chunks], num_threads=1)]


def _lists(rows: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Ids as lists, and lists of the byte offsets where they end."""
    count = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.fromiter(chain.from_iterable(rows), np.int32, int(count.sum()))
    offsets, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(sizes[ids]))
    at = pa.array(offsets, pa.int32())
    ends = total[1:] - np.repeat(total[offsets[:-1]], count)
    return pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))


class Encoders:
    """Both tokenizers over chunks."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self._sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b)]

    def lists(self, chunks: list[bytes], whole: bool) -> list[pa.Array]:
        """Lists of A's ids, their ends, B's ids and their ends; null where the bytes of either differ from the chunk's. whole: chunks are whole texts."""
        texts = [c.decode() for c in chunks]
        made = self.a.encode(texts), (self.b.encode if whole else self.b.encode_chunks)(texts)
        joined = ([b"".join([t.bytes_of[i] for i in ids]) for ids in rows] for t, rows in zip((self.a, self.b), made, strict=True))
        bad = pa.array([x != c or y != c for c, x, y in zip(chunks, *joined, strict=True)])
        return [pc.if_else(bad, pa.scalar(None, x.type), x) for rows, sizes in zip(made, self._sizes, strict=True) for x in _lists(rows, sizes)]


#: What a worker process keeps from task to task.
_kept: dict[bytes, Encoders] = {}


def _of_worker(a: bytes, b: bytes) -> Encoders:
    key = hashlib.sha256(a + b).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoders(a, b)
    return _kept[key]


def _slice(ids: pa.Array, texts: pa.Array, cuts: bool) -> pa.RecordBatch:
    """One row: the distinct chunks of the texts, each text behind a space, and each text as chunk numbers."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    some = size > 0
    ids, texts = pa.concat_arrays([ids.filter(pa.array(some)), ids.filter(pa.array(~some))]), texts.filter(pa.array(some))
    size, n = size[some], int(some.sum())
    joined = pc.binary_join_element_wise(*(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    data = np.frombuffer(joined.buffers()[2], np.uint8)[: int(size.sum()) + n] if n else np.zeros(0, np.uint8)
    begin = np.cumsum(size + 1) - size - 1  # of each text, with the space before it
    cut = cuttable(data)
    odd = np.asarray(pc.match_substring_regex(texts, _ODD)) if cuts else np.ones(n, bool)
    for i in np.flatnonzero(odd):
        cut[begin[i] : begin[i] + 1 + size[i]] = False
    cut[begin] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    codes = np.asarray(coded.indices)
    count = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    chunks = coded.dictionary.to_pylist()
    for k in set(codes[np.repeat(odd, count)].tolist()):
        chunks[k] = b"\0" + chunks[k]
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.append(0, np.cumsum(count)), np.full(int((~some).sum()), len(codes))), pa.int32()), pa.array(codes, pa.int32()))
    docs = pa.StructArray.from_arrays([ids, lists], ["doc_id", "codes"])
    columns = (pa.array(chunks, pa.binary()), pa.array(np.bincount(codes, minlength=len(chunks)), pa.int32()), docs)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], ["chunks", "times", "docs"])


def sliced(docs: DataFrame, cuts: bool = True) -> DataFrame:
    """Slices of the documents, a row each: their distinct chunks with how often they occur, and every document as chunk numbers.

    Texts, each behind a space, are cut before white space that follows something else. Texts with unusual white space, and
    all if not `cuts`, are one chunk each, marked by a zero byte before it (others begin with white space). Null and empty texts
    have no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            for part in slices(batch, "text", held // -(-held // SLICE_BYTES) + 1 if held else SLICE_BYTES):
                yield _slice(part.column("doc_id"), part.column("text"), cuts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICES)


def tokenised(chunks: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """chunks (chunk, times) with a_ids, a_ends, b_ids, b_ends: all null where either tokenizer's bytes differ from the chunk's."""
    shared = chunks.sparkSession.sparkContext.broadcast((a, b))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _of_worker(*shared.value)
        for batch in batches:
            for part in slices(batch, "chunk", 1 << 20):
                held = part.column("chunk").to_pylist()
                for whole in (False, True):
                    some = part.filter(pa.array([c.startswith(b"\0") is whole for c in held], pa.bool_()))
                    if some.num_rows:
                        lists = encoders.lists([c[whole:] for c in some.column("chunk").to_pylist()], whole)
                        yield pa.RecordBatch.from_arrays([*some.columns, *lists], [*some.schema.names, *(x.split()[0] for x in _TOKENS.split(", "))])

    return chunks.select("chunk", "times").mapInArrow(run, f"chunk binary, times long, {_TOKENS}")


def _marked(cuts: Column, ends: Column) -> Column:
    """ends in order, doubled, with one added to those that are cuts."""
    return F.sort_array(F.concat(F.transform(cuts, lambda e: e * 2 + 1), F.transform(F.array_except(ends, cuts), lambda e: e * 2)))


def _side(ids: Column, marks: Column) -> Column:
    """Ids by group as text; an empty text follows the last."""
    said = F.zip_with(ids, marks, lambda i, m: F.concat(i.cast("string"), F.when(m % 2 == 1, ";").otherwise(",")))
    return F.split(F.array_join(said, ""), ";")


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens (see `tokenised`): chunk, times, n_a, n_b, groups (`a1,a2|b1;a3|b2,b3`), links (array of A's id * 2^32 + B's id).

    A group ends where tokens of both sides end. Tokens are never empty, so the last of each side in a group are the only
    pair that ends together, and each group holds one link. Chunk ends are ends of both, so no group leaves its chunk. All
    steps but sorts of nearly sorted arrays take time in proportion to the chunk. All null where the tokens are.
    """
    cut = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    cut = cut.withColumn("am", _marked(F.col("cuts"), F.col("a_ends"))).withColumn("bm", _marked(F.col("cuts"), F.col("b_ends")))
    last = lambda ids, marks: F.filter(ids, lambda _, i: F.get(marks, i) % 2 == 1)
    links = F.zip_with(last("a_ids", F.col("am")), last("b_ids", F.col("bm")), lambda a, b: a.cast("long") * (1 << 32) + b)
    groups = F.zip_with(_side(F.col("a_ids"), F.col("am")), _side(F.col("b_ids"), F.col("bm")), lambda a, b: F.concat(a, F.lit("|"), b))
    some = F.col("a_ids").isNotNull()
    return cut.select(
        "chunk", "times", F.when(some, F.size("a_ids")).alias("n_a"), F.when(some, F.size("b_ids")).alias("n_b"),
        F.array_join(F.slice(groups, F.lit(1), F.size("cuts")), ";").alias("groups"), links.alias("links"),
    )


def chunk_scores(chunks: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """chunks (id, links, times), written out: id, n_best, count_sum, for chunks that have links.

    A pair's count is how many links of all documents are that pair: chunks' links times their occurrences, added in tasks
    before they are shuffled. n_best are the links whose count is the highest of their B id, ties included; count_sum adds the
    counts up. Pairs grow with the vocabularies, not with the documents. Up to broadcast_pairs of them are broadcast, more meet
    the links in a shuffled join.
    """
    each = chunks.select("id", "times", F.explode("links").alias("link"))
    counts, _ = materialize(each.groupBy("link").agg(F.sum("times").alias("n")), "pairs")
    b = F.col("link") % (1 << 32)
    pairs = counts.withColumn("b", b).join(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")), "b").select("link", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    pairs = F.broadcast(pairs) if counts.count() <= broadcast_pairs else pairs.hint("merge")
    return each.join(pairs, "link").groupBy("id").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def _without_lost(each: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """chunks with `times` less what stands in documents that have a chunk without tokens: those documents have no tokens at all."""
    bad = each.join(chunks.where("n_a is null").select("chunk"), "chunk", "left_semi").groupBy("slice").agg(F.collect_set("code").alias("bad"))
    lost = rows.select("slice", F.explode("docs").alias("d")).join(bad, "slice").where(F.arrays_overlap("d.codes", "bad"))
    less = lost.select("slice", F.explode("d.codes").alias("code")).groupBy("slice", "code").agg(F.count("*").alias("n"))
    less = less.join(each, ["slice", "code"]).groupBy("chunk").agg(F.sum("n").alias("less"))
    return chunks.join(less, "chunk", "left").withColumn("times", F.col("times") - F.coalesce("less", F.lit(0))).drop("less")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block a step's shuffle files go when the step, which writes a table, is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """How two tokenizers' tokens of every whole text lie against each other.

    docs: doc_id, text; other columns are ignored, whatever their names. a_file: byte-level BPE of `tokenizers`, given a
    space and the text; b_file: a `sentencepiece` model that adds the space itself. A null or empty text has no tokens, nor
    has one whose tokens' bytes differ from space and text (as where a model normalises). Repeated rows count each.

    Neither tokenizer joins across the places where texts are cut into chunks (checked on the files; else texts stay whole),
    so each distinct chunk of the corpus is encoded and aligned once. Slices of documents hold their distinct chunks once: a
    chunk that is everywhere is one row a slice when chunks are shuffled to be distinct, and when they meet their results,
    where AQE splits what is left of a hot one. Chunks' results then gather by slice, bounded by its bytes.

    Returns a row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (see `chunk_scores`), groups_sha256
    of groups `a1,a2|b1` joined by ';' ('' without tokens). A null doc_id stays null.
    """
    a, b = Path(a_file).read_bytes(), Path(b_file).read_bytes()
    with _shuffles_dropped(docs.sparkSession):
        rows, _ = materialize(sliced(docs, ByteLevel(a).cuts and Pieces(b).cuts).withColumn("slice", F.monotonically_increasing_id()), "slices")
        each = rows.select("slice", F.posexplode(F.arrays_zip("chunks", "times")).alias("code", "x")).select("slice", "code", F.col("x.chunks").alias("chunk"), "x.times")
        chunks, _ = materialize(aligned(tokenised(each.groupBy("chunk").agg(F.sum("times").alias("times")), a, b)).withColumn("id", F.monotonically_increasing_id()), "chunks")
        counted = _without_lost(each, chunks, rows) if chunks.where("n_a is null").limit(1).count() else chunks
        scores = chunk_scores(counted.select("id", "links", "times"))
    results = chunks.select("id", "chunk", "n_a", "n_b", F.size("links").alias("n_groups"), "groups").join(scores, "id", "left").drop("id")
    found = each.select("slice", "code", "chunk").join(results.hint("shuffle_hash"), "chunk").drop("chunk")
    by_code = F.sort_array(F.collect_list(F.struct("code", *(F.col(c).cast("int").alias(c) for c in ("n_a", "n_b", "n_groups", "n_best")), "count_sum", "groups")))
    both = rows.select("slice", "docs").join(found.groupBy("slice").agg(by_code.alias("x")), "slice", "left")

    def doc(d: Column, x: Column) -> Column:
        total = lambda name: F.aggregate(d.codes, F.lit(0).cast("long"), lambda s, c: s + F.get(x, c)[name])
        said = F.sha2(F.array_join(F.transform(d.codes, lambda c: F.get(x, c).groups), ";").cast("binary"), 256)
        return F.struct(d.doc_id.alias("doc_id"), F.size(d.codes).alias("n"), *(total(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")), said.alias("groups_sha256"))

    # The array holds one struct, so its lambda binds both columns once: a projection's names could be put back into every step.
    made = both.select(F.explode(F.flatten(F.transform(F.array(F.struct("docs", "x")), lambda s: F.transform(s.docs, lambda d: doc(d, s.x))))).alias("d")).select("d.*")
    some = F.coalesce(F.col("n") > 0, F.lit(False)) & F.col("n_a").isNotNull()  # a chunk without tokens makes the sums null
    number = lambda c, name: F.when(some, F.col(c)).otherwise(0).cast("long").alias(name)
    return made.select(
        "doc_id", number("n_a", "n_a"), number("n_b", "n_b"), number("n_groups", "n_groups"), number("n_groups", "n_links"), number("n_best", "n_best"), number("count_sum", "count_sum"),
        F.when(some, F.col("groups_sha256")).otherwise("").alias("groups_sha256"),
    )
