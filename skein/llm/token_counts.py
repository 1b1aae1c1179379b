"""Token counts by a map-side two-tier lookup."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import Words, slices

#: Words a worker remembers besides the broadcast ones; a full cache starts afresh.
CACHE_WORDS = 200_000

#: Words that a task sends of those it counted.
TASK_WORDS = 4_096

#: What a worker process keeps from task to task: the tokenizer it last used and that one's word lengths.
_kept: dict[bytes, tuple[Callable[[list[str]], list[int]], dict[bytes, int]]] = {}


def load_counter(content: bytes) -> Callable[[list[str]], list[int]]:
    """Token counts of strings by the `tokenizers` library, nothing added, special strings as its default has them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part; threads of its own only hold memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _of_worker(content: bytes) -> tuple[Callable[[list[str]], list[int]], dict[bytes, int]]:
    key = hashlib.sha256(content).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = load_counter(content), {}
    return _kept[key]


def frequent_words(docs: DataFrame, frequent: int) -> list[bytes]:
    """The `frequent` commonest words of all whole texts, near enough: each task counts its words and sends TASK_WORDS of them.

    A word's count is short where a task's table was pruned or the word was not among its commonest; that
    costs speed in the lookup, never correctness. What is sent is bounded by tasks * TASK_WORDS.
    """

    def top(counts: dict[bytes, int], n: int) -> dict[bytes, int]:
        return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]) if len(counts) > n else counts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                codes, distinct = Words(part.column("text")).encoded()
                n = np.bincount(codes, minlength=len(distinct))
                often = np.flatnonzero(n > 1)
                if len(often) > frequent:
                    often = often[np.argpartition(-n[often], frequent)[:frequent]]
                for i, c in zip(often.tolist(), n[often].tolist(), strict=True):
                    w = distinct[i]
                    total[w] = total.get(w, 0) + c
                if len(total) > 4 * frequent:
                    total = top(total, 2 * frequent)
        best = top(total, TASK_WORDS)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(best), pa.binary()), "n": pa.array(list(best.values()), pa.int64())})

    sums = docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in sums.orderBy(F.desc("n"), "word").limit(frequent).collect()]


def count_tokens(docs: DataFrame, tokenizer_file: str, max_tokens: int = 2048, frequent: int = 32_768) -> DataFrame:
    """Tokens of every whole text.

    docs: doc_id, text; other columns are ignored. tokenizer_file: a tokenizers .json whose
    pre-tokens never cross white space (those that split on words; the caller's choice, held
    against whole texts in the tests), so a text's count is the sum over its words.

    Tier one is a table word -> length of the `frequent` commonest words of all texts (see
    `frequent_words`), broadcast: its size is bounded by that parameter, and it only changes speed.
    Tier two encodes a worker's misses, each distinct word once, and remembers up to CACHE_WORDS of
    them. No pre-token is shuffled: only the tasks' counts of their commonest words are.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > max_tokens), one row per
    input row, repeated rows and ids included. A null text counts as empty: 0, 0, false. A null
    doc_id stays null.
    """
    spark = docs.sparkSession
    content = Path(tokenizer_file).read_bytes()
    words = frequent_words(docs, frequent)
    table = dict(zip(words, load_counter(content)([w.decode() for w in words]), strict=True))
    shared = spark.sparkContext.broadcast((content, table))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, known = shared.value
        encode, cache = _of_worker(content)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = Words(part.column("text"))
                codes, distinct = words.encoded()
                missing = [w for w in distinct if w not in known and w not in cache]
                if len(cache) + len(missing) > CACHE_WORDS:
                    cache.clear()
                    missing = [w for w in distinct if w not in known]
                for i in range(0, len(missing), 1024):
                    some = missing[i : i + 1024]
                    cache.update(zip(some, encode([w.decode() for w in some]), strict=True))
                lengths = np.fromiter((known[w] if w in known else cache[w] for w in distinct), np.int64, len(distinct))
                n = words.sums(lengths[codes]) if len(distinct) else np.zeros(part.num_rows, np.int64)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
