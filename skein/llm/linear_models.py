"""Linear models over hashed text: features, and full-batch fits whose gradients Spark sums."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import Words, slices
from skein.storage import drop, materialize

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


#: Leading letters of a word that are features of their own: stems show where endings vary.
PREFIXES = (4, 5, 6, 7)


def _buckets(distinct: list[bytes], bits: int, prefixes: tuple[int, ...]) -> np.ndarray:
    """Buckets of each distinct word and of its prefixes, a row a word; marks at a word's ends do not count."""
    h, shift = xxhash.xxh3_64_intdigest, 64 - bits
    if not prefixes:
        marks = _MARKS.encode()
        return (np.fromiter((h(w.strip(marks), 1) for w in distinct), np.uint64, len(distinct)) >> np.uint64(shift)).astype(np.int64)[:, None]
    out = np.zeros((len(distinct), 1 + len(prefixes)), np.int64)
    for i, w in enumerate(distinct):
        t = w.decode().strip(_MARKS)
        out[i] = [h(t, 1) >> shift, *(h(t[:n], n) >> shift for n in prefixes)]
    return out


def features(texts: pa.Array, bits: int, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by text): what occurs in each whole text (see `_featured`)."""
    return _featured(texts, bits, prefixes)[:2]


def _featured(texts: pa.Array, bits: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets by text, words by text): what occurs in each whole text.

    Distinct words in lower case and, for each of them, its prefixes; then how large (in ten
    steps) the shares of capitals, of marks, of repeated words and of words that end in two marks
    are. A bucket stands once for each distinct word that leads to it.
    """
    plain = Words(texts)
    words = plain.lowered()
    codes, distinct = words.encoded()
    n, size, own = len(texts), 1 << bits, 4
    pair = np.sort(words.text_of() * max(len(distinct), 1) + codes)
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    owner, code = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    letters, marks = np.zeros(len(plain.joined) + 1, np.int64), np.zeros(len(plain.joined) + 1, np.int64)
    np.cumsum(_UPPER[plain.joined], out=letters[1:])
    np.cumsum(_MARK[plain.joined], out=marks[1:])
    edge = np.append(plain.starts, len(plain.joined))[plain.offsets]
    several = np.bincount(owner, minlength=n)
    count = np.maximum(np.diff(words.offsets), 1)
    chars = np.maximum(np.diff(edge) - np.diff(plain.offsets), 1)
    tail = marks[plain.ends] - marks[np.maximum(plain.ends - 2, plain.starts)] >= 2
    shares = [np.diff(letters[edge]) / chars, np.diff(marks[edge]) / chars, 1 - several / count, words.sums(tail.astype(np.int64)) / count]
    width = 1 + len(prefixes)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(several * width + own, out=offsets[1:])
    bucket = np.empty(offsets[-1], np.int64)
    last = (offsets[1:, None] - own + np.arange(own)).reshape(-1)
    bucket[last] = np.stack([((i << 8) + np.ceil(10 * s).astype(np.int64)) * 7919 % size for i, s in enumerate(shares, 1)], axis=1).reshape(-1)
    rest = np.ones(len(bucket), bool)
    rest[last] = False
    bucket[rest] = _buckets(distinct, bits, prefixes)[code].reshape(-1)
    return bucket, offsets, np.diff(words.offsets)


def scored(df: DataFrame, score: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], bits: int, fields: str, prefixes: tuple[int, ...] = PREFIXES, count: str | None = None) -> DataFrame:
    """Columns of df (which has `text`) plus `fields`, which score(buckets, offsets) gives for whole texts; `count` names the field of their words."""
    names = [x.split()[0] for x in fields.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20 if prefixes else 4 << 20):
                *found, n = _featured(part.column("text"), bits, prefixes)
                got = score(*found) | ({count: n} if count else {})
                yield pa.RecordBatch.from_arrays([*part.columns, *(_column(got[k]) for k in names)], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def _column(values: np.ndarray) -> pa.Array:
    """A column of numbers, or of the rows of a table of them as lists."""
    if values.ndim == 1:
        return pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of values over runs; values has one row for every (text, bucket)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


#: loss(parameters, labels, scores rows) -> (sum of losses, gradient by score, gradient of other parameters)
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def fit(labelled: DataFrame, loss: Loss, extra: np.ndarray, bits: int, outputs: int = 1, prior: float = 8.0, rounds: int = 60, tasks: int = 6, prefixes: tuple[int, ...] = PREFIXES) -> np.ndarray:
    """Weights [2^bits x outputs] and other parameters, flat, by L-BFGS on the mean loss.

    labelled: text, y. Features are computed once and kept in the shared folder; each step is a
    Spark job in which every task gives one partial loss and gradient. The driver holds parameters
    and `tasks` partial gradients, whatever the number of rows. Weights have a normal prior of variance
    1 / prior, so that few rows are held back more than many.
    """
    spark = labelled.sparkSession
    size = (1 << bits) * outputs

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                bucket, offsets = features(part.column("text"), bits, prefixes)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, part.column("y")], ["x", "y"])

    rows = labelled.where("y is not null").select("text", F.col("y").cast("int")).mapInArrow(hashed, "x array<int>, y int").repartition(tasks)
    rows, at = materialize(rows, "features")
    n = rows.count()
    theta = np.concatenate([np.zeros(size), extra])
    if not n:
        drop(spark, at)
        return theta
    ridge = prior / n

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(theta)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, rest = shared.value[:size].reshape(-1, outputs), shared.value[size:]
            total, grad, other = 0.0, np.zeros_like(w), np.zeros_like(rest)
            for batch in batches:
                x = batch.column("x")
                bucket, lengths = np.asarray(x.flatten()), np.asarray(x.value_lengths())
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                one, by_score, by_rest = loss(rest, np.asarray(batch.column("y")), row_sums(w[bucket], offsets))
                total, other = total + one, other + by_rest
                each = np.repeat(by_score, lengths, axis=0)
                for k in range(outputs):
                    grad[:, k] += np.bincount(bucket, weights=each[:, k], minlength=len(w))
            yield pa.RecordBatch.from_pydict({"loss": [total], "grad": [np.concatenate([grad.reshape(-1), other]).astype(np.float32).tobytes()]})

        parts = rows.coalesce(tasks).mapInArrow(part, "loss double, grad binary").collect()
        shared.destroy()
        grad = np.sum([np.frombuffer(p["grad"], np.float32) for p in parts], axis=0, dtype=float) / n
        grad[:size] += ridge * theta[:size]
        return sum(p["loss"] for p in parts) / n + ridge / 2 * float(theta[:size] @ theta[:size]), grad

    now, grad = value(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step = -_two_loop(grad, pairs)
        slope, rate = float(grad @ step), 1.0 if pairs else 1 / max(1.0, float(np.linalg.norm(grad)))
        if -slope < 1e-9:
            break
        while True:
            new, new_grad = value(theta + rate * step)
            if new <= now + 1e-4 * rate * slope or rate < 1e-4:
                break
            rate /= 2
        if new >= now:
            break
        s, y = rate * step, new_grad - grad
        theta = theta + s
        done = now - new < 1e-5 * max(now, 1e-6)
        now, grad = new, new_grad
        if float(s @ y) > 1e-12:
            pairs = [*pairs[-7:], (s.astype(np.float32), y.astype(np.float32))]  # half the driver's memory; they only shape the step
        if done:
            break
    else:
        warnings.warn(f"fit stopped after {rounds} rounds at loss {now:.6g}, gradient {float(np.linalg.norm(grad)):.2g}", stacklevel=2)
    drop(spark, at)
    return theta


def _two_loop(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, alphas = grad.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(s @ y)
        alphas.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(alphas), strict=True):
        q += (a - float(y @ q) / float(s @ y)) * s
    return q


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label columns) of at most `rows` labelled documents, the first by a hash of their id.

    labels has doc_id and the label columns. Only the sample's labels, bounded by `rows`, are broadcast.
    """
    some = labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
