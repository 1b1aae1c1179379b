"""Mixing documents to target domain weights by soft membership."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.linear_models import fit, labelled_sample, row_sums, scored
from skein.storage import materialize

BITS = 16
SAMPLE_ROWS = 8_000
#: A domain with under this part of its target's tokens is minor (see `mix`).
MINOR = 0.25


def softmax_loss(rest: np.ndarray, y: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    p = _softmax(scores)
    picked = p[np.arange(len(y)), y]
    grad = p.copy()
    grad[np.arange(len(y)), y] -= 1
    return float(-np.log(np.maximum(picked, 1e-12)).sum()), grad, np.zeros_like(rest)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs plus n_tokens (words) and posterior (array<double>, in the order of `domains`).

    labelled: doc_id, domain; at most sample_rows of its documents fit a softmax regression over
    hashed words. Rows of other domains are left out; of repeated ids the least domain counts.
    Without labelled documents every domain is as likely. Null and blank texts have 0 tokens.
    """
    number = F.coalesce(*[F.when(F.col("domain") == d, i) for i, d in enumerate(domains)])
    y = labelled.select("doc_id", number.alias("y")).where("y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    k = len(domains)
    theta = fit(labelled_sample(docs, y, sample_rows).select("text", "y"), softmax_loss, np.zeros(0), BITS, outputs=k, prior=0.8, rounds=15, prefixes=())
    shared = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))

    def score(bucket: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        w = shared.value.reshape(-1, k)
        return {"posterior": _softmax(row_sums(w[bucket].astype(float), offsets))}

    return scored(docs, score, BITS, "n_tokens long, posterior array<double>", prefixes=(), count="n_tokens")


def _rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A document's rate after the projected steps so far, all of which follow from its posterior."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0, rate - p @ step)
    return rate


def _reachable(labelled: np.ndarray, share: np.ndarray, mass: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Which targets count, by domain: has labelled documents, target share, sums of n * p and of n * p^2 over documents."""
    minor = mass < MINOR * share * mass.sum()
    return labelled & (mass > 0) & ~(minor & (squares < share * mass))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """docs plus n_tokens, posterior and rate: nonnegative rates whose expected domain totals match the targets.

    docs: doc_id, text and any other columns, which stay (those named as the new ones are
    replaced). targets: shares by domain, scaled to sum to one; the total stays that of the input.
    Minimises the squared distance of sum(rate * n_tokens * posterior) from the targets, each
    domain scaled by its own mass, by projected gradient from rate 1 in the token-weighted inner
    product: a step is rate <- max(0, rate - posterior . e), where e is the residual times the
    step length. Each round is a job that gives the residual, one number a domain; the driver
    holds nothing else.

    Targets without labelled documents are left out, and so are minor ones, with under MINOR of
    the tokens asked for, whose share stays under the target even among tokens weighted by their
    posterior for it: to meet those, nearly all documents would have to get rate 0. The others
    share what the left-out domains do not hold in proportion; with none left every rate is 1.
    Other targets that no rates reach are met as nearly as can be; a fit that has not converged after
    `rounds` warns with its residual. Null and blank texts weigh
    nothing; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    domains = sorted(targets)
    docs = docs.drop("n_tokens", "posterior", "rate")
    table, _ = materialize(domain_posteriors(docs, labelled, domains), "posteriors")
    slim = table.select("n_tokens", "posterior")
    k = len(domains)

    def total(kind: str, steps: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, k) if kind == "moments" else k)
            for batch in batches:
                p = np.asarray(batch.column("posterior").flatten()).reshape(-1, k)
                n = np.asarray(batch.column("n_tokens")).astype(float)
                out += (p * n[:, None]).T @ p if kind == "moments" else (n * _rates(p, steps)) @ p
            yield pa.RecordBatch.from_pydict({"at": np.arange(out.size), "x": out.reshape(-1)})

        sums = slim.mapInArrow(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k * k if kind == "moments" else k)
        for r in sums:
            out[r["at"]] = r["x"]
        return out

    steps = np.zeros((0, k))
    now = total("sums", steps)
    share = np.array([targets[d] for d in domains], float)
    share = share / share.sum()
    moments = total("moments", steps).reshape(k, k)
    seen = {r["domain"] for r in labelled.where(F.col("domain").isin(domains)).join(docs.select("doc_id"), "doc_id", "left_semi").select("domain").distinct().collect()}
    used = _reachable(np.array([d in seen for d in domains]), share, now, moments.diagonal())
    goal = np.where(used, share / max(share[used].sum(), 1e-300) * now[used].sum(), now)
    scale = np.where(used & (moments.diagonal() > 0), 1 / np.maximum(moments.diagonal(), 1e-300), 0)
    root = np.sqrt(scale)
    length = 1 / max(float(np.linalg.eigvalsh(root[:, None] * moments * root).max(initial=0)), 1e-12)
    for done in range(rounds + 1):
        residual = np.where(used, now - goal, 0)
        if not now.sum() or np.abs(residual).max() <= tolerance * goal.sum():
            break
        if done == rounds:
            warnings.warn(f"rates not converged after {rounds} rounds: largest residual {np.abs(residual).max() / goal.sum():.2g} of all tokens", stacklevel=2)
            break
        steps = np.vstack([steps, length * scale * residual])
        before, now = now, total("sums", steps)
        if np.abs(now - before).max() <= 1e-3 * tolerance * goal.sum():
            break

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("posterior").flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(p, steps))], [*batch.schema.names, "rate"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), "rate double"])
    return table.mapInArrow(rated, schema)
