"""Ordinal cumulative-link regression on graded ratings of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.linear_models import fit, labelled_sample, row_sums, scored

BITS = 18
#: Labelled documents that a fit uses at most.
SAMPLE_ROWS = 12_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def thresholds(rest: np.ndarray) -> np.ndarray:
    """Ordered thresholds from a first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([rest[:1], np.exp(rest[1:])]))


def cumulative_link(rest: np.ndarray, y: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of grades y: P(y <= k) = sigmoid(threshold k - score)."""
    cuts, s = np.concatenate([[-np.inf], thresholds(rest), [np.inf]]), scores[:, 0]
    upper, lower = _sigmoid(cuts[y + 1] - s), _sigmoid(cuts[y] - s)
    p = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper), lower * (1 - lower)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, y + 1, -up / p)
    np.add.at(by_cut, y, low / p)
    inner = by_cut[1:-1]
    tail = np.cumsum(inner[::-1])[::-1]
    return float(-np.log(p).sum()), ((up - low) / p)[:, None], np.concatenate([tail[:1], tail[1:] * np.exp(rest[1:])])


def fit_ordinal(labelled: DataFrame, grades: int, bits: int = BITS) -> np.ndarray:
    """Weights and thresholds, flat, from labelled (text, y in 0..grades-1): shared weights, ordered thresholds.

    Thresholds start where the grades' shares put them (one more of each grade than there are).
    """
    counts = np.ones(grades)
    for r in labelled.where("y is not null").groupBy("y").count().collect():
        counts[r["y"]] += r["count"]
    share = np.cumsum(counts)[:-1] / counts.sum()
    cuts = np.log(share / (1 - share))
    return fit(labelled, cumulative_link, np.concatenate([cuts[:1], np.log(np.diff(cuts))]), bits)


def grade(docs: DataFrame, theta: np.ndarray, grades: int, bits: int = BITS) -> DataFrame:
    """docs plus expected_grade and tail_probability, that of the highest grade.

    A null or blank text has no features but one of its own: its score is what the fit gave that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))

    def score(bucket: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        w, rest = shared.value[: 1 << bits], shared.value[1 << bits :].astype(float)
        s = row_sums(w[bucket][:, None].astype(float), offsets)
        above = 1 - _sigmoid(thresholds(rest)[None, :] - s)  # P(y > k)
        return {"expected_grade": above.sum(axis=1), "tail_probability": above[:, -1]}

    return scored(docs, score, bits, "expected_grade double, tail_probability double")


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): 0 toxic, 1 of low quality, 2 neither; rows without both ratings are left out, of repeated ids the least grade counts."""
    y = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    return labels.where("toxic is not null and quality is not null").groupBy("doc_id").agg(F.min(y).alias("y"))


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose probability of the highest grade is at least `least`.

    docs: doc_id, text and any other columns, which stay (expected_grade and tail_probability are
    replaced if present). labels: doc_id, quality, toxic. The fit uses at most sample_rows
    labelled documents; every document is scored whole. Without labelled documents nothing is
    known and every document stays with probability 1. Null and blank texts are scored like
    others, by a feature of their own; repeated rows each count.
    """
    docs = docs.drop("expected_grade", "tail_probability")
    labelled = labelled_sample(docs, graded_labels(labels), sample_rows).select("text", "y")
    theta = fit_ordinal(labelled, 3)
    if not theta[: 1 << BITS].any():
        theta[1 << BITS :] = [-60.0, 0.0]
    return grade(docs, theta, 3).where(F.col("tail_probability") >= least)
