"""Quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` describes every text by ``FEATURES`` (shares of signs and words, repetition, lengths), each brought
to a roughly normal shape by a log or logit.  ``fit`` takes class means and covariances from moments summed in
Spark over all labelled rows, shrinks each covariance towards the pooled one and its own diagonal, and keeps the
inverse Cholesky factors.  A score is the difference of the two Mahalanobis log densities, mapped to 0..1 by a
logistic curve that is fitted to a histogram of that difference over the labelled rows.

Only moments (classes x features^2) and the histogram leave the cluster.

Edge cases: null and empty texts have the statistics of an empty text and get a score like any other; rows with
a null label, or whose doc_id has no text, teach nothing; rows that repeat a doc_id in the labels teach once for
each; with one class only every score is that class's share (0 or 1), with no labels at all it is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import as_bytes, cut, id_and_text

FEATURES = [
    "log_bytes", "log_words", "log_lines", "upper", "digit", "sign", "blank", "beyond_ascii", "word_length", "longest_word",
    "distinct_words", "commonest_word", "repeated_neighbours", "repeated_lines", "words_with_sign", "words_without_letter",
    "upper_words", "commonest_sign", "compressed", "sentence_ends",
]
SHRINK_TO_POOLED, SHRINK_TO_DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
LIMIT = 6.0  # standard deviations at which a statistic is cut off
BINS, SPREAD = 256, 200.0

_IS = {name: np.zeros(256, bool) for name in ("upper", "lower", "digit", "blank", "high")}
_IS["upper"][65:91], _IS["lower"][97:123], _IS["digit"][48:58], _IS["high"][128:] = True, True, True, True
_IS["blank"][[9, 10, 11, 12, 13, 32]] = True
_SIGN = ~(_IS["upper"] | _IS["lower"] | _IS["digit"] | _IS["blank"] | _IS["high"])
_SIGN_BYTES = bytes(np.flatnonzero(_SIGN).tolist())
_LETTERS = bytes(np.flatnonzero(_IS["upper"] | _IS["lower"] | _IS["high"]).tolist())


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, softened so that 0 and 1 stay finite."""
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole > 0 else 0.0


def describe(text: bytes) -> list[float]:
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = lambda which: float(counts[which].sum())
    words = text.split()
    w = len(words)
    tally = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    signs = total(_SIGN)
    lengths = sum(map(len, words))
    with_sign = sum(c for x, c in tally.items() if x[-1:] in _ENDS)
    bare = sum(c for x, c in tally.items() if not x.strip(_NOT_LETTERS))
    shouted = sum(c for x, c in tally.items() if len(x) > 1 and x.isupper())
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(len(lines))),
        _logit(total(_IS["upper"]), n), _logit(total(_IS["digit"]), n), _logit(signs, n), _logit(total(_IS["blank"]), n), _logit(total(_IS["high"]), n),
        float(np.log1p(lengths / w)) if w else 0.0, float(np.log1p(max(map(len, tally), default=0))),
        _logit(len(tally), w), _logit(max(tally.values(), default=0), w),
        _logit(sum(map(bytes.__eq__, words, words[1:])), w), _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(with_sign, w), _logit(bare, w), _logit(shouted, w),
        _logit(float(counts[_SIGN].max()), n), float(np.log((len(zlib.compress(text, 1)) + 20) / (n + 20))),
        _logit(float(counts[[33, 46, 63]].sum()), n),
    ]


_ENDS = frozenset(bytes([b]) for b in _SIGN_BYTES)
_NOT_LETTERS = bytes(b for b in range(256) if b not in _LETTERS)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, stats array<double>; one row per input row."""

    def run(batches):
        for batch in batches:
            rows = [describe(t) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics, and by class the mean, the inverse Cholesky factor and its log density constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0
    fixed: float | None = None

    def difference(self, stats: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        z = np.clip((stats - self.centre) / self.scale, -LIMIT, LIMIT)
        log_density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return log_density[1] - log_density[0]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(stats), self.fixed)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(stats) + self.offset, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moments(labelled: DataFrame, centre: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """By label the summed outer products of (1, z): counts, sums and squares in one matrix."""
    d = len(FEATURES) + 1

    def run(batches):
        sums = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
        for batch in batches:
            z = np.clip((_matrix(batch["stats"]) - centre) / scale, -LIMIT, LIMIT)
            z = np.hstack([np.ones((len(z), 1)), z])
            label = batch["label"].to_numpy()
            for k in sums:
                sums[k] += z[label == k].T @ z[label == k]
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, k), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], ["label", "cell", "total"])

    rows = labelled.select("label", "stats").mapInArrow(run, "label int, cell int, total double").groupBy("label", "cell").agg(F.sum("total").alias("total")).toPandas()
    out = {k: np.zeros(d * d) for k in (0, 1)}
    for label, cell, total in rows.itertuples(index=False):
        out[label][cell] = total
    return {k: m.reshape(d, d) for k, m in out.items()}


def _calibrate(labelled: DataFrame, model: Model) -> Model:
    """Logistic curve over the log density difference, from its histogram by label."""

    def run(batches):
        for batch in batches:
            at = np.clip((np.clip(model.difference(_matrix(batch["stats"])), -SPREAD, SPREAD) + SPREAD) / (2 * SPREAD) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(at)], ["label", "bin"])

    found = labelled.select("label", "stats").mapInArrow(run, "label int, bin int").groupBy("label", "bin").count().toPandas()
    x = ((found["bin"].to_numpy() + 0.5) / BINS * 2 - 1) * SPREAD
    y, n = found["label"].to_numpy().astype(float), found["count"].to_numpy().astype(float)
    beta = np.zeros(2)
    design = np.stack([x / 20, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.centre, model.scale, model.means, model.factors, model.constants, float(max(beta[0], 1e-6) / 20), float(beta[1]))


def fit(labelled: DataFrame) -> Model:
    """``labelled`` (label 0/1, stats) -> the discriminant."""
    d = len(FEATURES)
    unit = _moments(labelled, np.zeros(d), np.full(d, 1e6))  # no cut-off yet: plain means and spreads
    both = unit[0] + unit[1]
    n = both[0, 0]
    empty = Model(np.zeros(d), np.ones(d), [], [], [])
    if n == 0 or unit[0][0, 0] == 0 or unit[1][0, 0] == 0:
        return Model(empty.centre, empty.scale, [], [], [], fixed=0.5 if n == 0 else float(unit[1][0, 0] > 0))
    centre = both[0, 1:] / n * 1e6
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n * 1e12 - centre**2, 1e-6))
    moments = _moments(labelled, centre, scale)
    counts = {k: m[0, 0] for k, m in moments.items()}
    means = {k: m[0, 1:] / counts[k] for k, m in moments.items()}
    scatter = {k: m[1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k, m in moments.items()}
    pooled = sum(counts[k] * scatter[k] for k in (0, 1)) / n
    factors, constants = [], []
    for k in (0, 1):
        own = (1 - SHRINK_TO_POOLED) * scatter[k] + SHRINK_TO_POOLED * pooled
        own = (1 - SHRINK_TO_DIAGONAL) * own + SHRINK_TO_DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(counts[k] / n) - np.log(np.diag(lower)).sum()))
    return _calibrate(labelled, Model(centre, scale, [means[0], means[1]], factors, constants))


def score(described: DataFrame, model: Model) -> DataFrame:
    """``described`` (doc_id, stats) -> doc_id, score."""
    sent = described.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = sent.value.score(_matrix(batch["stats"])) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], ["doc_id", "score"])

    return described.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0/1; those that may teach) -> doc_id, score."""
    described = cut(statistics(docs))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    return score(described, fit(described.join(own, "doc_id")))
