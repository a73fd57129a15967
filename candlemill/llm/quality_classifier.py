"""Quality classifier: a support vector machine on naive Bayes features (NBSVM: Wang and Manning, 2012).

Features say which n-grams a text has: its words, and runs of one to three word shapes (letter case, digits and
marks of a word, and whether it repeats the word before). Each is scaled by the log of how much more often
documents of label 1 have it than those of label 0; a linear hinge-loss model is fitted on them by dual
coordinate descent (Hsieh et al., 2008), and its margins are turned into probabilities by a logistic curve
fitted on margins of folds that the model had not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import extended, held_out, texts, with_columns
from candlemill.llm.terms import BUCKETS, Known, bucket, compact, frequent, sample_rows

SAMPLE_ROWS = 20_000
LEAST_ROWS = 5
THRESHOLD = 0.7
FOLDS = 3
_CLASSES = bytes(65 if 65 <= i < 91 else 97 if 97 <= i < 123 or i >= 128 else 57 if 48 <= i < 58 else i for i in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Letters as A or a, digits as 9, other marks as they are; runs of one kind once; at most eight kinds."""
    return _RUNS.sub(rb"\1", word.translate(_CLASSES))[:8]


def _word_and_shape(word: bytes) -> int:
    return bucket(word) * BUCKETS + bucket(shape(word), 1)


_known = Known(_word_and_shape)


def ngrams(text: bytes) -> np.ndarray:
    """The buckets of a text's n-grams, each once, sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    word = codes // BUCKETS
    one = (codes % BUCKETS) * 2
    one[1:] += codes[1:] == codes[:-1]
    mixed = one.astype(np.uint64)
    two = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + mixed[2:] * np.uint64(0xD6E8FEB86659FD93)
    top = np.uint64(44)
    runs = np.concatenate([mixed * np.uint64(0xFF51AFD7ED558CCD) >> top, two >> top, three >> top]).astype(np.int64)
    return np.unique(np.concatenate([word, np.unique(runs)]))


@dataclass
class Model:
    weights: np.ndarray  # by bucket, the log ratio included
    used: np.ndarray  # by bucket
    bias: float
    slope: float
    offset: float

    def score(self, text: bytes) -> float:
        terms = ngrams(text)
        n = np.count_nonzero(self.used[terms])
        margin = self.bias + (float(self.weights[terms].sum()) / np.sqrt(n) if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """log of (share of a feature among those of label 1) / (the same for label 0), one added to each count."""
    def counts(label):
        own = [r for r, v in zip(rows, y) if v == label]
        return 1 + (np.bincount(np.concatenate(own), minlength=n) if own else np.zeros(n))

    good, bad = counts(1), counts(0)
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: float = 1.0, rounds: int = 15) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum of hinge losses, by one dual variable at a time. y is +1 or -1."""
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(y))
    size = np.array([float(v @ v) + 1 for v in values])
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)):
            r, v = rows[i], values[i]
            slope = y[i] * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to the share of label 1 (Platt, 1999), by Newton's method."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, x, at = np.where(y == 1, high, low), np.stack([margin, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        h = x.T * (p * (1 - p)) @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit_rows(all_rows: list[np.ndarray], y: np.ndarray) -> Model:
    vocabulary = frequent(all_rows, min(LEAST_ROWS, max(1, len(y) // 20)))
    weights, used = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    if not 0 < y.sum() < len(y):  # nothing to tell apart
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(weights, used, 0.0, 1.0, float(np.log(p / (1 - p))))
    rows, n = compact(all_rows, vocabulary), len(vocabulary)
    sign = 2 * y - 1

    def train(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[i] for i in chosen]
        ratio = log_ratios(own, y[chosen], n)
        w, bias = descend(own, [ratio[r] / np.sqrt(max(len(r), 1)) for r in own], sign[chosen], n)
        return w * ratio, ratio, bias

    margins, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        w, _, bias = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = bias + w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1))
    slope, offset = logistic_curve(margins, y)
    w, _, bias = train(np.arange(len(y)))
    weights[vocabulary], used[vocabulary] = w, True
    return Model(weights, used, bias, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """Fitted on at most ``most`` labelled documents, never on the held-out ones."""
    return fit_rows(*sample_rows(docs, labels, label, most, ngrams))


def score_documents(docs: DataFrame, model, threshold: float) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if the score reaches the threshold).

    Null and empty texts are scored like any other, from the model's bias alone. Repeated rows score alike; a
    null id is not held out. Columns of these names are replaced, others come through. An empty table
    gives an empty result. ``model`` needs ``score(bytes)`` and is sent to each executor once; its size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for batch in batches:
            found = np.array([score(t) for t in texts(batch)], float)
            yield with_columns(batch, {"score": pa.array(found), "predicted": pa.array((found >= threshold).astype(np.int32))})

    held = docs.withColumn("held_out", held_out("doc_id"))
    return held.mapInArrow(run, extended(held.schema, "score double, predicted int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), fit_quality(docs, labels), THRESHOLD)
    return scored.select("doc_id", "held_out", "score", "predicted")
