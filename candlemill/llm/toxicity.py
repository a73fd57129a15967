"""Toxicity: a factorization machine (Rendle, 2010) over hashed terms.

Besides a weight, each term has a short vector, and each pair of terms in a text adds the product of their
vectors. So an insult next to the mention of a group can count for more than either alone, which sums of
weights miss. All pairs of a text cost no more than its terms: the sum over pairs is half of the squared sum
less the sum of squares.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from candlemill.llm.quality_classifier import logistic_curve, score_documents
from candlemill.llm.terms import BUCKETS, Known, bucket, compact, frequent, sample_rows

SAMPLE_ROWS = 16_000
CALIBRATING = 4  # each so many-th row of the sample is left for the logistic curve
LEAST_SHARE = 1 / 800  # of the sample's rows that have a term, for it to be learned
FACTORS = 4
THRESHOLD = 0.3
STEMS = (4, 7)  # of words longer than that, the first letters are terms too
MEMORY = 200_000
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _of_word(word: bytes) -> list[int]:
    word = word.strip(_MARKS)
    letters = word.decode("utf-8", "replace")
    return [bucket(word), *(bucket(letters[:n].encode(), n) for n in STEMS if len(letters) > n)]


_known = Known(_of_word, MEMORY)


def terms(text: bytes) -> np.ndarray:
    """The buckets of a text's words (A-Z lower-cased, without marks around them) and of their stems, by which forms of a
    word that were never seen are known; each once, sorted."""
    return np.unique(np.fromiter(chain.from_iterable(map(_known.__getitem__, set(text.lower().split()))), np.int64))


@dataclass
class Machine:
    bias: float
    place: np.ndarray  # by bucket: the term's place in weights and factors, or the last, which has zeros
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        at = self.place[found]
        v = self.factors[at]
        return self.bias + float(self.weights[at].sum() + (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum() / 2)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(terms(text)) + self.offset, -50, 50))))


class Adam:
    """Steps of a size that follows each number's own gradients."""

    def __init__(self, rate: float) -> None:
        self.rate, self.turn, self.mean, self.square = rate, 0, 0.0, 0.0

    def step(self, x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.turn += 1
        self.mean = 0.9 * self.mean + 0.1 * g
        self.square = 0.99 * self.square + 0.01 * g * g
        size = self.rate / (np.sqrt(self.square / (1 - 0.99**self.turn)) + 1e-4)
        return x - size * self.mean / (1 - 0.9**self.turn), size


class Rows:
    """Rows of terms, as one array of places and one of the rows they are in."""

    def __init__(self, rows: list[np.ndarray], n: int) -> None:
        self.count, self.n = len(rows), n
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values[self.at], minlength=self.count)

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.row], minlength=self.n)

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.stack([self.by_row(v[:, f]) for f in range(v.shape[1])], 1)

    def margins(self, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return bias + self.by_row(w) + ((self.sums(v) ** 2).sum(axis=1) - self.by_row((v * v).sum(axis=1))) / 2


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -margin, margin)).mean())


def descend(rows: list[np.ndarray], y: np.ndarray, n: int, factors: int = FACTORS, rounds: int = 220, alone: int = 100, rate: float = 0.05,
            pair_rate: float = 0.005, weight_cut: float = 0.014, shrink: float = 3e-4,
            unseen: tuple[list[np.ndarray], np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss over all rows. ``alone`` rounds fit the weights, each under a penalty on its size (``weight_cut`` by the root of the rows, as
    chance gives a term that much) that leaves exact zeros for terms that say nothing: long texts have thousands of those. Then terms with a weight get vectors, and
    weights and vectors learn together; vectors shrink in proportion (a cut like the weights' would take
    them all, as pairs are rare). Of those rounds the one counts that does best on ``unseen`` rows, so pairs are
    learned as far as they hold beyond the rows they come from."""
    draw = np.random.default_rng(11)
    w, p = np.zeros(n), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = np.array([np.log(p / (1 - p))])
    table, adam = Rows(rows, n), [Adam(rate), Adam(rate)]
    error = lambda margin: (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / len(y)
    for _ in range(min(alone, rounds)):
        g = error(bias + table.by_row(w))
        w, size = adam[0].step(w, table.by_term(g))
        w = np.sign(w) * np.maximum(np.abs(w) - size * weight_cut / np.sqrt(len(y)), 0)
        bias, _ = adam[1].step(bias, g.sum())
    telling = np.flatnonzero(w)
    place = np.full(n + 1, -1)
    place[telling] = np.arange(len(telling))
    kept = lambda some: Rows([q[q >= 0] for q in (place[r] for r in some)], len(telling))
    table, start = kept(rows), w[telling]
    judged = kept(unseen[0]) if unseen else None
    own, v = start.copy(), draw.normal(0, 0.02, (len(telling), factors))
    best, least = (float(bias[0]), own, v), np.inf
    adam = [Adam(pair_rate), Adam(pair_rate)]
    for k in range(1, rounds - alone + 1):
        sums = table.sums(v)
        g = error(table.margins(float(bias[0]), own, v))
        by_term = table.by_term(g)
        gv = np.stack([table.by_term(g * sums[:, f]) for f in range(factors)], 1) - by_term[:, None] * v + shrink * v
        own, _ = adam[0].step(own, by_term + 0.01 * (own - start))
        v, _ = adam[1].step(v, gv)
        if judged is None:
            best = (float(bias[0]), own, v)
        elif k % 5 == 0:
            loss = _loss(judged.margins(float(bias[0]), own, v), unseen[1])
            if loss < least:
                best, least = (float(bias[0]), own, v), loss
            elif loss > 1.2 * least:
                break
    bias_, own, v = best
    w, all_v = np.zeros(n), np.zeros((n, factors))
    w[telling], all_v[telling] = own, v
    return bias_, w, all_v


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Rows that the machine has not learned from say how far pairs go, and a logistic curve over their margins puts
    the scores right, which penalties draw towards zero."""
    aside = np.arange(len(labels)) % CALIBRATING == CALIBRATING - 1
    all_rows, y = [r for r, a in zip(rows, aside) if not a], labels[~aside]
    vocabulary = frequent(all_rows, max(3, round(len(y) * LEAST_SHARE)))
    n = len(vocabulary)
    place = np.full(BUCKETS, n, np.int32)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(p / (1 - p))), np.zeros(BUCKETS, np.int32), np.zeros(1), np.zeros((1, FACTORS)))
    t, left = labels[aside], [r for r, a in zip(rows, aside) if a]
    both = 0 < t.sum() < len(t)
    bias, w, v = descend(compact(all_rows, vocabulary), y, n, unseen=(compact(left, vocabulary), t) if both else None)
    telling = (w != 0) | v.any(axis=1)
    place[:] = telling.sum()
    place[vocabulary[telling]] = np.arange(telling.sum())
    found = Machine(bias, place, np.append(w[telling], 0.0), np.vstack([v[telling], np.zeros((1, FACTORS))]))
    if both:
        found.slope, found.offset = logistic_curve(np.array([found.margin(r) for r in left]), t)
    return found


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> Machine:
    """Fitted on at most ``most`` labelled documents, never on the held-out ones."""
    return fit_rows(*sample_rows(docs, labels, label, most, terms))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), fit_toxicity(docs, labels), THRESHOLD)
    return scored.select("doc_id", "held_out", "score", "predicted")
