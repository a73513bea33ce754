"""Text quality by ordinal regression: one weight for each hashed feature, ordered thresholds between the grades.

With z the summed weights of a text's features, P(grade <= j) is the logistic function of (threshold j - z). Expected grade
and the probability of a grade of at least k come from the same weights, so that a selection by either is in one order.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textmodel as tm
from .common import map_texts

RIDGE = 1e-3
TAIL = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
STEPS = (0.01, 0.05, 0.2, 0.5)
LONGEST_HELD = 1000  # shapes of longer tokens are found again


def _kind(c: str) -> str:
    return ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c


def shape(token: str) -> str:
    """Letters, digits and signs of a whole token, runs as one: 'Haus,' and 'der,' are both 'a,', 'ABC!!' is 'A!'."""
    return "".join(kind for kind, _ in groupby(map(_kind, token)))


class Features:
    """Hashed features of a text: shares of token shapes, of repeated tokens and lines, length, and words."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.words, self.wanted, self.shapes = tm.WordBuckets(wanted), wanted, {}

    def _shape(self, token: str) -> str:
        found = self.shapes.get(token)
        if found is None:
            found = shape(token)
            if len(self.shapes) > tm.WORDS_HELD:
                self.shapes.clear()
            if len(token) <= LONGEST_HELD:
                self.shapes[token] = found
        return found

    def __call__(self, text: str) -> set[int]:
        tokens = text.split()
        n = max(len(tokens), 1)
        counts: dict[str, int] = {}
        for s in map(self._shape, tokens):
            counts[s] = counts.get(s, 0) + 1
        lines = [x for x in text.split("\n") if x.strip()]
        shares = {f"shape {s}": c / n for s, c in counts.items()} | {
            "same as before": sum(map(str.__eq__, tokens[1:], tokens)) / n,
            "seen before": 1 - len(set(tokens)) / n if tokens else 0,
            "lines seen before": 1 - len(set(lines)) / len(lines) if lines else 0,
        }
        names = [f"{k} {step}" for k, share in shares.items() for step in STEPS if share >= step]
        names += [f"longer than {k}" for k in (0, 5, 20, 50, 100, 1000) if len(tokens) > k]
        found = [tm.bucket(x) for x in names]
        chosen = found if self.wanted is None else [self.wanted[b] for b in found if b in self.wanted]
        return self.words(text).union(chosen)


class Model:
    """Weights of chosen buckets and ascending thresholds (one less than grades)."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.wanted = {int(b): i for i, b in enumerate(chosen)}
        self.weights, self.thresholds = weights.tolist(), thresholds

    def tails(self, features: Features, text: str) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        z = sum(sorted(self.weights[i] for i in features(text)))
        return tm.sigmoid(z - self.thresholds).tolist()


def fit(marks: np.ndarray, found: list[np.ndarray]) -> Model:
    """Grades 0 to K-1. Grades that no row has still count: their thresholds meet."""
    grades = int(marks.max()) + 1 if len(marks) else 1
    if grades < 2 or len(np.unique(marks)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.where(np.arange(1, grades) <= (marks.max() if len(marks) else 0), -5.0, 5.0))
    chosen = tm.choose(marks, found)
    row, column = tm.positions(found, chosen)
    n, k = len(marks), len(chosen)
    below = np.clip(np.cumsum(np.bincount(marks, minlength=grades))[:-1] / n, 0.01, 0.99)
    first = np.log(below / (1 - below))
    start = np.concatenate([np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def thresholds(at: np.ndarray) -> np.ndarray:
        return at[k] + np.concatenate([[0.0], np.cumsum(np.exp(at[k + 1 :]))])

    def slope(at: np.ndarray) -> np.ndarray:
        edges = np.concatenate([[-np.inf], thresholds(at), [np.inf]])
        z = np.bincount(row, at[:k][column], n)
        upper, lower = tm.sigmoid(edges[marks + 1] - z), tm.sigmoid(edges[marks] - z)
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance / n, lower * (1 - lower) / chance / n
        g = np.bincount(column, (du - dl)[row], k) + RIDGE * at[:k]
        edge = -np.bincount(marks, du, grades)[:-1] + np.bincount(marks, dl, grades)[1:]
        later = np.cumsum(edge[::-1])[::-1]  # a threshold moves with all gaps before it
        return np.concatenate([g, later[:1], later[1:] * np.exp(at[k + 1 :])])

    at = tm.adam(start, slope)
    return Model(chosen, at[:k], thresholds(at))


def learn(
    docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text: str = "text",
    rows: int = tm.SAMPLE_ROWS, allowed: Column | None = None,
) -> Model:
    """A model from at most ``rows`` rated rows; ``grade`` is a column of ``ratings`` with 0, 1, 2 and so on."""
    sample = tm.sample_of(docs, ratings, id_col, text, grade, F.lit(True) if allowed is None else allowed, rows)
    return fit(*tm.gathered(sample, lambda texts: [sorted(f(t)) for f in [Features()] for t in texts]))


def grade(docs: DataFrame, model: Model, keep: list[str], text: str = "text", least: int = 1) -> DataFrame:
    """``keep``, expected_grade, tail (P(grade >= ``least``)) of every row's whole text, and every grade's tail by commas.

    Null counts as empty; an empty text has the features of an empty text and is graded as all others. Repeated rows stay.
    """

    def work(texts: list[str]) -> list[dict]:
        if not held:
            held.append(Features(model.wanted))
        rows = []
        for t in texts:
            tails = model.tails(held[0], t)
            rows.append({"expected_grade": sum(tails), "tail": tails[least - 1] if len(tails) >= least else 0.0})
        return rows

    held: list[Features] = []
    return map_texts(docs, keep, text, work, "expected_grade double, tail double")
