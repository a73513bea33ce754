"""Toxicity scores by a logistic model that is held to equal scores when identity terms are swapped.

Every labelled text that names a group gets counterparts in which the term is swapped for the other terms of its list, sentence
by sentence. Beside the log loss the model pays ``fairness`` times the squared change of its logit between a text and its
counterpart, so that weight on the names of groups, which a label would not justify, is taken away.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textmodel as tm
from .common import map_texts

#: Terms that may be swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)
THRESHOLD = 0.3
FAIRNESS = 1.0
RIDGE = 1e-3
SENTENCE = re.compile(r"(?<=[.!?\n])\s*")


def swaps(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[str]:
    """Counterparts of the text: one for each sentence with identity terms and each way to shift its terms in their lists."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(place, key=len, reverse=True))) + r")\b", re.I)
    if not pattern.search(text):
        return []
    parts, found = [p for p in SENTENCE.split(text) if p], []
    for n, part in enumerate(parts):
        named = {place[m.lower()] for m in pattern.findall(part)}
        for shift in range(1, max((len(g) for g, _ in named), default=1)):
            other = pattern.sub(lambda m: (p := place[m[0].lower()])[0][(p[1] + shift) % len(p[0])], part)
            if other.lower() != part.lower():
                found.append(" ".join([*parts[:n], other, *parts[n + 1 :]]))
    return found


class Model:
    """Weights of chosen buckets and an intercept."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, intercept: float):
        self.wanted = {int(b): i for i, b in enumerate(chosen)}
        self.weights, self.intercept = weights.tolist(), float(intercept)

    def score(self, buckets: tm.WordBuckets, text: str) -> float:
        z = self.intercept + sum(sorted(self.weights[i] for i in buckets(text)))
        return float(tm.sigmoid(np.float64(z)))


def fit(marks: np.ndarray, found: list[np.ndarray], owner: np.ndarray, other: list[np.ndarray], fairness: float) -> Model:
    """``found``: buckets of each text; ``other``: buckets of counterparts, ``owner``: the row that each belongs to."""
    if not 0 < marks.sum() < len(marks):  # one class only: nothing to learn but the prior
        share = (marks.sum() + 0.5) / (len(marks) + 1) if len(marks) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    chosen = tm.choose(marks, found)
    row, column = tm.positions(found, chosen)
    row2, column2 = tm.positions(other, chosen)
    n, k, y = len(marks), len(chosen), marks.astype(float)

    def slope(at: np.ndarray) -> np.ndarray:
        w = at[:k]
        plain = np.bincount(row, w[column], n)
        error = (tm.sigmoid(plain + at[k]) - y) / n  # each row weighs alike, so that the score is a probability at the labels' own rate
        g = np.bincount(column, error[row], k) + RIDGE * w
        if len(owner):
            change = (np.bincount(row2, w[column2], len(owner)) - plain[owner]) * (2 * fairness / len(owner))
            g += np.bincount(column2, change[row2], k)
            g -= np.bincount(column, np.bincount(owner, change, n)[row], k)
        return np.append(g, error.sum())

    at = tm.adam(np.zeros(k + 1), slope)
    return Model(chosen, at[:k], at[k])


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic",
    fairness: float = FAIRNESS, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, rows: int = tm.SAMPLE_ROWS,
) -> Model:
    """A model from at most ``rows`` labelled rows whose ids are not held out."""
    allowed = ~held_out(id_col)
    sample = tm.sample_of(docs, labels, id_col, text, F.col(toxic), allowed, rows)

    def work(texts: list[str]) -> list[list[int]]:
        """Buckets of the text and of its counterparts; -1 stands before each set."""
        buckets, out = tm.WordBuckets(), []
        for t in texts:
            out.append([x for s in (t, *swaps(t, groups)) for x in (-1, *sorted(buckets(s)))])
        return out

    marks, sets = tm.gathered(sample, work)
    found, other, owner = [], [], []
    for i, s in enumerate(sets):
        first, *more = np.split(s, np.flatnonzero(s == -1)[1:])
        found.append(first[1:])
        other += [m[1:] for m in more]
        owner += [i] * len(more)
    return fit(marks, found, np.array(owner, np.int64), other, fairness)


def held_out(id_col: str):
    """Whether crc32 of the id's text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every row's whole text; null and empty texts get the intercept's score."""

    def work(texts: list[str]) -> list[dict]:
        if not held:
            held.append(tm.WordBuckets(model.wanted))
        return [{"score": model.score(held[0], t)} for t in texts]

    held: list[tm.WordBuckets] = []
    return map_texts(docs, keep, text, work, "score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``, with the columns of ``docs``; repeated rows stay."""
    names = docs.columns
    scored = score(docs.withColumn("__whole", F.col(text)), model, [*names], "__whole")
    return scored.where(F.col("score") < threshold).select(names) if "score" not in names else _apart(docs, model, text, threshold)


def _apart(docs: DataFrame, model: Model, text: str, threshold: float) -> DataFrame:
    """The same for tables that have a column of the score's name."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return keep_clean(plain, model, f"c{names.index(text)}", threshold).toDF(*names)
