"""Hashed text features for small linear models: a bounded labelled sample, choice of features, and Adam."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BUCKETS = 1 << 18
CHOSEN = 1024
LEAST_DOCUMENTS = 3
LEAST_CHI = 15.0
SAMPLE_ROWS = 8000
WORDS_HELD = 400_000
WORD = re.compile(r"[^\W\d_]+")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def word_features(word: str) -> list[str]:
    """The word, its beginnings and its endings, so that invented or inflected forms share weights."""
    return [
        f"w{word}",
        *(f"p{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k),
        *(f"s{word[-k:]}" for k in (3, 4, 5) if len(word) > k),
    ]


class WordBuckets:
    """Buckets of the words of a text as a set; what words give is held, up to a number of words."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.held = wanted, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = [bucket(f) for f in word_features(word)]
        return tuple(found) if self.wanted is None else tuple(self.wanted[b] for b in found if b in self.wanted)

    def __call__(self, text: str) -> set[int]:
        held = self.held
        words = set(WORD.findall(text.lower()))
        if new := [w for w in words if w not in held]:
            if len(held) + len(new) > WORDS_HELD:
                held.clear()
                new = words
            held.update((w, self.of_word(w)) for w in new)
        return set().union(*map(held.__getitem__, words))


def sample_of(
    docs: DataFrame, labels: DataFrame, id_col: str, text: str, mark: Column, allowed: Column, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(mark, text) of at most ``rows`` labelled rows: those whose ids have the smallest hashes, so always the same.

    ``mark`` and ``allowed`` are columns of ``labels``; rows without a mark, an id or a text are left out.
    """
    least = (
        labels.where(allowed & mark.isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), mark.cast("int").alias("mark"))
        .orderBy(F.xxhash64("__id"), "mark")
        .limit(rows)
    )
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("__own"), F.col(text).alias("text"))
    # the limit above bounds what is broadcast
    return texts.join(F.broadcast(least), F.col("__own") == F.col("__id")).select("mark", "text")


def gathered(sample: DataFrame, work: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Marks and bucket arrays of the sample; texts are worked on by the tasks, only buckets come to the driver.

    Rows are put in one order, so that the same sample gives the same model.
    """
    made = map_texts(sample, ["mark"], "text", lambda ts: [{"found": np.array(b, np.int32).tobytes()} for b in work(ts)],
                     "found binary")
    rows = made.toArrow()
    found = sorted(zip(rows.column("mark").to_pylist(), rows.column("found").to_pylist()))
    return np.array([m for m, _ in found], np.int64), [np.frombuffer(b, np.int32).astype(np.int64) for _, b in found]


def choose(marks: np.ndarray, found: list[np.ndarray], chosen: int = CHOSEN) -> np.ndarray:
    """Buckets that tell grades apart, by the largest chi-square over the splits of the grades."""
    if not len(marks):
        return np.zeros(0, np.int64)
    n, best = len(marks), np.zeros(BUCKETS)
    total = np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=BUCKETS).astype(float)
    for grade in np.unique(marks)[1:]:
        above = [f for f, m in zip(found, marks) if m >= grade]
        seen = np.bincount(np.concatenate(above), minlength=BUCKETS)
        share = len(above) / n
        spread = total * share * (1 - share) * np.maximum(1 - total / n, 1 / n)
        best = np.maximum(best, np.where(total >= LEAST_DOCUMENTS, (seen - total * share) ** 2 / np.maximum(spread, 1e-9), 0))
    order = np.argsort(-best, kind="stable")[:chosen]
    return order[best[order] >= LEAST_CHI]


def positions(found: Iterable[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every chosen bucket that a row has."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    columns = [place[f][place[f] >= 0] for f in found]
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    return rows, np.concatenate([np.zeros(0, np.int64), *columns])


def adam(start: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam from ``start``; ``slope`` gives the gradient."""
    at, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = slope(at)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at -= rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return at


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
