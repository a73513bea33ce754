"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

How many pieces there are of each length (at most ``capacity`` numbers) is all that packing depends on. So pieces are counted
on Spark, the counts are packed on the driver as groups of equal sequences, and every piece finds its place by its number
among the pieces of its length. The plan's size depends on the capacity, not on the number of documents.

Reduction: a set of pieces that dominates every other set with one of its members is fixed for good. That holds for a piece
with an exact complement, for one that fits with nothing, and, where no two others fit beside the longest piece (or
none of them is longer together), for it and the longest piece that fits. What is left is packed best-fit, longest first.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECES, SPECIAL_MARK, Vocabulary
from .common import settle, slices

CAPACITY = 2048
END = 0
WORDS_HELD = 400_000


class IdBytes:
    """Texts to ids as little-endian unsigned 32-bit numbers; what words have become is held, up to a number of words.

    The pieces are those of the vocabulary file; a word after a single space is encoded once (see ``bpe.Encoder``).
    """

    def __init__(self, path: str, entries: int = WORDS_HELD):
        voc = Vocabulary(path)
        if not (np.diff(voc.made) > 0).all():
            raise ValueError("merges must be numbered in the order of their ranks")
        ranks = {t: i for t, i in voc.ids.items() if t.decode("utf-8", "replace") not in voc.special}
        self.coder = tiktoken.Encoding("ids", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=voc.special)
        self.special, self.entries, self.words = set(voc.special), entries, {}

    def whole(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special=self.special).astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        words = self.words
        if new := {w for w in rest if w not in words}:
            if len(words) + len(new) > self.entries:
                words.clear()
                new = set(rest)
            plain = self.coder.encode_ordinary
            for w in new:
                usable = w and not w[0].isspace() and not w[-1].isspace() and SPECIAL_MARK not in w
                words[w] = np.array(plain(" " + w), "<u4").tobytes() if usable else None
        parts = list(map(words.__getitem__, rest))
        if None in parts or SPECIAL_MARK in first or (first and rest and first[-1].isspace()):
            return self.whole(text)
        return b"".join([self.whole(first), *parts])


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``capacity``."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, path: str, id_col: str, text: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """Every piece with its length, checksum, and its number among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encode = TaskContext.get().partitionId(), Counter(), IdBytes(path)
        last = np.uint32(end).astype("<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "__text"):
                row, out = [], []
                for i, t in enumerate(batch.column("__text").to_pylist()):
                    ids = encode(t or "") + last
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        held = ids[4 * start : 4 * (start + length)]
                        row.append(i)
                        out.append((n, start, length, zlib.crc32(held), task, seen[length], held if with_ids else None))
                        seen[length] += 1
                columns = list(zip(*out)) or [()] * 7
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                taken = batch.column(id_col).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *arrays], [id_col, *names])

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long, ids binary"
    return docs.select(id_col, F.col(text).alias("__text")).mapInArrow(run, schema)


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Sets that dominate ([lengths], times), and the counts that are left."""
    left, fixed = Counter({k: v for k, v in counts.items() if v > 0}), []

    def fix(members: list[int], times: int) -> None:
        fixed.append((members, times))
        for k in members:
            left[k] -= times
            if not left[k]:
                del left[k]

    if left[capacity]:
        fix([capacity], left[capacity])
    for k in sorted(left, reverse=True):
        if 2 * k > capacity and k in left and left.get(capacity - k, 0):
            fix([k, capacity - k], min(left[k], left[capacity - k]))
    if capacity % 2 == 0 and left.get(capacity // 2, 0) > 1:
        fix([capacity // 2] * 2, left[capacity // 2] // 2)
    while left:
        longest = max(left)
        room = capacity - longest
        others = Counter(left)
        others[longest] -= 1
        small = sorted(k for k, n in others.items() if n > 0 and k <= room)
        if not small:
            fix([longest], left[longest] if room < longest else 1)
            continue
        best, least = small[-1], small[0]
        two = 2 * least if others[least] > 1 else least + small[1] if len(small) > 1 else room + 1
        if two <= room:
            three = sorted(x for k in small[:3] for x in [k] * min(others[k], 3))[:3]
            pairs_only = len(three) < 3 or sum(three) > room
            if not (pairs_only and best >= _longest_pair(small, others, room)):
                break
        times = 1 if best == longest else min(left[longest], left[best])
        fix([longest, best], times)
    return fixed, dict(left)


def _longest_pair(small: list[int], count: Counter, room: int) -> int:
    """Greatest sum of two lengths that does not exceed ``room``."""
    low, high, best = 0, len(small) - 1, 0
    while low <= high:
        total = small[low] + small[high]
        if total > room or (low == high and count[small[low]] < 2):
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit, longest first, for all pieces of a length at once: groups of equal sequences ([(length, each)], times)."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            room = min((r for r, groups in rooms.items() if r >= length and groups), default=None)
            held, times = rooms[room].pop() if room is not None else ([], -(-todo // (capacity // length)))
            room = capacity if room is None else room
            each = min(room // length, todo)
            full = min(times, todo // each)
            rooms[room - each * length].append(([*held, (length, each)], full))
            if held and times > full:
                rooms[room].append((held, times - full))
            todo -= each * full
    return [g for groups in rooms.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first number, each, first sequence, offset) in the order of their first numbers."""
    fixed, left = reduce_counts(counts, capacity)
    groups = [([(k, n) for k, n in Counter(members).items()], times) for members, times in fixed]
    rows, given, sequence = defaultdict(list), Counter(), 0
    for members, times in [*groups, *best_fit(left, capacity)]:
        offset = 0
        for length, each in members:
            rows[length].append((given[length], each, sequence, offset))
            given[length] += each * times
            offset += each * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows: id, piece, start, length, ids_crc32, sequence_id, offset (and ids as bytes, if asked for).

    A document is its ids and then ``end``; null text counts as empty, so it is one piece of length 1. Documents longer than
    ``capacity`` are cut into pieces of that length, of which the first may be shorter. Repeated rows are packed each; a null
    id is kept; other columns do not matter; an empty table gives an empty result. Places in a sequence have no gaps.
    """
    found = settle(pieces(docs, path, id_col, text, capacity, end, with_ids), "pieces")
    tasks = found.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, starts = np.unique(length[order], return_index=True)
            for kind, at in zip(kinds.tolist(), np.split(order, starts[1:])):
                rows = places[kind]
                row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                nth = number[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * kind
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    keep = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = found.join(first, ["task", "length"]).withColumn("number", F.col("nth") + F.col("first"))
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)
    return numbered.select(*keep, "number").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
