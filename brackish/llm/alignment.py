"""Alignment of two tokenisations: verified shared ends before space-marked tokens cut a document into windows of token ids.

Both tokenisers read the whole text first. Where a token that starts with a space begins in both, the tokens before end in both;
these anchors cut the two rows of ids into windows. What a window's alignment is depends on nothing but its two tuples of ids:
its groups, how many links they hold, and which pairs of ids are linked. So a task aligns each distinct pair of tuples once and
looks it up from then on; words come again and again, and so do their windows.

A document is written with its distinct pairs of ids and how often each is linked, so both texts are read once. Pairs are counted
over all documents with map-side sums; there can be no more of them than pairs of vocabulary entries. Pairs of many documents,
of which there are at most ``COMMON``, reach the documents by broadcast and are summed before anything moves; the others by a join.
"""

from __future__ import annotations

import gc
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, Tokens
from .common import settle, sha256, slices

WINDOWS_HELD = 250_000
COMMON = 100_000
B_BITS = 20  # ids of the second vocabulary lie below
SLICE = 2 << 20
MADE = 1 << 16  # bytes of keys whose windows are made at once: arrays of some 100 KB each stay in a cache
MARK = 2**32 - 1  # no id


class Side:
    """The bytes of each token of a vocabulary, their number, and whether they start with a space."""

    def __init__(self, tokens: dict[int, bytes]):
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = [len(t) for t in self.bytes]
        self.size = np.array(self.sizes, np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in self.bytes])
        self.names = list(map(str, range(len(self.bytes))))

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> dict[int, bytes]:
    """Bytes of a piece: U+2581 is a space, a byte piece is its byte."""
    tokens = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return tokens


class Window:
    """The alignment of two tuples of ids: groups as text, their number, links, and the linked pairs of ids.

    ``packed`` has a pair as often as it is linked, as eight bytes each; groups of very many links have theirs in ``many``, with
    how often.
    """

    __slots__ = ("groups", "links", "many", "packed", "text")

    def __init__(self, a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int], a_names: list[str], b_names: list[str]):
        sides = (np.array(x, np.int64) for x in (a, b, a_sizes, b_sizes, [len(a)], [len(b)]))
        ((self.groups, self.links, self.many, self.packed, self.text),) = alignments(*sides, a_names + b_names, len(a_names))

    @property
    def pairs(self) -> tuple[int, ...]:
        return tuple(np.frombuffer(self.packed, np.int64).tolist())


class Windows(dict):
    """Windows by key. One that is asked for and not held is added without its alignment, and is in ``new`` until it has one."""

    def __init__(self):
        self.new: dict[bytes, Window] = {}

    def __missing__(self, key: bytes) -> Window:
        self[key] = self.new[key] = window = Window.__new__(Window)
        return window


def alignments(
    a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, a_count: np.ndarray, b_count: np.ndarray,
    names: list[str], b_name: int,
) -> Iterator[tuple[int, int, Counter | None, bytes, str]]:
    """What a ``Window`` holds, for windows one behind the other: ids and their sizes, and how many of them each window has.

    A window's sides have as many bytes, so the windows are worked like one text. ``names`` has the first vocabulary's, from
    ``b_name`` on the second's.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.zeros(a_ends[-1] + 1, np.int8)
    ends[a_ends] += 1
    ends[b_ends] += 1
    a_last, b_last = ends[a_ends] == 2, ends[b_ends] == 2
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_n, b_n = np.bincount(a_group), np.bincount(b_group)
    a_stop, b_stop = np.cumsum(a_n), np.cumsum(b_n)
    b_start = b_stop - b_n
    # every group's left ids, then its right ones, each before its mark
    a_at, b_at = np.arange(len(a)) + b_start[a_group], np.arange(len(b)) + a_stop[b_group]
    shown, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
    shown[a_at], shown[b_at] = a, b + b_name
    marks[a_at[a_last]], marks[b_at[b_last]] = 1, 2
    written = [""] * (2 * len(shown))
    written[::2], written[1::2] = map(names.__getitem__, shown.tolist()), map(",|;".__getitem__, marks.tolist())
    # each left id with all right ones of its group, but for groups of very many links
    large = (a_n > 1) & (a_n + b_n > 64)
    times = np.where(large, 0, b_n)[a_group]
    paired = np.cumsum(times)
    right = np.arange(paired[-1]) + np.repeat(b_start[a_group] - paired + times, times)
    packed = (np.repeat(a << B_BITS, times) | b[right]).tobytes()
    # where each window ends
    a_to, b_to = np.cumsum(a_count), np.cumsum(b_count)
    group_to = a_group[a_to - 1] + 1
    links = np.diff(np.cumsum(a_n * b_n)[group_to - 1], prepend=0)
    held: dict[int, Counter] = {}
    for g in np.flatnonzero(large).tolist():
        many = held.setdefault(int(np.searchsorted(group_to, g, "right")), Counter())
        lefts, rights = Counter(a[a_stop[g] - a_n[g] : a_stop[g]].tolist()), Counter(b[b_start[g] : b_stop[g]].tolist())
        for x, m in lefts.items():
            for y, o in rights.items():
                many[x << B_BITS | y] += m * o
    start = begin = 0
    columns = np.diff(group_to, prepend=0), links, 8 * paired[a_to - 1], 2 * (a_to + b_to)
    for n, (groups, linked, stop, end) in enumerate(zip(*(c.tolist() for c in columns))):
        yield groups, linked, held.get(n), packed[start:stop], "".join(written[begin : end - 1])
        start, begin = stop, end


class Aligner:
    """Alignments of texts; windows are held up to a number, and those of the texts at hand, then forgotten."""

    def __init__(self, byte_path: str, piece_path: str, held: int = WINDOWS_HELD):
        voc = Tokens(byte_path)
        ranks = {t: i for t, i in voc.ids.items() if t.decode("utf-8", "replace") not in voc.special}
        self.coder = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a, self.b = Side(voc.bytes), Side(piece_bytes(self.model))
        self.names = self.a.names + self.b.names
        self.held, self.windows = held, Windows()

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, list[Window]]]:
        """Numbers of tokens and the windows in order, for each text; nothing where the tokens are not the text."""
        if len(self.windows) > self.held:
            self.windows.clear()
        rows: list[tuple[int, int, list[Window]]] = []
        for text, b in zip(texts, self.model.encode(texts, num_threads=1, out_type="numpy")):
            data = b" " + text.encode()
            a = np.frombuffer(array("I", self.coder.encode_ordinary(" " + text)), np.uint32)
            # the first vocabulary has every byte, so its tokens lose nothing if their sizes add up
            if not text or self.a.size[a].sum() != len(data) or self.b.joined(b.tolist()) != data:
                rows.append((0, 0, []))
                continue
            rows.append((len(a), len(b), list(map(self.windows.__getitem__, self._keys(a, b)))))
        self._make()
        yield from rows

    def _keys(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Both tuples of each window, as bytes with a mark between."""
        a_sizes, b_sizes = self.a.size[a], self.b.size[b]
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        # at the byte where a token of the first vocabulary starts with a space, which one it is
        i, k = np.flatnonzero(self.a.spaced[a]), np.flatnonzero(self.b.spaced[b])
        spaced = np.zeros(a_ends[-1], np.int64)
        spaced[a_ends[i] - a_sizes[i]] = i
        i = spaced[b_ends[k] - b_sizes[k]]
        met = i > 0
        i, k = np.concatenate([[0], i[met], [len(a)]]), np.concatenate([[0], k[met], [len(b)]])
        number = np.arange(len(i) - 1)
        tuples = np.full(len(a) + len(b) + len(number), MARK, np.uint32)
        tuples[np.arange(len(a)) + np.repeat(k[:-1] + number, np.diff(i))] = a
        tuples[np.arange(len(b)) + np.repeat(i[1:] + number + 1, np.diff(k))] = b
        data, cuts = tuples.tobytes(), (4 * (i + k + np.arange(len(i)))).tolist()
        return [data[x:y] for x, y in zip(cuts, cuts[1:])]

    def _make(self) -> None:
        """Aligns the new windows, some at a time."""
        keys, windows = list(self.windows.new), list(self.windows.new.values())
        self.windows.new.clear()
        start = size = 0
        for n, key in enumerate(keys, 1):
            size += len(key)
            if size < MADE and n < len(keys):
                continue
            some = keys[start:n]
            ids = np.frombuffer(b"".join(some), np.uint32).astype(np.int64)
            marks, stops = np.flatnonzero(ids == MARK), np.cumsum(np.fromiter(map(len, some), np.int64, len(some))) // 4
            starts = np.concatenate([[0], stops[:-1]])
            left = np.repeat(np.tile([True, False], len(some)), np.stack([marks - starts, stops - marks], 1).ravel())
            right = ~left
            right[marks] = False
            a, b = ids[left], ids[right]
            made = alignments(a, b, self.a.size[a], self.b.size[b], marks - starts, stops - marks - 1, self.names, len(self.a.names))
            for w, alignment in zip(windows[start:n], made):
                w.groups, w.links, w.many, w.packed, w.text = alignment
            start, size = n, 0


def linked_pairs(windows: list[Window]) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's windows, the distinct pairs of ids in order, and how often each is linked."""
    pairs, times = np.unique(np.frombuffer(b"".join([w.packed for w in windows]), np.int64), return_counts=True)
    many = [w.many for w in windows if w.many is not None]
    if not many:
        return pairs, times
    pairs = np.concatenate([pairs, *(np.fromiter(m, np.int64, len(m)) for m in many)])
    times = np.concatenate([times, *(np.fromiter(m.values(), np.int64, len(m)) for m in many)])
    distinct, place = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, times)
    return distinct, total


FIELDS = {
    "row": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups_sha256": pa.string(), "groups": pa.string(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "times": pa.list_(pa.int64()),
}
SCHEMA = (
    "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a array<int>, b array<int>, "
    "times array<bigint>"
)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text: str, with_groups: bool) -> DataFrame:
    """A row for each row of ``docs``, with a number of its own and the distinct linked pairs of ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is held has no cycles, and looking for them costs a sixth of the time
        try:
            yield from work(batches)
        finally:
            gc.enable()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "__text", SLICE):
                columns: dict[str, list] = {c: [] for c in FIELDS}
                for n_a, n_b, windows in aligner.align([t or "" for t in batch.column("__text").to_pylist()]):
                    (codes, times), shown = linked_pairs(windows), ";".join([w.text for w in windows])
                    made = (
                        row, n_a, n_b, sum([w.groups for w in windows]), sum([w.links for w in windows]),
                        sha256(shown.encode()) if windows else "", shown if with_groups else None,
                        (codes >> B_BITS).astype(np.int32), (codes & ((1 << B_BITS) - 1)).astype(np.int32), times,
                    )
                    for column, value in zip(columns.values(), made):
                        column.append(value)
                    row += 1
                arrays = [pa.array(columns[c], kind) for c, kind in FIELDS.items()]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *arrays], [id_col, *FIELDS])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {id_kind}, {SCHEMA}")


def pair_counts(each: DataFrame) -> DataFrame:
    """(pair, documents, best): of each linked pair of ids how many documents hold it, and whether its first id has none with more."""
    pairs = settle(each.groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pairs")
    first = F.shiftright("pair", B_BITS)
    most = pairs.groupBy(first.alias("first")).agg(F.max("documents").alias("most"))
    counted = pairs.withColumn("first", first).join(most, "first")
    return counted.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def common_least(pairs: DataFrame, most: int) -> int:
    """The smallest power of two of documents that at most ``most`` pairs reach."""
    steps = pairs.groupBy(F.floor(F.log2("documents")).alias("step")).count().collect()  # a row for each power of two
    reached, least = 0, 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        reached += r["count"]
        if reached > most:
            break
        least = int(r["step"])
    return 1 << least


def align(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False,
    common: int = COMMON,
) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row (``groups`` too, if asked for).

    Null and empty texts, and those whose tokens do not give their bytes back, have zeros and ''. A row is a document, so rows that
    repeat count each; null ids stay; other columns do not matter; an empty table gives an empty result. The files are
    read by every executor. Texts may be of any length; a link's count is exact whatever ``common`` is.
    """
    found = settle(aligned(docs, byte_path, piece_path, id_col, text, with_groups), "aligned")
    each = found.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
    pair = F.shiftleft(F.col("p.a").cast("long"), B_BITS).bitwiseOR(F.col("p.b").cast("long"))
    each = each.select("row", pair.alias("pair"), F.col("p.times").alias("times"))
    pairs = settle(pair_counts(each), "pair-counts")
    least = common_least(pairs, common)
    top = F.broadcast(pairs.where(F.col("documents") >= least))
    of_top = each.join(top, "pair")
    of_rest = each.join(top.select("pair"), "pair", "left_anti").join(pairs.where(F.col("documents") < least), "pair")
    totals = lambda df: df.groupBy("row").agg(
        F.sum(F.col("times") * F.col("documents")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    )
    both = totals(of_top).unionByName(totals(of_rest)).groupBy("row")
    both = both.agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    more = ["groups"] if with_groups else []
    return found.join(both, "row", "left").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *more
    )
