"""Removal of repeated passages: Burrows-Wheeler transforms of shards are merged, repeated strings are intervals of the merge.

Which strings can repeat at all: the 16-byte grams of every window of 200 bytes have hashes, and the smallest is the window's
class. Equal windows have equal classes. Consecutive windows of one class are kept as one string, so a document becomes about
a string for every 92 bytes. A string whose class no other has, and in which no gram of that hash repeats, holds no repeat.
The others meet in the task of their class, each distinct string once with its number of occurrences; a class of one
distinct string, as copies leave behind, is an interval as it stands.

There, strings are dealt into shards. Each shard is suffix-sorted by itself, and its transform gives for each suffix the
eight bytes before it. The shards are merged by refining their interleave: from the order of all suffixes by their first d
bytes, a stable distribution by the symbol before each suffix gives the order by d + 8 bytes. Within a shard the order is
known, so the interleave only holds from which shard each suffix comes. Blocks of equal prefixes split along the way; at
depth 200 a block is an interval of suffixes with a common prefix of 200 bytes, and it repeats if its strings
occur more than once. Only suffixes that some window needs at a depth take part in it. No suffix is sorted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, sha256, slices

LENGTH = 200
GRAM = 16
WIDE = 8
WINDOWS = 1024  # most windows of a string; longer runs of a class are more strings of it
SHARD_BYTES = 1 << 18
BUCKET_BYTES = 1 << 20  # the merge needs some hundred bytes for each of its bytes, in every worker of an executor
CLASS_BYTES = 2 << 20
ODD, EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros behind the end."""
    x = np.zeros(len(data) + WIDE - 1, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    x = packed(data)[: len(data) - WIDE + 1]
    h = (x[: -(GRAM - WIDE)] * ODD) ^ ((x[GRAM - WIDE :] + EVEN) * EVEN)
    h ^= h >> np.uint64(29)
    h *= ODD
    return h ^ (h >> np.uint64(32))


def _sliding(h: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` neighbours."""
    m, width = h, 1
    while 2 * width <= size:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    rest = size - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def strings_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, first window, windows, whether windows of the string may be equal to each other) of each string of a text."""
    size = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    h = gram_hashes(np.frombuffer(data, np.uint8))
    least = _sliding(h, size)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.append(first[1:], len(least))
    parts = -(-(end - first) // WINDOWS)
    if (parts > 1).any():
        of = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = first[of] + nth * WINDOWS
        end = np.minimum(end[of], first + WINDOWS)
    value = least[first]
    # grams that are smallest in some window, and pairs of equal ones that a window can hold
    peak = ~_sliding(np.concatenate([np.full(size - 1, ~np.uint64(0)), ~least, np.full(size - 1, ~np.uint64(0))]), size)
    at = np.flatnonzero(h == peak)
    order = at[np.lexsort((at, h[at]))]
    near = (h[order[1:]] == h[order[:-1]]) & (order[1:] - order[:-1] <= size)
    marks = np.zeros(len(first) + 1, np.int64)
    np.add.at(marks, np.maximum(np.searchsorted(first, order[1:][near] - size, "right") - 1, 0), 1)
    np.add.at(marks, np.searchsorted(first, order[:-1][near] + 1, "right"), -1)
    return value.view(np.int64), first, end - first, (np.cumsum(marks[:-1]) > 0).astype(np.int64)


def _sorted_places(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places in the order of (high, low), both below 2^31 and not negative. Sorts plain numbers where they fit in one."""
    n = len(high)
    bits = max(1, (n - 1).bit_length())
    wide = max(1, int(high.max(initial=0)).bit_length()), max(1, int(low.max(initial=0)).bit_length())
    if sum(wide) + bits > 63:
        return np.argsort((high << 32) | low, kind="stable")
    keys = (high << (wide[1] + bits)) | (low << bits) | np.arange(n)
    keys.sort()
    return keys & ((1 << bits) - 1)


def _shard_order(numbers: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first bytes, to ``length`` at least, by doubling.

    numbers: ranks of the first eight bytes; left: bytes to the string's end.
    """
    rank, depth = numbers.astype(np.int64) + 1, WIDE
    while True:
        after = np.zeros(len(rank), np.int64)
        inside = np.flatnonzero(left > depth)
        after[inside] = rank[inside + depth]
        order = _sorted_places(rank, after)
        high, low = rank[order], after[order]
        split = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        depth *= 2
        if depth >= length or split.all():
            return order
        rank[order] = np.cumsum(np.concatenate([[1], split]))


def _distributed(symbols: np.ndarray) -> np.ndarray:
    """Places of the symbols in a stable distribution by symbol."""
    keys = (symbols.astype(np.int64) << 32) | np.arange(len(symbols))
    keys.sort()
    return keys & 0xFFFFFFFF


def repeated_windows(
    strings: list[bytes], weights: list[int], length: int = LENGTH, shard: int = SHARD_BYTES
) -> list[np.ndarray]:
    """For each string, which of its windows occur more than once, a string counting as often as its weight says."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = np.maximum(sizes - length + 1, 0)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    offset = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), sizes)
    left = np.repeat(sizes.astype(np.int32), sizes) - offset
    keys = packed(data)
    short = np.flatnonzero(left < WIDE)  # what follows belongs to the next string
    keys[short] &= ~np.uint64(0) << ((WIDE - left[short]) * 8).astype(np.uint64)
    numbers = np.unique(keys, return_inverse=True)[1].astype(np.int32)
    # shards of whole strings, at most 255
    per = max(shard, -(-len(data) // 200))
    of_string = begin // per
    starts = np.searchsorted(of_string, np.unique(of_string))
    order = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(strings)]):
        lo, hi = int(begin[a]), int(begin[b - 1] + sizes[b - 1])
        order.append(_shard_order(numbers[lo:hi], left[lo:hi], length) + lo)
    counts = np.array([len(o) for o in order])
    suffixes = np.concatenate(order)
    shard_of = np.repeat(np.arange(len(order)), counts).astype(np.uint8)
    away = offset[suffixes]
    until = (offset - np.repeat(windows.astype(np.int32), sizes))[suffixes]
    before = np.concatenate([np.zeros(WIDE, np.int32), numbers])[suffixes]  # the transform: of each suffix, in its shard's order, what stands before

    def taking_part(depth: int) -> np.ndarray:
        """Suffixes that are the last ``depth`` bytes of a window."""
        return (away >= length - depth) & (until < length - depth)

    first = length % WIDE or WIDE
    part = taking_part(first)
    prefix = keys[suffixes[part]] >> np.uint64(8 * (WIDE - first))
    place = np.argsort(prefix, kind="stable")
    interleave, prefix = shard_of[part][place], prefix[place]
    block = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]])).astype(np.int32) if len(prefix) else np.zeros(0, np.int32)
    for depth in range(first, length, WIDE):
        by_shard = np.argsort(interleave, kind="stable")
        symbols = np.empty(len(interleave), np.int32)
        symbols[by_shard] = before[taking_part(depth)]
        place = _distributed(symbols)
        interleave, block, symbols = interleave[place], block[place], symbols[place]
        split = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(np.concatenate([[False], split]), dtype=np.int32) if len(block) else block
    by_shard = np.argsort(interleave, kind="stable")
    whole = suffixes[taking_part(length)]
    interval = block[by_shard]
    occurs = np.bincount(interval, np.asarray(weights, float)[owner[whole]])
    found = np.zeros(len(data), bool)
    found[whole[occurs[interval] > 1]] = True
    return [found[b : b + w] for b, w in zip(begin.tolist(), windows.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def _pack(first: np.ndarray, windows: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return (first << 12) | (windows << 1) | inner


def _strings(docs: DataFrame, length: int) -> DataFrame:
    """(class, string's hash, document's key, place) of every string of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                out = [[], [], [], []]
                for key, data in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                    kind, first, windows, inner = strings_of(data, length)
                    out[0].append(kind)
                    hashes = [xxhash.xxh3_64_intdigest(data[a : a + n + length - 1]) for a, n in zip(first.tolist(), windows.tolist())]
                    out[1].append(np.array(hashes, np.uint64).view(np.int64))
                    out[2].append(np.full(len(kind), key))
                    out[3].append(_pack(first, windows, inner))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "string", "key", "place"])

    return docs.select("key", "body").mapInArrow(run, "kind long, string long, key long, place long")


def _bytes_of(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(class, string's hash, weight, bytes) of the strings that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                rows = [
                    (w["kind"], w["string"], w["weight"], data[w["place"] >> 12 :][: (w["place"] >> 1 & 0x7FF) + length - 1])
                    for data, wanted in zip(batch.column("body").to_pylist(), batch.column("wanted").to_pylist())
                    for w in wanted
                ]
                columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "string", "weight", "bytes"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("kind", "string", "weight", "place")).alias("wanted"))
    return docs.join(wanted, "key").select("body", "wanted").mapInArrow(run, "kind long, string long, weight long, bytes binary")


def _verdicts(strings: DataFrame, length: int) -> DataFrame:
    """(class, string's hash, start, windows): runs of repeated windows in each string."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Whole classes, several megabytes together; rows come in the order of classes and strings."""
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "string", "weight", "bytes"))):
                if row[:2] == last:
                    continue  # equal rows of the table gave the same string
                if held and row[0] != last[0] and size > BUCKET_BYTES:
                    yield held
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[:2]
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in buckets(batches):
            found = repeated_windows([r[3] for r in held], [r[2] for r in held], length)
            rows = [(r[0], r[1], start, n) for r, flags in zip(held, found) if flags.any() for start, n in runs(flags)]
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 4)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "string", "start", "windows"])

    ordered = strings.repartition("kind").sortWithinPartitions("kind", "string")
    return ordered.mapInArrow(run, "kind long, string long, start long, windows long")


def _verdicts_by_window(strings: DataFrame, length: int) -> DataFrame:
    """The same for classes too large for one task: each window meets its equals by a hash of 128 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, string, weight, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "string", "weight", "bytes"))):
                n = len(data) - length + 1
                hashes = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                same = [pa.array([x] * n, pa.int64()) for x in (kind, string, weight)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(range(n), pa.int64()), pa.array(hashes, pa.binary())],
                    ["kind", "string", "weight", "start", "window"],
                )

    rows = strings.dropDuplicates(["kind", "string"]).mapInArrow(
        cut, "kind long, string long, weight long, start long, window binary"
    )
    often = rows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    return rows.join(often, "window", "left_semi").select("kind", "string", "start", F.lit(1).cast("long").alias("windows"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(key, spans) of documents (key long, body binary): unsorted runs (start, size) of bytes in repeated strings."""
    every = Window.partitionBy("kind")
    counted = _strings(docs, length).select(
        "*", F.count("*").over(every).alias("n"), F.max(F.col("place").bitwiseAND(F.lit(1))).over(every).alias("inner"),
        (F.min("string").over(every) == F.max("string").over(every)).alias("alike"),
    )
    # where a class is one string that comes again, all its windows do: an interval of equal suffixes, with nothing to merge
    marked = counted.select("kind", "string", "key", "place", (F.col("alike") & (F.col("inner") == 0)).alias("alike"), "n", "inner")
    held = settle(marked.where("n > 1 OR inner = 1").drop("n", "inner"), "strings")
    live = held.where(~F.col("alike")).drop("alike")
    distinct = live.groupBy("kind", "string").agg(F.count("*").alias("weight"), F.min(F.struct("key", "place")).alias("one"))
    distinct = distinct.select("kind", "string", "weight", "one.key", "one.place")
    strings = settle(_bytes_of(distinct, docs, length), "string-bytes")
    large = strings.groupBy("kind").agg(F.sum(F.length("bytes")).alias("n")).where(F.col("n") > class_bytes).select("kind")
    large = settle(large, "large-classes")
    usual = _verdicts(strings.join(large, "kind", "left_anti"), length)
    judged = usual.union(_verdicts_by_window(strings.join(large, "kind", "left_semi"), length))
    spans = live.join(judged, ["kind", "string"]).select(
        "key", (F.shiftright("place", 12) + F.col("start")).alias("start"), (F.col("windows") + (length - 1)).alias("size")
    )
    whole = held.where("alike").select(
        "key", F.shiftright("place", 12).alias("start"),
        (F.shiftright("place", 1).bitwiseAND(F.lit(0x7FF)) + (length - 1)).alias("size"),
    )
    spans = spans.unionByName(whole)
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """(start, end) of maximal runs, in order."""
    found: list[list[int]] = []
    for start, end in sorted((s["start"], s["start"] + s["size"]) for s in spans or ()):
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)]))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters that they hold at their ends."""
    found = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            found.append((a, b))
    return found


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    key = F.xxhash64(F.col(id_col).cast("string"), text)
    return docs.withColumns({"key": key, "body": F.coalesce(F.col(text), F.lit("")).cast("binary")})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row.

    Every byte that a string of ``length`` bytes covers which starts anywhere else too, in any row, is removed. Null text is
    empty. Rows that repeat id and text are copies of each other, as are equal texts under other ids. Texts shorter than
    ``length`` stay as they are. Documents are told apart by a hash of 64 bits of id and text. An empty table gives
    an empty result.
    """
    plain = _keyed(docs.select(id_col, text), id_col, text).select(id_col, "key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                rows = []
                for data, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                    cut = merged(spans)
                    kept = without(data, cut)
                    rows.append((len(data), len(data) - len(kept), len(cut), sha256(kept), kept))
                columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, *names])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    found = plain.join(repeated_spans(plain.select("key", "body"), length), "key", "left").select(id_col, "body", "spans")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    return found.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, other columns as they are; characters are removed whole or stay."""
    packed_rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    keyed = _keyed(packed_rows, "id", "text")
    spans = repeated_spans(keyed.select("key", "body"), length)
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")  # taken behind the join, so that text travels once
    found = keyed.select("row", "key").join(spans, "key", "left").select("row", body.alias("body"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                kept = [
                    without(data, whole_characters(data, merged(spans))).decode()
                    for data, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    made = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, kept string")
    new = F.when(F.col(f"row.`{text}`").isNotNull(), F.col("kept"))
    return made.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
