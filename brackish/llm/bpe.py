"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

A piece of text is a row of byte symbols. The leaves of a segment tree hold the merge rank of each pair of neighbours,
every inner node the smaller of its children, so the root is the lowest rank and the way down to the left one its leftmost
place. A merge changes three leaves, and each is a walk to the root. It ends when the root holds no rank. Many pieces are
worked at once: the trees of pieces of like length are the rows of one array, and each step is a step of all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex

from .common import map_texts, sha256

NONE = np.int32(2**31 - 1)
SPECIAL_MARK = "<|"
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 500_000
CELLS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Ids and bytes of the tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.model, letters = held["model"], {ord(c): b for c, b in byte_alphabet().items()}
        self.ids: dict[bytes, int] = {t.translate(letters).encode("latin-1"): i for t, i in self.model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", ())}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}


class Vocabulary(Tokens):
    """Merges and ids of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        super().__init__(path)
        model, letters = self.__dict__.pop("model"), byte_alphabet()
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs, made = [], []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            left, right = (bytes(letters[c] for c in side) for side in (left, right))
            pairs.append(self.ids[left] << 20 | self.ids[right])
            made.append(self.ids[left + right])
        self.made = np.array(made, np.int64)
        self._index(np.array(pairs, np.int64))

    def _index(self, pairs: np.ndarray) -> None:
        """An open table of the pairs with few collisions: slot of a key, then the next ones."""
        self.bits = 19
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size + 64, -1, np.int64), np.full(size + 64, NONE, np.int32)
        self.reach = 0
        for rank, (key, slot) in enumerate(zip(pairs.tolist(), self._slot(pairs).tolist())):
            step = 0
            while self.keys[slot + step] != -1:
                step += 1
            self.keys[slot + step], self.ranks[slot + step] = key, rank
            self.reach = max(self.reach, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE if there is none or an end is missing (-1)."""
        keys = left << 20 | right
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.keys[slots] != -1))
        for step in range(1, self.reach + 1):
            if not len(open_):
                break
            at = slots[open_] + step
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return np.where((left < 0) | (right < 0), NONE, found)


def _merge_all(voc: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merges until no row has a mergeable pair. symbols: ids (rows, width), -1 behind the end, width a power of two.

    Merged-away places become -1, each remaining symbol stays at the place of its first byte.
    """
    count, width = symbols.shape
    after = np.tile(np.arange(1, width + 1), (count, 1))  # next place that holds a symbol; width: none
    before = np.tile(np.arange(-1, width - 1), (count, 1))
    tree = np.full((count, 2 * width), NONE, np.int32)
    if width > 1:
        tree[:, width : 2 * width - 1] = voc.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(count, -1)
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    flat, symbol, after, before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        root, place = row * (2 * width), row * width
        best, node, step = flat[root + 1], root + 1, 1
        while step < width:  # to the left child if it holds the lowest rank too
            node = node + (node - root)
            node += flat[node] != best
            step *= 2
        at = node - root - width
        gone = after[place + at]
        last = after[place + gone]
        new = voc.made[best]
        symbol[place + at], symbol[place + gone], after[place + at] = new, -1, last
        inside = np.flatnonzero(last < width)
        before[place[inside] + last[inside]] = at[inside]
        right = np.full(len(row), -1)
        right[inside] = symbol[place[inside] + last[inside]]
        first = before[place + at]
        has = np.flatnonzero(first >= 0)
        left = symbol[place[has] + first[has]]
        both = voc.rank(np.concatenate([new, left]), np.concatenate([right, new[has]]))
        _update(flat, root, gone + width, NONE)
        _update(flat, root, at + width, both[: len(row)])
        _update(flat, root[has], first[has] + width, both[len(row) :])
        row = row[flat[root + 1] != NONE]
    return symbols


def _update(tree: np.ndarray, root: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int32) -> None:
    """Point updates: the leaves, then every node on their ways to the root."""
    tree[root + leaf] = value
    if not len(root):
        return
    while leaf[0] > 1:
        leaf = leaf >> 1
        node = root + 2 * leaf
        tree[root + leaf] = np.minimum(tree[node], tree[node + 1])


def merge_pieces(voc: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece; no merge crosses a piece's end."""
    found: list[list[int]] = [[] for _ in pieces]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    widths = np.array([max(1, 1 << (n - 1).bit_length()) for n in lengths.tolist()], np.int64)
    for width in np.unique(widths[lengths > 0]).tolist():
        here = np.flatnonzero((widths == width) & (lengths > 0))
        step = max(1, CELLS // (4 * width))
        for start in range(0, len(here), step):
            some = here[start : start + step]
            data = np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)
            inside = np.arange(width) < lengths[some][:, None]
            symbols = np.full((len(some), width), -1, np.int64)
            symbols[inside] = voc.of_byte[data]
            symbols = _merge_all(voc, symbols)
            left = symbols >= 0
            ids, begin = symbols[left].tolist(), 0
            for i, end in zip(some.tolist(), np.cumsum(left.sum(axis=1)).tolist()):
                found[i] = ids[begin:end]
                begin = end
    return found


class Encoder:
    """Texts to ids and back. What words have become is held in a table that is emptied when it is full.

    A single space between two characters that are no white space always begins a piece. A text is therefore cut there
    into words, and each distinct word is cut into pieces and merged once. Texts with other spaces, or with special
    tokens, are cut into pieces as a whole.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.voc, self.entries = Vocabulary(path), entries
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.voc.special)) if self.voc.special else None
        self.names = {i: str(i) for i in self.voc.bytes}
        self.words: dict[str, tuple | None] = {}  # without the space before them; None: ends in white space

    def pieces(self, text: str) -> list[str]:
        """Pieces of the text between special tokens, and those tokens, each by itself."""
        if self.cut is None or not any(s in text for s in self.voc.special):
            return self.pattern.findall(text)
        parts = [p for p in self.cut.splititer(text) if p]
        return [x for p in parts for x in ([p] if p in self.voc.special else self.pattern.findall(p))]

    def encoded(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text, of its parts in order: ids (joined by commas), their number, the bytes that they decode to."""
        cut = [t.split(" ") for t in texts]
        new = {w for c in cut for w in c[1:] if w not in self.words}
        if len(self.words) + len(new) > self.entries:
            self.words.clear()
            new = set().union(*(c[1:] for c in cut))
        usable = [w for w in new if w and not w[0].isspace() and not w[-1].isspace() and SPECIAL_MARK not in w]
        self.words.update(dict.fromkeys(new))
        self.words.update(zip(usable, self._merged([self.pattern.findall(" " + w) for w in usable])))
        found: list[list | None] = []
        whole = []
        for text, (first, *rest) in zip(texts, cut):
            parts = list(map(self.words.__getitem__, rest))
            plain = None not in parts and SPECIAL_MARK not in first and not (first and rest and first[-1].isspace())
            found.append(parts if plain else None)
            whole.append(self.pattern.findall(first) if plain else self.pieces(text))
        for parts, head in zip(found, self._merged(whole)):
            yield [head, *(parts or ())]

    def _merged(self, cut: list[list[str]]) -> list[tuple[str, int, bytes]]:
        """Of each run of pieces: ids, their number and bytes; every distinct piece is merged once."""
        distinct = list(set().union(*cut))
        ids = merge_pieces(self.voc, [b"" if p in self.voc.special else p.encode() for p in distinct])
        of = dict(zip(distinct, ids)) | {p: [i] for p, i in self.voc.special.items()}
        name, token = self.names.__getitem__, self.voc.bytes.__getitem__
        rows = []
        for run in cut:
            got = of[run[0]] if len(run) == 1 else [i for p in run for i in of[p]]
            rows.append((",".join(map(name, got)), len(got), b"".join(map(token, got))))
        return rows

    def encode(self, text: str) -> list[int]:
        found = next(self.encoded([text]))
        return [int(i) for joined, n, _ in found if n for i in joined.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not UTF-8 become the replacement character, ids that do not exist nothing."""
        return b"".join(self.voc.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def encode_documents(docs, path: str, keep: list[str], text: str = "text", with_ids: bool = False):
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 for every row, and with ``with_ids`` the ids and decoded text.

    Null text counts as empty: no tokens, digests of nothing. ``path`` is the vocabulary file, which every executor must
    reach (or ship with ``spark.files``).
    """
    held: list[Encoder] = []

    def work(texts: list[str]) -> list[dict]:
        if not held:
            held.append(Encoder(path))
        rows = []
        for found in held[0].encoded(texts):
            ids = ",".join([f[0] for f in found if f[1]])
            decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace")
            row = {"n_tokens": sum(f[1] for f in found), "ids_sha256": sha256(ids.encode()),
                   "decoded_sha256": sha256(decoded.encode())}
            rows.append(row | ({"ids": ids, "decoded": decoded} if with_ids else {}))
        return rows

    more = ", ids string, decoded string" if with_ids else ""
    return map_texts(docs, keep, text, work, "n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
