"""Spelling variants: words that differ by one code point meet in a trie of letter-group counts.

Letters fall into groups. A word is the row of how many of its letters each group has, and a level of the trie is one such
count. Inserting, deleting or replacing one letter changes at most one count by +1 and one by -1, so a search goes down the trie
with a budget of one surplus and one deficit; of each pair the word that is first behind is the one that searches, so it spends
the surplus before the deficit and finds every pair once. Leaves hold words with equal counts, which are compared letter by letter.

The top levels are dealt to tasks: a node is a row key, every word is a member of its own node and a probe in the nodes it
may reach. A node that is still too large goes a level deeper, members to one child, probes to at most three, until all
nodes are small; words whose counts all agree are told apart by their halves, of which one edit leaves one alike. Members
of a node are held in the task, probes pass by in blocks, and a block is searched depth first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

RUN = re.compile("[a-zÀ-ÿ]{7,}")  # after A-Z have become a-z; shorter runs cannot become words
LEAST_LENGTH, LEAST_COUNT = 7, 2
DELETED, TIMES = 31, 10

GROUPS = 11  # a letter's group is its code point's remainder
TOP = 4
NODE_MEMBERS, NODE_PROBES = 20_000, 400_000
BLOCK = 1 << 16
WIDTH = 32  # longer words are compared one by one
HELD_WORDS = 200_000

FIRST, AHEAD, BOTH = 0, 1, 2  # nothing spent; surplus spent; both spent
MEMBER = -1


def runs(text: str, id_text: str) -> Iterator[tuple[str, int]]:
    """Words of a text, each with how often: runs of letters, one letter deleted where the checksum says so."""
    start = zlib.crc32(f"{id_text}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that occur at least twice over all rows of ``docs``.

    Null texts have none; a null id counts as an empty one; rows that repeat count each. A task sums what it has seen and
    hands it on whenever it holds ``HELD_WORDS`` words, and the sums are combined before they move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "__text"):
                for name, body in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist()):
                    for word, n in runs(body or "", name or ""):
                        held[word] += n
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    source = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text).cast("string").alias("__text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def counts(found: list[bytes]) -> np.ndarray:
    """Rows of the letters of each group, for words in Latin-1."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    of = np.repeat(np.arange(len(found)), sizes) * GROUPS + np.frombuffer(b"".join(found), np.uint8) % GROUPS
    return np.bincount(of, minlength=len(found) * GROUPS).reshape(-1, GROUPS)


def steps(own: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The children a search may enter: places in the input, the child's count, the state behind it."""
    for spent, change, then in ((None, 0, None), (FIRST, 1, AHEAD), (AHEAD, -1, BOTH)):
        at = np.arange(len(own)) if spent is None else np.flatnonzero((state == spent) & (own + change >= 0))
        yield at, own[at] + change, state[at] if then is None else np.full(len(at), then, state.dtype)


def halves(word: str, longer: bool) -> tuple[str, str]:
    """Keys of a word for comparison with words as long, or with words that are one shorter (``longer``).

    After one edit, either what is before the middle of the shorter word is alike or what is behind it.
    """
    middle = (len(word) - longer) // 2
    kind = "+" if longer else "="
    return f"{kind}P{word[:middle]}", f"{kind}S{word[middle + longer :]}"


def _rows(table: list[tuple]) -> pa.RecordBatch:
    node, word, n, state = table
    arrays = [pa.array(node, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(state, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["node", "word", "n", "state"])


ROWS = "node string, word string, n long, state int"


def enter(found: DataFrame, depth: int = TOP) -> DataFrame:
    """Every word of (word, n) as a member of its node at ``depth`` and as a probe in each node it may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                vectors = counts([w.encode("latin-1") for w in text])
                start = np.arange(len(text))
                own = [",".join(map(str, row)) for row in vectors[:, :depth].tolist()]
                yield _rows((own, text, n, np.full(len(text), MEMBER)))
                at, state, nodes = start, np.zeros(len(text), np.int32), [""] * len(text)
                for level in range(depth):
                    at, state, nodes = _deeper(vectors, level, at, state, nodes)
                yield _rows((nodes, [text[i] for i in at.tolist()], n[at], state))

    return found.select("word", "n").mapInArrow(run, ROWS)


def _deeper(vectors: np.ndarray, level: int, at: np.ndarray, state: np.ndarray, nodes: list[str]) -> tuple:
    """Searches one level down: word, state and node of each."""
    entered = list(steps(vectors[at, level], state))
    separator = "," if level else ""
    names = [nodes[i] + separator + str(c) for places, child, _ in entered for i, c in zip(places.tolist(), child.tolist())]
    return np.concatenate([at[p] for p, _, _ in entered]), np.concatenate([s for _, _, s in entered]), names


def descend(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of nodes at ``depth`` a level deeper; below the last count, by the halves of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                state, nodes = batch.column("state").to_numpy(), batch.column("node").to_pylist()
                if depth == GROUPS:
                    out: list[tuple] = []
                    for node, word, count, s in zip(nodes, text, n.tolist(), state.tolist()):
                        if s == MEMBER:
                            keys = (*halves(word, False), *halves(word, True))
                        else:  # the words that a search ahead looks for are one longer than its own
                            keys = halves(word, False)
                            keys = tuple("+" + k[1:] for k in keys) if s == AHEAD else keys
                        out += [(f"{node};{k}", word, count, s) for k in keys]
                    yield _rows(list(zip(*out)) if out else [(), (), (), ()])
                    continue
                vectors = counts([w.encode("latin-1") for w in text])
                own = np.flatnonzero(state == MEMBER)
                kept = [f"{nodes[i]},{c}" for i, c in zip(own.tolist(), vectors[own, depth].tolist())]
                yield _rows((kept, [text[i] for i in own.tolist()], n[own], state[own]))
                at = np.flatnonzero(state != MEMBER)
                at, moved, names = _deeper(vectors, depth, at, state[at], [nodes[i] for i in at.tolist()])
                yield _rows((names, [text[i] for i in at.tolist()], n[at], moved))

    return rows.select("node", "word", "n", "state").mapInArrow(run, ROWS)


class Trie:
    """The members of some nodes from ``depth`` on: for each level the children's keys in order, at the end the words of a leaf.

    The words of a leaf are found by leaf and half. Below the last count a node has one half in common, and the leaf is all.
    """

    def __init__(self, nodes: list[str], text: list[str], n: np.ndarray, depth: int):
        self.roots = {node: i for i, node in enumerate(dict.fromkeys(nodes))}
        self.text, self.n, self.by_half = text, n, depth <= GROUPS
        found = [w.encode("latin-1") for w in text]
        vectors = counts(found)
        here = np.fromiter((self.roots[x] for x in nodes), np.int64, len(nodes))
        self.base = int(vectors.max(initial=0)) + 3
        self.levels: list[np.ndarray] = []
        for level in range(depth, GROUPS):
            keys, here = np.unique(here * self.base + vectors[:, level] + 1, return_inverse=True)
            self.levels.append(keys)
        self.letters, self.sizes = _letters(found)
        member = np.arange(len(text))
        if self.by_half:
            own = [_half_keys(found, self.sizes, here, longer) for longer in (False, True)]
            here, member = np.concatenate([k for pair in own for k in pair]), np.tile(member, 4)
        order = np.argsort(here, kind="stable")
        self.keys, self.member = here[order], member[order]

    def search(self, nodes: list[str], text: list[str], state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, member) places of all pairs that differ by one letter, in blocks."""
        found = [w.encode("latin-1") for w in text]
        vectors, (letters, sizes) = counts(found), _letters(found)
        root = np.fromiter((self.roots.get(x, -1) for x in nodes), np.int64, len(nodes))
        probe = np.flatnonzero(root >= 0)
        stack = [(0, probe, root[probe], state[probe])]
        while stack:
            level, probe, here, spent = stack.pop()
            if len(probe) > BLOCK:
                middle = len(probe) // 2
                stack += [(level, probe[s], here[s], spent[s]) for s in (slice(0, middle), slice(middle, None))]
                continue
            if level < len(self.levels):
                keys, reached = self.levels[level], []
                for at, child, then in steps(vectors[probe, level + GROUPS - len(self.levels)], spent):
                    wanted = here[at] * self.base + child + 1
                    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[place] == wanted
                    reached.append((probe[at[hit]], place[hit], then[hit]))
                stack.append((level + 1, *(np.concatenate(x) for x in zip(*reached))))
                continue
            kind = np.zeros(len(probe), np.int64)
            if self.by_half:
                words = [found[i] for i in probe.tolist()]
                first, second = _half_keys(words, sizes[probe], here, False)
                here = np.concatenate([first, second]) + np.tile(np.where(spent == AHEAD, _LONGER, 0), 2)
                kind = np.repeat([0, 1], len(probe))
                probe, spent = np.tile(probe, 2), np.tile(spent, 2)
            low, high = np.searchsorted(self.keys, here), np.searchsorted(self.keys, here, side="right")
            many = high - low
            cuts = np.searchsorted(np.cumsum(many), np.arange(BLOCK, int(many.sum()), BLOCK))
            for part in np.split(np.arange(len(probe)), cuts):
                times = many[part]
                if not times.any():
                    continue
                left = np.repeat(probe[part], times)
                right = self.member[np.arange(len(left)) + np.repeat(low[part] - np.cumsum(times) + times, times)]
                same = self._verified(text, letters, sizes, left, np.repeat(spent[part], times), right, np.repeat(kind[part], times))
                yield left[same], right[same]

    def _verified(self, text, letters, sizes, left, spent, right, kind) -> np.ndarray:
        """Places of the pairs that one edit tells apart, each pair once.

        Of two words that are equal in counts the smaller one counts as the one that searches. A pair that is alike in both halves
        counts where its first half was looked up.
        """
        letters, sizes, others, other_sizes = letters[left], sizes[left], self.letters[right], self.sizes[right]
        short = (sizes <= WIDTH) & (other_sizes <= WIDTH)
        differ = letters != others
        signed = (letters.astype(np.int16) - others).sum(axis=1)
        equal_length = (spent != AHEAD) & (differ.sum(axis=1) == 1) & ((spent == BOTH) | (signed < 0))
        before = np.argmax(differ, axis=1)
        shifted = (letters[:, :-1] == others[:, 1:]) | (np.arange(WIDTH) < before[:, None])
        inserted = (spent == AHEAD) & (other_sizes == sizes + 1) & shifted.all(axis=1)
        good = short & (equal_length | inserted)
        if self.by_half:
            good &= (before >= sizes // 2) == (kind == 0)
        for i in np.flatnonzero(~short).tolist():
            a, b = text[left[i]], self.text[right[i]]
            good[i] = one_edit(a, b) and (spent[i] != FIRST or a < b)
            if self.by_half:
                good[i] &= (a[: len(a) // 2] == b[: len(a) // 2]) == (kind[i] == 0)
        return np.flatnonzero(good)


_LONGER = 1 << 33  # bits above a half's checksum: second half, word one longer, and then the leaf


def _half_keys(found: list[bytes], sizes: np.ndarray, leaf: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and second halves (see ``halves``) in their leaves; other halves may share one."""
    middle = ((sizes - longer) // 2).tolist()
    first = np.fromiter((zlib.crc32(w[:m]) for w, m in zip(found, middle)), np.int64, len(found))
    second = np.fromiter((zlib.crc32(w[m + longer :]) for w, m in zip(found, middle)), np.int64, len(found))
    base = (leaf << 34) + (_LONGER if longer else 0)
    return base + first, base + (1 << 32) + second


def _letters(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word in a row of WIDTH + 1, zeros behind; what is longer is cut and told by its size."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    padded = b"".join([w[: WIDTH + 1].ljust(WIDTH + 1, b"\0") for w in found])
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH + 1), sizes


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def search(rows: DataFrame, depth: int) -> DataFrame:
    """(word, near, near_n) in both directions, from members and probes of nodes at ``depth``."""

    def work(nodes, text, n, state) -> Iterator[pa.RecordBatch]:
        counted, states = np.array(n, np.int64), np.array(state, np.int32)
        own = np.flatnonzero(states == MEMBER).tolist()
        if not own:
            return
        trie = Trie([nodes[i] for i in own], [text[i] for i in own], counted[own], depth)
        probes = np.flatnonzero(states != MEMBER)
        asked = [text[i] for i in probes.tolist()]
        where = [nodes[i] for i in probes.tolist()]
        for left, right in trie.search(where, asked, states[probes]):
            if depth > GROUPS:  # a pair may agree in both halves if a letter is inserted in the middle
                once = [_first_half(where[i], asked[i], trie.text[j]) for i, j in zip(left.tolist(), right.tolist())]
                left, right = left[once], right[once]
            a, b = [asked[i] for i in left.tolist()], [trie.text[j] for j in right.tolist()]
            near_n = np.concatenate([trie.n[right], counted[probes[left]]])
            arrays = [pa.array([*a, *b], pa.string()), pa.array([*b, *a], pa.string()), pa.array(near_n)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [[], [], [], []], 0
        for whole in batches:
            for kept, column in zip(held, ("node", "word", "n", "state")):
                kept.extend(whole.column(column).to_pylist())
            fresh += whole.num_rows
            if fresh < BLOCK:
                continue
            yield from work(*held)
            fresh = 0
            # a node's members come before its probes, more of which may follow
            last = held[0][-1]
            stay = [i for i in range(held[0].index(last), len(held[0])) if held[3][i] == MEMBER]
            held = [[column[i] for i in stay] for column in held]
        if held[0]:
            yield from work(*held)

    dealt = rows.repartition("node").sortWithinPartitions("node", "state")
    return dealt.select("node", "word", "n", "state").mapInArrow(run, "word string, near string, near_n long")


def _first_half(node: str, shorter: str, longer: str) -> bool:
    """Whether the pair belongs to this key: to the one of the first half if that is alike."""
    if node.rpartition(";")[2][1] == "P":
        return True
    middle = min(len(shorter), len(longer)) // 2
    return shorter[:middle] != longer[:middle]


def near_words(found: DataFrame, members: int = NODE_MEMBERS, probes: int = NODE_PROBES, top: int = TOP) -> DataFrame:
    """(word, near, near_n): every two words of ``found`` (word, n; distinct) that one edit tells apart, in both directions."""
    rows, depth, parts = settle(enter(found, top), "trie"), top, []
    while True:
        load = rows.groupBy("node").agg(
            F.count(F.when(F.col("state") == MEMBER, 1)).alias("members"), F.count(F.when(F.col("state") != MEMBER, 1)).alias("probes")
        )
        large = load.where((F.col("members") > members) | (F.col("probes") > probes) & (F.col("members") > 0)).select("node")
        large = settle(large, "large-nodes") if depth <= GROUPS else None
        if large is None or large.isEmpty():
            parts.append(search(rows, depth))
            break
        parts.append(search(rows.join(large, "node", "left_anti"), depth))
        rows = settle(descend(rows.join(large, "node", "left_semi"), depth), "trie")
        depth += 1
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.union(more)
    return pairs


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps of ``forms`` (word, form), which never return, end. Each round doubles the steps taken."""
    reached = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = settle(reached.join(ahead, "root", "left"), "roots")
        moved = not joined.where("next IS NOT NULL").isEmpty()
        reached = joined.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` the word's own,
    else null. Nulls, ids and repeated rows count as in ``words``; other columns do not matter; a table without words gives
    an empty result. Words may be of any length.
    """
    found = settle(words(docs, id_col, text), "words")
    pairs = near_words(found)
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top")
    )
    joined = found.join(best, "word", "left")
    enough = -F.col("top.less") >= F.lit(times) * F.col("n")
    named = settle(
        joined.select(
            "word", F.when(enough, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("top.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
