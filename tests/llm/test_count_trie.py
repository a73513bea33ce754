"""Spelling variants against wildcard patterns in plain Python, at all depths of the trie, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from brackish.llm import count_trie
from brackish.llm.queries import op12_count_trie

SF = "/root/testdata/sf0.001"


def _words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def _near(words):
    """Words that share a pattern: one letter as a wildcard, or one letter more than the other."""
    patterns, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            patterns[w[:i] + "?" + w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for held in patterns.values():
        for w in held:
            near[w] |= held - {w}
    return near


def _expected(words):
    near, rows = _near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        rows[w] = best if best is not None and words[best] >= 10 * n else None
    table = set()
    for w, n in words.items():
        root = w
        while rows[root] is not None:
            root = rows[root]
        form = rows[w]
        table.add((w, form, root, n, len(near[w]), None if form is None else words[form]))
    return table


def _got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = _expected(_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert any(r[1] for r in expected) and sum(r[4] for r in expected) > 100
    assert _got(op12_count_trie(spark, SF)) == expected


@pytest.fixture(scope="module")
def invented():
    """Words over few letters, so that many are anagrams and differ by one letter, some of them long."""
    rnd, words = random.Random(5), {}
    while len(words) < 700:
        w = "".join(rnd.choice("abél") for _ in range(rnd.choice([7, 7, 8])))
        words[w] = rnd.randint(2, 90)
    base = "".join(rnd.choice("abcdefghijk") for _ in range(60))
    for w in (base, base[:30] + base[31:], base[:59] + "z", base + "k", "x" + base, base[:32], base[:33], base[:31] + "q"):
        words[w] = rnd.randint(2, 90)
    return words


@pytest.mark.parametrize("limits", [(20_000, 400_000, 4), (40, 300, 2), (1, 1, 1), (3, 10_000, 11)])
def test_nodes_of_any_depth_find_each_pair_once(spark, invented, limits):
    table = spark.createDataFrame(list(invented.items()), "word string, n long")
    members, probes, top = limits
    pairs = [(r.word, r.near, r.near_n) for r in count_trie.near_words(table, members, probes, top).collect()]
    expected = {(w, v, invented[v]) for w, held in _near(invented).items() for v in held}
    assert len(pairs) == len(expected) and set(pairs) == expected


def test_one_edit():
    for a, b, same in (("abc", "abc", False), ("abc", "abd", True), ("abc", "abcd", True), ("bc", "abc", True), ("ab", "ba", False),
                       ("abc", "abcde", False), ("aab", "ab", True), ("", "a", True), ("acb", "abc", False)):
        assert count_trie.one_edit(a, b) == count_trie.one_edit(b, a) == same


def test_chains_end_at_their_roots(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(19)] + [("a", "w07"), ("b", "c")]
    got = {r.word: r.root for r in count_trie.follow(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: ("c" if w == "b" else "w19") for w, _ in forms}


def test_odd_rows(spark):
    long = "y" * 3_000
    hub = "hubwords"
    rows = [(1, "Éclairée éclairée ÉCLAIRÉE", 1, "x", None), (None, "nothing nothing nowhere", None, None, None), (None, None, None, None, None)]
    rows += [(2, "", 1, "x", "a"), (3, None, 1, "x", "a"), (4, f"{long} {long} {long}x {long}x short", 1, "x", "a")]
    rows += [(5, "Repeated repeated", 1, "x", "a")] * 3 + [(6, "÷÷÷÷÷÷÷ ××××××× don't-split_words splitwords", 2, "k", "b")] * 2
    rows += [(10 + i, " ".join([hub] * 12 + [hub[:-1] + c for c in "abcdefgh"] * (i % 3)), 1, "n", "m") for i in range(40)]
    schema = "doc_id long, text string, n long, word string, near string"
    docs = spark.createDataFrame(rows, schema)
    assert _got(count_trie.variants(docs)) == _expected(_words([(r[0], r[1]) for r in rows]))
    assert count_trie.variants(spark.createDataFrame([], schema)).count() == 0
    assert count_trie.variants(spark.createDataFrame([(1, "few short words", 1, "", "")], schema)).count() == 0
