"""Alignments against both libraries' tokens and all pairs in plain Python, on the tables and on odd texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
import sentencepiece
from tokenizers import Tokenizer

from brackish.llm import alignment
from brackish.llm.bpe import byte_alphabet
from brackish.llm.queries import op13_alignment, vocabulary

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = vocabulary(), vocabulary("piece_bpe_32k.model")


def _expected(texts):
    """Rows in the order of ``texts``: groups by merging both rows of ends, then counts over all documents."""
    first = Tokenizer.from_file(A_FILE)
    first.encode_special_tokens = True
    second, letters = sentencepiece.SentencePieceProcessor(model_file=B_FILE), byte_alphabet()
    shown, documents = [], Counter()
    for text in texts:
        data, groups = b" " + (text or "").encode(), []
        if text:
            a = first.encode(" " + text, add_special_tokens=False)
            a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
            b = second.encode(text)
            pieces = [second.id_to_piece(i) for i in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(a_bytes) == b"".join(b_bytes) == data:
                a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
                shared = set(a_ends) & set(b_ends)
                for ids, ends, side in ((a.ids, a_ends, 0), (b, b_ends, 1)):
                    at = 0
                    for i, end in zip(ids, ends):
                        if len(groups) <= at:
                            groups.append(([], []))
                        groups[at][side].append(i)
                        at += end in shared
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        documents.update(links.keys())
        shown.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    rows = []
    for groups, links in shown:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if documents[p] == best[p[0]]), sum(n * documents[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return rows


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = dict(zip([r.doc_id for r in docs], _expected([r.text for r in docs])))
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in op13_alignment(spark, SF).collect()}
    assert got == expected and sum(r[2] for r in expected.values()) > 1000


ODD = [
    "plain words here and words there", "  two  spaces\tand\n\nlines ", "<|endoftext|> and </s> <s> are text", "▁mark", "", None,
    "日本語のテキスト 混ぜた text 🙂🙂 naïve ﬁne ½", "a\x00b\r\n", " ", "\n", "x" * 3000, "word " * 20_000, "no-space" * 2000, "1234567890 12,345.67",
    "plain words here and words there", "é" * 500 + " " + "́" * 50, "    ﻿x", "ab�c \U0010ffff",
]


@pytest.mark.parametrize("common", [100_000, 5, 0])
def test_odd_texts(spark, common):
    rows = [(i, t, 7, "k", 1) for i, t in enumerate(ODD)] + [(3, ODD[0], None, None, None), (None, ODD[0], 1, "x", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, n long, key string, row long"
    got = alignment.align(spark.createDataFrame(rows, schema), A_FILE, B_FILE, with_groups=True, common=common)
    found = Counter((r.doc_id, *(r[c] for c in FIELDS)) for r in got.collect())
    assert found == Counter((r[0], *e) for r, e in zip(rows, _expected([r[1] for r in rows])))
    for r in got.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    if common:
        assert alignment.align(spark.createDataFrame([], schema), A_FILE, B_FILE).count() == 0


def _pairs(windows):
    pairs, times = alignment.linked_pairs(windows)
    assert pairs.tolist() == sorted(set(pairs.tolist()))
    return dict(zip(pairs.tolist(), times.tolist()))


def test_windows_are_held_up_to_a_number_and_found_again():
    small, large = alignment.Aligner(A_FILE, B_FILE, held=3), alignment.Aligner(A_FILE, B_FILE)
    texts = ["some words that differ", "some other words", "words", "some words that differ"] * 3
    for x, y in zip(small.align(texts), large.align(texts)):
        assert x[:2] == y[:2] and [w.text for w in x[2]] == [w.text for w in y[2]]
        assert _pairs(x[2]) == _pairs(y[2])
    assert len(small.windows) <= 3 + 4
    again = list(large.align(texts[:1]))[0][2]
    assert all(any(w is held for held in large.windows.values()) for w in again)


def test_window_of_many_repeats():
    names = list(map(str, range(10)))
    made = lambda a, b, a_sizes, b_sizes: alignment.Window(a, b, a_sizes, b_sizes, names, names)
    single = made([1, 2] * 50, [3] * 100, [1] * 99 + [2], [1] * 99 + [2])
    assert (single.groups, single.links) == (100, 100)
    assert _pairs([single, single]) == {1 << alignment.B_BITS | 3: 100, 2 << alignment.B_BITS | 3: 100}
    crossed = made([7] * 50 + [8], [9] * 33 + [4] * 17 + [5], [2] * 50 + [1], [1] + [2] * 50)
    assert (crossed.groups, crossed.links) == (1, 51 * 51)
    found = _pairs([crossed, single])
    assert found[7 << alignment.B_BITS | 9] == 50 * 33 and found[8 << alignment.B_BITS | 5] == 1 and found[1 << alignment.B_BITS | 3] == 50


def test_windows_hold_their_pairs_ready_to_be_counted():
    aligner = alignment.Aligner(A_FILE, B_FILE)
    for _, _, windows in aligner.align(["Some words, 1234567 qzxv  jkwpq", "x", "é ▁a  b", ""]):
        for w in windows:
            assert [int.from_bytes(w.packed[n : n + 8], "little") for n in range(0, len(w.packed), 8)] == list(w.pairs)
            left, right = zip(*((g.split("|")) for g in w.text.split(";")))
            assert w.links == sum((x.count(",") + 1) * (y.count(",") + 1) for x, y in zip(left, right)) == len(w.pairs)


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_new_windows_of_many_texts_are_made_together(monkeypatch, most):
    calls, whole = [], alignment.alignments

    def counted(a, *rest):
        calls.append(len(a))
        return whole(a, *rest)

    texts = [f"{t} and x{n}y zq{n * 7919}w" for n in range(40) for t in (ODD[0], ODD[2], ODD[6], ODD[13], ODD[15])] + ["", "▁mark", ODD[12]]
    one_by_one = alignment.Aligner(A_FILE, B_FILE)
    expected = [next(one_by_one.align([t])) for t in texts]
    monkeypatch.setattr(alignment, "alignments", counted)
    monkeypatch.setattr(alignment, "MADE", most)
    aligner = alignment.Aligner(A_FILE, B_FILE)
    found = list(aligner.align(texts))
    assert len(calls) == 1 if most > 100 else len(calls) > 10
    assert not aligner.windows.new and len(aligner.windows) > 80
    for x, y in zip(found, expected, strict=True):
        assert x[:2] == y[:2] and [(w.groups, w.links, w.many, w.packed, w.text) for w in x[2]] == [(w.groups, w.links, w.many, w.packed, w.text) for w in y[2]]
    calls.clear()
    assert list(aligner.align(texts)) == found and not calls  # the same windows, none made again
