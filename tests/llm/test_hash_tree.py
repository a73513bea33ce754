"""Shards against the same draws in plain Python, laws of movement, odd tables."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from brackish.llm import hash_tree
from brackish.llm.hash_tree import Shard
from brackish.llm.queries import op11_hash_tree

SF = "/root/testdata/sf0.001"
LONG = "ż" * 400_000


def _draw(doc, child, weight):
    seed = 42 if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
    return -math.log(((xxhash.xxh64_intdigest(child.encode(), seed) >> 11) + 0.5) / 2**53) / weight


def _shard(doc, shards):
    """Three draws, each over nodes whose weight is the sum of the shards below."""
    left = [s for s in shards if s.weight]
    for name in (lambda s: s.region, lambda s: s.rack, lambda s: str(s.number)):
        weight = defaultdict(float)
        for s in left:
            weight[name(s)] += s.weight
        best = min(weight, key=lambda c: (_draw(doc, c, weight[c]), c))
        left = [s for s in left if name(s) == best]
    return left[0].number


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def _placed(spark, shards, n=3000):
    return {r.doc_id: r for r in hash_tree.place(_ids(spark, n), shards).collect()}


def test_query_against_plain_draws(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_hash_tree(spark, SF).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.shard == _shard(r.doc_id, hash_tree.grown(40)) and r.grown_shard in (r.shard, 40)
        assert r.grown_shard == _shard(r.doc_id, hash_tree.grown(41))
        slots[r.shard].append((r.slot, r.doc_id))
    for held in slots.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held))) and [d for _, d in held] == sorted(d for _, d in held)


@pytest.mark.parametrize("count", [1, 3, 17, 40, 41, 52])
def test_growth_moves_rows_only_into_the_new_region(spark, count):
    if not any(s.region.startswith("x") for s in hash_tree.grown(count + 1)):
        old = hash_tree.grown(count)
        new = [*old, Shard(count, f"x{count}", f"x{count}k0")]
    else:
        old, new = hash_tree.grown(count), hash_tree.grown(count + 1)
    before, after = _placed(spark, old), _placed(spark, new)
    moved = [i for i in before if before[i].shard != after[i].shard]
    assert moved and {after[i].shard for i in moved} == {count}
    assert abs(len(moved) - 3000 / (count + 1)) < 6 * math.sqrt(3000 / (count + 1))


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    old = hash_tree.grown(40)
    heavy = [Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in old]  # in rack r0k1 of region r0
    before, after = _placed(spark, old), _placed(spark, heavy)
    moved = [i for i in before if before[i].shard != after[i].shard]
    assert moved
    for i in moved:
        a, b = before[i], after[i]
        assert b.shard_region == "r0"
        if a.shard_region == "r0":
            assert b.shard_rack == "r0k1"
            if a.shard_rack == "r0k1":
                assert b.shard == 5


def test_shares_follow_the_weights(spark):
    shards = [Shard(0, "a", "a0", 1), Shard(1, "a", "a0", 2), Shard(2, "a", "a1", 3), Shard(3, "b", "b0", 6), Shard(4, "b", "b0", 0)]
    got = Counter(r.shard for r in _placed(spark, shards, 12000).values())
    assert 4 not in got
    for s in shards[:4]:
        assert abs(got[s.number] - 1000 * s.weight) < 5 * math.sqrt(1000 * s.weight)


def test_trees_that_are_refused():
    for bad in ([], [Shard(0, "a", "k", 0)], [Shard(0, "a", "k"), Shard(0, "a", "k")], [Shard(0, "a", "k"), Shard(1, "b", "k")],
                [Shard(0, "a", "k", -1)]):
        with pytest.raises(ValueError):
            hash_tree.children(bad)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a", 7, "x"), (1, "a", 7, "x"), (None, None, None, None), (None, "", 1, "y"), (2, None, 3, "z"), (3, LONG, 3, "z")]
    rows += [(9, "copy", 1, "k")] * 50
    schema = "doc_id long, text string, shard int, number string"
    docs = spark.createDataFrame(rows, schema)
    got = hash_tree.sharded(docs, 4).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got if r.doc_id in (2, 3, None)) == [16, 16, 16, 800_016]
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    placed = hash_tree.place(docs, hash_tree.grown(4))
    assert placed.columns == [*docs.columns, "shard_region", "shard_rack"] and placed.count() == len(rows)
    hash_tree.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}
    assert hash_tree.sharded(spark.createDataFrame([], schema), 4).count() == 0
    words = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string").selectExpr("*", "'t' AS text")
    assert hash_tree.sharded(words, 4).count() == 3
