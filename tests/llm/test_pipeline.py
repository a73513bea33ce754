"""The stages one by one, each held against the operator's contract on what the stage before it kept."""

from __future__ import annotations

import re

import corpus_pipeline
from brackish.llm import pii, simhash, toxicity
from brackish.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], SF), name))
    start, clean, single, cut, private, packed = seen
    assert all(s.columns == start.columns for s in seen[:-1])
    scores = {r.doc_id: r.score for r in toxicity.score(start, model, ["doc_id"]).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    first = {r.component_id for r in simhash.components(clean).collect()}
    assert {r.doc_id for r in single.collect()} == first and single.count() == len(first)
    before = {r.doc_id: r.text for r in single.collect()}
    bodies = [t.encode() for t in before.values()]
    seen_once = {}
    for b in bodies:
        for i in range(len(b) - 199):
            seen_once[b[i : i + 200]] = seen_once.get(b[i : i + 200], 0) + 1
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts.keys() == before.keys()
    for i, old in before.items():
        data, mark = old.encode(), bytearray(len(old.encode()))
        for at in range(len(data) - 199):
            if seen_once[data[at : at + 200]] > 1:
                mark[at : at + 200] = b"\x01" * 200
        kept, at = [], 0
        for char in old:
            size = len(char.encode())
            if not all(mark[at : at + size]):
                kept.append(char)
            at += size
        assert texts[i] == "".join(kept)
    for r in private.collect():
        assert re.split(pii.VALUE, texts[r.doc_id]) == re.split(pii.VALUE, r.text) and r.n_chars == len(r.text)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == texts.keys()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "pii", "packing"]
