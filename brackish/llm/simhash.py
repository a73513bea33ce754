"""SimHash near-duplicates: a lattice of segment bit counts finds candidates, one-bit midpoints verify them.

A fingerprint is mapped to the number of set bits in each of 16 segments of four bits. The Manhattan distance of two such
vectors is never more than the Hamming distance of the fingerprints, so fingerprints that differ in at most two bits lie
within two lattice steps, and some lattice cell lies within one step of both. Every distinct fingerprint therefore meets
the 33 cells within one step of its own; a cell that two different fingerprints meet is a candidate.

Two fingerprints differ in at most two bits exactly if some third value differs from each in at most one bit, and that
midpoint lies in a cell that both meet. A candidate cell is verified by the midpoints inside it: those with equal midpoints
are linked to the smallest of them. A midpoint has at most 65 fingerprints, whatever the data, so no pair list arises
and no link is lost.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, settle
from .components import connected_components

SEED = 42
SEGMENTS, WIDTH, COUNT_BITS = 16, 4, 3


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; the whole sequence if it is shorter; none without a word."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)))]


def simhash(text: str, size: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the shingles' hashes."""
    found = shingles(text, size)
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = np.add.reduce(bits, axis=0, dtype=np.int32) * 2 > len(found)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """``keep`` and ``fp`` (long) for every row; null text counts as empty, and the empty text has fingerprint 0."""
    return map_texts(docs, keep, text, lambda texts: [{"fp": simhash(t, size)} for t in texts], "fp long")


def _counts(fp: Column) -> Column:
    """The lattice cell: bits set in each segment, three bits a segment."""
    cell = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        bits = F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)))
        cell = cell + F.shiftleft(bits.cast("long"), COUNT_BITS * i)
    return cell


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among the fingerprints ``fp`` of ``distinct`` that keep every connection at two or fewer bits."""
    steps = [(0, 0), *((i, s) for i in range(SEGMENTS) for s in (1, -1))]
    probes = (
        distinct.select("fp", _counts(F.col("fp")).alias("own"))
        .select("fp", "own", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in steps))))
        .select("fp", F.col("col.i").alias("i"), F.col("col.s").alias("s"),
                (F.col("own") + F.col("col.s") * F.expr(f"shiftleft(1L, {COUNT_BITS} * col.i)")).alias("cell"))
    )
    # a step up needs a bit that is not set, a step down one that is
    held = f"bit_count(shiftrightunsigned(fp, {WIDTH} * i) & {(1 << WIDTH) - 1})"
    probes = probes.where(f"s = 0 OR (s = 1 AND {held} < {WIDTH}) OR (s = -1 AND {held} > 0)")
    met = probes.groupBy("cell").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    candidates = probes.join(met.where("least < most").select("cell"), "cell", "left_semi")
    middles = candidates.selectExpr(
        "fp",
        f"""explode(if(s = 0, array(fp), transform(
                filter(sequence(0, {WIDTH - 1}),
                       b -> (shiftrightunsigned(fp, {WIDTH} * i + b) & 1) = if(s = 1, 0, 1)),
                b -> fp ^ shiftleft(1L, {WIDTH} * i + b)))) AS middle""",
    )
    heads = middles.groupBy("middle").agg(F.min("fp").alias("head"))
    return middles.join(heads, "middle").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that the row's fingerprint reaches by steps of two or fewer bits. Rows with equal
    fingerprints belong together, texts without a word as well (fingerprint 0); repeated rows stay; a null id is never
    the smallest unless all are null; an empty table gives an empty result.
    """
    marked = settle(fingerprints(docs, [id_col], text, size), "fingerprints")
    by_fp = settle(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "by-fingerprint")
    roots = connected_components(links(by_fp.select("fp")))
    rooted = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with the row of the smallest id of each component, all columns as they are.

    Rows that repeat id and text count once. Rows with a null id have no place in the order of ids and stay.
    """
    return first_of(docs, components(docs, id_col, text, size), id_col, text)


def first_of(docs: DataFrame, classes: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with the row of the smallest id of each of ``classes`` (id, component_id)."""
    found = settle(classes, "classes")
    lost = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    repeated = settle(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().where("count > 1"), "repeated")
    rest = docs.join(lost.union(repeated.select(id_col)).distinct(), id_col, "left_anti").select(docs.columns)
    once = docs.join(repeated.select(id_col), id_col, "left_semi").select(docs.columns).dropDuplicates([id_col, text])
    return rest.unionByName(once)
