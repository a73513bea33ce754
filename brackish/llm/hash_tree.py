"""Sharding by a hierarchical weighted hash tree: a document descends region, rack and shard, one weighted draw a level.

At a node every child draws an exponential variable from a hash of document and child, over the child's weight; the lowest
draw is taken. A child's weight is the sum of the shards below it. A draw depends on nothing but document, child and the
child's weight. If weights grow, rows therefore move only into subtrees whose weight has grown, and if they shrink only out
of such subtrees; all other nodes keep the order of their draws.

Growth beyond the built regions adds a region for each new shard (``grown``): no weight of an older subtree changes, so a new
shard takes rows only into itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators.numbering import number_rows

#: Racks of the regions that the first shards fill, and shards of a rack.
REGION_RACKS = (4, 3, 3)
RACK_SHARDS = 4


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def grown(count: int, regions: Sequence[int] = REGION_RACKS, rack_shards: int = RACK_SHARDS) -> list[Shard]:
    """The shards 0 to ``count`` - 1: ``regions`` of racks that are filled in order, then a region for each further shard.

    Fewer shards than the regions hold leave the last ones out.
    """
    racks = [(f"r{r}", f"r{r}k{k}") for r, n in enumerate(regions) for k in range(n)]
    built = [Shard(i, *racks[i // rack_shards]) for i in range(min(count, len(racks) * rack_shards))]
    return built + [Shard(i, f"x{i}", f"x{i}k0") for i in range(len(built), count)]


def children(shards: Sequence[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, of every node the children with their weights; nodes without weight are left out."""
    if len({s.number for s in shards}) < len(shards):
        raise ValueError("two shards have one number")
    region_of: dict[str, str] = {}
    levels: list[dict[str, dict[str, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for s in shards:
        if s.weight < 0 or region_of.setdefault(s.rack, s.region) != s.region:
            raise ValueError("weights are at least 0 and a rack lies in one region")
        if s.weight:
            for level, parent, child in ((0, "", s.region), (1, s.region, s.rack), (2, s.rack, str(s.number))):
                levels[level][parent][child] += s.weight
    if not levels[0]:
        raise ValueError("no shard has a weight")
    return [{p: sorted(c.items()) for p, c in level.items()} for level in levels]


def _descend(key: Column, parent: Column | None, level: dict[str, list[tuple[str, float]]]) -> Column:
    """The child of ``parent`` with the lowest draw; of equal draws the one whose name is least."""
    name = lambda c, w: F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight"))
    of = {p: F.array(*(name(c, w) for c, w in held)) for p, held in level.items()}
    if parent is None:
        held = of[""]
    else:
        held = F.element_at(F.create_map(*(x for p, c in of.items() for x in (F.lit(p), c))), parent)
    uniform = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c.child), 11).cast("double") + 0.5) / float(1 << 53)
    draws = F.transform(held, lambda c: F.struct((-F.log(uniform(c)) / c.weight).alias("cost"), c.child.alias("child")))
    return F.array_min(draws)["child"]


def place(docs: DataFrame, shards: Sequence[Shard], id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the columns ``name`` (int), ``name``_region and ``name``_rack.

    Only the id decides: rows that repeat an id share its shard, all rows without an id share one. Other columns, texts among
    them, are left as they are; columns of the three names are replaced; an empty table gives an empty result. The tree is a
    literal of the plan, so it is bounded by the number of shards.
    """
    regions, racks, leaves = children(shards)
    key = F.col(id_col)
    placed = docs.withColumn(f"{name}_region", _descend(key, None, regions))
    placed = placed.withColumn(f"{name}_rack", _descend(key, F.col(f"{name}_region"), racks))
    return placed.withColumn(name, _descend(key, F.col(f"{name}_rack"), leaves).cast("int"))


def slots(placed: DataFrame, id_col: str = "doc_id", shard: str = "shard", name: str = "slot") -> DataFrame:
    """``placed`` with a number from 0 without gaps for each row of a shard, in the order of ids, nulls first.

    Numbers come from ranges and prefix sums, so that a shard may hold any number of rows, and an id as well.
    """
    return number_rows(placed, [id_col], name, within=[shard], start=0)


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """The rows as Parquet, a folder for each shard."""
    placed.write.partitionBy(shard).parquet(path)


def sharded(docs: DataFrame, count: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row, for ``count`` shards and for one more.

    ``size`` is the UTF-8 length and 16, and null text has no bytes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32")
    )
    now = place(facts, grown(count), "id", "shard")
    both = place(now, grown(count + 1), "id", "grown_shard")
    numbered = slots(both.select("id", "size", "text_crc32", "shard", "grown_shard"), "id")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
