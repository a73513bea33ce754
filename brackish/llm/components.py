"""Connected components of a link table by random contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.session import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); nodes of one component share their root.

    Each round draws an order of the nodes, joins every node to its first neighbour in that order and contracts what
    was joined. An expected share of the nodes goes in each round, chains included, so rounds grow with the logarithm
    of the largest component. Every round is settled as a table, so that lost executors cost a read. Null ends and
    loops are left out; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    proper = links.select(a.cast("long"), b.cast("long")).where((a != b))
    edges = settle(proper.union(proper.select(b.alias("a"), a.alias("b"))).distinct(), "links")
    nodes = settle(edges.select(a.alias("node"), a.alias("root")).distinct(), "nodes")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c: F.xxhash64(c, F.lit(turn))
        first = edges.groupBy("a").agg(F.min(F.struct(order(b).alias("o"), b.alias("n"))).alias("f"))
        joined = settle(
            first.select(a.alias("old"), F.when(order(a) < F.col("f.o"), a).otherwise(F.col("f.n")).alias("new")),
            "joined",
        )
        nodes = settle(
            nodes.join(joined, nodes.root == joined.old, "left").select("node", F.coalesce("new", "root").alias("root")),
            "nodes",
        )
        moved = edges.join(joined, a == F.col("old")).select(F.col("new").alias("a"), "b")
        moved = moved.join(joined, b == F.col("old")).select("a", F.col("new").alias("b"))
        edges = settle(moved.where(a != b).distinct(), "links")
    return nodes
