"""Row numbers and first-seen order over tables of any size, without a window that holds them whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.operators.attach import join_null_safe
from brackish.session import settle

#: A generated id holds the number of its partition above these bits and the row's place in it below.
PLACE_BITS = 33


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str = "number",
    within: Sequence[str] = (),
    descending: Sequence[str] = (),
    start: int = 1,
) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of ``within`` and ``order``, anew for each ``within``.

    Rows are dealt into ranges of the order and sorted there; a row's place in its range is its number less the rows of the
    ranges before. Rows that tie in all columns are told apart by where they were read, so a pile of equal rows is split like
    any other. Nulls come first, or last where ``descending``. Only one count for each range, never the rows, meets in one
    task; an empty table gives an empty result.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).desc() if c in descending else F.col(c).asc() for c in (*within, *order)]
    marked = df.withColumn("__read", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(partitions, *keys, "__read").sortWithinPartitions(*keys, "__read")
    placed = settle(dealt.drop("__read").withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", PLACE_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    placed = placed.withColumn("__part", part)
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    numbered = placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + place + F.lit(start))
    numbered = numbered.drop("__part", "__at", "__offset")
    if not within:
        return numbered.select(*df.columns, name)
    firsts = numbered.groupBy(*within).agg(F.min(name).alias("__first"))
    joined = join_null_safe(numbered, firsts, list(within), "inner")
    return joined.withColumn(name, F.col(name) - F.col("__first") + F.lit(start)).select(*df.columns, name)


def first_seen(
    df: DataFrame, column: str, order: Sequence[str], baseline: Sequence = (), name: str = "level"
) -> DataFrame:
    """(column, first_row, level): each distinct value, the number of its first row, and its place among the values.

    ``baseline`` values, and missing ones, are no level, but their rows count in ``first_row``.
    """
    rows = number_rows(df.select(column, *(c for c in order if c != column)), order, "first_row")
    kept = rows.where(F.col(column).isNotNull())
    if baseline:
        kept = kept.where(~F.col(column).isin(list(baseline)))
    firsts = kept.groupBy(column).agg(F.min("first_row").alias("first_row"))
    return number_rows(firsts, ["first_row"], name)
