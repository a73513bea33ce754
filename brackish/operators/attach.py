"""Join a small-per-group table onto rows, missing keys matching missing ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.strict import checked


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on same-named keys with missing matching missing, keys kept once."""
    held = {k: f"__{k}" for k in keys}
    renamed = right.withColumnsRenamed(held)
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[held[k]]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*held.values())


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Left, inner or left-semi join of ``table`` (few rows per key) onto ``rows``.

    One lazy plan at every size: a null-safe equi-join. Catalyst and AQE broadcast the table by
    its bytes where they are known to be few, and split the tasks of a hot key where they are not.
    """
    return join_null_safe(rows, table, list(keys), how)


def shared_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return join_null_safe(left, right, shared)


def lookup(rows: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a dimension table, repeated rows removed so that it cannot multiply rows."""
    return attach(rows, dimension.distinct(), keys, how)


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """``df``, which has one row for each key; the query that reads it fails with ``message`` where a key repeats.

    The guard is an aggregate on the way of the rows, combined map-side, so no job runs just to look.
    """
    keys = list(keys)
    others = [F.first(c).alias(c) for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *others)
    return held.where(checked(F.col("__n") == 1, F.lit(True), message)).select(*df.columns)


def expect_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; the query that reads it fails with ``message`` at a row where the condition does not hold."""
    return df.where(checked(F.coalesce(condition, F.lit(False)), F.lit(True), message))
