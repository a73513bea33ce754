"""Column selection by pattern, wide to long and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_like(
    df: DataFrame, contains: str | Sequence[str] = (), starts: str = "", ends: str = "", negate: bool = False
) -> list[str]:
    """Names matching any given pattern; ``contains`` ignores case."""
    pieces = [contains] if isinstance(contains, str) else list(contains)

    def hit(name: str) -> bool:
        return (
            any(p.lower() in name.lower() for p in pieces if p)
            or (bool(starts) and name.startswith(starts))
            or (bool(ends) and name.endswith(ends))
        )

    return [c for c in df.columns if hit(c) != negate]


def relocate(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def across(df: DataFrame, columns: Sequence[str], fns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Add ``{column}_{fn}`` for each pair; every output sees the original columns."""
    new = [fn(F.col(c)).alias(f"{c}_{name}") for c in columns for name, fn in fns.items()]
    return df.select("*", *new)


def lengthen(
    df: DataFrame, columns: Sequence[str], names_to: str, values_to: str, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Wide to long, missing values kept; a name prefix or suffix can be cut off."""
    ids = [c for c in df.columns if c not in columns]
    long = df.unpivot(ids, list(columns), names_to, values_to)
    if prefix:
        long = long.withColumn(names_to, F.regexp_replace(names_to, f"^\\Q{prefix}\\E", ""))
    if suffix:
        long = long.withColumn(names_to, F.regexp_replace(names_to, f"\\Q{suffix}\\E$", ""))
    return long


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: Sequence[str],
    levels: Sequence,
) -> DataFrame:
    """Long to wide over known levels, columns named ``{value}_{level}``.

    With one value column the level alone is the name.
    """
    single = len(values_from) == 1
    cells = [
        F.any_value(F.when(F.col(names_from) == level, F.col(v)), True).alias(
            str(level) if single else f"{v}_{level}"
        )
        for v in values_from
        for level in levels
    ]
    return df.groupBy(*ids).agg(*cells)


def group_all_but(df: DataFrame, *values: str):
    """Group by every column except the named ones; missing keys group together."""
    return df.groupBy(*[c for c in df.columns if c not in values])


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the source in a column; absent columns become missing."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``."""
    return left.subtract(right)
