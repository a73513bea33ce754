"""Fill a table up to every combination of its levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.operators.attach import join_null_safe


def complete(
    df: DataFrame,
    axes: Sequence[str | tuple[str, ...]],
    within: Sequence[str] = (),
    levels: Mapping[str, Sequence] | None = None,
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """Every combination of the axes, once per ``within`` group.

    An axis is a column, or a tuple of columns whose observed pairs stay together. Its
    levels are the observed ones unless ``levels`` lists them (an ordered factor). ``fill``
    replaces missing values, those already in the data included.

    The levels of one group are gathered into arrays and exploded, so ``df`` must be an
    aggregate over calendar units and named regions, not raw rows.
    """
    levels = dict(levels or {})
    axes = [(a,) if isinstance(a, str) else tuple(a) for a in axes]
    observed = [a for a in axes if a[0] not in levels]
    gathered = [
        F.collect_set(F.struct(*a)).alias("__" + "_".join(a)) for a in observed
    ] or [F.count(F.lit(1)).alias("__n")]
    grid = df.groupBy(*within).agg(*gathered)
    for axis in axes:
        if axis[0] in levels:
            kind = df.schema[axis[0]].dataType
            values = F.array(*[F.lit(v).cast(kind) for v in levels[axis[0]]])
            grid = grid.withColumn(axis[0], F.explode(values))
        else:
            name = "__" + "_".join(axis)
            grid = grid.withColumn(name, F.explode(name)).select(
                *[c for c in grid.columns if c != name], F.col(f"{name}.*")
            )
    keys = [*within, *[c for a in axes for c in a]]
    dense = join_null_safe(grid.select(*keys), df, keys)
    if fill:
        dense = dense.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return dense.select(*df.columns)


def expand_grid(spark: SparkSession, **levels: Sequence) -> DataFrame:
    """A frame of every combination of short literal lists, in the order given."""
    frame = spark.range(1).select()
    for name, values in levels.items():
        frame = frame.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return frame
