"""Exact quantiles by group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions.numeric import interpolate
from brackish.operators.attach import attach
from brackish.session import settle

ACCURACY = 20_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group, one column per entry of probs.

    A first pass keeps a bounded sketch per group and takes from it, for each quantile, two
    values that surely enclose it. The second pass counts what lies below and ranks only
    the distinct values between the two. So a large group leaves about ``8 / accuracy`` of
    its rows to one task, and equal values are counted before they move. Smaller groups get
    wider limits, and those too small for the sketch to separate ranks are ranked whole.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    names = list(probs)
    narrow, wide = 4.0 / accuracy, max(0.01, 4.0 / accuracy)
    edges = [p + side * m for m in (narrow, wide) for side in (-1, 1) for p in probs.values()]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", [min(1.0, max(0.0, e)) for e in edges], accuracy).alias("__q"),
    )

    def enclosing(i: int, side: int) -> Column:
        """Lower (0) or upper (1) enclosing value of quantile i, by the size of the group."""
        end = F.col("__max") if side else F.col("__min")
        out = end
        for at, m, least in ((2, wide, 1000), (0, narrow, 2 * accuracy)):
            reach = probs[names[i]] + (m if side else -m)
            value_there = F.col("__q")[(at + side) * len(names) + i] if 0 < reach < 1 else end
            out = F.when(F.col("__n") >= least, value_there).otherwise(out)
        return out

    bounds = sketch.select(
        *keys,
        "__n",
        *[enclosing(i, side).alias(f"__{i}_{side}") for i in range(len(names)) for side in (0, 1)],
    )
    bounds = settle(bounds, "quantile-limits")  # a row a group: the plan then knows how few they are
    # One entry per quantile a row can matter for: its value if it lies in between,
    # missing if it lies below and is only counted.
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(probs[n]).alias("p"),
                F.col(f"__{i}_0").alias("low"),
                F.col(f"__{i}_1").alias("high"),
            )
            for i, n in enumerate(names)
        ]
    )
    counted = (
        attach(rows, bounds, keys, "inner")
        .select(*keys, "__n", "__v", F.inline(entries))
        .filter("__v <= high")
        .groupBy(*keys, "__n", "i", "p", F.expr("CASE WHEN __v >= low THEN __v END").alias("v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    order = (
        Window.partitionBy(*keys, "i")
        .orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = (F.col("__n") - 1) * F.col("p")
    ranked = counted.withColumn("__upto", F.sum("__c").over(order))
    picked = ranked.groupBy(*keys, "__n", "i", "p").agg(
        F.min_by("v", F.when(F.col("__upto") > F.floor(position), F.col("__upto"))).alias("lo"),
        F.min_by("v", F.when(F.col("__upto") > F.ceil(position), F.col("__upto"))).alias("hi"),
    )
    enclosed = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    result = F.when(
        enclosed, interpolate(F.col("lo"), F.col("hi"), position - F.floor(position))
    ).otherwise(F.raise_error(F.lit("a quantile lies outside its enclosing values")).cast("double"))
    solved = picked.select(*keys, "i", result.alias("q"))
    return solved.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    )
