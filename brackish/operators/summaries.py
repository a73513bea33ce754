"""Box summaries and histograms by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.operators.attach import attach
from brackish.operators.quantiles import exact_quantiles
from brackish.session import settle

WHISKER = 1.5  # fixed value: whisker reach in interquartile ranges
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group."""
    quartiles = settle(exact_quantiles(df, keys, value, QUARTILES), "quartiles")
    v, reach = F.col(value), WHISKER * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    rows = attach(df.select(*keys, value).dropna(subset=[value]), quartiles, keys)
    return rows.groupBy(*keys, *QUARTILES).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def box_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows beyond the whiskers."""
    quartiles = settle(exact_quantiles(df, keys, value, QUARTILES), "quartiles")  # known to be few, so no row is dealt by its group
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    rows = attach(df, quartiles, keys)
    beyond = ~F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.filter(beyond).select(*df.columns)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins of each group: the first is centred on the smallest value, the last on the largest.

    So a bin is as wide as the range by one less than the bins. A bin holds its upper edge, to a part in 10^8 of its width.
    Empty bins are listed; a group of one value, or a single bin, has one bin, of width 0.1 if the values are equal.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).dropna(subset=["__v"])
    span = settle(rows.groupBy(*keys).agg(F.min("__v").alias("low"), F.max("__v").alias("high")), "span")
    extent = F.col("high") - F.col("low")
    single = (extent == 0) | F.lit(bins == 1)
    width = F.when(extent == 0, 0.1).otherwise(extent / max(bins - 1, 1))
    first = F.when(single & (extent > 0), F.col("low")).otherwise(F.col("low") - width / 2)
    span = span.select(*keys, width.alias("__width"), first.alias("__first"), F.when(single, 1).otherwise(bins).alias("__bins"))
    place = F.ceil((F.col("__v") - F.col("__first")) / F.col("__width") - 1e-8)
    counts = (
        attach(rows, span, keys)
        .groupBy(*keys, F.least(F.greatest(place, F.lit(1)), F.col("__bins")).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every_bin = span.select("*", F.explode(F.sequence(F.lit(1), F.col("__bins"))).alias("bin"))
    filled = attach(every_bin, counts, [*keys, "bin"])
    return filled.select(
        *keys,
        "bin",
        (F.col("__first") + (F.col("bin") - 1) * F.col("__width")).alias("bin_low"),
        (F.col("__first") + F.col("bin") * F.col("__width")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def band(df: DataFrame, centre: str, spread: str) -> DataFrame:
    """Lower and upper edge of centre +- spread."""
    c, s = F.col(centre), F.col(spread)
    return df.withColumns({"ymin": c - s, "ymax": c + s})
