"""Daily flows by water year and runs of like years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions.calendar import month_label, water_day, water_year
from brackish.functions.strict import strict_over
from brackish.operators.attach import attach


def water_year_flow(daily: DataFrame, flows: Sequence[str], date: str = "date") -> DataFrame:
    """Running and whole totals of each flow in its water year.

    ``daily`` has one row per date, so a water year is at most 366 rows. A missing day
    makes the running total missing from there on, and the whole total missing.
    """
    day = F.col(date)
    dated = daily.withColumns({"wy": water_year(day), "wdoy": water_day(day)})
    year = Window.partitionBy("wy")
    so_far = year.orderBy("wdoy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {}
    for f in flows:
        totals[f"{f}_cum"] = strict_over(F.sum, f, so_far)
        totals[f"{f}_sum"] = strict_over(F.sum, f, year)
    return dated.withColumns(totals)


def month_starts(flow: DataFrame, date: str = "date") -> DataFrame:
    """First water day of each month and where to put its label."""
    return (
        flow.groupBy(month_label(F.col(date)).alias("month"))
        .agg(F.min("wdoy").alias("day_min"))
        .withColumn("month_label", F.col("day_min") + 15)
    )


def drought_series(years: DataFrame, year: str = "year", group: str = "drought") -> DataFrame:
    """Number runs of consecutive years of one class and the years in each run.

    ``years`` has one row per year. Runs are numbered by class, then time; the label of a
    year in its run is 1, 2 or 3+.
    """
    # The table is one row per calendar year, so the window without keys is small.
    in_order = Window.partitionBy(group).orderBy(year)
    start = F.coalesce((F.col(year) - F.lag(year).over(in_order) > 1).cast("int"), F.lit(1))
    islands = years.withColumn("__island", F.sum(start).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(group, "__island").orderBy(year)
    numbered = islands.withColumns(
        {
            "series_id": F.dense_rank().over(Window.orderBy(group, "__island")),
            "series_year": F.row_number().over(run),
        }
    )
    label = F.when(F.col("series_year") >= 3, "3+").otherwise(F.col("series_year").cast("string"))
    return numbered.withColumn("series_year2", label).drop("__island")


def flow_with_series(flow: DataFrame, series: DataFrame, year: str = "year") -> DataFrame:
    """Flows of the water years that belong to a series."""
    named = series.withColumnRenamed(year, "wy")
    return attach(flow, named, ["wy"]).filter(F.col("drought").isNotNull())


def with_flow_share(flow: DataFrame, name: str) -> DataFrame:
    """Daily and running flow as parts of the year's total."""
    total = F.nullif(F.col(f"{name}_sum"), F.lit(0.0))
    return flow.withColumns(
        {f"{name}_share": F.col(name) / total, f"{name}_cum_share": F.col(f"{name}_cum") / total}
    )


def fill_down(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Carry the last value forward. Meant for groups bounded by the calendar."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(frame))
