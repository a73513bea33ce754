"""Clocks, seasons and water years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Season order, months of each season, noon in seconds.
SEASONS = ("Winter", "Spring", "Summer", "Fall")
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}
NOON = 43200


def local_clock(df: DataFrame, name: str, zone: str) -> Column:
    """Wall clock of an instant in ``zone``, whatever the session zone is.

    A zone-less timestamp column is taken as UTC.
    """
    zoneless = isinstance(df.schema[name].dataType, T.TimestampNTZType)
    source = F.lit("UTC") if zoneless else None
    return F.convert_timezone(source, F.lit(zone), F.col(name))


def seconds_of_day(clock: Column) -> Column:
    return F.hour(clock) * 3600 + F.minute(clock) * 60 + F.extract(F.lit("SECOND"), clock).cast("double")


def noon_distance(seconds: Column) -> Column:
    return F.abs(F.lit(NOON) - seconds)


def season(month: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS.items():
        expr = F.when(month.isin(list(months)), name).otherwise(expr)
    return expr


def season_year(month: Column, year: Column) -> Column:
    """December counts towards the next year's winter."""
    return F.when(month == 12, year + 1).otherwise(year).cast("int")


def shifted_year(date: Column, start_month: int = 12) -> Column:
    """Calendar year, with only ``start_month`` itself moved to the next year."""
    return (F.year(date) + (F.month(date) == start_month).cast("int")).cast("int")


def water_year(date: Column) -> Column:
    return (F.year(date) + (F.month(date) >= 10).cast("int")).cast("int")


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def water_day(date: Column) -> Column:
    """Day of the water year, 1 on October 1."""
    day = F.dayofyear(date)
    october = F.when(is_leap(F.year(date)), 275).otherwise(274)
    return F.when(day >= october, day - october + 1).otherwise(day + 92).cast("int")


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM")


def month_day_year(text: Column) -> Column:
    """Date from text such as 7/4/2012; unreadable text is missing."""
    return F.try_to_date(text, "M/d/yyyy")
