"""Seasonal and yearly water-quality indices, sampling effort and salinity zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions.calendar import SEASONS, season, season_year
from brackish.functions.numeric import band_overlaps
from brackish.functions.geometry import Datum
from brackish.functions.strict import strict_avg, strict_sd, strict_sum, strict_var
from brackish.operators.attach import attach
from brackish.operators.dedupe import LOCAL_ZONE, STATION_DAY, by_variable, complete_observations, nearest_noon
from brackish.operators.densify import complete, expand_grid
from brackish.operators.reshape import lengthen, set_difference, widen
from brackish.operators.spatial import assign_subregion
from brackish.session import settle

# Study years, outlier limit, salinity band of the low-salinity zone.
FIRST_YEAR, LAST_YEAR = 1975, 2021
OUTLIER_LIMIT = 10.0
ZONE_LOW, ZONE_HIGH = 0.5, 6.0


def _one_of(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


# --- rows ---------------------------------------------------------------------------


def drop_high_outliers(
    rows: DataFrame, keys: Sequence[str], value: str = "value", limit: float = OUTLIER_LIMIT
) -> DataFrame:
    """Drop values ``limit`` or more standard deviations above their group's mean.

    One-sided: far lower values stay. A group without spread or with a missing value has
    no score and is dropped whole. The group statistics are settled first, so that the plan
    knows how few they are: the raw rows then meet them by broadcast and are not shuffled.
    """
    stats = rows.groupBy(*keys).agg(
        strict_avg(value).alias("__mean"), F.nullif(strict_sd(value), F.lit(0.0)).alias("__sd")
    )
    stats = settle(stats, "outlier-statistics")
    scored = attach(rows, stats, keys)
    return scored.filter((F.col(value) - F.col("__mean")) / F.col("__sd") < limit).drop("__mean", "__sd")


def with_season(rows: DataFrame) -> DataFrame:
    """Season of the month; December belongs to the next year's winter."""
    month, year = F.col("month"), F.col("year")
    return rows.withColumns({"season": season(month), "year": season_year(month, year)})


def usable_observations(
    observations: DataFrame,
    variables: Sequence[str],
    polygons: DataFrame,
    place: tuple[str, str] = ("x", "y"),
    cell: float | None = None,
    zone: str = LOCAL_ZONE,
    datum: Datum | None = None,
) -> DataFrame:
    """One value per variable, station and day, in a sub-region, outliers out, season set.

    With a datum, ``place`` names longitude and latitude.
    """
    wanted = ["source", "station", "date", "datetime", *place, "month", "year", *variables]
    complete_rows = complete_observations(observations.select(*wanted), place)
    chosen = nearest_noon(complete_rows, STATION_DAY, variables, zone)
    placed = assign_subregion(chosen, polygons, *place, cell=cell, datum=datum, positions=observations)
    narrow = by_variable(placed.select("subregion", "month", "year", *variables), variables)
    narrow = settle(narrow, "observations")
    kept = drop_high_outliers(narrow, ["variable", "subregion"])
    return with_season(kept)


# --- indices ------------------------------------------------------------------------


def join_eligibility(rows: DataFrame, eligibility: DataFrame, region: str) -> DataFrame:
    """Keep rows of eligible cells: the low-salinity zone by year, or long-term cells."""
    _one_of("region", region, ("lsz", "all"))
    if region == "lsz":
        zone = eligibility.drop("n")
        joined = attach(rows, zone, ["season", "subregion", "year"])
        return joined.filter(F.col("long_term") | F.col("short_term"))
    joined = attach(rows, eligibility, ["season", "subregion"])
    return joined.filter("long_term")


def monthly_means(rows: DataFrame, unit: str) -> DataFrame:
    return rows.groupBy("variable", "month", "season", unit, "year").agg(
        strict_avg("value").alias("month_mean"), F.count(F.lit(1)).alias("n")
    )


def seasonal_means(monthly: DataFrame, unit: str, month_na: str = "strict") -> DataFrame:
    """Unweighted mean of the monthly means of each season.

    ``strict``: a season with a month missing is missing. ``relaxed``: only whole missing
    seasons are. Either way every level of season, unit and year is present.
    """
    _one_of("month_na", month_na, ("strict", "relaxed"))
    season_axis = ("month", "season") if month_na == "strict" else "season"
    dense = complete(monthly, [season_axis, unit, "year"], within=["variable"], fill={"n": 0})
    return dense.groupBy("variable", "season", unit, "year").agg(
        strict_avg("month_mean").alias("value"), F.sum("n").alias("n")
    )


def roll_up(
    seasonal: DataFrame,
    kind: str,
    unit: str,
    years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR),
) -> DataFrame:
    """Mean over units for each season, or over seasons for each unit."""
    _one_of("kind", kind, ("season", "year"))
    inside = seasonal.filter(F.col("year").between(*years))
    if kind == "season":
        keys = ["season", "year"]
    else:
        inside = complete(inside, ["season", unit, "year"], within=["variable"], fill={"n": 0})
        keys = [unit, "year"]
    return inside.groupBy("variable", *keys).agg(strict_avg("value").alias("value"), F.sum("n").alias("n"))


def seasonal_index(
    observations: DataFrame,
    variables: Sequence[str],
    polygons: DataFrame,
    eligibility: DataFrame,
    region: str = "lsz",
    kind: str = "season",
    month_na: str = "strict",
    unit: str | None = None,
    place: tuple[str, str] = ("x", "y"),
    cell: float | None = None,
    datum: Datum | None = None,
) -> DataFrame:
    """The index of each variable: long rows (variable, season or unit, year, value, n).

    ``unit`` is what monthly means are taken over: the sub-region in the low-salinity
    zone, the region otherwise (``eligibility`` then maps sub-regions to regions).
    """
    _one_of("kind", kind, ("season", "year"))
    _one_of("month_na", month_na, ("strict", "relaxed"))
    unit = unit or ("subregion" if region == "lsz" else "region")
    rows = usable_observations(observations, variables, polygons, place, cell, datum=datum)
    return index_of_rows(rows, eligibility, region, kind, month_na, unit)


def index_of_rows(
    rows: DataFrame,
    eligibility: DataFrame,
    region: str = "lsz",
    kind: str = "season",
    month_na: str = "strict",
    unit: str = "region",
    years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR),
) -> DataFrame:
    """The index from usable observations, for callers that draw several tables from them."""
    eligible = join_eligibility(rows, eligibility, region)
    monthly = settle(monthly_means(eligible, unit), "monthly")
    return roll_up(seasonal_means(monthly, unit, month_na), kind, unit, years)


def index_table(index: DataFrame, frame: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Indices on a fixed frame: one value and one ``n_`` column per variable."""
    cells = [
        F.any_value(F.when(F.col("variable") == v, F.col(c)), True).alias(name)
        for v in variables
        for c, name in (("value", v), ("n", f"n_{v}"))
    ]
    wide = index.groupBy(*keys).agg(*cells)
    return attach(frame, wide, keys)


def season_frame(spark, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    return expand_grid(spark, season=SEASONS, year=range(years[0], years[1] + 1))


def region_frame(regions: DataFrame, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR), name: str = "region") -> DataFrame:
    """Every region with every year."""
    every = F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))
    return regions.select(name).dropna().distinct().select(name, every.alias("year"))


def sample_sizes(table: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Sample sizes of an index table in long form."""
    counts = [f"n_{v}" for v in variables]
    return lengthen(table.select(*keys, *counts), counts, "variable", "n", prefix="n_")


def index_wide(table: DataFrame, variables: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per year, columns ``{variable}_{season}``."""
    wide = widen(table, ["year"], "season", list(variables), SEASONS)
    if len(variables) == 1:
        wide = wide.withColumnsRenamed({s: f"{variables[0]}_{s}" for s in SEASONS})
    return wide.select("year", *columns) if columns else wide


# --- salinity zone --------------------------------------------------------------------


def salinity_field(rows: DataFrame) -> DataFrame:
    """Seasonal mean and pooled deviation per sub-region and year.

    The deviation is the root of the mean monthly variance; where that is missing the mean
    deviation of the same sub-region and season stands in.
    """
    monthly = settle(
        rows.groupBy("month", "season", "subregion", "year").agg(
            strict_avg("value").alias("month_mean"),
            strict_var("value").alias("month_var"),
            F.count(F.lit(1)).alias("n"),
        ),
        "salinity-monthly",
    )
    dense = complete(monthly, [("month", "season"), "subregion", "year"], fill={"n": 0})
    seasonal = dense.groupBy("season", "subregion", "year").agg(
        strict_avg("month_mean").alias("sal_mean"),
        F.sqrt(strict_avg("month_var")).alias("sal_sd"),
        F.sum("n").alias("n"),
    )
    over_years = Window.partitionBy("subregion", "season")
    return seasonal.withColumn("sal_sd", F.coalesce("sal_sd", F.avg("sal_sd").over(over_years)))


def with_zone_flags(field: DataFrame, low: float = ZONE_LOW, high: float = ZONE_HIGH) -> DataFrame:
    """In the zone by the mean, and by the mean give or take one deviation."""
    mean, spread = F.col("sal_mean"), F.col("sal_sd")
    return field.withColumns(
        {"low_sal": mean.between(low, high), "low_sal_sd": band_overlaps(mean, spread, low, high)}
    )


def low_salinity_zone(field: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Cells in the zone by their mean, with eligibility; unknown cells are not eligible."""
    cells = with_zone_flags(field).filter("low_sal").select("season", "subregion", "year", "n")
    joined = attach(cells, eligibility.select("season", "subregion", "long_term", "short_term"), ["season", "subregion"])
    return joined.fillna(False, ["long_term", "short_term"])


# --- eligibility ------------------------------------------------------------------------


# Sub-regions of the study area.
STUDY_SUBREGIONS = (
    "Suisun Marsh", "Grizzly Bay", "West Suisun Bay", "Mid Suisun Bay", "Honker Bay", "Confluence",
    "Lower Sacramento River", "San Joaquin River at Twitchell Island", "San Joaquin River at Prisoners Pt",
    "Disappointment Slough", "Lower San Joaquin River", "Franks Tract", "Holland Cut", "Mildred Island",
    "San Joaquin River near Stockton", "Old River", "Middle River", "Victoria Canal",
    "Upper San Joaquin River", "Sacramento River near Rio Vista", "Lower Mokelumne River",
    "Middle Sacramento River",
)
# Sub-regions of short-term analyses only.
SHORT_TERM_SUBREGIONS = (
    "Cache Slough and Lindsey Slough", "Liberty Island", "Lower Sacramento River Ship Channel",
    "Upper Sacramento River Ship Channel", "Lower Cache Slough", "Steamboat and Miner Slough",
    "Upper Mokelumne River", "Sacramento River near Ryde",
)
# Sub-regions eligible for long-term analyses in some seasons only.
SEASONAL_SUBREGIONS = {
    "Franks Tract": ("Summer",),
    "Holland Cut": ("Summer",),
    "Mildred Island": ("Summer",),
    "Middle River": ("Fall",),
    "Victoria Canal": ("Spring", "Summer"),
}


def region_eligibility(
    subregions: DataFrame,
    short_term_only: Sequence[str] = SHORT_TERM_SUBREGIONS,
    seasonal: Mapping[str, Sequence[str]] = SEASONAL_SUBREGIONS,
) -> DataFrame:
    """Each distinct sub-region by season, with long-term and short-term flags."""
    name, when = F.col("subregion"), F.col("season")
    out_of_season = [(name == s) & ~when.isin(list(ok)) for s, ok in seasonal.items()]
    excluded = reduce(lambda a, b: a | b, [name.isin(list(short_term_only)), *out_of_season])
    cells = subregions.select("subregion").distinct().select(
        "subregion", F.explode(F.array(*[F.lit(s) for s in SEASONS])).alias("season")
    )
    return cells.withColumn("long_term", ~excluded).withColumn(
        "short_term", F.col("long_term") | name.isin(list(short_term_only))
    )


def study_subregions(spark) -> DataFrame:
    return expand_grid(spark, subregion=[*STUDY_SUBREGIONS, *SHORT_TERM_SUBREGIONS])


# --- effort -----------------------------------------------------------------------------


def sampling_effort(monthly: DataFrame, eligibility: DataFrame, region: str = "all") -> DataFrame:
    """Months sampled (0 to 3) and sample size per season, sub-region and year."""
    dense = complete(monthly, [("month", "season"), "subregion", "year"], within=["variable"], fill={"n": 0})
    effort = dense.groupBy("variable", "season", "subregion", "year").agg(
        F.count_distinct(F.when(F.col("n") > 0, F.col("month"))).alias("n_months"),
        F.sum("n").alias("n"),
    )
    return join_eligibility(effort, eligibility, region.lower())


def effort_min(effort: DataFrame) -> DataFrame:
    """Smallest number of months sampled in any sub-region."""
    return effort.groupBy("variable", "year", "season").agg(F.min("n_months").alias("n_months_min"))


def effort_disagreement(minimum: DataFrame, index: DataFrame, months: int = 3) -> DataFrame:
    """Season-years fully sampled but without an index, and the reverse."""
    keys = ["variable", "year", "season"]
    sampled = minimum.filter(F.col("n_months_min") >= months).select(*keys)
    indexed = index.filter(F.col("value").isNotNull()).select(*keys)
    return (
        set_difference(sampled, indexed)
        .withColumn("side", F.lit("effort only"))
        .unionByName(set_difference(indexed, sampled).withColumn("side", F.lit("index only")))
    )
