"""Biomass under salinity scenarios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.functions.numeric import array_quantile, tenths
from brackish.functions.strict import only_value, ratio, strict_sd, strict_sum
from brackish.operators.attach import attach, expect_rows, expect_unique, join_null_safe
from brackish.operators.quantiles import exact_quantiles
from brackish.operators.reshape import columns_like, lengthen, set_difference, widen
from brackish.operators.surface import DRAWS, SEED, Surface, batch_groups, coefficient_draws, with_fits
from brackish.session import settle

# Edges of the 95 % band.
BAND = {"l95": 0.025, "median": 0.5, "u95": 0.975}
BLOCK = 512


def scenario_means(output: DataFrame, pattern: str = "_bn_") -> DataFrame:
    """Monthly mean of every scenario column, one decimal; incomplete rows are left out."""
    scenarios = columns_like(output, contains=pattern)
    return (
        output.dropna("any")
        .groupBy(F.month("datetime").alias("month"))
        .agg(*[F.bround(F.avg(c), 1).alias(c) for c in scenarios])
    )


# --- correction -----------------------------------------------------------------------


def out_of_range(values: DataFrame, conversions: DataFrame) -> DataFrame:
    """Salinities (in tenths) that the conversions do not cover."""
    return set_difference(values.select("tenths"), conversions.select("tenths"))


def targets_out_of_range(
    target: DataFrame, scenarios: Sequence[str], conversions: DataFrame, months: Sequence[int]
) -> DataFrame:
    """(scenario, outside): of each scenario the target salinities (in tenths) that no conversion of these months covers, in order.

    Scenarios without one are left out. A list holds distinct tenths only, of a row for each month.
    """
    aims = lengthen(target.select(*scenarios), scenarios, "scenario", "salinity").select("scenario", tenths(F.col("salinity")).alias("tenths"))
    covered = conversions.filter(F.col("month").isin(list(months))).select("tenths").distinct()
    outside = aims.dropna().distinct().join(covered, "tenths", "left_anti")
    return outside.groupBy("scenario").agg(F.array_sort(F.collect_set("tenths")).alias("outside"))


def salinity_correction(
    data: DataFrame,
    conversions: DataFrame,
    target: DataFrame,
    scenarios: Sequence[str],
    months: Sequence[int],
) -> DataFrame:
    """Biomass moved to the target salinity of its month, once per scenario.

    ``conversions`` has ibmr, month, tenths and fit; ``target`` one row per month with a
    salinity column per scenario; ``data`` has ibmr, month, salsurf and bpue_log1p.
    The plan fails when a target picks a conversion twice or leaves a month of a group empty; no job runs just to look.
    The data is read once: corrections of all scenarios are joined side by side.
    """
    usable = conversions.filter(F.col("month").isin(list(months))).select("ibmr", "month", "tenths", "fit")
    aims = lengthen(target.select("month", *scenarios), scenarios, "scenario", "salinity")
    aims = aims.select("month", "scenario", tenths(F.col("salinity")).alias("tenths"))
    per_step = aims.groupBy("month", "tenths").agg(F.collect_set("scenario").alias("scenarios"))
    aimed = attach(usable, per_step, ["month", "tenths"], "inner").select(
        "ibmr", "month", F.explode("scenarios").alias("scenario"), F.col("fit").alias("fit_target")
    )
    aimed = expect_unique(aimed, ["scenario", "month", "ibmr"], "the target salinities pick a conversion more than once")
    # A row for each month is left, so counting rows counts months.
    months_found = F.count(F.lit(1)).over(Window.partitionBy("scenario", "ibmr"))
    counted = aimed.withColumn("__months", months_found)
    complete = F.col("__months") == len(set(months))
    aimed = settle(expect_rows(counted, complete, "some months are missing in the target salinities").drop("__months"), "target")
    side_by_side = widen(aimed, ["ibmr", "month"], "scenario", ["fit_target"], scenarios)
    shift = attach(usable, side_by_side, ["ibmr", "month"]).select(
        "ibmr", "month", "tenths", *[(F.col(s) - F.col("fit")).alias(s) for s in scenarios]
    )
    keyed = data.withColumn("tenths", tenths(F.col("salsurf")))
    moved = attach(keyed, shift, ["month", "tenths", "ibmr"])
    per_scenario = F.array(
        *[F.struct(F.lit(s).alias("scenario"), F.col(s).alias("correction")) for s in scenarios]
    )
    long = moved.select(*keyed.columns, F.inline(per_scenario))
    return long.withColumn("bpue_adj", F.expm1(F.col("bpue_log1p") + F.col("correction")))


def corrected_summary(corrected: DataFrame) -> DataFrame:
    """Sum and deviation of corrected biomass, missing if any correction is missing."""
    return corrected.groupBy("ibmr", "month", "scenario").agg(
        strict_sum("bpue_adj").alias("bpue_sum"), strict_sd("bpue_adj").alias("bpue_sd")
    )


# --- ratios ---------------------------------------------------------------------------


def scenario_salinities(wide: DataFrame, base: str = "sal_base", prefix: str = "sal_") -> DataFrame:
    """Long scenario salinities; a missing one falls back to the base."""
    names = columns_like(wide, starts=prefix)
    filled = wide.select(
        "region", "year", "month", *[F.coalesce(F.col(n), F.col(base)).alias(n) for n in names]
    )
    return lengthen(filled, names, "scenario", "salinity").withColumn("tenths", tenths(F.col("salinity")))


def _scenario_cells(salinities: DataFrame, groups: DataFrame, scenarios: Sequence[str], base: str) -> DataFrame:
    """(region, year, month, ibmr, region2, base_tenths, scenario, tenths): every cell and group, scenario by scenario.

    ``groups`` names the taxon groups that are modelled, a list of the study's, so it travels as one literal.
    """
    all_groups = settle(groups.select("ibmr").distinct(), "groups").select(F.array_sort(F.collect_set("ibmr"))).scalar()
    cells = salinities.groupBy("region", "year", "month").agg(
        only_value("region2").alias("region2"),
        *[only_value(F.when(F.col("scenario") == s, F.col("tenths")), f"salinity of {s}").alias(s) for s in scenarios],
    )
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(s).alias("tenths")) for s in scenarios]))
    return (
        cells.withColumn("ibmr", F.explode(all_groups))
        .select(*CELL, "region2", F.col(base).alias("base_tenths"), each.alias("own"))
        .select(*CELL, "region2", "base_tenths", "own.*")
    )


CELL = ["region", "year", "month", "ibmr"]
WHERE = ["region2", "month", "ibmr"]


def _bands_to_cells(long: DataFrame, bands: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """The bands of each distinct pair of salinities, back at the cells and side by side for the scenarios."""
    found = join_null_safe(long, bands, [*WHERE, "base_tenths", "tenths"])
    return found.groupBy(*CELL).agg(
        *[
            F.any_value(F.when(F.col("scenario") == s, F.col(label)), True).alias(f"{s}_{label}")
            for s in scenarios
            for label in BAND
        ]
    )


def scenario_ratio(
    salinities: DataFrame,
    draws: DataFrame,
    scenarios: Sequence[str],
    base: str = "sal_base",
    clamp_at_zero: bool = True,
) -> DataFrame:
    """Biomass of each scenario relative to the base: median and 95 % band over draws.

    ``salinities`` is long (region, year, month, scenario, tenths, and region2, the region
    the draws know); ``draws`` has region2, month, ibmr, tenths and the array ``draws``.
    Draws stay in arrays and meet only where they differ: cells and scenarios are short rows, each
    distinct pair of salinities of a region, month and group is compared once, and three numbers
    travel back to the cells. Fails where a cell has two salinities of a scenario.
    """
    long = _scenario_cells(salinities, draws, scenarios, base)
    biomass = F.transform("draws", lambda d: F.expm1(d.cast("double")))
    if clamp_at_zero:
        biomass = F.transform(biomass, lambda b: F.when(b < 0, 0.0).otherwise(b))
    held = draws.select(*WHERE, "tenths", biomass.alias("biomass"))
    pairs = long.select(*WHERE, "base_tenths", "tenths").distinct()
    compared = join_null_safe(pairs, held, [*WHERE, "tenths"])
    compared = join_null_safe(
        compared, held.withColumnsRenamed({"tenths": "base_tenths", "biomass": "base_biomass"}), [*WHERE, "base_tenths"]
    )
    relative = F.array_sort(F.array_compact(F.zip_with("biomass", "base_biomass", ratio)))
    bands = compared.withColumn("relative", relative).select(
        *WHERE, "base_tenths", "tenths", *[array_quantile(F.col("relative"), p).alias(label) for label, p in BAND.items()]
    )
    return _bands_to_cells(long, bands, scenarios)


def _row_quantiles(sorted_rows: np.ndarray, probs: Sequence[float]) -> list[np.ndarray]:
    """Quantiles by linear interpolation of each row, which is in order with what is missing last; NaN if all is."""
    n = (~np.isnan(sorted_rows)).sum(axis=1)
    row, out = np.arange(len(sorted_rows)), []
    for p in probs:
        position = np.maximum(n - 1, 0) * p
        low, high = (sorted_rows[row, f(position).astype(int)] for f in (np.floor, np.ceil))
        with np.errstate(invalid="ignore"):
            between = low + (high - low) * (position - np.floor(position))
        out.append(np.where(low == high, low, between))
    return out


def ratio_bands(
    pairs: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    own: tuple[str, str],
    base: tuple[str, str],
    clamp_at_zero: bool = True,
    n: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """``pairs`` with the median and 95 % band of biomass at the point ``own`` over biomass at ``base`` (columns of predictors).

    A group's draws of the 20 weights are one small matrix in the task that meets the group; both points of a pair are evaluated
    against it, in blocks, and only three numbers leave. Draws are seeded by group, so the result is that of drawing
    every point first. Draws of 0 over 0 are missing, other draws over 0 infinite. ``keys`` are the columns of a group.
    """
    keys, columns = list(keys), pairs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict = {}
        for batch in batches:
            bands = np.full((len(batch), len(BAND)), np.nan)
            for key, at in batch_groups(batch, keys):
                model = batch.iloc[at[0]]
                if key not in weights:
                    weights[key] = coefficient_draws(model, n, seed)
                surface = Surface.of(model)
                for start in range(0, len(at), BLOCK):
                    some = at[start : start + BLOCK]
                    part = batch.iloc[some]
                    over, under = (
                        np.expm1(surface.basis(part[x].to_numpy(float), part[d].to_numpy(float)) @ weights[key])
                        for x, d in (own, base)
                    )
                    if clamp_at_zero:
                        over, under = np.maximum(over, 0.0), np.maximum(under, 0.0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        relative = np.sort(over / under, axis=1)
                    bands[some] = np.column_stack(_row_quantiles(relative, list(BAND.values())))
            yield batch[columns].assign(**dict(zip(BAND, bands.T)))

    schema = T.StructType([*pairs.schema, *[T.StructField(label, T.DoubleType()) for label in BAND]])
    banded = with_fits(pairs, fits, keys).mapInPandas(run, schema)
    return banded.select(*columns, *[F.nanvl(label, F.lit(None).cast("double")).alias(label) for label in BAND])


def scenario_ratio_fitted(
    salinities: DataFrame,
    fits: DataFrame,
    grid: DataFrame,
    scenarios: Sequence[str],
    base: str = "sal_base",
    x: tuple[str, str] = ("salsurf_s", "doy_s"),
    clamp_at_zero: bool = True,
    n: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """The ratios of ``scenario_ratio`` straight from fitted surfaces (by ibmr and region2): no draw is stored or shuffled.

    ``grid`` (region2, month, tenths and both predictors) says where the model holds; a salinity outside it has no result.
    """
    long = settle(_scenario_cells(salinities, fits, scenarios, base), "cells")  # read twice, and far fewer than what was summed
    pairs = long.select(*WHERE, "base_tenths", "tenths").distinct()
    point = grid.select("region2", "month", "tenths", F.col(x[0]).alias("own_x"), F.col(x[1]).alias("own_day"))
    other = point.withColumnsRenamed({"tenths": "base_tenths", "own_x": "base_x", "own_day": "base_day"})
    met = attach(pairs, point, ["region2", "month", "tenths"], "inner")
    met = attach(met, other, ["region2", "month", "base_tenths"], "inner")
    bands = ratio_bands(met, fits, ["ibmr", "region2"], ("own_x", "own_day"), ("base_x", "base_day"), clamp_at_zero, n, seed)
    return _bands_to_cells(long, bands.drop("own_x", "own_day", "base_x", "base_day"), scenarios)


def missing_results(ratios: DataFrame, keys: Sequence[str] = ("region", "year", "month", "ibmr")) -> DataFrame:
    """For each cell and scenario: is there no result?"""
    medians = columns_like(ratios, ends="_median")
    long = lengthen(ratios.select(*keys, *medians), medians, "scenario", "zoop_change", suffix="_median")
    return long.select(*keys, "scenario", F.col("zoop_change").isNull().alias("missing"))


def draw_band(draws: DataFrame, column: str = "draws") -> DataFrame:
    """Median and 95 % band over the draws of each row."""
    ordered = draws.withColumn("__sorted", F.array_sort(F.transform(column, lambda d: d.cast("double"))))
    return ordered.select(
        *[c for c in draws.columns if c != column],
        *[array_quantile(F.col("__sorted"), p).alias(label) for label, p in BAND.items()],
    )


def draws_to_rows(draws: DataFrame, column: str = "draws") -> DataFrame:
    """One row per draw, numbered from 1."""
    kept = [c for c in draws.columns if c != column]
    return draws.select(*kept, F.posexplode(column).alias("draw", "fit")).withColumn("draw", F.col("draw") + 1)


def rows_to_draws(rows: DataFrame, keys: Sequence[str], column: str = "draws", n: int | None = None) -> DataFrame:
    """The inverse of ``draws_to_rows``: for each key an array with the value of draw i at place i, missing where there is none.

    The array is as long as the key's last draw, or ``n``, beyond which draws are refused. Values are merged by their numbers, so
    the order of rows does not matter; a draw that comes twice, or has a number below 1, fails. A row per draw and key is
    gathered at most, which is what an array holds.
    """
    keys = list(keys)
    last = F.max("draw") if n is None else F.lit(n)
    held = rows.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("draw").cast("int"), "fit"))).alias("__held"),
        F.count(F.lit(1)).alias("__n"), F.min("draw").alias("__first"), F.max("draw").alias("__last"), last.alias("__length"),
    )
    wrong = (F.col("__first") < 1) | (F.col("__last") > F.col("__length"))
    places = F.sequence(F.lit(1), F.when(wrong, F.raise_error(F.lit("a draw lies outside the array")).cast("int")).otherwise(F.col("__length").cast("int")))
    return held.select(*keys, F.transform(places, lambda i: F.try_element_at("__held", i)).alias(column))


# --- prediction grid ------------------------------------------------------------------


def salinity_grid(
    data: DataFrame,
    region: str = "region",
    quant: float = 0.99,
    lower_bound_tenths: int | None = None,
) -> DataFrame:
    """Months by salinity steps of 0.1, inside each month's central ``quant`` of the data.

    ``lower_bound_tenths`` starts the steps there when it is below the smallest salinity.
    """
    tail = (1 - quant) / 2
    limits = exact_quantiles(data, [region, "month"], "salsurf", {"l": tail, "u": 1 - tail})
    first = tenths(F.min("salsurf"))
    if lower_bound_tenths is not None:
        first = F.least(first, F.lit(lower_bound_tenths))
    span = data.groupBy(region).agg(first.alias("first"), tenths(F.max("salsurf")).alias("last"))
    steps = span.select(
        region,
        F.explode(F.sequence("first", "last")).alias("tenths"),
    )
    steps = steps.withColumn("month", F.explode(F.array(*[F.lit(m) for m in range(1, 13)])))
    salinity = F.col("tenths") / 10.0
    inside = attach(steps, limits, [region, "month"], "inner").filter(salinity.between(F.col("l"), F.col("u")))
    mid_month = F.make_date(F.lit(2001), F.col("month"), F.lit(15))  # a year without a leap day
    return inside.select(region, "month", F.dayofyear(mid_month).alias("doy"), "tenths", salinity.alias("salsurf"))
