"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(c: Column) -> Column:
    """Integer key of a value rounded to one decimal (half to even)."""
    return F.bround(c * 10).cast("int")


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_expm1(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def band_overlaps(mean: Column, spread: Column, low: float, high: float) -> Column:
    """Does mean +- spread touch [low, high]?"""
    return (mean - spread <= high) & (mean + spread >= low)


def interpolate(low: Column, high: Column, weight: Column) -> Column:
    """Value between two neighbours; equal neighbours are returned as they are,
    so that two infinities do not turn into NaN."""
    return F.when(low == high, low).otherwise((1 - weight) * low + weight * high)


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of an already sorted array without NULL."""
    position = (F.size(ordered) - 1) * F.lit(p)
    at = F.floor(position).cast("int")
    low = F.get(ordered, at)
    high = F.get(ordered, F.ceil(position).cast("int"))
    return F.when(F.size(ordered) > 0, interpolate(low, high, position - at))
