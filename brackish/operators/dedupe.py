"""One observation per station and day: the one nearest to noon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.calendar import NOON, local_clock, noon_distance, seconds_of_day
from brackish.functions.strict import present
from brackish.functions.text import paste
from brackish.operators.attach import join_null_safe

LOCAL_ZONE = "America/Phoenix"  # fixed value: a zone without daylight saving
STATION_DAY = ("station", "source", "date")


def with_noon_distance(df: DataFrame, zone: str = LOCAL_ZONE, instant: str = "datetime") -> DataFrame:
    """Add the local time of day and its distance to noon, both in seconds."""
    tod = seconds_of_day(local_clock(df, instant, zone))
    return df.withColumn("tod", tod).withColumn("noon_diff", noon_distance(F.col("tod")))


def nearest_noon(
    df: DataFrame,
    keys: Sequence[str] = STATION_DAY,
    variables: Sequence[str] = (),
    zone: str = LOCAL_ZONE,
    instant: str = "datetime",
) -> DataFrame:
    """Keep the rows nearest to noon in each group, the earlier time on a tie.

    Rows that agree in both are all kept. With ``variables`` the choice is made for each of
    them among the rows where it is not missing: a row stays if it is chosen for any, and
    the variables it is not chosen for are set to missing.

    The best time per group is a map-side aggregate of one number; rows then meet it on
    keys and time together. Both sides are shuffled for that, so AQE may split a group, or a
    pile of equal rows, of any size.
    """
    keys = list(keys)
    timed = with_noon_distance(df, zone, instant)
    # Distance in microseconds, doubled, plus one after noon: smaller is better.
    order = F.round(F.col("noon_diff") * 1e6).cast("bigint") * 2 + (F.col("tod") > NOON).cast("int")
    ranked = timed.withColumn("noon_order", order)
    best = {f"__best_{v}": F.when(F.col(v).isNotNull(), F.col("noon_order")) for v in variables}
    best = best or {"__best": F.col("noon_order")}
    chosen = ranked.groupBy(*keys).agg(*[F.min(c).alias(name) for name, c in best.items()])
    times = F.array_distinct(F.array_compact(F.array(*best)))
    chosen = chosen.select("*", F.explode(times).alias("noon_order"))
    # A row per station and day grows with the data: never to be broadcast.
    met = join_null_safe(ranked, chosen.hint("merge"), [*keys, "noon_order"], "inner")
    kept = {v: F.when(F.col(f"__best_{v}") == F.col("noon_order"), F.col(v)) for v in variables}
    return met.withColumns(kept).drop("noon_order", *best) if kept else met.drop("noon_order", *best)


def complete_observations(df: DataFrame, place: Sequence[str]) -> DataFrame:
    """Observations with time and place, the station named with its source."""
    usable = present(df, ["datetime", "date", *place])
    return usable.withColumn("station", paste(F.col("source"), F.col("station")))


def by_variable(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Long rows (variable, value) of the values present."""
    ids = [c for c in df.columns if c not in variables]
    return df.unpivot(ids, list(variables), "variable", "value").filter(F.col("value").isNotNull())
