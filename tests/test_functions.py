from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackish.functions import calendar, geometry, laws, numeric, strict, text


def value(spark, expr, **cols):
    frame = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return frame.select(expr.alias("v")).first()["v"]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), ("c", None)], "k string, v double")
    got = {
        r["k"]: tuple(r)[1:]
        for r in df.groupBy("k").agg(
            strict.strict_avg("v"), strict.strict_sum("v"), strict.strict_min("v"), strict.strict_max("v"), strict.strict_sd("v")
        ).collect()
    }
    assert got["a"] == (2.0, 4.0, 1.0, 3.0, pytest.approx(math.sqrt(2)))
    assert got["b"] == got["c"] == (None,) * 5


def test_membership_is_never_missing(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in df.select(strict.is_member("v", ["a"])).collect()] == [True, False]


@pytest.mark.parametrize(
    "x,base,want", [(1.0, 2.0, 0.5), (0.0, 0.0, None), (3.0, 0.0, math.inf), (-3.0, 0.0, -math.inf), (None, 1.0, None)]
)
def test_ratio(spark, x, base, want):
    df = spark.createDataFrame([(x, base)], "x double, b double")
    assert df.select(strict.ratio("x", "b")).first()[0] == want


def test_positive_log(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(strict.positive_log("v")).collect()] == [0.0, None, None, None]


@pytest.mark.parametrize(
    "date,wy,wday",
    [
        ("2020-10-01", 2021, 1),
        ("2019-10-01", 2020, 1),
        ("2020-09-30", 2020, 366),
        ("2019-09-30", 2019, 365),
        ("2020-01-01", 2020, 93),
        ("2019-12-31", 2020, 92),
    ],
)
def test_water_calendar(spark, date, wy, wday):
    df = spark.createDataFrame([(dt.date.fromisoformat(date),)], "d date")
    assert tuple(df.select(calendar.water_year(F.col("d")), calendar.water_day(F.col("d"))).first()) == (wy, wday)


def test_season_and_year(spark):
    df = spark.createDataFrame([(m, 2000) for m in (12, 1, 3, 8, 11)] + [(None, 2000)], "m int, y int")
    got = [tuple(r) for r in df.select(calendar.season(F.col("m")), calendar.season_year(F.col("m"), F.col("y"))).collect()]
    assert got == [("Winter", 2001), ("Winter", 2000), ("Spring", 2000), ("Summer", 2000), ("Fall", 2000), (None, 2000)]


def test_shifted_year_moves_only_the_start_month(spark):
    df = spark.createDataFrame([(dt.date(2000, m, 1),) for m in (11, 12)], "d date")
    assert [r[0] for r in df.select(calendar.shifted_year(F.col("d"))).collect()] == [2000, 2001]


def test_month_day_year(spark):
    df = spark.createDataFrame([("7/4/2012",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(calendar.month_day_year(F.col("t"))).collect()] == [dt.date(2012, 7, 4), None, None]


def test_local_clock_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            df = spark.sql(
                "SELECT timestamp_ntz'2024-07-01 19:30:15.5' AS n, make_timestamp(2024, 7, 1, 19, 30, 15.5, 'UTC') AS t"
            )
            clocks = [calendar.seconds_of_day(calendar.local_clock(df, c, "America/Phoenix")) for c in ("n", "t")]
            assert tuple(df.select(*clocks).first()) == (45015.5, 45015.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_text_helpers(spark):
    df = spark.createDataFrame([("A_UnID_UnID",), ("plain",), (None,)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(text.remove_first(t, "_UnID")).collect()] == ["A_UnID", "plain", None]
    assert [r[0] for r in df.select(text.remove_all(t, "_UnID")).collect()] == ["A", "plain", None]
    assert [r[0] for r in df.select(text.paste(F.lit("x"), t)).collect()] == ["x A_UnID_UnID", "x plain", "x NA"]
    assert [r[0] for r in df.select(text.recode(t, {"plain": "new"})).collect()] == ["A_UnID_UnID", "new", None]
    assert [r[0] for r in df.select(text.categorise(t, {"c": ("plain",)})).collect()] == [None, "c", None]
    assert value(spark, text.split_part(F.lit("a b c"), " ", 2, 1)) == "b c"
    assert value(spark, text.p_label(F.lit(0.0004))) == "< 0.001"
    assert value(spark, text.p_label(F.lit(0.12346))) == "0.1235"


def test_numeric_helpers(spark):
    assert value(spark, numeric.tenths(F.lit(1.25))) == 12  # half to even
    assert value(spark, numeric.signed_expm1(numeric.signed_log1p(F.lit(-3.0)))) == pytest.approx(-3.0)
    ordered = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 10)])
    got = [value(spark, numeric.array_quantile(ordered, p)) for p in (0.025, 0.5, 0.975)]
    assert got == pytest.approx([1.1, 3.0, 9.4])
    infinite = F.array(F.lit(math.inf), F.lit(math.inf))
    assert value(spark, numeric.array_quantile(infinite, 0.3)) == math.inf
    empty = F.array().cast("array<double>")
    assert value(spark, numeric.array_quantile(empty, 0.5)) is None
    assert value(spark, numeric.band_overlaps(F.lit(8.0), F.lit(2.0), 0.5, 6.0)) is True


def test_transverse_mercator(spark):
    def project(lon, lat, datum=geometry.WGS84):
        x, y = geometry.transverse_mercator(F.lit(lon), F.lit(lat), datum)
        return spark.range(1).select(x, y).first()

    assert tuple(project(-123.0, 0.0)) == pytest.approx((500000.0, 0.0), abs=1e-6)
    # On the central meridian the northing is the scaled length of the meridian arc.
    lat, f, a = math.radians(38.0), 1 / 298.257223563, 6378137.0
    e2 = f * (2 - f)
    phi = np.linspace(0, lat, 200001)
    speed = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.trapezoid(speed, phi)
    assert project(-123.0, 38.0)[1] == pytest.approx(0.9996 * arc, abs=1e-3)
    east, west = project(-121.5, 38.0), project(-124.5, 38.0)
    assert east[0] - 500000 == pytest.approx(500000 - west[0], abs=1e-6)
    assert project(-121.5, 38.0, geometry.NAD83)[0] == pytest.approx(east[0], abs=0.01)


def test_datum_shift(spark):
    def row(columns):
        return tuple(spark.range(1).select(*columns).first())

    # Published worked examples: geocentric metres of a point, and a similarity of seven parameters.
    lat, lon = 53 + 48 / 60 + 33.82 / 3600, 2 + 7 / 60 + 46.38 / 3600
    level = row(geometry.geocentric(F.lit(lon), F.lit(lat), geometry.WGS84))
    up = (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    assert [x + 73 * u for x, u in zip(level, up)] == pytest.approx([3771793.968, 140253.342, 5124304.349], abs=1e-3)
    wgs72 = geometry.Datum(6378135.0, 1 / 298.26, (0.0, 0.0, 4.5), (0.0, 0.0, 0.554), 0.219)
    point = [F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)]
    there = row(geometry.similarity(*point, wgs72))
    assert there == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    back = row(geometry.similarity(*[F.lit(v) for v in there], wgs72, inverse=True))
    assert back == pytest.approx((3657660.66, 255768.55, 5201382.11), abs=0.05)
    for datum in (geometry.WGS84, geometry.NAD83, geometry.NAD27):
        xyz = geometry.geocentric(F.lit(-121.7), F.lit(38.2), datum)
        assert row(geometry.geodetic(*xyz, datum)) == pytest.approx((-121.7, 38.2), abs=1e-10)


def test_tails():
    assert laws.f_tail(30.776834890730576, 2, 217) == pytest.approx(1.7e-12, rel=0.05)
    assert laws.t_tail(2.0, 10) == pytest.approx(0.036694017, abs=1e-8)
    assert laws.t_quantile(0.025, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert laws.f_tail(1.0, 1, 1) == pytest.approx(0.5, abs=1e-9)
    # Published 5 % points of the studentized range.
    for k, df, q in ((3, 10, 3.877), (5, 20, 4.232), (4, 217, 3.66)):
        assert laws.studentized_range_tail(q, laws.range_table(k), df) == pytest.approx(0.05, abs=1e-3)
    # For two means the range is the absolute t times root two.
    assert laws.studentized_range_tail(2.0 * math.sqrt(2), laws.range_table(2), 10) == pytest.approx(2 * 0.036694017, abs=1e-6)
