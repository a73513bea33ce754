from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackish.functions.geometry import NAD27, NAD83, WGS84
from brackish.operators import biomass, dedupe, hydro, indices, numbering, regression, reshape, scenario, spatial, summaries
from brackish.operators.attach import attach, duplicated_keys, expect_rows, expect_unique, shared_left_join
from brackish.operators.densify import complete, expand_grid
from brackish.operators.quantiles import exact_quantiles
from brackish.session import settle


# --- joins ----------------------------------------------------------------------------


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_attach_small_and_large_agree(spark, rows, threshold, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, v string")
    right = settle(spark.createDataFrame([(1, 10), (None, 20), (2, 30)], "k int, w int"), "t")
    got = rows(attach(left, right, ["k"], how))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if how == "left_semi":
        assert got == [(1, "a"), (1, "a"), (2, "b"), (None, "c")]
    else:
        matched = [(1, "a", 10), (1, "a", 10), (2, "b", 30), (None, "c", 20)]
        want = matched + ([(4, "d", None)] if how == "left" else [])
        assert sorted(got, key=str) == sorted(want, key=str)


def test_natural_join_and_guards(spark, rows):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "k int, s string, v int")
    right = spark.createDataFrame([(1, "a", True), (2, None, False)], "k int, s string, f boolean")
    assert rows(shared_left_join(left, right)) == [(1, "a", 5, True), (2, None, 6, False)]
    with pytest.raises(ValueError):
        shared_left_join(left, right.toDF("x", "y", "z"))
    twice = left.union(left)
    assert duplicated_keys(twice, ["k"]).count() == 2
    assert rows(expect_unique(left, ["k"], "twice")) == rows(left)
    looked = jobs_of(spark, lambda: expect_unique(twice, ["k"], "twice"))
    assert looked == 0  # the guard rides on the query that reads the rows
    with pytest.raises(Exception, match="twice"):
        expect_unique(twice, ["k"], "twice").collect()
    with pytest.raises(Exception, match="too small"):
        expect_rows(left, F.col("v") > 5, "too small").select("k").collect()
    assert expect_rows(left, F.col("v") >= 5, "too small").count() == 2


def jobs_of(spark, work):
    """How many jobs a piece of work starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    work()
    after = len(sc.statusTracker().getJobIdsForGroup("counted"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return after - before


# --- densify and reshape --------------------------------------------------------------


def test_complete_nested_levels_and_fill(spark, rows):
    df = spark.createDataFrame([(1, "Winter", 2000, 5), (6, "Summer", 2001, None)], "m int, s string, y int, n int")
    dense = complete(df, [("m", "s"), "y"], fill={"n": 0})
    assert rows(dense) == [(1, "Winter", 2000, 5), (1, "Winter", 2001, 0), (6, "Summer", 2000, 0), (6, "Summer", 2001, 0)]
    by_level = complete(df, ["s", "y"], levels={"s": ["Winter", "Fall"]})
    assert rows(by_level.select("s", "y")) == [("Fall", 2000), ("Fall", 2001), ("Winter", 2000), ("Winter", 2001)]


def test_complete_within_groups(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "g string, x int, y int")
    assert {r["g"]: r["count"] for r in complete(df, ["x", "y"], within=["g"]).groupBy("g").count().collect()} == {"a": 4, "b": 1}


def test_expand_grid(spark):
    grid = expand_grid(spark, a=["x", "y"], b=range(3))
    assert grid.columns == ["a", "b"] and grid.distinct().count() == 6


def test_reshape_round_trip(spark, rows):
    df = spark.createDataFrame([(1, 2, None), (2, 3, 4)], "id int, n_a int, n_b int")
    long = reshape.lengthen(df, ["n_a", "n_b"], "name", "n", prefix="n_")
    assert rows(long) == [(1, "a", 2), (1, "b", None), (2, "a", 3), (2, "b", 4)]
    assert rows(reshape.widen(long, ["id"], "name", ["n"], ["a", "b"])) == [(1, 2, None), (2, 3, 4)]
    assert reshape.columns_like(df, contains="N_") == ["n_a", "n_b"]
    assert reshape.columns_like(df, starts="n_", negate=True) == ["id"]
    assert reshape.columns_like(df, ends="_b") == ["n_b"]
    assert reshape.relocate(df, "n_b").columns == ["n_b", "id", "n_a"]
    doubled = reshape.across(df, ["n_a"], {"twice": lambda c: c * 2})
    assert rows(doubled, "n_a_twice") == [(4,), (6,)]
    tagged = reshape.union_tagged({"p": df, "q": df.drop("n_b")}, "src")
    assert tagged.filter("src = 'q' AND n_b IS NULL").count() == 2
    assert rows(reshape.set_difference(df.select("id"), df.select("id").filter("id = 1"))) == [(2,)]
    assert reshape.group_all_but(df, "n_a").count().count() == 2


# --- quantiles and summaries ----------------------------------------------------------


@pytest.mark.parametrize("accuracy", [20_000, 200])
def test_exact_quantiles(spark, accuracy):
    rng = random.Random(3)
    data = [("hot", float(rng.randint(0, 50))) for _ in range(4000)]
    data += [("wide", rng.lognormvariate(0, 3)) for _ in range(3000)]
    data += [("one", 7.0), ("gap", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    probs = {"lo": 0.005, "q1": 0.25, "med": 0.5, "u": 0.975, "max": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy).collect()}
    assert set(got) == {"hot", "wide", "one", None}
    for g, r in got.items():
        values = [v for k, v in data if k == g and v is not None]
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_box_and_histogram(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 5.0)], "g string, v double")
    box = {r["g"]: r for r in summaries.box_summary(df, ["g"], "v").collect()}
    assert (box["a"]["median"], box["a"]["whisker_high"], box["a"]["n_outliers"], box["a"]["n"]) == (3.0, 4.0, 1, 5)
    assert rows(summaries.box_outliers(df, ["g"], "v")) == [("a", 100.0)]
    hist = summaries.histogram(df, ["g"], "v", 3)
    assert rows(hist.select("g", "bin", "n")) == [("a", 1, 4), ("a", 2, 0), ("a", 3, 1), ("b", 1, 2)]
    assert rows(hist.filter("g = 'a'"), "bin_low", "bin_high")[0] == (-23.75, 25.75)  # centred on the smallest value
    edges = spark.createDataFrame([("c", v) for v in (0.0, 1.0, 1.0, 1.5, 4.0)], "g string, v double")
    assert [r.n for r in summaries.histogram(edges, ["g"], "v", 3).orderBy("bin").collect()] == [3, 1, 1]  # upper edges inside
    assert rows(summaries.histogram(edges, ["g"], "v", 1), "bin", "n") == [(1, 5)]
    assert rows(summaries.band(df.limit(1), "v", "v"), "ymin", "ymax") == [(0.0, 2.0)]


# --- noon -----------------------------------------------------------------------------


def _at(hour, minute=0):
    # Local noon is 19:00 UTC.
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour + 7, minutes=minute)


def test_nearest_noon_ties(spark, rows):
    data = [
        ("s", "x", 1, _at(11), 1.0),  # as far as 13:00, earlier: kept
        ("s", "x", 2, _at(13), 2.0),
        ("s", "x", 3, _at(11), 3.0),  # the same time: kept too
        ("s", "y", 4, _at(18), None),
        (None, "z", 5, _at(9), 5.0),  # missing keys make a group
    ]
    df = spark.createDataFrame(data, "source string, station string, id int, datetime timestamp_ntz, v double")
    df = df.withColumn("date", F.lit(dt.date(2024, 1, 1)))
    assert rows(dedupe.nearest_noon(df), "id") == [(1,), (3,), (4,), (5,)]
    by_value = dedupe.nearest_noon(df, variables=["v"])
    assert rows(by_value, "id", "v") == [(1, 1.0), (3, 3.0), (5, 5.0)]


def test_noon_choice_is_made_per_variable(spark, rows):
    data = [("s", "x", _at(12), None, 1.0), ("s", "x", _at(15), 2.0, 3.0)]
    df = spark.createDataFrame(data, "source string, station string, datetime timestamp_ntz, a double, b double")
    df = df.withColumn("date", F.lit(dt.date(2024, 1, 1)))
    long = dedupe.by_variable(dedupe.nearest_noon(df, variables=["a", "b"]), ["a", "b"])
    assert rows(long, "variable", "value") == [("a", 2.0), ("b", 1.0)]


def test_hot_pile_of_equal_rows_is_kept_and_split(spark):
    """A third of all rows in one station-day, all at one time."""
    hot = spark.range(20000).select(F.lit("s").alias("source"), F.lit("hot").alias("station"), F.lit(12).alias("h"), "id")
    cold = spark.range(40000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("station"), F.lit(9).alias("h"), "id")
    df = hot.union(cold).withColumns(
        {"date": F.lit(dt.date(2024, 1, 1)), "datetime": F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.col("h") + 7, F.lit(0), F.lit(0))}
    ).repartition(6)
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = dedupe.nearest_noon(df)
        assert len(kept.select("id").collect()) == 60000
        plan = kept.select("id")
        plan.collect()
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


# --- space ----------------------------------------------------------------------------


def _square(name, x, y, size=10.0):
    return (name, [(x, y), (x + size, y), (x + size, y + size), (x, y + size)])


@pytest.fixture(scope="module")
def squares(spark):
    return spark.createDataFrame(
        [_square("west", 0.0, 0.0), _square("east", 10.0, 0.0), ("notch", [(0.0, 20.0), (10.0, 20.0), (10.0, 30.0), (5.0, 22.0), (0.0, 30.0)])],
        "subregion string, ring array<struct<x: double, y: double>>",
    )


@pytest.mark.parametrize("cell", [3.0, 10.0, 100.0, None])
def test_locate(spark, rows, squares, cell):
    points = spark.createDataFrame(
        [(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 50.0, 5.0), (4, 5.0, 26.0), (5, 2.0, 24.0), (6, None, 1.0)], "id int, x double, y double"
    )
    got = rows(spatial.locate(points, squares, cell=cell), "id", "subregion")
    assert got == [(1, "west"), (2, "east"), (2, "west"), (3, None), (4, None), (5, "notch"), (6, None)]
    inside = rows(spatial.assign_subregion(points, squares, cell=cell), "id", "subregion")
    assert inside == [(1, "west"), (2, "east"), (2, "west"), (5, "notch")]
    assert rows(spatial.assign_subregion(points, squares, cell=cell, keep=["east"]), "id") == [(2,)]


def test_cells_follow_from_the_polygons(spark):
    """Thirty polygons of 20 km have some thousand cells each at most, whatever the unit of their coordinates."""
    corners = [(0, 0), (20000, 0), (20000, 20000), (0, 20000), (0, 0)]
    rings = [(f"r{i}", [(float(x + 20000 * i), float(y)) for x, y in corners]) for i in range(30)]
    polygons = spark.createDataFrame(rings, "subregion string, ring array<struct<x: double, y: double>>")
    assert spatial.cell_cover(polygons, spatial.cell_size(polygons)).count() <= 30 * 34 * 34


def test_strict_standardising(spark, rows):
    years = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "year int, index double")
    matrix = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "year int, taxon double")
    assert [r.index_s for r in regression.taxa_long(matrix, years).collect()] == [None] * 3
    whole = regression.taxa_long(matrix, years.where("year < 3"))
    assert whole.where("year = 3 AND index_s IS NOT NULL").isEmpty()
    grid = spark.createDataFrame([(4.0,)], "v double")
    reference = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert rows(biomass.standardise(grid, reference, ["v"]), "v_s") == [(2.0,)]


def test_datum_check(spark, rows):
    # A position in the older datum lies some 90 m further west here: a station east of a border by less than that changes sides.
    stations = spark.createDataFrame([("a", -122.0, 38.0), ("far", -100.0, 38.0), ("none", None, 38.0)], "station string, lon double, lat double")
    named = [("here", WGS84), ("old", NAD27), ("own", NAD83)]
    place = stations.where("station = 'a'")
    at = {n: spatial.with_grid_position(place, "lon", "lat", d).select("east", "north").first() for n, d in named}
    assert 80 < at["here"].east - at["old"].east < 100 and abs(at["old"].north - at["here"].north) < 30
    assert 0.5 < math.dist(at["own"], at["here"]) < 2.5
    border = (at["old"].east + at["here"].east) / 2
    box = lambda left, right: [(x, y) for x, y in ((left, 4e6), (right, 4e6), (right, 5e6), (left, 5e6))]
    squares = spark.createDataFrame(
        [("west", box(border - 1e4, border)), ("east", box(border, border + 1e4))], "subregion string, ring array<struct<x:double,y:double>>"
    )
    got = rows(spatial.datum_check(stations, squares, dict(named)), "station", "subregion_here", "subregion_old", "subregion_own")
    side = lambda e: "west" if e < border else "east"
    assert got == [("a", *(side(at[n].east) for n, _ in named)), ("far", None, None, None), ("none", None, None, None)]
    assert got[0][1] != got[0][2]
    kept = spatial.assign_subregion(stations, squares, "lon", "lat", datum=NAD27)
    assert rows(kept, "station", "subregion") == [("a", got[0][2])] and kept.first().lon == -122.0


# --- indices --------------------------------------------------------------------------


def test_outliers_are_one_sided(spark, rows):
    data = [("a", float(v)) for v in [0, 1] * 200] + [("a", 100.0), ("a", -100.0), ("flat", 1.0), ("flat", 1.0), ("single", 1.0)]
    df = spark.createDataFrame(data, "g string, value double")
    kept = indices.drop_high_outliers(df, ["g"])
    assert kept.count() == 401 and kept.filter("value = -100").count() == 1 and kept.filter("g <> 'a'").count() == 0


def test_seasonal_means_strict_and_relaxed(spark):
    data = [("t", m, "Spring", "r", y, 1.0 * m, 1) for y in (2000, 2001) for m in (3, 4, 5) if (y, m) != (2001, 4)]
    monthly = spark.createDataFrame(data, "variable string, month int, season string, region string, year int, month_mean double, n long")
    strict_means = {r["year"]: (r["value"], r["n"]) for r in indices.seasonal_means(monthly, "region").collect()}
    assert strict_means == {2000: (4.0, 3), 2001: (None, 2)}
    relaxed = {r["year"]: r["value"] for r in indices.seasonal_means(monthly, "region", "relaxed").collect()}
    assert relaxed == {2000: 4.0, 2001: 4.0}


def test_roll_up_years_needs_all_seasons(spark):
    data = [("t", s, r, 2000, 2.0, 1) for s in ("Winter", "Spring") for r in ("n", "s") if (s, r) != ("Spring", "s")]
    seasonal = spark.createDataFrame(data, "variable string, season string, region string, year int, value double, n long")
    got = {r["region"]: r["value"] for r in indices.roll_up(seasonal, "year", "region").collect()}
    assert got == {"n": 2.0, "s": None}
    assert indices.roll_up(seasonal, "season", "region", (1975, 1999)).count() == 0


def test_arguments_are_checked(spark):
    df = spark.range(1)
    for bad in ({"region": "some"}, {"kind": "month"}, {"month_na": "lax"}):
        with pytest.raises(ValueError):
            indices.seasonal_index(df, ["t"], df, df, **{"kind": "season", "month_na": "strict", **bad}) if "region" not in bad else indices.join_eligibility(df, df, bad["region"])


def test_study_eligibility(spark):
    table = indices.region_eligibility(indices.study_subregions(spark))
    assert table.count() == 120
    counts = {
        r["season"]: (r["l"], r["s"])
        for r in table.groupBy("season").agg(F.count_if("long_term").alias("l"), F.count_if("short_term").alias("s")).collect()
    }
    assert counts == {"Winter": (17, 25), "Spring": (18, 26), "Summer": (21, 29), "Fall": (18, 26)}


def test_effort_three_months_iff_strict_index(spark):
    rng = random.Random(1)
    data = [
        ("t", "sub", r, m, y, rng.random())
        for r in ("n", "s") for y in range(1990, 1996) for m in range(1, 13) for _ in range(2) if rng.random() < 0.8
    ]
    df = spark.createDataFrame(data, "variable string, x string, subregion string, month int, year int, value double")
    rows_ = indices.with_season(df)
    monthly = settle(indices.monthly_means(rows_, "subregion"), "m")
    eligibility = indices.region_eligibility(df, [], {})
    effort = indices.sampling_effort(monthly, eligibility, "All")
    strict_index = indices.seasonal_means(monthly, "subregion")
    joined = effort.join(strict_index.select("season", "subregion", "year", "value"), ["season", "subregion", "year"])
    assert joined.filter((F.col("n_months") == 3) != F.col("value").isNotNull()).count() == 0
    assert joined.count() == effort.count()


def test_salinity_field_fills_missing_deviation(spark):
    data = [("r", m, y, v) for y in (2000, 2001) for m in (3, 4, 5) for v in ((1.0, 3.0) if y == 2000 else (2.0,))]
    df = indices.with_season(spark.createDataFrame(data, "subregion string, month int, year int, value double"))
    field = {r["year"]: r for r in indices.salinity_field(df).collect()}
    assert field[2000]["sal_sd"] == field[2001]["sal_sd"] == pytest.approx(math.sqrt(2))
    flagged = indices.with_zone_flags(indices.salinity_field(df)).filter("low_sal AND low_sal_sd")
    assert flagged.count() == 2
    zone = indices.low_salinity_zone(indices.salinity_field(df), indices.region_eligibility(spark.createDataFrame([("q",)], "subregion string")))
    assert {(r["long_term"], r["short_term"]) for r in zone.collect()} == {(False, False)}


def test_index_table_and_wide(spark, rows):
    index = spark.createDataFrame([("a", "Winter", 2000, 1.5, 2), ("b", "Fall", 2000, 2.5, 3)], "variable string, season string, year int, value double, n long")
    table = indices.index_table(index, indices.season_frame(spark, (2000, 2001)), ["season", "year"], ["a", "b"])
    assert table.count() == 8
    assert rows(indices.index_wide(table, ["a", "b"], ["a_Winter", "b_Fall"])) == [(2000, 1.5, 2.5), (2001, None, None)]
    assert indices.index_wide(table, ["a"], ["a_Winter"]).columns == ["year", "a_Winter"]
    assert indices.sample_sizes(table, ["season", "year"], ["a", "b"]).filter("n = 3").first()["variable"] == "b"


# --- flows ----------------------------------------------------------------------------


def test_running_total_is_strict(spark, rows):
    days = [(dt.date(2019, 10, 1), 1.0), (dt.date(2019, 10, 2), None), (dt.date(2019, 10, 3), 2.0), (dt.date(2020, 10, 1), 4.0)]
    flow = hydro.water_year_flow(spark.createDataFrame(days, "date date, q double"), ["q"])
    assert rows(flow, "wy", "wdoy", "q_cum", "q_sum") == [(2020, 1, 1.0, None), (2020, 2, None, None), (2020, 3, None, None), (2021, 1, 4.0, 4.0)]
    assert rows(hydro.month_starts(flow)) == [("Oct", 1, 16)]


def test_drought_series(spark):
    classes = dict(zip(range(1995, 2003), "DDWWWNDD"))
    df = spark.createDataFrame(list(classes.items()), "year int, drought string")
    got = {r["year"]: (r["series_id"], r["series_year"], r["series_year2"]) for r in hydro.drought_series(df).collect()}
    assert got == {
        1995: (1, 1, "1"), 1996: (1, 2, "2"), 2001: (2, 1, "1"), 2002: (2, 2, "2"), 2000: (3, 1, "1"),
        1997: (4, 1, "1"), 1998: (4, 2, "2"), 1999: (4, 3, "3+"),
    }


def test_flow_shares_end_at_one(spark):
    days = [(dt.date(2019, 10, 1) + dt.timedelta(days=i), float(i + 1)) for i in range(60)]
    flow = hydro.water_year_flow(spark.createDataFrame(days, "date date, q double"), ["q"])
    series = spark.createDataFrame([(2020, "D")], "year int, drought string")
    shares = hydro.with_flow_share(hydro.flow_with_series(flow, series), "q")
    last = shares.orderBy(F.desc("date")).first()
    assert last["q_cum_share"] == pytest.approx(1.0)
    assert shares.agg(F.sum("q_share")).first()[0] == pytest.approx(1.0)


def test_fill_down(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, None)], "k string, t int, v int")
    assert rows(hydro.fill_down(df, "v", ["k"], ["t"])) == [("a", 1, 5), ("a", 2, 5), ("b", 1, None)]


# --- biomass --------------------------------------------------------------------------

SAMPLE = "sampleid string, station string, source string, sizeclass string, taxlifestage string, ord string, cpue double, salsurf double, date date, year int, x double, y double"


def _samples(spark, *items):
    rest = (1.0, dt.date(2000, 6, 1), 2000, 1.0, 1.0)
    return spark.createDataFrame([(f"s{i}", "st", *item, *rest) for i, item in enumerate(items)], SAMPLE)


def test_net_and_order_rules(spark, rows):
    df = _samples(
        spark,
        ("EMP", "Meso", "Keratella Adult", "Calanoida", 1.0),  # better in the other net
        ("EMP", "Micro", "Keratella Adult", "Calanoida", 1.0),
        ("EMP", "Meso", "Limnoithona tetraspina Adult", "Calanoida", 1.0),  # not on the list as written
        ("EMP", "Meso", "Gammarus Adult", "Amphipoda", 1.0),
        ("EMP", "Macro", "Neomysis Adult", "Mysida", 1.0),
        ("EMP", "Macro", "Hyperacanthomysis longirostris Adult", "Mysida", 1.0),
        ("EMP", "Meso", "Other Adult", None, 1.0),
    )
    kept = rows(df.filter(biomass.net_rule(biomass.BiomassRules())), "sampleid")
    assert kept == [("s1",), ("s2",), ("s5",)]
    lenient = rows(df.filter(biomass.net_rule(biomass.BiomassRules(keep_null_order=True))), "sampleid")
    assert lenient == [("s1",), ("s2",), ("s5",), ("s6",)]


def test_biomass_choice_and_gear_rule(spark, rows):
    df = _samples(
        spark,
        ("EMP", "Micro", "A Adult_UnID", "Calanoida", 2.0),
        ("STN", "Meso", "B Adult", "Calanoida", 3.0),  # group in both nets: this survey is out
        ("EMP", "Meso", "B Adult", "Calanoida", 3.0),
        ("STN", "Meso", "C Adult", "Calanoida", 4.0),
        ("STN", "Macro", "Hyperacanthomysis longirostris Adult", "Mysida", 9.0),
        ("STN", "Meso", "Unweighed Adult", "Calanoida", 4.0),
    )
    weights = spark.createDataFrame([("A Adult", 10.0), ("B Adult", 1.0), ("C Adult", 2.0)], "taxlifestage string, carbonweight_ug double")
    mysids = spark.createDataFrame([("s4", "Hyperacanthomysis longirostris Adult", "Macro", 77.0)], "sampleid string, taxlifestage string, sizeclass string, bpue_mysid double")
    groups = spark.createDataFrame([("A Adult", "g"), ("B Adult", "g"), ("B Adult", "g"), ("C Adult", "h")], "taxlifestage string, ibmr string")
    got = biomass.plankton_biomass(df, weights, mysids, groups)
    assert rows(got, "sampleid", "ibmr", "bpue") == [("s0", "g", 20.0), ("s2", "g", 3.0), ("s3", "h", 8.0), ("s4", None, 77.0)]


def test_mysid_union(spark, rows):
    a = spark.createDataFrame([(dt.date(2000, 1, 2), "N1", 0.5)], f"sampledate date, stationnz string, `{biomass.MYSID}` double")
    b = spark.createDataFrame([("MONT", "3/4/2001", "STN", 1.0)], f"station string, sampledate string, project string, `{biomass.MYSID}` double")
    assert rows(biomass.mysid_union(a, b), "sampleid", "bpue_mysid") == [("EMP N1 2000-01-02", 500.0), ("STN Mont 2001-03-04", 1000.0)]


def test_covariates_sizes_and_composition(spark, rows):
    data = [("s1", "st", "r", 1.0, dt.date(2000, 1, 5), 2000, 1, "c1", 3.0), ("s1", "st", "r", 1.0, dt.date(2000, 1, 5), 2000, 1, "c2", 1.0),
            ("s2", "st", "r", 3.0, dt.date(2000, 1, 7), 2000, 1, "c1", 4.0)]
    df = spark.createDataFrame(data, "sampleid string, station string, subregion string, salsurf double, date date, year int, month int, category string, bpue double")
    cov = biomass.with_covariates(df).agg(F.avg("salsurf_s"), F.stddev_samp("doy_s")).first()
    assert cov[0] == pytest.approx(0, abs=1e-12) and cov[1] == pytest.approx(1)
    assert rows(biomass.sample_size(df), "mean_bpue", "samplesize") == [(4.0, 2)]
    assert rows(biomass.composition(df), "category", "bpue", "prop") == [("c1", 7.0, 0.875), ("c2", 1.0, 0.125)]


# --- scenarios ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def correction_inputs(spark):
    conversions = spark.createDataFrame([("g", m, t, t * 0.1) for m in (6, 7) for t in range(0, 50)], "ibmr string, month int, tenths int, fit double")
    data = spark.createDataFrame([("g", 6, 1.0, math.log(3)), ("g", 7, 2.0, math.log(3)), ("g", 7, 9.0, 0.0)], "ibmr string, month int, salsurf double, bpue_log1p double")
    return data, conversions


def test_salinity_correction(spark, rows, correction_inputs):
    data, conversions = correction_inputs
    target = spark.createDataFrame([(6, 2.0, 1.0), (7, 2.0, 2.0)], "month int, a double, b double")
    got = {(r["month"], r["salsurf"], r["scenario"]): r["bpue_adj"] for r in scenario.salinity_correction(data, conversions, target, ["a", "b"], [6, 7]).collect()}
    assert got[(6, 1.0, "a")] == pytest.approx(3 * math.exp(1.0) - 1)
    assert got[(6, 1.0, "b")] == pytest.approx(2.0)
    assert got[(7, 2.0, "a")] == pytest.approx(2.0)
    assert got[(7, 9.0, "a")] is None and len(got) == 6
    summary = scenario.corrected_summary(scenario.salinity_correction(data, conversions, target, ["a"], [6, 7]))
    assert rows(summary.filter("month = 7"), "bpue_sum", "bpue_sd") == [(None, None)]
    keyed = data.select(scenario.tenths(F.col("salsurf")).alias("tenths"))
    assert rows(scenario.out_of_range(keyed, conversions)) == [(90,)]


def test_correction_guards(spark, correction_inputs):
    data, conversions = correction_inputs
    missing = spark.createDataFrame([(6, 2.0), (7, 99.0)], "month int, a double")
    with pytest.raises(Exception, match="missing"):
        scenario.salinity_correction(data, conversions, missing, ["a"], [6, 7])
    twice = spark.createDataFrame([(6, 2.0), (6, 2.1), (7, 2.0)], "month int, a double")
    with pytest.raises(Exception, match="more than once"):
        scenario.salinity_correction(data, conversions, twice, ["a"], [6, 7])


def test_scenario_ratio_and_missing(spark, rows):
    wide = spark.createDataFrame([("r", 2000, 6, 0.0, 0.1, None), ("r", 2001, 6, 0.2, 0.1, 9.0)], "region string, year int, month int, sal_base double, sal_a double, sal_b double")
    salinities = scenario.scenario_salinities(wide).withColumn("region2", F.col("region"))
    draws = spark.createDataFrame(
        [("r", 6, "g", 0, [math.log(2.0), math.log(0.5), math.log(3.0)]), ("r", 6, "g", 1, [math.log(3.0), math.log(2.0), math.log(0.5)]), ("r", 6, "g", 2, [0.0, 0.0, math.log(2.0)])],
        "region2 string, month int, ibmr string, tenths int, draws array<double>",
    )
    ratios = scenario.scenario_ratio(salinities, draws, ["sal_base", "sal_a", "sal_b"])
    got = {r["year"]: r for r in ratios.collect()}
    # Base draws 1, 0 (clamped), 2; scenario draws 2, 1, 0: ratios 2, infinite, 0.
    assert got[2000]["sal_a_median"] == pytest.approx(2.0) and got[2000]["sal_a_u95"] == math.inf
    assert got[2000]["sal_b_median"] == pytest.approx(1.0)  # falls back to the base; 0/0 is left out
    assert got[2001]["sal_b_median"] is None  # out of range
    missing = rows(scenario.missing_results(ratios).filter("missing"), "year", "scenario")
    assert missing == [(2001, "sal_b")]


def test_draw_band_and_rows(spark, rows):
    df = spark.createDataFrame([(1, [10.0, 1.0, 3.0, 2.0, 4.0])], "k int, draws array<double>")
    assert rows(scenario.draw_band(df)) == [(1, pytest.approx(1.1), 3.0, pytest.approx(9.4))]
    assert rows(scenario.draws_to_rows(df), "draw", "fit")[0] == (1, 10.0)


def test_salinity_grid(spark):
    data = spark.createDataFrame([("r", 1, t / 10) for t in range(5, 26)], "region string, month int, salsurf double")
    grid = scenario.salinity_grid(data, quant=1.0)
    assert grid.count() == 21 and grid.first()["doy"] == 15
    assert scenario.salinity_grid(data, quant=1.0, lower_bound_tenths=0).count() == 21


def test_scenario_means(spark, rows):
    df = spark.createDataFrame([(dt.datetime(2022, 6, 1), 1.0, 2.0), (dt.datetime(2022, 6, 2), 1.25, 3.0), (dt.datetime(2022, 6, 3), 9.0, None)], "datetime timestamp_ntz, a_bn_x double, a_bn_y double")
    assert rows(scenario.scenario_means(df)) == [(6, 1.1, 2.5)]


# --- numbering ------------------------------------------------------------------------


def test_row_numbers_of_ties_and_groups(spark, rows):
    data = [("a", 3), ("b", 1), ("a", None), ("b", 1), ("b", 2), (None, 5)] + [("z", 7)] * 500
    df = spark.createDataFrame(data, "g string, v int").repartition(7)
    got = numbering.number_rows(df, ["g", "v"]).collect()
    assert sorted(r.number for r in got) == list(range(1, len(data) + 1))
    order = [(r.g, r.v) for r in sorted(got, key=lambda r: r.number)]
    assert order[:6] == [(None, 5), ("a", None), ("a", 3), ("b", 1), ("b", 1), ("b", 2)]
    within = numbering.number_rows(df, ["v"], "place", within=["g"], descending=["v"], start=0)
    assert within.columns == ["g", "v", "place"]
    assert rows(within.filter("g = 'b' OR g IS NULL")) == [("b", 1, 1), ("b", 1, 2), ("b", 2, 0), (None, 5, 0)]
    assert sorted(r.place for r in within.filter("g = 'z'").collect()) == list(range(500))
    assert numbering.number_rows(df.filter("v > 99"), ["v"]).count() == 0


def test_hot_value_is_numbered_in_more_than_one_task(spark, monkeypatch):
    """A pile of equal rows is dealt into several ranges."""
    written = []
    monkeypatch.setattr(numbering, "settle", lambda df, label: written.append(settle(df, label)) or written[-1])
    numbered = numbering.number_rows(spark.range(20_000).select(F.lit(1).alias("k")), ["k"])
    assert numbered.agg(F.count_distinct("number"), F.max("number")).first()[:] == (20_000, 20_000)
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("__at", numbering.PLACE_BITS).alias("part")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000


def test_first_seen_order(spark, rows):
    data = [(1, "x"), (2, None), (3, "base"), (4, "y"), (5, "x"), (6, "base")]
    df = spark.createDataFrame(data, "at int, name string").repartition(3)
    assert rows(numbering.first_seen(df, "name", ["at"], baseline=["base"])) == [("x", 1, 1), ("y", 4, 2)]
    assert rows(numbering.first_seen(df, "name", ["at"])) == [("base", 3, 2), ("x", 1, 1), ("y", 4, 3)]


def test_few_statistics_are_broadcast(spark):
    """Settled statistics: the raw rows meet them without a shuffle of their own."""
    df = settle(spark.range(5000).selectExpr("id % 3 AS g", "double(id % 17) AS value"), "rows")
    kept = indices.drop_high_outliers(df, ["g"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_rows_beyond_whiskers_are_not_dealt_by_group(spark, rows):
    """Settled quartiles: no task has to read what all others found in a group."""
    df = settle(spark.range(5000).selectExpr("id % 3 AS g", "IF(id < 6, 1e6 + id, double(id % 17)) AS value"), "rows")
    far = summaries.box_outliers(df, ["g"], "value")
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(rows(far)) == [(i % 3, 1e6 + i) for i in (0, 3, 1, 4, 2, 5)]


def test_rows_are_not_dealt_by_group_of_taxa(spark, rows):
    """Which groups are in both nets is settled: their rows meet it by broadcast."""
    data = [("both", "Micro", "EMP"), ("both", "Meso", "FMWT"), ("one", "Micro", "FMWT"), (None, None, "FMWT")]
    df = settle(spark.createDataFrame(data, "ibmr string, sizeclass string, source string"), "rows")
    kept = biomass.same_gear_only(df)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan
    assert rows(kept) == rows(df.where("NOT (ibmr <=> 'both' AND source = 'FMWT')"))


def test_targets_outside_the_model_come_in_order(spark):
    target = spark.createDataFrame([(1, 9.1, 1.0), (2, 1.0, 1.1), (3, 8.0, None)], "month int, a double, b double")
    covered = spark.createDataFrame([(6, t) for t in (10, 11)] + [(1, 80)], "month int, tenths int")
    got = scenario.targets_out_of_range(target, ["a", "b"], covered, [6, 7]).collect()
    assert [(r.scenario, r.outside) for r in got] == [("a", [80, 91])]
