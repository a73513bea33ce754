from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackish.functions.laws import f_tail
from brackish.operators import anova, regression, scenario, surface
from brackish.session import settle

# Published two-factor tables: sums of squares, degrees of freedom and F.
TABLES = {
    "Regional_Drought": ((24.295357884747887, 2, 30.776834890730576), (51.95626977206456, 4, 32.90854046889625), (85.65033863469421, 217)),
    "Regional_Year": ((87.99067773076258, 46, 15.072702286691337), (51.37078974914979, 4, 101.19721044358018), (21.95501878867923, 173)),
    "Seasonal_Drought": ((13.3397914261801, 2, 10.076625976194444), (3107.5382371899022, 3, 1564.9170476749102), (112.52598577182998, 170)),
    "Seasonal_Year": ((61.74506305172605, 46, 2.6376465648325205), (3096.0193297998467, 3, 2027.937673228947), (64.12071414628399, 126)),
}
PARTIAL_R2 = {
    "Regional_Drought": (0.220976, 0.377571), "Regional_Year": (0.800310, 0.700583),
    "Seasonal_Drought": (0.105984, 0.965055), "Seasonal_Year": (0.490563, 0.979710),
}


def test_partial_r2_and_p_of_published_tables(spark):
    data = []
    for model, (a, b, (rss, rdf)) in TABLES.items():
        for name, (ss, df, f) in (("a", a), ("b", b)):
            assert (ss / df) / (rss / rdf) == pytest.approx(f, rel=1e-12)
            assert f_tail(f, df, rdf) < 0.001
            data.append((model, name, ss))
        data.append((model, "Residuals", rss))
    table = spark.createDataFrame(data, "model string, parameter string, sum_sq double")
    got = {(r["model"], r["parameter"]): r["partial_r2"] for r in anova.partial_r2(table).collect()}
    for model, (a, b) in PARTIAL_R2.items():
        assert got[(model, "a")] == pytest.approx(a, abs=1e-6) and got[(model, "b")] == pytest.approx(b, abs=1e-6)


@pytest.fixture(scope="module")
def two_factor(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.choice(list("DNW"), n, p=[0.5, 0.3, 0.2]), rng.choice(list("pqrs"), n)
    effect = {"D": 1.0, "N": 0.0, "W": -1.0, "p": 0.0, "q": 0.02, "r": 3.0, "s": 6.0}
    y = 1000 + np.array([effect[i] + effect[j] for i, j in zip(a, b)]) + rng.normal(0, 1, n)
    pdf = pd.DataFrame({"a": a, "b": b, "y": y})
    return pdf, spark.createDataFrame(pdf)


def _rss(pdf, *factors):
    x = np.hstack([np.ones((len(pdf), 1)), *[pd.get_dummies(pdf[f], drop_first=True).to_numpy(float) for f in factors]])
    beta = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    return float(((pdf["y"] - x @ beta) ** 2).sum()), x, beta


def test_anova_against_row_level_fits(spark, two_factor):
    pdf, df = two_factor
    cells = anova.settled_cells(df, "y", {"m": ("a", "b")})
    table = {r["parameter"]: r for r in anova.anova2(cells).collect()}
    rss, x, _ = _rss(pdf, "a", "b")
    assert table["Residuals"]["sum_sq"] == pytest.approx(rss, rel=1e-9)
    assert table["Residuals"]["df"] == len(pdf) - x.shape[1] and table["Residuals"]["f_value"] is None
    assert table["a"]["sum_sq"] == pytest.approx(_rss(pdf, "b")[0] - rss, rel=1e-9)
    assert table["b"]["sum_sq"] == pytest.approx(_rss(pdf, "a")[0] - rss, rel=1e-9)
    stacked = {r["parameter"]: r["p_text"] for r in anova.anova_stack(anova.anova2(cells, {"m": ("A", "B")})).collect()}
    assert stacked == {"A": "< 0.001", "B": "< 0.001", "Residuals": None}


def test_residuals_are_orthogonal(spark, two_factor):
    _, df = two_factor
    cells = anova.settled_cells(df, "y", {"m": ("a", "b")})
    out = anova.fitted_residuals(df, cells, "y", "m", "a", "b")
    for key in ("a", "b"):
        for r in out.groupBy(key).agg(F.sum("resid").alias("s")).collect():
            assert r["s"] == pytest.approx(0, abs=1e-6)


def test_marginal_means_and_letters(spark, two_factor):
    pdf, df = two_factor
    cells = anova.settled_cells(df, "y", {"m": ("a", "b")})
    got = anova.marginal_means(cells).toPandas().set_index(["factor", "level"])
    rss, x, beta = _rss(pdf, "a", "b")
    # Level D: intercept plus the mean of the effects of the other factor.
    contrast = np.array([1, 0, 0, 0.25, 0.25, 0.25])
    assert got.loc[("a", "D"), "emmean"] == pytest.approx(contrast @ beta, rel=1e-9)
    v = np.linalg.inv(x.T @ x) * rss / (len(pdf) - x.shape[1])
    assert got.loc[("a", "D"), "se"] == pytest.approx(math.sqrt(contrast @ v @ contrast), rel=1e-6)
    assert got.loc[("a", "D"), "max_y"] == pdf.loc[pdf["a"] == "D", "y"].max()
    letters = got["letters"].to_dict()
    assert [letters[("a", k)] for k in "WND"] == ["a", "b", "c"]
    assert letters[("b", "p")] == letters[("b", "q")] == "a" and letters[("b", "s")] == "c"


def test_compact_letters():
    different = np.zeros((3, 3), dtype=bool)
    different[0, 2] = different[2, 0] = True
    assert anova.compact_letters(different) == ["a", "ab", "b"]


def test_grouped_lm_and_residuals(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=40)
    y = 2 + 3 * x + rng.normal(size=40)
    data = [("g", float(a), float(b)) for a, b in zip(x, y)] + [("g", None, 1.0), ("g", 1.0, None), ("line", 0.0, 1.0), ("line", 1.0, 2.0)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    models = regression.with_p_values(regression.grouped_lm(df, ["k"], "y", "x"))
    r = models.filter("k = 'g'").first()
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - intercept - slope * x
    sigma = math.sqrt((resid**2).sum() / 38)
    sxx = ((x - x.mean()) ** 2).sum()
    assert (r["n"], r["slope"], r["intercept"]) == (40, pytest.approx(slope), pytest.approx(intercept))
    assert r["sigma"] == pytest.approx(sigma) and r["se_slope"] == pytest.approx(sigma / math.sqrt(sxx))
    assert r["se_intercept"] == pytest.approx(sigma * math.sqrt(1 / 40 + x.mean() ** 2 / sxx))
    assert r["p_f"] == pytest.approx(r["p_slope"])
    assert models.filter("k = 'line'").first()["sigma"] is None
    out = regression.lm_residuals(df, models, ["k"], "y", "x").filter("k = 'g'")
    assert out.count() == 40 and out.agg(F.sum("resid")).first()[0] == pytest.approx(0, abs=1e-9)


def test_taxa_long_scales_years_once(spark):
    matrix = spark.createDataFrame([(2000, 1.0, None), (2001, 2.0, 5.0), (2002, 0.0, 6.0)], "year int, a double, b double")
    years = spark.createDataFrame([(2000, 1.0, "D"), (2001, 2.0, "N"), (2002, 3.0, "W")], "year int, index double, drought string")
    long = regression.taxa_long(matrix, years)
    assert long.count() == 6
    assert sorted({round(r["index_s"], 9) for r in long.collect()}) == [-1.0, 0.0, 1.0]
    y = regression.response(F.col("taxa"), F.col("bpue"), ("b",))
    got = {(r["year"], r["taxa"]): r["y"] for r in long.withColumn("y", y).collect()}
    assert got[(2001, "b")] == 5.0 and got[(2000, "a")] == 0.0 and got[(2002, "a")] is None


# --- surfaces ---------------------------------------------------------------------------


def test_spline_bases():
    natural = surface.Spline.even(0.0, 10.0, 7)
    x = np.linspace(-2, 12, 200)
    b = natural.basis(x)
    assert np.allclose(b.sum(axis=1), 1)
    assert np.allclose(b @ np.linspace(0.0, 10.0, 7), x, atol=1e-9)  # straight lines are kept
    cyclic = surface.Spline.even(0.0, 366.0, 6, cyclic=True)
    assert np.allclose(cyclic.basis(np.array([0.0])), cyclic.basis(np.array([366.0])))
    eps = 1e-5
    left, right = cyclic.basis(np.array([366.0 - eps])), cyclic.basis(np.array([eps]))
    middle = cyclic.basis(np.array([0.0]))
    assert np.allclose((middle - left) / eps, (right - middle) / eps, atol=1e-5)


@pytest.fixture(scope="module")
def surface_data(spark):
    rng = np.random.default_rng(5)
    frames = []
    for group, stations in (("many", 12), ("single", 1)):
        n = 3000
        sal, doy = rng.uniform(0, 10, n), rng.integers(1, 366, n)
        year, station = rng.choice([2000, 2001, 2002], n), rng.integers(0, stations, n)
        truth = 3 + np.sin(sal / 3) + np.cos(2 * np.pi * doy / 366)
        shift = rng.normal(0, 1, stations)[station] if stations > 1 else 0
        y = truth + shift + 0.3 * (year - 2001) + rng.normal(0, 0.3, n)
        frames.append(pd.DataFrame({"ibmr": group, "station": station.astype(str), "year": year.astype("int32"), "doy": doy.astype("int32"), "salsurf": sal, "bpue_log1p": y}))
    return spark.createDataFrame(pd.concat(frames)).repartition(5)




@pytest.fixture(scope="module")
def fits(spark, surface_data):

    return settle(surface.response_surface(surface_data), "fits")


def _grid(spark):
    cells = [(g, d, s) for g in ("many", "single") for d in range(15, 360, 30) for s in np.arange(0.5, 10, 1.0).tolist()]
    return spark.createDataFrame(cells, "ibmr string, doy int, salsurf double")


def test_surface_recovers_a_known_shape(spark, fits):
    got = surface.surface_terms(_grid(spark), fits).toPandas()
    for group in ("many", "single"):
        part = got[got["ibmr"] == group]
        truth = np.sin(part["salsurf"] / 3) + np.cos(2 * np.pi * part["doy"] / 366)
        error = (part["fit"] - part["fit"].mean()) - (truth - truth.mean())
        assert np.abs(error).max() < 0.2
        assert (part["se"] > 0).all() and part["se"].max() < 0.5
    fitted = {r["ibmr"]: r for r in fits.collect()}
    assert fitted["single"]["station_ridge"] is None or math.isnan(fitted["single"]["station_ridge"])
    for r in fitted.values():
        assert math.sqrt(r["sigma2"]) == pytest.approx(0.3, abs=0.05)


def test_station_elimination_equals_full_system(spark, surface_data):
    """Summed elimination of station intercepts against the whole ridge system at once."""
    only = surface_data.filter("ibmr = 'many'")
    design = surface.surface_design(only, ["ibmr"], ("salsurf", "doy"))
    shape = surface.Surface.of(design.first())
    pdf = only.toPandas()
    x = shape.design(pdf["salsurf"].to_numpy(), pdf["doy"].to_numpy(), pdf["year"].to_numpy())
    z = pd.get_dummies(pdf["station"]).to_numpy(float)
    y = pdf["bpue_log1p"].to_numpy()
    ridge = 10.0
    full = np.hstack([x, z])
    penalty = np.zeros((full.shape[1], full.shape[1]))
    penalty[shape.size :, shape.size :] = ridge * np.eye(z.shape[1])
    penalty[: shape.size, : shape.size] = sum(shape.penalties())
    want = np.linalg.solve(full.T @ full + penalty, full.T @ y)[: shape.size]

    sums = settle(surface.surface_sums(only, design, ["ibmr"], ("salsurf", "doy"), "bpue_log1p"), "sums")
    m = np.array(sums.where(F.col("kind") == surface.GROUP).first()["sums"]).reshape(shape.size + 2, -1)
    s = surface.station_corrections(sums.where(F.col("kind") == surface.STATION), ["ibmr"], ridges=[ridge]).first()["sums"]
    m = m - np.array(s[:-2]).reshape(shape.size + 2, -1)
    p = shape.size
    got = np.linalg.solve(m[:p, :p] + sum(shape.penalties()), m[:p, p])
    assert np.allclose(got, want, atol=1e-8)


def test_station_sums_are_dealt_by_station(spark):
    """Sums by hand of groups with a missing key and a hot station; no row is made for each number of a sum."""
    rng = np.random.default_rng(6)
    groups = [("a", 1), ("a", None), (None, 1)]
    rows = []
    for g, r in groups:
        for i in range(400):
            station = "hot" if i % 3 == 0 else f"s{i % 40}"
            rows.append((g, r, station, 2000 + i % 3, float(rng.uniform(0, 9)), float(rng.uniform(1, 365)), float(rng.normal())))
    rows += [("a", 1, None, 2000, 1.0, 1.0, 1.0), ("a", 1, "s1", 2000, None, 1.0, 1.0)]  # left out
    df = spark.createDataFrame(rows, "g string, r int, station string, year int, s double, d double, y double").repartition(3)
    design = settle(surface.surface_design(df, ["g", "r"], ("s", "d")), "design")
    plans = []
    for most in (50_000, 20):
        sums = surface.surface_sums(df, design, ["g", "r"], ("s", "d"), "y", most)
        plans.append(sums._jdf.queryExecution().optimizedPlan().toString())
        got = {(x.g, x.r, x.kind, x.station): np.array(x.sums) for x in sums.collect()}
        want = {}
        shapes = {(x.g, x.r): surface.Surface.of(x) for x in design.collect()}
        for g, r, station, year, s, d, y in rows[:-2]:
            full = np.append(shapes[g, r].design([s], [d], [year])[0], [y, 1.0])
            for key, part in (((g, r, surface.STATION, station), full), ((g, r, surface.GROUP, None), np.outer(full, full).ravel())):
                want[key] = want.get(key, 0) + part
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)
    assert all("RebalancePartitions" in p and "Generate" not in p for p in plans)


def test_knots_follow_uneven_data(spark):
    """Knots at quantiles of the distinct values, per group of two keys; groups with few values get even ones."""
    rng = np.random.default_rng(2)
    dense = [round(float(v), 2) for v in np.concatenate([rng.uniform(0, 1, 900), rng.uniform(9, 10, 30)])]
    rows = [("a", 1, v) for v in dense] + [("a", 2, v) for v in (1.0, 3.0, 3.0)] + [("b", None, 5.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, r int, x double")
    got = {(r.g, r.r): r.knots for r in surface.place_knots(df, ["g", "r"], "x").collect()}
    assert got["a", 1] == pytest.approx(np.quantile(np.unique(dense), np.linspace(0, 1, 5)).tolist())
    assert got["a", 1][3] < 1.0 < got["a", 1][4]
    assert got["a", 2] == [1.0, 1.5, 2.0, 2.5, 3.0] and got["b", None] == [5.0, 5.25, 5.5, 5.75, 6.0]


def test_fits_of_several_keys_recover_their_own_shapes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for region, sign in ((0, 1.0), (1, -1.0)):
        x = np.concatenate([rng.uniform(0, 4, 800), rng.uniform(4, 10, 400)])  # spread unevenly
        for i, v in enumerate(x):
            day = int(rng.integers(1, 366))
            y = 5 + sign * np.sin(v / 3) + 0.2 * np.cos(2 * np.pi * day / 365) + rng.normal(0, 0.1)
            rows.append(("g", region, f"s{i % 7}", 2000 + i % 3, day, float(v), float(y)))
    df = spark.createDataFrame(rows, "ibmr string, region2 int, station string, year int, doy int, salsurf double, bpue_log1p double")
    keys = ["ibmr", "region2"]
    fits = settle(surface.response_surface(df, keys), "fits")
    assert fits.count() == 2
    grid = [("g", r, d, v) for r in (0, 1) for d in (50, 200) for v in np.linspace(0.2, 9.5, 30).tolist()]
    grid = spark.createDataFrame(grid, "ibmr string, region2 int, doy int, salsurf double")
    got = surface.surface_terms(grid, fits, keys).toPandas()
    for region, sign in ((0, 1.0), (1, -1.0)):
        part = got[got["region2"] == region]
        truth = sign * np.sin(part["salsurf"] / 3) + 0.2 * np.cos(2 * np.pi * part["doy"] / 365)
        error = (part["fit"] - part["fit"].mean()) - (truth - truth.mean())
        assert np.abs(error).max() < 0.25


def test_posterior_draws_match_their_moments(spark, fits):
    grid = _grid(spark).limit(40)
    one = surface.posterior_draws(grid, fits).toPandas()
    again = surface.posterior_draws(grid.repartition(3), fits).toPandas()
    key = ["ibmr", "doy", "salsurf"]
    a, b = one.sort_values(key), again.sort_values(key)
    assert np.allclose(np.vstack(a["draws"]), np.vstack(b["draws"]))  # seeded, wherever computed
    model = {r["ibmr"]: r for r in fits.collect()}
    for _, r in a.head(5).iterrows():
        m = model[r["ibmr"]]
        shape = surface.Surface.of(m)
        basis = shape.basis(np.array([r["salsurf"]]), np.array([r["doy"]]))[0]
        v = np.array(m["covariance"]).reshape(shape.terms, shape.terms)
        sd = math.sqrt(basis @ v @ basis)
        assert len(r["draws"]) == 1000
        assert np.mean(r["draws"]) == pytest.approx(basis @ np.array(m["beta"]), abs=5 * sd / math.sqrt(1000))
        assert np.std(r["draws"]) == pytest.approx(sd, rel=0.15)


# --- ratios from fits ---------------------------------------------------------------------


def _made_fit(spark, level):
    """A fit with known weights and a known covariance, of one group in two regions."""
    rng = np.random.default_rng(4)
    size = 5 * 4
    rows = []
    for region in (0, 1):
        root = rng.normal(0, 0.05, (size, size))
        beta = level + rng.normal(0, 0.5, size)
        rows.append(("g", region, beta.tolist(), (root @ root.T).ravel().tolist(), [0.0, 1.0, 2.0, 4.0, 8.0],
                     [0.0, 90.0, 180.0, 270.0, 365.0], [2000]))
    schema = "ibmr string, region2 int, beta array<double>, covariance array<double>, sal_knots array<double>, day_knots array<double>, years array<int>"
    return spark.createDataFrame(rows, schema)


def _scenarios(spark):
    salinities, grid = [], []
    for region in (0, 1):
        for month in (1, 7):
            grid += [(region, month, t, t / 10, 30.0 * month) for t in range(0, 80)]
            for scenario, t in (("sal_base", 10), ("sal_a", 35 + month), ("sal_b", 10 if region else 90)):
                salinities.append((region, 2001, month, scenario, t, region))
    return (
        spark.createDataFrame(salinities, "region int, year int, month int, scenario string, tenths int, region2 int"),
        spark.createDataFrame(grid, "region2 int, month int, tenths int, salsurf_s double, doy_s double"),
    )


NAMES = ("sal_base", "sal_a", "sal_b")


def test_ratio_of_a_normal_fit_has_the_closed_form(spark):
    """At a high level the ratio is the exponential of a normal difference of two basis rows."""
    fits, (salinities, grid) = _made_fit(spark, 15.0), _scenarios(spark)
    got = scenario.scenario_ratio_fitted(salinities, fits, grid, NAMES, n=20_000).collect()
    model = {r.region2: r for r in fits.collect()}
    assert len(got) == 4
    for r in got:
        shape = surface.Surface.of(model[r.region])
        day = 30.0 * r.month
        points = shape.basis(np.array([1.0, (35 + r.month) / 10]), np.array([day, day]))
        change = points[1] - points[0]
        size = shape.terms
        mean = change @ np.array(model[r.region].beta)
        sd = math.sqrt(change @ np.array(model[r.region].covariance).reshape(size, size) @ change)
        assert math.log(r.sal_a_median) == pytest.approx(mean, abs=0.05 * sd)
        assert math.log(r.sal_a_l95) == pytest.approx(mean - 1.96 * sd, abs=0.08 * sd)
        assert math.log(r.sal_a_u95) == pytest.approx(mean + 1.96 * sd, abs=0.08 * sd)
        assert r.sal_base_median == r.sal_base_l95 == r.sal_base_u95 == 1.0
        # outside the grid there is no result; the same salinity as the base is no change
        assert r.sal_b_median is None if r.region == 0 else r.sal_b_median == 1.0


@pytest.mark.parametrize("level", [3.0, 0.05, -0.5])
def test_ratios_from_fits_are_those_of_stored_draws(spark, level):
    """With zero biomass on either side too: both ways share draws and rules."""
    fits, (salinities, grid) = _made_fit(spark, level), _scenarios(spark)
    points = grid.withColumn("ibmr", F.lit("g"))
    draws = surface.posterior_draws(points, fits, ["ibmr", "region2"], ("salsurf_s", "doy_s"), n=200)
    stored = scenario.scenario_ratio(salinities, draws.select("region2", "month", "ibmr", "tenths", "draws"), NAMES)
    direct = scenario.scenario_ratio_fitted(salinities, fits, grid, NAMES, n=200)
    assert sorted(stored.columns) == sorted(direct.columns)
    order = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    for a, b in zip(order(stored), order(direct), strict=True):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9)), (a, b)


def test_cells_with_two_salinities_fail(spark):
    salinities, grid = _scenarios(spark)
    twice = salinities.union(salinities.limit(1).withColumn("tenths", F.lit(77)))
    with pytest.raises(Exception, match="more than one value: salinity of sal_base"):
        scenario.scenario_ratio_fitted(twice, _made_fit(spark, 3.0), grid, NAMES, n=10).collect()
    same = salinities.union(salinities.limit(1))
    assert scenario.scenario_ratio_fitted(same, _made_fit(spark, 3.0), grid, NAMES, n=10).count() == 4


def test_draws_to_rows_and_back(spark):
    rows = [("a", [1.0, None, 3.0]), ("b", [2.0]), ("c", [])]
    df = spark.createDataFrame(rows, "k string, draws array<double>")
    long = scenario.draws_to_rows(df)
    back = scenario.rows_to_draws(long.repartition(3), ["k"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", [1.0, None, 3.0]), ("b", [2.0])]
    gap = scenario.rows_to_draws(long.where("fit IS NOT NULL AND draw <> 1"), ["k"], n=4)
    assert [tuple(r) for r in gap.collect()] == [("a", [None, None, 3.0, None])]
    with pytest.raises(Exception, match="outside the array"):
        scenario.rows_to_draws(long, ["k"], n=2).collect()
    with pytest.raises(Exception):
        scenario.rows_to_draws(long.union(long), ["k"]).collect()


def test_smooth_curve(spark):
    x = np.arange(1, 367)
    y = 100 + 50 * np.sin(x / 40)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y + rng.normal(0, 5, len(x))}))
    got = surface.smooth_curves(df, ["k"], "x", "y").toPandas()
    assert len(got) == 80
    assert np.abs(got["fit"] - (100 + 50 * np.sin(got["x"] / 40))).max() < 5
