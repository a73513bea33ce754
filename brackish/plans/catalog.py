"""The registered queries: each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.functions.calendar import SEASONS, shifted_year
from brackish.functions.geometry import NAD27, NAD83, WGS84
from brackish.functions.numeric import signed_expm1, signed_log1p
from brackish.functions.text import level_order, remove_all, split_part
from brackish.operators import anova, biomass, dedupe, hydro, indices, numbering, regression, scenario, spatial, summaries, surface
from brackish.operators.attach import attach, shared_left_join
from brackish.operators.reshape import relocate, union_tagged
from brackish.plans import views
from brackish.plans.views import snapped
from brackish.session import fresh_path, settle
from brackish.sources.readers import (
    header_names,
    read_after_preamble,
    read_by_headers,
    read_table,
    survey_observations,
    surveys_of,
)
from brackish.sources.writers import write_and_continue, write_observations, write_table

VARIABLES = ("temperature", "secchi", "salinity")
YEARS = range(1995, 2003)

# --- water quality ----------------------------------------------------------------------


def nearest_noon(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.complete_observations(views.obs_t(spark, d), ["x", "y"])
    kept = dedupe.by_variable(dedupe.nearest_noon(rows, variables=["temperature"]), ["temperature"])
    return snapped(kept.select("source", "station", "date", "obs_id", "value", "tod", "noon_diff"))


def drop_high_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = views.placed_obs(spark, d).select("source", "station", "date", "subregion", "secchi")
    return indices.drop_high_outliers(rows, ["subregion"], "secchi", limit=1.5)


def season_year(spark: SparkSession, d: str) -> DataFrame:
    rows = indices.with_season(views.obs(spark, d))
    out = rows.groupBy("season", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("secchi").alias("secchi"))
    return snapped(out)


def season_levels(spark: SparkSession, d: str) -> DataFrame:
    """Counts in the order of the seasons, not of their names."""
    rows = indices.with_season(views.obs(spark, d))
    order = level_order(F.col("season"), SEASONS)
    counts = rows.groupBy("season", order.alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("ord")


def _eligibility(spark: SparkSession, d: str) -> DataFrame:
    regions = views.region_map(spark, d)
    cells = indices.region_eligibility(regions, views.SHORT_TERM_NATIONS, views.SEASONAL_NATIONS)
    return cells.join(regions, "subregion")


def _index(spark: SparkSession, d: str, kind: str, month_na: str) -> DataFrame:
    return indices.seasonal_index(
        views.obs(spark, d), VARIABLES, views.polygons(spark, d), _eligibility(spark, d), "all", kind, month_na
    )


def seasonal_index_strict(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_index(spark, d, "season", "strict"))


def seasonal_index_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_index(spark, d, "season", "relaxed"))


def yearly_index(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_index(spark, d, "year", "relaxed"))


def _index_table(spark: SparkSession, d: str) -> DataFrame:
    index = settle(_index(spark, d, "season", "relaxed"), "index")
    frame = indices.season_frame(spark, (YEARS[0], YEARS[-1]))
    return indices.index_table(index, frame, ["season", "year"], VARIABLES)


def index_table_multi(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_index_table(spark, d))


def index_table_year(spark: SparkSession, d: str) -> DataFrame:
    """Yearly indices on every region and year, sample sizes beside them."""
    index = settle(_index(spark, d, "year", "relaxed"), "index")
    frame = indices.region_frame(views.region_map(spark, d), (YEARS[0], YEARS[-1]))
    return snapped(indices.index_table(index, frame, ["region", "year"], VARIABLES))


def index_window(spark: SparkSession, d: str) -> DataFrame:
    """The seasonal index of some of the years."""
    rows = _rows(spark, d, "secchi")
    return snapped(indices.index_of_rows(rows, _eligibility(spark, d), "all", "season", "relaxed", years=(1996, 1998)))


def index_n_long(spark: SparkSession, d: str) -> DataFrame:
    return indices.sample_sizes(_index_table(spark, d), ["season", "year"], VARIABLES)


def index_wide(spark: SparkSession, d: str) -> DataFrame:
    columns = ["temperature_Summer", "temperature_Fall", "secchi_Fall", "salinity_Winter"]
    return snapped(indices.index_wide(_index_table(spark, d), VARIABLES, columns))


def _rows(spark: SparkSession, d: str, *variables: str) -> DataFrame:
    return indices.usable_observations(views.obs(spark, d), variables, views.polygons(spark, d))


def salinity_field(spark: SparkSession, d: str) -> DataFrame:
    return snapped(indices.salinity_field(_rows(spark, d, "salinity")))


def salinity_zone_flags(spark: SparkSession, d: str) -> DataFrame:
    return snapped(indices.with_zone_flags(indices.salinity_field(_rows(spark, d, "salinity"))))


def low_salinity_zone(spark: SparkSession, d: str) -> DataFrame:
    return indices.low_salinity_zone(indices.salinity_field(_rows(spark, d, "salinity")), _eligibility(spark, d))


def seasonal_index_zone(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, *VARIABLES)
    field = indices.salinity_field(rows.filter("variable = 'salinity'"))
    zone = indices.low_salinity_zone(field, _eligibility(spark, d)).join(views.region_map(spark, d), "subregion")
    return snapped(indices.index_of_rows(rows.filter("variable <> 'salinity'"), zone, "lsz"))


def region_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return indices.region_eligibility(views.placed_obs(spark, d), views.SHORT_TERM_NATIONS, views.SEASONAL_NATIONS)


def _effort(rows: DataFrame, eligibility: DataFrame) -> DataFrame:
    monthly = settle(indices.monthly_means(rows, "subregion"), "effort")
    return indices.sampling_effort(monthly, eligibility.drop("region"), "All")


def sampling_effort(spark: SparkSession, d: str) -> DataFrame:
    return _effort(_rows(spark, d, "temperature", "secchi"), _eligibility(spark, d))


def effort_min(spark: SparkSession, d: str) -> DataFrame:
    return indices.effort_min(sampling_effort(spark, d))


def effort_vs_index(spark: SparkSession, d: str) -> DataFrame:
    rows, eligibility = _rows(spark, d, "temperature", "secchi"), _eligibility(spark, d)
    index = indices.index_of_rows(rows, eligibility, "all")
    return indices.effort_disagreement(indices.effort_min(_effort(rows, eligibility)), index)


def effort_vs_relaxed_index(spark: SparkSession, d: str) -> DataFrame:
    """Seasons that have an index although a month of some sub-region was not sampled."""
    rows, eligibility = _rows(spark, d, "temperature", "secchi"), _eligibility(spark, d)
    index = indices.index_of_rows(rows, eligibility, "all", month_na="relaxed")
    return indices.effort_disagreement(indices.effort_min(_effort(rows, eligibility)), index)


def assign_subregion(spark: SparkSession, d: str) -> DataFrame:
    return spatial.assign_subregion(views.obs_t(spark, d), views.polygons(spark, d)).select("obs_id", "subregion")


DATUMS = {"wgs84": WGS84, "nad83": NAD83, "nad27": NAD27}


def assign_subregion_projected(spark: SparkSession, d: str) -> DataFrame:
    """Sub-regions of observations given by longitude and latitude, the polygons in metres of another datum."""
    rows = views.on_earth(views.obs_t(spark, d))
    placed = spatial.assign_subregion(rows, views.grid_polygons(spark, d), "lon", "lat", datum=WGS84)
    return placed.select("obs_id", "subregion")


def seasonal_index_projected(spark: SparkSession, d: str) -> DataFrame:
    """The relaxed index of one variable from longitude and latitude in an older datum."""
    index = indices.seasonal_index(
        views.on_earth(views.obs(spark, d)), ["salinity"], views.grid_polygons(spark, d), _eligibility(spark, d),
        "all", "season", "relaxed", place=("lon", "lat"), datum=NAD27,
    )
    return snapped(index)


def datum_check(spark: SparkSession, d: str) -> DataFrame:
    stations = spatial.station_counts(views.on_earth(views.obs(spark, d)), ["station", "lon", "lat"])
    return spatial.datum_check(stations, views.grid_polygons(spark, d), DATUMS).drop("lon", "lat")


def datum_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return spatial.unmatched(datum_check(spark, d), [f"subregion_{n}" for n in DATUMS])


def grid_positions(spark: SparkSession, d: str) -> DataFrame:
    """Easting and northing of each station under each datum, in centimetres."""
    out = views.on_earth(views.obs(spark, d)).select("station", "lon", "lat").distinct()
    for label, datum in DATUMS.items():
        out = spatial.with_grid_position(out, "lon", "lat", datum, names=(f"east_{label}", f"north_{label}"))
    return snapped(out.drop("lon", "lat"), 2)


def survey_years(spark: SparkSession, d: str) -> DataFrame:
    """Observations stored by survey, read back for two surveys and some years: folders and rows are pruned by the scan."""
    path = fresh_path(spark, "surveys")
    write_observations(views.obs(spark, d), path)
    rows = survey_observations(spark, path, ("A", "N"), end_year=1998)
    return snapped(rows.groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("secchi").alias("secchi")))


def survey_long_term(spark: SparkSession, d: str) -> DataFrame:
    """The same for the surveys that a filter on a dimension table leaves: folders are pruned when the query runs."""
    path = fresh_path(spark, "surveys")
    write_observations(views.obs(spark, d), path)
    marked = settle(views.surveys(spark, d), "survey-list").filter("short_of_third > 0")
    rows = surveys_of(spark.read.parquet(path), marked)
    return snapped(rows.groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("salinity").alias("salinity")))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").select(*LINE_ORDER, "l_returnflag")


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every order line with its number by date, order and line, over all and within its survey from the latest on."""
    over_all = numbering.number_rows(_lines(spark, d), LINE_ORDER)
    within = numbering.number_rows(over_all, LINE_ORDER, "place", within=["l_returnflag"], descending=LINE_ORDER)
    return within.select("l_orderkey", "l_linenumber", "number", "place")


def first_seen_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations in the order in which they first appear, two of them as baseline left out."""
    return numbering.first_seen(_lines(spark, d), "l_suppkey", LINE_ORDER, baseline=[1, 2])


def region_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their sub-region's region by a join on the columns both tables share."""
    nations = views.table(spark, d, "nation").select(F.col("n_name").alias("subregion"), "n_nationkey")
    return relocate(shared_left_join(nations, views.region_map(spark, d)), "region", "subregion")


def shifted_years(spark: SparkSession, d: str) -> DataFrame:
    """Observations by the year that December opens."""
    rows = views.obs(spark, d).groupBy(shifted_year(F.col("date")).alias("yearadj"), "month")
    return snapped(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("secchi").alias("secchi")))


# --- flows --------------------------------------------------------------------------------


def _flow(spark: SparkSession, d: str) -> DataFrame:
    return hydro.water_year_flow(views.flow(spark, d), views.FLOWS)


def water_year_flow(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_flow(spark, d), 1)


def month_starts(spark: SparkSession, d: str) -> DataFrame:
    return hydro.month_starts(_flow(spark, d))


def drought_series(spark: SparkSession, d: str) -> DataFrame:
    return hydro.drought_series(views.year_types(spark, d))


def _named_flow(spark: SparkSession, d: str) -> DataFrame:
    series = hydro.drought_series(views.year_types(spark, d))
    return hydro.with_flow_share(hydro.flow_with_series(_flow(spark, d), series), "inflowtotal")


def flow_with_series(spark: SparkSession, d: str) -> DataFrame:
    columns = ["date", "wy", "wdoy", "drought", "series_id", "series_year", "series_year2"]
    shares = ["inflowtotal_share", "inflowtotal_cum_share"]
    return snapped(_named_flow(spark, d).select(*columns, *shares), 9)


def hydro_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Smooth hydrograph of each class and year in its run."""
    return surface.smooth_curves(
        _named_flow(spark, d), ["drought", "series_year2"], "wdoy", "inflowtotal_cum_share"
    )


# --- plankton -------------------------------------------------------------------------------

RULES = biomass.BiomassRules(
    excluded={"Meso": views.BETTER_IN_MICRO, "Micro": views.BETTER_IN_MESO},
    single_taxon=f"{views.MYSID_SPECIES} Adult",
    renamed={"MEDIUM Juvenile": "MEDIUM Adult"},
)
LENIENT_RULES = biomass.BiomassRules(
    excluded=RULES.excluded, single_taxon=RULES.single_taxon, renamed=RULES.renamed, keep_null_order=True
)


def _mysids(spark: SparkSession, d: str) -> DataFrame:
    return biomass.mysid_union(*views.mysid_surveys(spark, d), species=views.MYSID_SPECIES)


def mysid_union(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_mysids(spark, d))


def _biomass(spark: SparkSession, d: str, rules=RULES, **options) -> DataFrame:
    weights = biomass.carbon_weights(views.carbon(spark, d))
    return biomass.plankton_biomass(
        views.zoop(spark, d), weights, _mysids(spark, d), views.groups(spark, d), rules, **options
    )


def plankton_biomass(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_biomass(spark, d))


def plankton_biomass_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Rows of unknown order kept."""
    return snapped(_biomass(spark, d, LENIENT_RULES))


def _placed_biomass(spark: SparkSession, d: str, **options) -> DataFrame:
    rows = _biomass(spark, d, **options)
    placed = spatial.assign_subregion(rows, views.polygons(spark, d), positions=views.zoop(spark, d))
    return placed.withColumn("month", F.month("date"))


def biomass_covariates(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_placed_biomass(spark, d), "biomass")
    out = biomass.with_covariates(rows)
    return snapped(out.select("sampleid", "ibmr", "subregion", "month", "doy", "bpue_log1p", "salsurf_s", "doy_s"))


def sample_size(spark: SparkSession, d: str) -> DataFrame:
    merged = biomass.merge_regions(F.col("subregion"), ["NATION_0", "NATION_1"], "NATION_0+1")
    return snapped(biomass.sample_size(_placed_biomass(spark, d).withColumn("subregion", merged)))


def composition(spark: SparkSession, d: str) -> DataFrame:
    rows = _placed_biomass(spark, d, group="category", categories=biomass.CATEGORIES)
    return snapped(biomass.composition(rows.filter(F.col("year") >= 1996)))


# --- scenarios ------------------------------------------------------------------------------


def scenario_means(spark: SparkSession, d: str) -> DataFrame:
    return scenario.scenario_means(views.model_output(spark, d))


def _ordinary_biomass(spark: SparkSession, d: str) -> DataFrame:
    """Summer biomass of the below-normal years."""
    types = views.year_types(spark, d).select(F.col("year").alias("yearadj"), "yr_type")
    rows = _biomass(spark, d).withColumns(
        {
            "yearadj": shifted_year(F.col("date")),
            "month": F.month("date"),
            "bpue_log1p": F.log1p("bpue"),
        }
    )
    typed = attach(rows, types, ["yearadj"])
    chosen = typed.filter((F.col("yr_type") == "Below Normal") & F.col("month").isin(list(views.SUMMER_MONTHS)))
    return chosen.select("sampleid", "date", "month", "year", "salsurf", "ibmr", "bpue", "bpue_log1p")


TARGETS = ["a_bn_base", "a_bn_gates"]


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    data = settle(_ordinary_biomass(spark, d), "ordinary")
    target = scenario.scenario_means(views.model_output(spark, d))
    return scenario.salinity_correction(data, views.conversions(data), target, TARGETS, views.SUMMER_MONTHS)


def salinity_correction(spark: SparkSession, d: str) -> DataFrame:
    rows = _corrected(spark, d)
    return snapped(rows.select("sampleid", "ibmr", "month", "tenths", "scenario", "correction", "bpue_adj"))


def corrected_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapped(scenario.corrected_summary(_corrected(spark, d)), 4)


def out_of_range_keys(spark: SparkSession, d: str) -> DataFrame:
    data = _ordinary_biomass(spark, d)
    keyed = data.select(scenario.tenths(F.col("salsurf")).alias("tenths"))
    return scenario.out_of_range(keyed, views.conversions(data))


def targets_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    """Target salinities that conversions up to 2.5 do not reach."""
    short = views.conversions(_ordinary_biomass(spark, d)).filter("tenths <= 25")
    target = scenario.scenario_means(views.model_output(spark, d))
    return scenario.targets_out_of_range(target, TARGETS, short, views.SUMMER_MONTHS)


def monthly_salinity_grid(spark: SparkSession, d: str) -> DataFrame:
    data = views.placed_obs(spark, d).withColumn("salsurf", F.col("secchi") / 5)
    return scenario.salinity_grid(data.select("region", "month", "salsurf"), "region")


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    salinities = scenario.scenario_salinities(views.scenario_salinity(spark, d)).withColumn("region2", F.col("region"))
    return scenario.scenario_ratio(salinities, views.draws(spark, d), views.SCENARIOS)


def scenario_ratio(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_ratios(spark, d))


def missing_results(spark: SparkSession, d: str) -> DataFrame:
    return scenario.missing_results(_ratios(spark, d))


def draw_band(spark: SparkSession, d: str) -> DataFrame:
    return snapped(scenario.draw_band(views.draws(spark, d)), 9)


def draws_restored(spark: SparkSession, d: str) -> DataFrame:
    """Draws as rows, those below a level left out, and back to arrays with gaps where they were."""
    keys = ["ibmr", "month", "region2", "tenths"]
    rows = scenario.draws_to_rows(views.draws(spark, d)).where("fit > -0.1")
    back = scenario.rows_to_draws(rows, keys)
    held = F.filter("draws", lambda v: v.isNotNull())
    places = F.transform("draws", lambda v, i: F.when(v.isNotNull(), i + 1))
    return snapped(
        back.select(*keys, F.size("draws").alias("n"), F.size(held).alias("held"), F.array_max(places).alias("last"),
                    F.aggregate(F.zip_with(held, F.array_compact(places), lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, v: a + v)
                    .alias("weighted"))
    )


def draws_long(spark: SparkSession, d: str) -> DataFrame:
    rows = scenario.draws_to_rows(views.draws(spark, d))
    return snapped(rows.groupBy("ibmr", "month", "draw").agg(F.avg(F.col("fit").cast("double")).alias("fit")), 8)


# --- helpers on whole tables ------------------------------------------------------------------


def signed_logs(spark: SparkSession, d: str) -> DataFrame:
    """Means on the signed log scale, and back."""
    off = F.col("secchi") - 50
    rows = views.obs(spark, d).select("source", "year", signed_log1p(off).alias("log"))
    means = rows.groupBy("source", "year").agg(F.avg("log").alias("log"))
    return snapped(means.withColumn("back", signed_expm1(F.col("log"))), 6)


def priority_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the pieces of their priority, and by its text without a letter."""
    c = F.col("o_orderpriority")
    rows = views.table(spark, d, "orders").select(
        split_part(c, "-", 2, 0).alias("rank"), split_part(c, "-", 2, 1).alias("label"), remove_all(c, "E").alias("short")
    )
    return rows.groupBy("rank", "label", "short").agg(F.count(F.lit(1)).alias("n"))


def tagged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of observations under one header, with what each lacks as missing."""
    timed = views.obs_t(spark, d).select("station", "year", "temperature")
    whole = views.obs(spark, d).select("station", "year", "temperature", "secchi")
    rows = union_tagged({"timed": timed, "whole": whole}, "origin")
    out = rows.groupBy("origin", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("secchi").alias("n_secchi"), F.avg("temperature").alias("temperature")
    )
    return snapped(out)


def filled_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily smallest value by source, two days of three filled from the day before."""
    daily = views.obs(spark, d).groupBy("source", "year", "date").agg(F.min("temperature").alias("low"))
    gaps = daily.withColumn("low", F.when(F.dayofmonth("date") % 3 == 0, F.col("low").cast("double")))
    return hydro.fill_down(gaps, "low", ["source", "year"], ["date"])


def yearly_band(spark: SparkSession, d: str) -> DataFrame:
    means = views.obs(spark, d).groupBy("source", "year").agg(F.avg("secchi").alias("mean"), F.stddev_samp("secchi").alias("sd"))
    return snapped(summaries.band(means, "mean", "sd"), 6)


def far_values(spark: SparkSession, d: str) -> DataFrame:
    """Values beyond the whiskers of their source."""
    value = F.pow(F.col("secchi").cast("double"), F.lit(5.0))
    rows = views.obs(spark, d).select("source", "station", "date", "datetime", value.alias("power"))
    return snapped(summaries.box_outliers(rows, ["source"], "power"), 2)


# --- statistics -------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = indices.with_season(views.placed_obs(spark, d)).dropna(subset=["temperature"])
    types = anova.year_attributes(views.year_types(spark, d), ["year", "drought", "yr_type"])
    return attach(rows, types, ["year"])


def recent_year_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = anova.recent_labels(_labelled(spark, d), ["drought", "yr_type"], recent=(2000, 2001))
    out = rows.groupBy("drought", "drought_recent", "yr_type_recent", "season", "region").agg(
        F.count(F.lit(1)).alias("n"), F.avg("temperature").alias("temperature")
    )
    return snapped(out)


MODELS = {
    "Regional_Drought": ("drought", "region"),
    "Regional_Year": ("year", "region"),
    "Seasonal_Drought": ("drought", "season"),
    "Seasonal_Year": ("year", "season"),
}


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return anova.settled_cells(_labelled(spark, d), "temperature", MODELS)


def anova2_cells(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_cells(spark, d))


def anova2(spark: SparkSession, d: str) -> DataFrame:
    return snapped(anova.anova2(_cells(spark, d), MODELS), 3)


def anova_stack(spark: SparkSession, d: str) -> DataFrame:
    return snapped(anova.anova_stack(anova.anova2(_cells(spark, d), MODELS)), 3)


def partial_r2(spark: SparkSession, d: str) -> DataFrame:
    table = settle(anova.anova2(_cells(spark, d), MODELS), "anova")
    return snapped(anova.partial_r2(table))


def marginal_means(spark: SparkSession, d: str) -> DataFrame:
    means = anova.marginal_means(_cells(spark, d))
    return snapped(means.select("model", "factor", "level", "emmean", "df", "max_y"))


def tukey_letters(spark: SparkSession, d: str) -> DataFrame:
    return snapped(anova.marginal_means(_cells(spark, d)))


def fitted_resid(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_labelled(spark, d), "labelled")
    cells = anova.settled_cells(rows, "temperature", {"m": ("drought", "region")})
    out = anova.fitted_residuals(rows, cells, "temperature", "m", "drought", "region")
    return snapped(out.select("source", "station", "date", "temperature", "fitted", "resid"))


def _taxa(spark: SparkSession, d: str) -> DataFrame:
    return regression.taxa_long(views.taxa_matrix(spark, d), views.year_types(spark, d))


def taxa_long(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_taxa(spark, d).select("year", "drought", "index", "index_s", "taxa", "bpue"))


def _modelled(spark: SparkSession, d: str) -> DataFrame:
    rows = _taxa(spark, d)
    return rows.withColumn("y", regression.response(F.col("taxa"), F.col("bpue"), ("LARGE",)))


def grouped_lm(spark: SparkSession, d: str) -> DataFrame:
    return snapped(regression.grouped_lm(_modelled(spark, d), ["taxa"], "y", "index_s"), 5)


def grouped_lm_p(spark: SparkSession, d: str) -> DataFrame:
    models = regression.with_p_values(regression.grouped_lm(_modelled(spark, d), ["taxa"], "y", "index_s"))
    return snapped(models.select("taxa", "p_slope", "p_intercept", "p_f"))


def grouped_lm_resid(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_modelled(spark, d), "modelled")
    models = regression.grouped_lm(rows, ["taxa"], "y", "index_s")
    return snapped(regression.lm_residuals(rows, models, ["taxa"], "y", "index_s").select("taxa", "year", "resid"), 4)


def box_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = indices.with_season(views.placed_obs(spark, d))
    return snapped(summaries.box_summary(rows, ["season", "region"], "secchi"))


def histogram_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapped(summaries.histogram(views.placed_obs(spark, d), ["region"], "secchi", 15))


# --- surfaces -----------------------------------------------------------------------------------

SURFACE_KEYS = ("ibmr", "region2")
PREDICTORS = ("salsurf_s", "doy_s")


def _surface_rows(spark: SparkSession, d: str) -> DataFrame:
    """Biomass with its predictors, centred and scaled over the whole table; region2 is the region the surfaces know."""
    rows = _biomass(spark, d).select(
        "ibmr", "station", "year", F.month("date").alias("month"), F.dayofyear("date").alias("doy"), "salsurf",
        F.log1p("bpue").alias("bpue_log1p"), (F.col("station").cast("int") % 2).alias("region2"),
    )
    rows = settle(rows.dropna(subset=["ibmr"]), "surface-input")
    return biomass.standardise(rows, rows, ["salsurf", "doy"])


def _surface_grid(rows: DataFrame) -> DataFrame:
    """Months by salinity in steps of 0.1 inside each month's central values, on the scale of the training table."""
    return biomass.standardise(scenario.salinity_grid(rows, "region2"), rows, ["salsurf", "doy"])


def _surface_fits(rows: DataFrame) -> DataFrame:
    return settle(surface.response_surface(rows, SURFACE_KEYS, PREDICTORS), "surfaces")


def surface_grid(spark: SparkSession, d: str) -> DataFrame:
    return snapped(_surface_grid(_surface_rows(spark, d)))


def surface_knots(spark: SparkSession, d: str) -> DataFrame:
    """Where the knots of each group and region lie, knot by knot, and how many years it has."""
    design = surface.surface_design(_surface_rows(spark, d), SURFACE_KEYS, PREDICTORS)
    each = design.select(
        *SURFACE_KEYS, F.size("years").alias("n_years"), F.posexplode(F.arrays_zip("sal_knots", "day_knots")).alias("knot", "k")
    )
    return snapped(each.select(*SURFACE_KEYS, "n_years", "knot", "k.sal_knots", "k.day_knots"))


def response_surface(spark: SparkSession, d: str) -> DataFrame:
    fits = _surface_fits(_surface_rows(spark, d))
    return fits.select(*SURFACE_KEYS, "n", "stations", "sigma2", "station_ridge", "log_ridges", "beta", "sal_knots", "day_knots")


def _grid_by_group(rows: DataFrame, fits: DataFrame) -> DataFrame:
    return attach(_surface_grid(rows), fits.select(*SURFACE_KEYS), ["region2"], "inner")


def surface_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _surface_rows(spark, d)
    fits = _surface_fits(rows)
    return surface.surface_terms(_grid_by_group(rows, fits), fits, SURFACE_KEYS, PREDICTORS)


def posterior_draws(spark: SparkSession, d: str) -> DataFrame:
    """Band over 1000 posterior draws at each grid point."""
    rows = _surface_rows(spark, d)
    fits = _surface_fits(rows)
    return scenario.draw_band(surface.posterior_draws(_grid_by_group(rows, fits), fits, SURFACE_KEYS, PREDICTORS))


def scenario_ratio_fitted(spark: SparkSession, d: str) -> DataFrame:
    """From counts to scenario ratios in one chain: fits by group and region, their draws, and the bands of the ratios."""
    rows = _surface_rows(spark, d)
    salinities = scenario.scenario_salinities(views.scenario_salinity(spark, d)).withColumn("region2", F.col("region"))
    return scenario.scenario_ratio_fitted(salinities, _surface_fits(rows), settle(_surface_grid(rows), "grid"), views.SCENARIOS)


# --- text tables ----------------------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = views.placed_obs(spark, d).select("source", "station", "date", "subregion", "temperature", "secchi")
    return write_and_continue(rows, fresh_path(spark, "csv"))


def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv-inferred")
    write_and_continue(views.flow(spark, d), path, ["date"])
    return read_table(spark, path, columns=["date", "inflowtotal", "export"])


NOTES = "\n".join(f"# note {i}" for i in range(1, 11))


def csv_skip_preamble(spark: SparkSession, d: str) -> DataFrame:
    """Model runs, one file per year with ten lines of notes, read back as one table."""
    path = fresh_path(spark, "runs")
    line = F.concat_ws(",", F.col("date").cast("string"), "inflowtotal", F.coalesce(F.col("export").cast("string"), F.lit("NA")))
    # A file is one year of days, so the lines gathered per row are at most 366.
    files = (
        views.flow(spark, d)
        .groupBy(F.year("date").alias("run"))
        .agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
        .select("run", F.concat(F.lit(NOTES + "\ndate,inflowtotal,export\n"), F.col("body")).alias("value"))
    )
    files.write.partitionBy("run").text(path)
    return read_after_preamble(spark, path, "date date, inflowtotal double, export double").dropna("any")


def csv_by_headers(spark: SparkSession, d: str) -> DataFrame:
    """Scenario files whose columns differ from year to year, found by their first lines and read as one table."""
    path = fresh_path(spark, "scenarios")
    rows = settle(views.scenario_salinity(spark, d), "scenarios")
    for odd, names in ((0, ["sal_base", "sal_a"]), (1, ["sal_b", "sal_base"])):
        write_table(rows.filter(F.col("year") % 2 == odd).select("region", "year", "month", *names), f"{path}/{odd}")
    table = read_by_headers(spark, f"{path}/*", {"region": "int", "year": "int", "month": "int"}, "double")
    names = header_names(table, "sal_")
    return table.groupBy("year").agg(*[F.count(n).alias(f"n_{n}") for n in names], *[F.bround(F.sum(n), 1).alias(n) for n in names])


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        nearest_noon,
        drop_high_outliers,
        season_year,
        season_levels,
        seasonal_index_strict,
        seasonal_index_relaxed,
        yearly_index,
        index_table_multi,
        index_table_year,
        index_window,
        index_n_long,
        index_wide,
        salinity_field,
        salinity_zone_flags,
        low_salinity_zone,
        seasonal_index_zone,
        region_eligibility,
        sampling_effort,
        effort_min,
        effort_vs_index,
        effort_vs_relaxed_index,
        assign_subregion,
        assign_subregion_projected,
        seasonal_index_projected,
        datum_check,
        datum_unmatched,
        grid_positions,
        survey_years,
        survey_long_term,
        numbered_lines,
        first_seen_stations,
        region_rows,
        shifted_years,
        water_year_flow,
        month_starts,
        drought_series,
        flow_with_series,
        hydro_smooth,
        mysid_union,
        plankton_biomass,
        plankton_biomass_lenient,
        biomass_covariates,
        sample_size,
        composition,
        scenario_means,
        salinity_correction,
        corrected_summary,
        out_of_range_keys,
        targets_out_of_range,
        monthly_salinity_grid,
        scenario_ratio,
        missing_results,
        draw_band,
        draws_long,
        draws_restored,
        signed_logs,
        priority_parts,
        tagged_sources,
        filled_days,
        yearly_band,
        far_values,
        recent_year_labels,
        anova2_cells,
        anova2,
        anova_stack,
        partial_r2,
        marginal_means,
        tukey_letters,
        fitted_resid,
        taxa_long,
        grouped_lm,
        grouped_lm_p,
        grouped_lm_resid,
        box_summary,
        histogram_counts,
        surface_grid,
        surface_knots,
        response_surface,
        surface_terms,
        posterior_draws,
        scenario_ratio_fitted,
        csv_roundtrip,
        csv_inferred,
        csv_skip_preamble,
        csv_by_headers,
    )
}
