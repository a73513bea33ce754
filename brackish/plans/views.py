"""Domain tables built from the star-schema test tables.

``plans/oracle.py`` holds the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(c: Column, digits: int = 6) -> Column:
    """Value on a decimal grid, so that two engines that add in another order agree.

    The offset is off-centre on purpose: exact results sit on or half-way between grid
    points, and so never at the step.
    """
    scale = 10.0**digits
    snapped_value = F.floor(c * scale + 0.6371937) / scale
    return F.when(F.abs(c) == float("inf"), c).otherwise(snapped_value)


def snapped(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Every double column on its grid."""
    return df.select(
        *[
            snap(F.col(f"`{n}`"), special.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def place_of(key: Column) -> dict[str, Column]:
    """Station coordinates; some lie outside all polygons."""
    return {"x": (key * 37) % 110 + 0.5, "y": (key * 61) % 100 + 0.5}


def obs_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed observations from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("station"),
        F.col("ts").alias("datetime"),
        F.to_date("ts").alias("date"),
        F.month("ts").alias("month"),
        F.year("ts").alias("year"),
        F.when(F.col("value") >= 0.5, F.col("value")).alias("temperature"),
        F.col("event_id").alias("obs_id"),
        *[c.alias(n) for n, c in place_of(F.col("user_id")).items()],
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water-quality observations of seven years from lineitem."""
    ship = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"),
        F.col("l_suppkey").cast("string").alias("station"),
        (ship + F.make_dt_interval(hours=F.col("l_linenumber") * 3)).alias("datetime"),
        F.to_date(ship).alias("date"),
        F.month(ship).alias("month"),
        F.year(ship).alias("year"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("temperature"),
        (F.col("l_extendedprice") / 1000).alias("secchi"),
        (F.col("l_discount") * 100).alias("salinity"),
        *[c.alias(n) for n, c in place_of(F.col("l_suppkey")).items()],
    )


def _corner(i: Column, j: Column) -> Column:
    """Corner of the five by five patchwork, shifted a little inside it."""
    dx = F.when(i.between(1, 4), (j * 3 + i * 2) % 7 - 3).otherwise(0)
    dy = F.when(j.between(1, 4), (i * 5 + j) % 7 - 3).otherwise(0)
    return F.struct((i * 20 + dx).cast("double").alias("x"), (j * 20 + dy).cast("double").alias("y"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crooked four-sided polygon per nation."""
    k = F.col("n_nationkey")
    i, j = k % 5, (k / 5).cast("int")
    ring = F.array(_corner(i, j), _corner(i + 1, j), _corner(i + 1, j + 1), _corner(i, j + 1))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("subregion"), ring.alias("ring"))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the observations, with how many rows each is short of a third of them."""
    sources = obs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = sources.select(F.sum("n")).scalar()
    return sources.select("source", (total - F.col("n") * 3).alias("short_of_third"))


#: A unit of the patchwork as degrees and as metres of the zone's grid, and where its corner lies.
DEGREES, METRES = (0.00114, 0.0009), 100.0
LON_LAT, EAST_NORTH = (-122.0, 38.0), (587900.0, 4206400.0)


def on_earth(rows: DataFrame) -> DataFrame:
    """Rows with longitude and latitude in place of x and y."""
    places = {n: F.lit(LON_LAT[i]) + F.col(c) * DEGREES[i] for i, (n, c) in enumerate((("lon", "x"), ("lat", "y")))}
    return rows.withColumns(places).drop("x", "y")


def grid_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons in metres of the grid."""
    metres = F.transform(
        "ring",
        lambda p: F.struct((p["x"] * METRES + EAST_NORTH[0]).alias("x"), (p["y"] * METRES + EAST_NORTH[1]).alias("y")),
    )
    return polygons(spark, sf_dir).withColumn("ring", metres)


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("subregion"), F.col("r_name").alias("region")
    )


# Rules on nations in place of the study's own sub-regions.
SHORT_TERM_NATIONS = ("NATION_3", "NATION_7", "NATION_12")
SEASONAL_NATIONS = {
    "NATION_4": ("Summer",),
    "NATION_9": ("Spring", "Summer"),
    "NATION_11": ("Fall",),
}


def placed_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with sub-region and region by supplier, without a spatial step."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("subregion"), "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return (
        obs(spark, sf_dir)
        .join(supplier, F.col("station").cast("bigint") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .drop("s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
    )


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flows from orders."""
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def total(condition=None):
        return F.round(F.sum(price if condition is None else F.when(condition, price)), 2)

    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            total().alias("inflowtotal"),
            total(priority == "1-URGENT").alias("inflowsacr"),
            total(priority == "2-HIGH").alias("inflowyolo"),
            total(priority == "3-MEDIUM").alias("infloweast"),
            total(status == "F").alias("outflow"),
            total(status == "O").alias("export"),
        )
    )


FLOWS = ("inflowtotal", "inflowsacr", "inflowyolo", "infloweast", "outflow", "export")


def year_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and class of each calendar year from the mean order.

    The few years are settled: a plan that joins them to rows then knows their size and deals no rows by year.
    """
    mean = F.avg("o_totalprice") / 1000
    index = (F.floor(mean * 100 + 0.6371937) / 100).alias("index")
    years = settle(table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(index), "years")
    middle = years.select(F.avg("index")).scalar()
    gap = F.col("index") - middle
    drought = F.when(gap < -0.5, "D").when(gap > 0.5, "W").otherwise("N")
    yr_type = F.when(gap < -0.5, "Dry").when(gap > 0.5, "Wet").otherwise("Below Normal")
    return years.withColumns({"drought": drought, "yr_type": yr_type})


# --- plankton ---------------------------------------------------------------------------

# The mysid taxon of the test tables and nets that retain some taxa better.
MYSID_SPECIES = "PROMO"
BETTER_IN_MICRO = ("SMALL Adult", "SMALL Juvenile", "LARGE Larva")
BETTER_IN_MESO = ("ECONOMY Larva",)


def _survey() -> Column:
    n = F.col("l_linenumber") % 3
    return F.when(n == 0, "EMP").when(n == 1, "STN").otherwise("FMWT")


def _with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def zoop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plankton counts."""
    flag, size = F.col("l_returnflag"), F.col("p_size")
    stage = F.when(flag == "A", " Adult").when(flag == "N", " Juvenile").otherwise(" Larva_UnID")
    order = (
        F.when(size % 7 == 1, "Amphipoda").when(size % 7 == 2, "Mysida").when(size % 7 > 2, "Calanoida")
    )
    date = F.to_date("l_shipdate")
    return _with_part(spark, sf_dir).select(
        F.concat_ws(" ", _survey(), F.col("l_suppkey").cast("string"), date.cast("string")).alias("sampleid"),
        F.col("l_suppkey").cast("string").alias("station"),
        _survey().alias("source"),
        F.when(F.col("p_type") == MYSID_SPECIES, "Macro")
        .when(F.col("l_linestatus") == "O", "Micro")
        .otherwise("Meso")
        .alias("sizeclass"),
        F.concat("p_type", stage).alias("taxlifestage"),
        order.alias("ord"),
        F.col("l_quantity").alias("cpue"),
        F.round(F.col("l_discount") * 100, 1).alias("salsurf"),
        date.alias("date"),
        F.year(date).alias("year"),
        *[c.alias(n) for n, c in place_of(F.col("l_suppkey")).items()],
    )


def mysid_surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weighed mysids: the first survey with dates, the others with dates as text."""
    caught = _with_part(spark, sf_dir).filter(
        (F.col("p_type") == MYSID_SPECIES) & (F.col("l_returnflag") == "A")
    )
    date = F.to_date("l_shipdate")
    weighed = caught.groupBy(
        date.alias("sampledate"), F.col("l_suppkey").cast("string").alias("station"), _survey().alias("project")
    ).agg((F.sum("l_quantity") / 100).alias(MYSID_SPECIES))
    weighed = settle(weighed, "mysids")  # read for each survey
    a = weighed.filter("project = 'EMP'").select("sampledate", F.col("station").alias("stationnz"), MYSID_SPECIES)
    b = weighed.filter("project <> 'EMP'").withColumn("sampledate", F.date_format("sampledate", "M/d/yyyy"))
    return a, b


def carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carbon weights by type and stage; larvae of LARGE have none."""
    stages = F.array(*[F.lit(s) for s in ("Adult", "Juvenile", "Larva")])
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("taxname"))
        .agg((F.count(F.lit(1)) % 15 + 1).cast("double").alias("carbonweight_ug"))
        .select("taxname", F.explode(stages).alias("lifestage"), "carbonweight_ug")
        .filter(~((F.col("taxname") == "LARGE") & (F.col("lifestage") == "Larva")))
    )


# Groups of the taxa; a group of its own for juveniles that no category lists.
TYPE_GROUPS = {
    "ECONOMY": "acartela",
    "SMALL": "limno",
    "MEDIUM": "daphnia",
    "LARGE": "other",
    "STANDARD": "allcopnaup",
    "PROMO": "mysid",
}


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxon groups, one row per part and stage, so with many repeats."""
    stages = F.explode(F.array(*[F.lit(s) for s in ("Adult", "Juvenile", "Larva")])).alias("lifestage")
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("taxname"), stages)
    ibmr = F.lit(None).cast("string")
    for kind, group in TYPE_GROUPS.items():
        ibmr = F.when(F.col("taxname") == kind, group).otherwise(ibmr)
    juvenile = (F.col("taxname") == "ECONOMY") & (F.col("lifestage") == "Juvenile")
    ungrouped = (F.col("taxname") == "SMALL") & (F.col("lifestage") == "Larva")
    ibmr = F.when(juvenile, "pdiapjuv").when(~ungrouped, ibmr)
    return rows.select(F.concat_ws(" ", "taxname", "lifestage").alias("taxlifestage"), ibmr.alias("ibmr"))


def taxa_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year with a column per type; no SMALL was counted before 1998."""
    kinds = sorted(TYPE_GROUPS)
    kind = F.substring_index("taxlifestage", " ", 1)
    cells = [F.sum(F.when(kind == k, F.col("cpue"))).alias(k) for k in kinds]
    wide = zoop(spark, sf_dir).groupBy("year").agg(F.sum("cpue").alias("All taxa"), *cells)
    return wide.withColumn("SMALL", F.when(F.col("year") >= 1998, F.col("SMALL")))


# --- scenarios --------------------------------------------------------------------------

SUMMER_MONTHS = (6, 7, 8, 9, 10)


def conversions(biomass: DataFrame) -> DataFrame:
    """Stand-in for fitted surfaces: every group by month by salinity step up to 8.0."""
    months = F.array(*[F.lit(m) for m in range(1, 13)])
    return (
        biomass.select("ibmr")
        .distinct()
        .select("ibmr", F.explode(months).alias("month"))
        .select("ibmr", "month", F.explode(F.sequence(F.lit(0), F.lit(80))).alias("tenths"))
        .withColumn("fit", F.col("tenths") * 0.01 - F.col("month") * 0.05)
    )


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled salinity: one row per order line of an instant, two scenarios."""
    ship = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        ship.alias("datetime"),
        (F.col("l_discount") * 60).alias("a_bn_base"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 100).alias("a_bn_gates"),
    )


SCENARIOS = ("sal_base", "sal_a", "sal_b")


def scenario_salinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario salinities by region, year and month, with gaps."""
    ship = F.col("l_shipdate")

    def step(column, modulus):
        return (F.sum(column) % modulus).cast("double") / 10

    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 2).cast("int").alias("region"), F.year(ship).alias("year"), F.month(ship).alias("month"))
        .agg(
            step("l_linenumber", 25).alias("sal_base"),
            step("l_partkey", 25).alias("sal_a"),
            step("l_suppkey", 31).alias("sal_b"),
        )
    )
    return sums.withColumn("sal_a", F.when(F.col("sal_a") >= 0.4, F.col("sal_a")))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior draws by group, month, region and salinity step from the embeddings."""
    v = F.col("vec_id")

    def digit(divisor, modulus=None):
        q = F.floor(v / divisor)
        return (q % modulus if modulus else q).cast("int")

    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("g"), digit(1, 2).cast("string")).alias("ibmr"),
        (digit(2, 5) + 6).alias("month"),
        digit(10, 2).alias("region2"),
        digit(20).alias("tenths"),
        F.col("embedding").alias("draws"),
    )
