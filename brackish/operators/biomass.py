"""Plankton counts to biomass by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.calendar import month_day_year
from brackish.functions.strict import is_member, present, share, strict_avg, strict_sd
from brackish.functions.text import categorise, paste, recode, remove_first
from brackish.operators.attach import attach, join_null_safe, lookup
from brackish.operators.reshape import group_all_but
from brackish.session import settle

# The mysid species weighed directly, station and taxon spellings.
MYSID = "Hyperacanthomysis longirostris"
STATION_NAMES = {"MONT": "Mont", "HONK": "Honk"}
WEIGHT_NAMES = {"Sinocalanus": "Sinocalanus doerrii"}
TAXON_NAMES = {
    "Synchaeta bicornis Adult": "Synchaeta Adult",
    "Pseudodiaptomus Adult": "Pseudodiaptomus forbesi Adult",
    "Acanthocyclops vernalis Adult": "Acanthocyclops Adult",
}
# Taxa the other net retains better. "Limnoithona tetraspina Adult" is not
# among them: the list this follows holds it with a line break, so it never matched.
BETTER_IN_MICRO = (
    "Asplanchna Adult", "Copepoda Larva", "Cyclopoida Juvenile", "Eurytemora Larva",
    "Harpacticoida Undifferentiated", "Keratella Adult", "Limnoithona Adult", "Limnoithona Juvenile",
    "Limnoithona sinenesis Adult", "Oithona Adult", "Oithona Juvenile", "Oithona davisae Adult",
    "Polyarthra Adult", "Pseudodiaptomus Larva", "Rotifera Adult", "Sinocalanus doerrii Larva",
    "Synchaeta Adult", "Synchaeta bicornis Adult", "Trichocerca Adult",
)
BETTER_IN_MESO = ("Cirripedia Larva", "Cyclopoida Adult", "Oithona similis")
# Categories of the composition report. Group "pdiapjuv" is in none.
CATEGORIES = {
    "Calanoid": ("acartela", "eurytem", "othcalad", "othcaljuv", "pdiapfor"),
    "Cyclopoid": ("limno", "othcyc"),
    "Cladoceran": ("daphnia", "othclad"),
    "Rotifer": ("other",),
    "Mysid": ("mysid",),
    "Copepod": ("allcopnaup",),
}


@dataclass(frozen=True)
class BiomassRules:
    """What differs between studies."""

    excluded: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {"Meso": BETTER_IN_MICRO, "Micro": BETTER_IN_MESO}
    )
    dropped_order: str = "Amphipoda"
    single_order: str = "Mysida"
    single_taxon: str = f"{MYSID} Adult"
    renamed: Mapping[str, str] = field(default_factory=lambda: TAXON_NAMES)
    keep_null_order: bool = False
    gear_sizes: tuple[str, str] = ("Micro", "Meso")
    gear_source: str = "EMP"


def mysid_union(survey_a: DataFrame, survey_b: DataFrame, species: str = MYSID) -> DataFrame:
    """Two mysid surveys as one keyed table, mass in micrograms.

    Survey A has sampledate (date) and stationnz, survey B station, sampledate (month/day/
    year text) and project; both have a mass column named after the species.
    """
    a = survey_a.select(
        F.col("sampledate").alias("date"),
        F.col("stationnz").cast("string").alias("station"),
        F.lit("EMP").alias("source"),
        F.col(species).alias("bpue"),
    )
    b = survey_b.select(
        month_day_year(F.col("sampledate")).alias("date"),
        recode(F.col("station").cast("string"), STATION_NAMES).alias("station"),
        F.col("project").alias("source"),
        F.col(species).alias("bpue"),
    )
    both = a.unionByName(b)
    return both.select(
        paste(F.col("source"), F.col("station"), F.col("date")).alias("sampleid"),
        F.lit(f"{species} Adult").alias("taxlifestage"),
        F.lit("Macro").alias("sizeclass"),
        (F.col("bpue") * 1000).alias("bpue_mysid"),
    )


def carbon_weights(weights: DataFrame) -> DataFrame:
    """Carbon weight keyed by taxon and life stage in one text."""
    name = recode(F.col("taxname"), WEIGHT_NAMES)
    return weights.select(paste(name, F.col("lifestage")).alias("taxlifestage"), "carbonweight_ug")


def net_rule(rules: BiomassRules) -> Column:
    """Rows counted with the right net, of the orders wanted."""
    size, taxon, order = F.col("sizeclass"), F.col("taxlifestage"), F.col("ord")
    keep = F.lit(True)
    for net, taxa in rules.excluded.items():
        keep = keep & ~((size == net) & is_member(taxon, taxa))
    not_dropped = order != rules.dropped_order
    single = (order != rules.single_order) | (taxon == rules.single_taxon)
    if rules.keep_null_order:
        not_dropped, single = order.isNull() | not_dropped, order.isNull() | single
    return keep & not_dropped & single


def taxon_names(samples: DataFrame, weights: DataFrame, groups: DataFrame, rules: BiomassRules) -> DataFrame:
    """Each name as written with its clean and its final form, carbon weight and group.

    Names are few, so text work and lookups are done once per name and not per row.
    """
    written = settle(samples.select("taxlifestage").distinct(), "names")
    clean = remove_first(F.col("taxlifestage"), "_UnID")
    named = written.select(
        F.col("taxlifestage").alias("__written"), clean.alias("__clean"), recode(clean, rules.renamed).alias("taxlifestage")
    )
    known = lookup(attach(named, weights, ["taxlifestage"]), groups, ["taxlifestage"])
    final = known.withColumnsRenamed({"taxlifestage": "__name", "__written": "taxlifestage"})
    return settle(final, "taxon-names")


def taxon_biomass(
    samples: DataFrame,
    weights: DataFrame,
    mysids: DataFrame,
    groups: DataFrame,
    rules: BiomassRules = BiomassRules(),
    place: Sequence[str] = ("x", "y"),
) -> DataFrame:
    """Biomass per counted taxon with its group, before any summing.

    ``weights`` has taxlifestage and carbonweight_ug, ``groups`` taxlifestage and ibmr.
    """
    usable = present(samples, ["salsurf", *place])
    weighed = (
        attach(usable, taxon_names(usable, weights, groups, rules), ["taxlifestage"])
        .drop("taxlifestage")
        .withColumnRenamed("__clean", "taxlifestage")
        .filter(net_rule(rules))
        .drop("taxlifestage")
        .withColumnRenamed("__name", "taxlifestage")
    )
    # Weighed masses are of one taxon. Only its rows are shuffled to meet them.
    single = F.coalesce(F.col("taxlifestage") == rules.single_taxon, F.lit(False))
    met = join_null_safe(weighed.filter(single), mysids, ["sampleid", "taxlifestage", "sizeclass"])
    with_mysid = met.unionByName(weighed.filter(~single).withColumn("bpue_mysid", F.lit(None).cast("double")))
    bpue = F.when(F.col("taxlifestage") == rules.single_taxon, F.col("bpue_mysid")).when(
        F.col("taxlifestage").isNotNull(), F.col("cpue") * F.col("carbonweight_ug")
    )
    return present(with_mysid.withColumn("bpue", bpue), ["bpue"])


def same_gear_only(rows: DataFrame, rules: BiomassRules = BiomassRules()) -> DataFrame:
    """Groups counted in both nets come from the one survey that uses both."""
    size = F.col("sizeclass")
    flags = rows.groupBy("ibmr").agg(
        *[F.bool_or(is_member(size, [g])).alias(f"__has_{i}") for i, g in enumerate(rules.gear_sizes)]
    )
    # a row a group: settled, it is known to be, and no row is dealt by its group
    mixed = settle(flags.select("ibmr", (F.col("__has_0") & F.col("__has_1")).alias("__mixed")), "mixed-nets")
    return attach(rows, mixed, ["ibmr"]).filter(~(F.col("__mixed") & (F.col("source") != rules.gear_source))).drop("__mixed")


def plankton_biomass(
    samples: DataFrame,
    weights: DataFrame,
    mysids: DataFrame,
    groups: DataFrame,
    rules: BiomassRules = BiomassRules(),
    place: Sequence[str] = ("x", "y"),
    group: str = "ibmr",
    categories: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Biomass per sample and group (or per category of groups)."""
    taxa = taxon_biomass(samples, weights, mysids, groups, rules, place)
    wanted = ["sampleid", "station", *place, "salsurf", "date", "year", "ibmr", "source", "sizeclass", "bpue"]
    # Summed before it is written, by what the gear rule still has to see.
    sums = group_all_but(taxa.select(*wanted), "bpue").agg(F.sum("bpue").alias("bpue"))
    rows = same_gear_only(settle(sums, "taxa"), rules)
    if categories is not None:
        rows = rows.withColumn(group, categorise(F.col("ibmr"), categories))
    picked = rows.select("sampleid", "station", *place, "salsurf", "date", "year", group, "bpue")
    return group_all_but(picked, "bpue").agg(F.sum("bpue").alias("bpue"))


def with_covariates(biomass: DataFrame) -> DataFrame:
    """Month, day of year, standardised predictors and log biomass for the models.

    The means and deviations are those of the whole table, read as one-row subqueries.
    """
    dated = biomass.withColumns(
        {"month": F.month("date"), "doy": F.dayofyear("date"), "bpue_log1p": F.log1p("bpue")}
    )
    return standardise(dated, dated, ["salsurf", "doy"])


def standardise(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``{c}_s``: centred and scaled by the mean and deviation of ``reference``.

    One missing value of ``reference`` makes them missing.
    """

    def stat(agg, c):
        return reference.select(agg(c)).scalar()

    return df.withColumns(
        {
            f"{c}_s": (F.col(c) - stat(strict_avg, c)) / F.nullif(stat(strict_sd, c), F.lit(0.0))
            for c in columns
        }
    )


def merge_regions(c: Column, members: Sequence[str], merged: str) -> Column:
    """Put thinly sampled regions together under one name."""
    return F.when(is_member(c, members), merged).otherwise(c)


def sample_size(biomass: DataFrame, first_year: int = 1995) -> DataFrame:
    """Mean biomass and number of samples by year, month and sub-region."""
    per_sample = (
        biomass.filter(F.col("year") >= first_year)
        .groupBy("sampleid", "year", "month", "subregion", "station")
        .agg(F.sum("bpue").alias("bpue"))
    )
    return per_sample.groupBy("year", "month", "subregion").agg(
        F.avg("bpue").alias("mean_bpue"), F.count(F.lit(1)).alias("samplesize")
    )


def composition(
    biomass: DataFrame, keys: Sequence[str] = ("month", "subregion"), category: str = "category"
) -> DataFrame:
    """Biomass of each category and its share within the keys."""
    totals = settle(biomass.groupBy(*keys, category).agg(F.sum("bpue").alias("bpue")), "composition")
    whole = totals.groupBy(*keys).agg(F.sum("bpue").alias("__whole"))
    return attach(totals, whole, keys).withColumn("prop", share("bpue", "__whole")).drop("__whole")
