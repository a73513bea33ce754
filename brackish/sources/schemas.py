"""Declared schemas of the input and output tables."""

from __future__ import annotations

OBSERVATIONS = (
    "source string, station string, stationid string, latitude double, longitude double, "
    "datetime timestamp, date date, month int, year int, "
    "temperature double, secchi double, salinity double, chlorophyll double"
)
POLYGONS = "subregion string, ring array<struct<x: double, y: double>>"
ELIGIBILITY = "subregion string, season string, long_term boolean, short_term boolean"
SALINITY_ZONE = "season string, subregion string, year int, n bigint, long_term boolean, short_term boolean"
DAILY_FLOW = (
    "date date, inflowsacr double, inflowyolo double, infloweast double, inflowtotal double, "
    "outflow double, export double"
)
REGIONAL_MEANS = "year int, region string, temperature double, svindex double, yeartype string, drought string"
SEASONAL_MEANS = "year int, season string, temperature double, svindex double, yeartype string, drought string"
WATER_YEARS = "year int, index double, yr_type string, drought string"
TAXON_GROUPS = "lifestage string, taxname string, ibmr string, taxlifestage string"
CARBON_WEIGHTS = "taxname string, lifestage string, carbonweight_ug double"
PLANKTON = (
    "sampleid string, source string, station string, sizeclass string, taxlifestage string, ord string, "
    "latitude double, longitude double, salsurf double, cpue double, date date, year int"
)
CORRECTED = "ibmr string, month int, scenario string, bpue_sum double, bpue_sd double"
