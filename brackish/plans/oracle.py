"""SQL twins of the registered queries, for DuckDB on the same tables.

``plans/views.py`` holds the same adapter views as DataFrames.
"""

from __future__ import annotations

import re


def snap(expression: str, digits: int = 6) -> str:
    """Value on a decimal grid; see ``views.snap``."""
    return f"floor(({expression}) * 1e{digits} + 0.6371937) / 1e{digits}"


def snaps(names: str, digits: int = 6) -> str:
    return ", ".join(f"{snap(n, digits)} AS {n}" for n in names.split())


PLACE = "(({0} * 37) % 110 + 0.5)::DOUBLE AS x, (({0} * 61) % 100 + 0.5)::DOUBLE AS y"
SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
 WHEN month IN (6, 7, 8) THEN 'Summer' WHEN month IN (9, 10, 11) THEN 'Fall' END"""
SEASONS = "(VALUES ('Winter'), ('Spring'), ('Summer'), ('Fall')) s(season)"

# --- adapter views ------------------------------------------------------------------------

OBS_T = f"""obs_t AS (
 SELECT event_type AS source, user_id::VARCHAR AS station, ts AS datetime, ts::DATE AS date,
  month(ts)::INT AS month, year(ts)::INT AS year, CASE WHEN value >= 0.5 THEN value END AS temperature,
  event_id AS obs_id, {PLACE.format("user_id")}
 FROM events)"""

OBS = f"""obs AS (
 SELECT l_returnflag AS source, l_suppkey::VARCHAR AS station, l_suppkey,
  l_shipdate + to_hours(l_linenumber * 3) AS datetime, l_shipdate::DATE AS date,
  month(l_shipdate)::INT AS month, year(l_shipdate)::INT AS year,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS temperature,
  l_extendedprice / 1000 AS secchi, l_discount * 100 AS salinity, {PLACE.format("l_suppkey")}
 FROM lineitem)"""

PLACED = f"""{OBS}, placed AS (
 SELECT obs.*, n_name AS subregion, r_name AS region
 FROM obs JOIN supplier ON obs.l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

PLACED_SEASON = f"""{PLACED}, seasonal_rows AS (
 SELECT * REPLACE (CASE WHEN month = 12 THEN year + 1 ELSE year END AS year), {SEASON} AS season FROM placed)"""

EDGES = """lattice AS (
 SELECT i, j, (i * 20 + CASE WHEN i BETWEEN 1 AND 4 THEN (j * 3 + i * 2) % 7 - 3 ELSE 0 END)::DOUBLE AS x,
  (j * 20 + CASE WHEN j BETWEEN 1 AND 4 THEN (i * 5 + j) % 7 - 3 ELSE 0 END)::DOUBLE AS y
 FROM range(0, 6) a(i), range(0, 6) b(j)),
edges AS (
 SELECT n_name AS subregion, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
 FROM nation CROSS JOIN (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) e(ai, aj, bi, bj)
  JOIN lattice p ON p.i = n_nationkey % 5 + ai AND p.j = n_nationkey // 5 + aj
  JOIN lattice q ON q.i = n_nationkey % 5 + bi AND q.j = n_nationkey // 5 + bj)"""


INSIDE = """sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1
   THEN 1 ELSE 0 END) % 2 = 1
  OR bool_or((x - x1) * (y2 - y1) = (y - y1) * (x2 - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
   AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"""


def located(points: str, name: str = "located") -> str:
    """Distinct points of a table with the polygons they touch."""
    return f"""{name} AS (
 SELECT x, y, subregion FROM (SELECT DISTINCT x, y FROM {points}) p CROSS JOIN edges
 GROUP BY x, y, subregion
 HAVING {INSIDE})"""


GRID_EDGES = """grid_edges AS (
 SELECT subregion, x1 * 100 + 587900 AS x1, y1 * 100 + 4206400 AS y1, x2 * 100 + 587900 AS x2, y2 * 100 + 4206400 AS y2
 FROM edges)"""

# Radius, 1 / flattening, shift in metres and turn in seconds of arc to the common datum.
DATUM = {
    "wgs84": (6378137.0, 298.257223563, (0, 0, 0), (0, 0, 0)),
    "nad83": (6378137.0, 298.257222101, (-0.991, 1.9072, 0.5129), (0.02579, 0.00965, 0.01166)),
    "nad27": (6378206.4, 294.978698214, (-8, 159, 175), (0, 0, 0)),
}


def on_grid(points: str, datum: str, grid: str = "nad83") -> str:
    """The CTE ``grid_<datum>``: easting and northing of each point (x, y), taken as longitude and latitude in a datum."""
    radius, inverse, (tx, ty, tz), (rx, ry, rz) = DATUM[datum]
    to_radius, to_inverse, (ux, uy, uz), (sx, sy, sz) = DATUM[grid]
    f, g = 1 / inverse, 1 / to_inverse
    e2, to_e2 = f * (2 - f), g * (2 - g)
    n = g / (2 - g)
    minor = to_radius * (1 - g)
    arc = "pi() / 648000"
    moved = f"""SELECT x, y, degrees(atan2(cy, cx)) AS lon,
  degrees(atan2(cz + {to_e2 / (1 - to_e2)!r} * {minor!r} * pow(sin(theta), 3), p - {to_e2!r} * {to_radius!r} * pow(cos(theta), 3))) AS lat
 FROM (SELECT *, sqrt(cx * cx + cy * cy) AS p, atan2(cz * {to_radius!r}, sqrt(cx * cx + cy * cy) * {minor!r}) AS theta FROM (
  SELECT x, y, wx + ({sz}) * {arc} * wy - ({sy}) * {arc} * wz AS cx, -({sz}) * {arc} * wx + wy + ({sx}) * {arc} * wz AS cy,
   ({sy}) * {arc} * wx - ({sx}) * {arc} * wy + wz AS cz FROM (
   SELECT x, y, cx - ({rz}) * {arc} * cy + ({ry}) * {arc} * cz + ({tx}) - ({ux}) AS wx,
    ({rz}) * {arc} * cx + cy - ({rx}) * {arc} * cz + ({ty}) - ({uy}) AS wy,
    -({ry}) * {arc} * cx + ({rx}) * {arc} * cy + cz + ({tz}) - ({uz}) AS wz FROM (
    SELECT x, y, v * cos(radians(lat)) * cos(radians(lon)) AS cx, v * cos(radians(lat)) * sin(radians(lon)) AS cy,
     v * {1 - e2!r} * sin(radians(lat)) AS cz
    FROM (SELECT *, {radius!r} / sqrt(1 - {e2!r} * pow(sin(radians(lat)), 2)) AS v FROM placed_points)))))"""
    if datum == grid:
        moved = "SELECT * FROM placed_points"
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(series, 1))
    north = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(series, 1))
    scale = 0.9996 * to_radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = to_e2**0.5
    return f"""grid_{datum} AS (
 WITH placed_points AS (SELECT DISTINCT x, y, -122.0::DOUBLE + x * 0.00114 AS lon, 38.0::DOUBLE + y * 0.0009 AS lat FROM {points}),
 moved AS ({moved}),
 conformal AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon + 123) AS lam FROM moved),
 angles AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM conformal)
 SELECT x, y, 500000 + {scale!r} * (eta + {east}) AS east, {scale!r} * (xi + {north}) AS north FROM angles)"""


def located_on_grid(datum: str, name: str) -> str:
    """Points of ``grid_<datum>`` with the polygons they touch there."""
    return f"""{name} AS (
 SELECT px AS x, py AS y, subregion FROM (SELECT x AS px, y AS py, east AS x, north AS y FROM grid_{datum}) CROSS JOIN grid_edges
 GROUP BY px, py, subregion HAVING {INSIDE})"""


def noon(rows: str, name: str = "chosen") -> str:
    """Long rows nearest to local noon per variable, station, source and date."""
    return f"""timed AS (
 SELECT *, hour(clock) * 3600 + minute(clock) * 60 + microsecond(clock) / 1e6 AS tod
 FROM (SELECT *, datetime - INTERVAL 7 HOUR AS clock FROM {rows})),
{name} AS (
 SELECT * FROM (
  SELECT *, abs(43200 - tod) AS noon_diff,
   rank() OVER (PARTITION BY variable, station, source, date ORDER BY abs(43200 - tod), tod) AS place
  FROM timed) WHERE place = 1)"""


def usable(variables: str, meet: str = located("chosen")) -> str:
    """Usable observations with season; the CTE ``usable``. ``meet`` makes ``located`` from the chosen rows."""
    return f"""{OBS}, {EDGES}, long AS (
 SELECT source, source || ' ' || station AS station, datetime, date, month, year, x, y, variable, value
 FROM obs UNPIVOT (value FOR variable IN ({variables}))),
{noon("long")}, {meet},
inside AS (SELECT variable, subregion, month, year, value FROM chosen JOIN located USING (x, y)),
spread AS (SELECT variable, subregion, avg(value) AS m, nullif(stddev_samp(value), 0) AS s FROM inside GROUP BY ALL),
usable AS (
 SELECT variable, subregion, month, CASE WHEN month = 12 THEN year + 1 ELSE year END AS year, value, {SEASON} AS season
 FROM inside JOIN spread USING (variable, subregion) WHERE (value - m) / s < 10)"""


ELIGIBILITY = """eligibility AS (
 SELECT *, long_term OR subregion IN ('NATION_3', 'NATION_7', 'NATION_12') AS short_term FROM (
  SELECT n_name AS subregion, r_name AS region, season,
   NOT (n_name IN ('NATION_3', 'NATION_7', 'NATION_12')
    OR (n_name = 'NATION_4' AND season <> 'Summer')
    OR (n_name = 'NATION_9' AND season NOT IN ('Spring', 'Summer'))
    OR (n_name = 'NATION_11' AND season <> 'Fall')) AS long_term
  FROM nation JOIN region ON n_regionkey = r_regionkey
   CROSS JOIN (VALUES ('Winter'), ('Spring'), ('Summer'), ('Fall')) s(season)))"""


def monthly(rows: str, unit: str, name: str = "monthly") -> str:
    return f"""{name} AS (
 SELECT variable, month, season, {unit}, year, avg(value) AS month_mean, count(*) AS n FROM {rows} GROUP BY ALL)"""


def dense(table: str, first: str, unit: str, name: str = "dense") -> str:
    """Every combination of the first axis, unit and year within a variable."""
    return f"""{name} AS (
 SELECT g.*, t.* EXCLUDE (variable, {first}, {unit}, year)
  REPLACE (coalesce(t.n, 0) AS n)
 FROM ((SELECT DISTINCT variable, {first} FROM {table}) JOIN (SELECT DISTINCT variable, {unit} FROM {table})
   USING (variable) JOIN (SELECT DISTINCT variable, year FROM {table}) USING (variable)) g
 LEFT JOIN {table} t USING (variable, {first}, {unit}, year))"""


def strict(expression: str, agg: str = "avg") -> str:
    return f"CASE WHEN count({expression}) = count(*) THEN {agg}({expression}) END"


def seasonal(unit: str, month_na: str, prefix: str = "") -> str:
    first = "month, season" if month_na == "strict" else "season"
    return f"""{dense(prefix + "monthly", first, unit, prefix + "dense")},
{prefix}seasonal AS (
 SELECT variable, season, {unit}, year, {strict("month_mean")} AS value, sum(n)::BIGINT AS n
 FROM {prefix}dense GROUP BY variable, season, {unit}, year)"""


ALL_REGIONS = f"""eligible AS (
 SELECT u.*, e.region FROM usable u JOIN eligibility e USING (subregion, season) WHERE long_term),
{monthly("eligible", "region")}"""
THREE = usable("temperature, secchi, salinity")


def index(month_na: str, kind: str = "season") -> str:
    """The CTE ``index`` over all regions."""
    base = f"{THREE}, {ELIGIBILITY}, {ALL_REGIONS}, {seasonal('region', month_na)}"
    inside = "inside_years AS (SELECT * FROM seasonal WHERE year BETWEEN 1975 AND 2021)"
    if kind == "season":
        return f"""{base}, {inside}, index AS (
 SELECT variable, season, year, {strict("value")} AS value, sum(n)::BIGINT AS n
 FROM inside_years GROUP BY variable, season, year)"""
    return f"""{base}, {inside}, {dense("inside_years", "season", "region", "dense_years")}, index AS (
 SELECT variable, region, year, {strict("value")} AS value, sum(n)::BIGINT AS n
 FROM dense_years GROUP BY variable, region, year)"""


FRAME = f"frame AS (SELECT season, y::INT AS year FROM {SEASONS} CROSS JOIN range(1995, 2003) r(y))"
TABLE = f"""{index("relaxed")}, {FRAME}, wide AS (
 SELECT season, year, {", ".join(f"any_value(value) FILTER (variable = '{v}') AS {v}, any_value(n) FILTER (variable = '{v}') AS n_{v}" for v in ("temperature", "secchi", "salinity"))}
 FROM index GROUP BY season, year),
index_table AS (SELECT * FROM frame LEFT JOIN wide USING (season, year))"""

FIELD = f"""{usable("salinity")},
sal_monthly AS (
 SELECT 's' AS variable, month, season, subregion, year, avg(value) AS month_mean, var_samp(value) AS month_var,
  count(*) AS n FROM usable GROUP BY ALL),
{dense("sal_monthly", "month, season", "subregion", "sal_dense")},
raw_field AS (
 SELECT season, subregion, year, {strict("month_mean")} AS sal_mean,
  sqrt({strict("month_var")}) AS sal_sd, sum(n)::BIGINT AS n
 FROM sal_dense GROUP BY season, subregion, year),
field AS (
 SELECT * REPLACE (coalesce(sal_sd, avg(sal_sd) OVER (PARTITION BY subregion, season)) AS sal_sd) FROM raw_field)"""

ZONE = f"""{FIELD}, {ELIGIBILITY}, zone AS (
 SELECT f.season, f.subregion, f.year, f.n, coalesce(long_term, false) AS long_term,
  coalesce(short_term, false) AS short_term
 FROM field f LEFT JOIN eligibility e USING (season, subregion) WHERE sal_mean BETWEEN 0.5 AND 6)"""

EFFORT = f"""{usable("temperature, secchi")}, {ELIGIBILITY}, {monthly("usable", "subregion")},
{dense("monthly", "month, season", "subregion")},
all_effort AS (
 SELECT variable, season, subregion, year, count(DISTINCT CASE WHEN n > 0 THEN month END) AS n_months,
  sum(n)::BIGINT AS n FROM dense GROUP BY variable, season, subregion, year),
effort AS (
 SELECT a.*, long_term, short_term FROM all_effort a JOIN eligibility e USING (season, subregion) WHERE long_term),
effort_min AS (
 SELECT variable, year, season, min(n_months) AS n_months_min FROM effort GROUP BY variable, year, season)"""

# --- flows ----------------------------------------------------------------------------------


def _flow_sum(condition: str = "true") -> str:
    return f"round(sum(CASE WHEN {condition} THEN o_totalprice END), 2)"


FLOWS = ("inflowtotal", "inflowsacr", "inflowyolo", "infloweast", "outflow", "export")
FLOW = f"""flow AS (
 SELECT o_orderdate::DATE AS date, {_flow_sum()} AS inflowtotal,
  {_flow_sum("o_orderpriority = '1-URGENT'")} AS inflowsacr,
  {_flow_sum("o_orderpriority = '2-HIGH'")} AS inflowyolo,
  {_flow_sum("o_orderpriority = '3-MEDIUM'")} AS infloweast,
  {_flow_sum("o_orderstatus = 'F'")} AS outflow, {_flow_sum("o_orderstatus = 'O'")} AS export
 FROM orders GROUP BY 1)"""

LEAP = "dayofyear(make_date(year(date), 12, 31)) = 366"
WATER = f"""{FLOW}, dated AS (
 SELECT *, (year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END)::INT AS wy,
  (CASE WHEN {LEAP} AND dayofyear(date) >= 275 THEN dayofyear(date) - 274
   WHEN {LEAP} THEN dayofyear(date) + 92
   WHEN dayofyear(date) >= 274 THEN dayofyear(date) - 273
   ELSE dayofyear(date) + 92 END)::INT AS wdoy
 FROM flow),
water AS (
 SELECT *, {", ".join(
     f"CASE WHEN count({f}) OVER run = count(*) OVER run THEN sum({f}) OVER run END AS {f}_cum, "
     f"CASE WHEN count({f}) OVER whole = count(*) OVER whole THEN sum({f}) OVER whole END AS {f}_sum"
     for f in FLOWS)}
 FROM dated
 WINDOW run AS (PARTITION BY wy ORDER BY wdoy ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY wy))"""

YEAR_TYPES = """year_index AS (
 SELECT year(o_orderdate)::INT AS year, floor(avg(o_totalprice) / 1000 * 100 + 0.6371937) / 100 AS index
 FROM orders GROUP BY 1),
year_types AS (
 SELECT year, index,
  CASE WHEN gap < -0.5 THEN 'D' WHEN gap > 0.5 THEN 'W' ELSE 'N' END AS drought,
  CASE WHEN gap < -0.5 THEN 'Dry' WHEN gap > 0.5 THEN 'Wet' ELSE 'Below Normal' END AS yr_type
 FROM (SELECT *, index - avg(index) OVER () AS gap FROM year_index))"""

SERIES = f"""{YEAR_TYPES}, starts AS (
 SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY drought ORDER BY year) <= 1 THEN 0 ELSE 1 END AS start
 FROM year_types),
islands AS (
 SELECT *, sum(start) OVER (PARTITION BY drought ORDER BY year ROWS UNBOUNDED PRECEDING) AS island FROM starts),
series AS (
 SELECT year, index, drought, yr_type, dense_rank() OVER (ORDER BY drought, island)::INT AS series_id,
  row_number() OVER (PARTITION BY drought, island ORDER BY year)::INT AS series_year,
  CASE WHEN row_number() OVER (PARTITION BY drought, island ORDER BY year) >= 3 THEN '3+'
   ELSE row_number() OVER (PARTITION BY drought, island ORDER BY year)::VARCHAR END AS series_year2
 FROM islands)"""

# --- plankton ---------------------------------------------------------------------------------

SURVEY = "CASE l_linenumber % 3 WHEN 0 THEN 'EMP' WHEN 1 THEN 'STN' ELSE 'FMWT' END"
ZOOP = f"""zoop AS (
 SELECT {SURVEY} || ' ' || l_suppkey || ' ' || l_shipdate::DATE AS sampleid, l_suppkey::VARCHAR AS station,
  {SURVEY} AS source,
  CASE WHEN p_type = 'PROMO' THEN 'Macro' WHEN l_linestatus = 'O' THEN 'Micro' ELSE 'Meso' END AS sizeclass,
  p_type || CASE l_returnflag WHEN 'A' THEN ' Adult' WHEN 'N' THEN ' Juvenile' ELSE ' Larva_UnID' END AS taxlifestage,
  CASE WHEN p_size % 7 = 1 THEN 'Amphipoda' WHEN p_size % 7 = 2 THEN 'Mysida' WHEN p_size % 7 > 2 THEN 'Calanoida' END AS ord,
  l_quantity AS cpue, round(l_discount * 100, 1) AS salsurf, l_shipdate::DATE AS date,
  year(l_shipdate)::INT AS year, {PLACE.format("l_suppkey")}
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

MYSIDS = f"""weighed AS (
 SELECT l_shipdate::DATE AS date, l_suppkey::VARCHAR AS station, {SURVEY} AS source, sum(l_quantity) / 100 AS mass
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND l_returnflag = 'A' GROUP BY ALL),
mysids AS (
 SELECT source || ' ' || station || ' ' || date AS sampleid, 'PROMO Adult' AS taxlifestage,
  'Macro' AS sizeclass, mass * 1000 AS bpue_mysid FROM weighed)"""


def biomass(lenient: bool = False, group: str = "ibmr") -> str:
    """Biomass by sample and group; the CTE ``biomass``."""
    order = (
        "(ord IS NULL OR ord <> 'Amphipoda') AND (ord IS NULL OR ord <> 'Mysida' OR taxlifestage = 'PROMO Adult')"
        if lenient
        else "ord <> 'Amphipoda' AND (ord <> 'Mysida' OR taxlifestage = 'PROMO Adult')"
    )
    category = """CASE WHEN ibmr IN ('acartela', 'eurytem', 'othcalad', 'othcaljuv', 'pdiapfor') THEN 'Calanoid'
  WHEN ibmr IN ('limno', 'othcyc') THEN 'Cyclopoid' WHEN ibmr IN ('daphnia', 'othclad') THEN 'Cladoceran'
  WHEN ibmr = 'other' THEN 'Rotifer' WHEN ibmr = 'mysid' THEN 'Mysid' WHEN ibmr = 'allcopnaup' THEN 'Copepod' END"""
    key = "ibmr" if group == "ibmr" else f"{category} AS {group}"
    return f"""{ZOOP}, {MYSIDS},
clean AS (SELECT * REPLACE (
  CASE WHEN instr(taxlifestage, '_UnID') > 0
   THEN left(taxlifestage, instr(taxlifestage, '_UnID') - 1) || substr(taxlifestage, instr(taxlifestage, '_UnID') + 5)
   ELSE taxlifestage END AS taxlifestage) FROM zoop),
netted AS (
 SELECT * REPLACE (CASE WHEN taxlifestage = 'MEDIUM Juvenile' THEN 'MEDIUM Adult' ELSE taxlifestage END AS taxlifestage)
 FROM clean
 WHERE NOT (sizeclass = 'Meso' AND taxlifestage IN ('SMALL Adult', 'SMALL Juvenile', 'LARGE Larva'))
  AND NOT (sizeclass = 'Micro' AND taxlifestage IN ('ECONOMY Larva')) AND {order}),
weights AS (
 SELECT taxname || ' ' || lifestage AS taxlifestage, w AS carbonweight_ug
 FROM (SELECT p_type AS taxname, (count(*) % 15 + 1)::DOUBLE AS w FROM part GROUP BY 1)
  CROSS JOIN (VALUES ('Adult'), ('Juvenile'), ('Larva')) s(lifestage)
 WHERE NOT (taxname = 'LARGE' AND lifestage = 'Larva')),
taxon_groups AS (
 SELECT DISTINCT p_type || ' ' || lifestage AS taxlifestage,
  CASE WHEN p_type = 'ECONOMY' AND lifestage = 'Juvenile' THEN 'pdiapjuv'
   WHEN p_type = 'SMALL' AND lifestage = 'Larva' THEN NULL
   WHEN p_type = 'ECONOMY' THEN 'acartela' WHEN p_type = 'SMALL' THEN 'limno' WHEN p_type = 'MEDIUM' THEN 'daphnia'
   WHEN p_type = 'LARGE' THEN 'other' WHEN p_type = 'STANDARD' THEN 'allcopnaup' WHEN p_type = 'PROMO' THEN 'mysid' END AS ibmr
 FROM part CROSS JOIN (VALUES ('Adult'), ('Juvenile'), ('Larva')) s(lifestage)),
taxa AS (
 SELECT * FROM (
  SELECT n.*, g.ibmr, CASE WHEN n.taxlifestage = 'PROMO Adult' THEN bpue_mysid ELSE cpue * carbonweight_ug END AS bpue
  FROM netted n LEFT JOIN weights w ON n.taxlifestage = w.taxlifestage
   LEFT JOIN mysids m ON n.sampleid = m.sampleid AND n.taxlifestage = m.taxlifestage AND n.sizeclass = m.sizeclass
   LEFT JOIN taxon_groups g ON n.taxlifestage = g.taxlifestage)
 WHERE bpue IS NOT NULL AND salsurf IS NOT NULL),
gear AS (SELECT ibmr, bool_or(sizeclass = 'Micro') AND bool_or(sizeclass = 'Meso') AS mixed FROM taxa GROUP BY ibmr),
biomass AS (
 SELECT sampleid, station, x, y, salsurf, date, year, {key}, sum(bpue) AS bpue
 FROM taxa t JOIN gear ON t.ibmr IS NOT DISTINCT FROM gear.ibmr
 WHERE NOT (mixed AND source <> 'EMP') GROUP BY ALL)""".replace(
        "SELECT sampleid, station, x, y, salsurf, date, year, ibmr, sum(bpue)",
        "SELECT sampleid, station, x, y, salsurf, date, year, t.ibmr, sum(bpue)",
    ).replace("CASE WHEN ibmr IN ('acartela'", "CASE WHEN t.ibmr IN ('acartela'").replace(
        "WHEN ibmr IN ('limno'", "WHEN t.ibmr IN ('limno'"
    ).replace("WHEN ibmr IN ('daphnia'", "WHEN t.ibmr IN ('daphnia'").replace(
        "WHEN ibmr = 'other'", "WHEN t.ibmr = 'other'"
    ).replace("WHEN ibmr = 'mysid'", "WHEN t.ibmr = 'mysid'").replace(
        "WHEN ibmr = 'allcopnaup'", "WHEN t.ibmr = 'allcopnaup'"
    )


def placed_biomass(group: str = "ibmr") -> str:
    return f"""{biomass(group=group)}, {EDGES}, {located("biomass")}, placed_biomass AS (
 SELECT b.*, subregion, month(date)::INT AS month FROM biomass b JOIN located USING (x, y))"""


# --- scenarios ----------------------------------------------------------------------------------

MEANS = """model_output AS (
 SELECT l_shipdate AS datetime, l_discount * 60 AS a_bn_base,
  CASE WHEN l_linenumber <> 7 THEN l_tax * 100 END AS a_bn_gates FROM lineitem),
scenario_means AS (
 SELECT month(datetime)::INT AS month, round_even(avg(a_bn_base), 1)::DOUBLE AS a_bn_base,
  round_even(avg(a_bn_gates), 1)::DOUBLE AS a_bn_gates
 FROM model_output WHERE a_bn_gates IS NOT NULL GROUP BY 1)"""

ORDINARY = f"""{biomass()}, {YEAR_TYPES}, ordinary AS (
 SELECT sampleid, date, month(date)::INT AS month, b.year, salsurf, ibmr, bpue, ln(1 + bpue) AS bpue_log1p,
  round_even(salsurf * 10, 0)::INT AS tenths
 FROM biomass b JOIN year_types t
  ON t.year = b.year + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END
 WHERE yr_type = 'Below Normal' AND month(date) IN (6, 7, 8, 9, 10)),
conversions AS (
 SELECT ibmr, m::INT AS month, t::INT AS tenths, t * 0.01::DOUBLE - m * 0.05::DOUBLE AS fit
 FROM (SELECT DISTINCT ibmr FROM ordinary), range(1, 13) r(m), range(0, 81) q(t))"""

CORRECTED = f"""{ORDINARY}, {MEANS},
aims AS (
 SELECT month, scenario, round_even(salinity * 10, 0)::INT AS tenths
 FROM scenario_means UNPIVOT (salinity FOR scenario IN (a_bn_base, a_bn_gates))),
aimed AS (
 SELECT c.ibmr, c.month, scenario, fit AS fit_target FROM conversions c JOIN aims USING (month, tenths)
 WHERE month IN (6, 7, 8, 9, 10)),
shift AS (
 SELECT c.ibmr, c.month, c.tenths, scenario, fit_target - fit AS correction
 FROM conversions c JOIN aimed a ON a.month = c.month AND a.ibmr IS NOT DISTINCT FROM c.ibmr),
corrected AS (
 SELECT o.sampleid, o.ibmr, o.month, o.tenths, k.scenario, correction, exp(bpue_log1p + correction) - 1 AS bpue_adj
 FROM ordinary o CROSS JOIN (VALUES ('a_bn_base'), ('a_bn_gates')) k(scenario)
 LEFT JOIN shift s ON s.month = o.month AND s.tenths = o.tenths AND s.ibmr IS NOT DISTINCT FROM o.ibmr
  AND s.scenario = k.scenario)"""

DRAWS = """draws AS (
 SELECT 'g' || (vec_id % 2) AS ibmr, (floor(vec_id / 2)::BIGINT % 5 + 6)::INT AS month,
  (floor(vec_id / 10)::BIGINT % 2)::INT AS region2, floor(vec_id / 20)::INT AS tenths,
  list_transform(embedding, lambda e: e::DOUBLE) AS draws
 FROM embeddings)"""


def quantile(sorted_list: str, p: float) -> str:
    """Linear interpolation in a sorted list; equal neighbours stay as they are."""
    at = f"((len({sorted_list}) - 1) * {p})"
    low = f"{sorted_list}[floor({at})::INT + 1]"
    high = f"{sorted_list}[ceil({at})::INT + 1]"
    w = f"({at} - floor({at}))"
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (1 - {w}) * {low} + {w} * {high} END"


BAND = (("l95", 0.025), ("median", 0.5), ("u95", 0.975))
SCENARIOS = ("sal_base", "sal_a", "sal_b")
RATIO = f"""scenario_raw AS (
 SELECT (l_suppkey % 2)::INT AS region, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month,
  (sum(l_linenumber) % 25)::DOUBLE / 10 AS sal_base, (sum(l_partkey) % 25)::DOUBLE / 10 AS raw_a,
  (sum(l_suppkey) % 31)::DOUBLE / 10 AS sal_b
 FROM lineitem GROUP BY 1, 2, 3),
salinities AS (
 SELECT region, year, month, scenario, round_even(salinity * 10, 0)::INT AS tenths FROM (
  SELECT region, year, month, sal_base, CASE WHEN raw_a >= 0.4 THEN raw_a ELSE sal_base END AS sal_a, sal_b
  FROM scenario_raw) UNPIVOT (salinity FOR scenario IN (sal_base, sal_a, sal_b))),
{DRAWS},
matched AS (
 SELECT s.region, s.year, s.month, g.ibmr, s.scenario,
  list_transform(d.draws, lambda e: greatest(exp(e) - 1, 0)) AS biomass
 FROM salinities s CROSS JOIN (SELECT DISTINCT ibmr FROM draws) g
 LEFT JOIN draws d ON d.region2 = s.region AND d.month = s.month AND d.ibmr = g.ibmr AND d.tenths = s.tenths),
sides AS (
 SELECT region, year, month, ibmr, {", ".join(f"any_value(biomass) FILTER (scenario = '{s}') AS {s}" for s in SCENARIOS)}
 FROM matched GROUP BY region, year, month, ibmr),
relative AS (
 SELECT region, year, month, ibmr, {", ".join(
     f"list_sort(list_filter(list_transform(list_zip({s}, sal_base), lambda p: CASE WHEN p[2] = 0 THEN "
     f"(CASE WHEN p[1] > 0 THEN 'inf'::DOUBLE END) ELSE p[1] / p[2] END), lambda r: r IS NOT NULL)) AS r_{s}"
     for s in SCENARIOS)}
 FROM sides),
ratios AS (
 SELECT region, year, month, ibmr, {", ".join(
     f"CASE WHEN {s}_present THEN {quantile('r_' + s, p)} END AS {s}_{label}" for s in SCENARIOS for label, p in BAND)}
 FROM (SELECT r.*, {", ".join(f"(k.{s} IS NOT NULL AND k.sal_base IS NOT NULL) AS {s}_present" for s in SCENARIOS)}
  FROM relative r JOIN sides k USING (region, year, month, ibmr)))"""

SURFACE_ROWS = f"""{biomass()}, surface_rows AS (
 SELECT ibmr, year, month(date)::INT AS month, dayofyear(date)::INT AS doy, salsurf, (station::INT % 2)::INT AS region2
 FROM biomass WHERE ibmr IS NOT NULL),
stats AS (
 SELECT avg(salsurf) AS sm, stddev_samp(salsurf) AS ss, avg(doy) AS dm, stddev_samp(doy) AS ds FROM surface_rows)"""

# --- statistics -----------------------------------------------------------------------------------

LABELLED = f"""{PLACED_SEASON}, {YEAR_TYPES}, labelled AS (
 SELECT r.*, t.drought, t.yr_type FROM seasonal_rows r LEFT JOIN year_types t USING (year)
 WHERE temperature IS NOT NULL)"""

CELLS = f"""{LABELLED}, factors AS (
 SELECT 'Regional_Drought' AS model, drought AS a, region AS b, temperature AS y FROM labelled
 UNION ALL SELECT 'Regional_Year', year::VARCHAR, region, temperature FROM labelled
 UNION ALL SELECT 'Seasonal_Drought', drought, season, temperature FROM labelled
 UNION ALL SELECT 'Seasonal_Year', year::VARCHAR, season, temperature FROM labelled),
cells AS (
 SELECT model, a, b, count(*) AS n, sum(y) AS sum_y, sum(y * y) AS sum_y2, max(y) AS max_y
 FROM factors WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY model, a, b)"""

# Additive fit by alternating between the effects of the two factors until they settle.
FIT = f"""{CELLS}, b_steps AS (
 SELECT 0 AS step, model, b, 0.0::DOUBLE AS effect FROM (SELECT DISTINCT model, b FROM cells)
 UNION ALL
 SELECT a.step + 1, c.model, c.b, sum(c.sum_y - c.n * a.effect) / sum(c.n)
 FROM cells c JOIN (
  SELECT s.step, k.model, k.a, sum(k.sum_y - k.n * s.effect) / sum(k.n) AS effect
  FROM cells k JOIN b_steps s ON s.model = k.model AND s.b = k.b WHERE s.step < 60 GROUP BY s.step, k.model, k.a) a
  ON a.model = c.model AND a.a = c.a
 GROUP BY a.step, c.model, c.b),
b_effects AS (SELECT model, b, effect FROM b_steps WHERE step = 60),
a_effects AS (
 SELECT model, a, sum(sum_y - n * effect) / sum(n) AS effect FROM cells JOIN b_effects USING (model, b) GROUP BY model, a),
fitted AS (
 SELECT c.*, x.effect + z.effect AS fit FROM cells c JOIN a_effects x USING (model, a) JOIN b_effects z USING (model, b)),
residual AS (
 SELECT model, sum(sum_y2 - 2 * fit * sum_y + n * fit * fit) AS rss,
  (sum(n) - count(DISTINCT a) - count(DISTINCT b) + 1)::INT AS df FROM fitted GROUP BY model),
one_way AS (
 SELECT model, 'a' AS factor, sum(y2) - sum(s * s / n) AS rss, count(*) AS levels
 FROM (SELECT model, a, sum(n) AS n, sum(sum_y) AS s, sum(sum_y2) AS y2 FROM cells GROUP BY model, a) GROUP BY model
 UNION ALL
 SELECT model, 'b', sum(y2) - sum(s * s / n), count(*)
 FROM (SELECT model, b, sum(n) AS n, sum(sum_y) AS s, sum(sum_y2) AS y2 FROM cells GROUP BY model, b) GROUP BY model),
names AS (SELECT * FROM (VALUES ('Regional_Drought', 'drought', 'region'), ('Regional_Year', 'year', 'region'),
 ('Seasonal_Drought', 'drought', 'season'), ('Seasonal_Year', 'year', 'season')) n(model, name_a, name_b)),
effects AS (
 SELECT r.model, CASE o.factor WHEN 'b' THEN name_a ELSE name_b END AS parameter, o.rss - r.rss AS sum_sq,
  (p.levels - 1)::INT AS df, ((o.rss - r.rss) / (p.levels - 1)) / (r.rss / r.df) AS f_value, r.df AS df2, r.rss AS rss
 FROM residual r JOIN one_way o USING (model) JOIN one_way p ON p.model = r.model AND p.factor <> o.factor
  JOIN names n ON n.model = r.model)"""


def f_tails(source: str, keys: str, f: str, df1: str, df2: str, name: str = "tails") -> str:
    """P(F > f) by Simpson's rule; the CTE has the keys and ``p``."""
    return f"""{name} AS (
 SELECT {keys}, 1 - sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
   * CASE WHEN k = 0 AND d1 > 1 THEN 0 WHEN k = 0 THEN exp(scale)
      ELSE exp(scale + (d2 - 1) * ln(cos(k * h)) + (d1 - 1) * ln(sin(k * h))) END) * any_value(h) / 3 AS p
 FROM (SELECT {keys}, ({df1})::DOUBLE AS d1, ({df2})::DOUBLE AS d2, asin(sqrt({df1} * {f} / ({df2} + {df1} * {f}))) / 2000 AS h,
   lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0) + ln(2) AS scale FROM {source})
  CROSS JOIN range(0, 2001) r(k)
 GROUP BY {keys})"""


ANOVA = f"""{FIT}, {f_tails("effects", "model, parameter", "f_value", "df", "df2")}, anova AS (
 SELECT e.model, e.parameter, sum_sq, df, f_value, p AS p_value FROM effects e JOIN tails USING (model, parameter)
 UNION ALL SELECT model, 'Residuals', rss, df, NULL, NULL FROM residual)"""

TAXA = f"""{ZOOP}, {YEAR_TYPES}, matrix AS (
 SELECT year, sum(cpue) AS "All taxa", {", ".join(
     f"sum(CASE WHEN split_part(taxlifestage, ' ', 1) = '{k}' {'AND year >= 1998 ' if k == 'SMALL' else ''}THEN cpue END) AS \"{k}\""
     for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))}
 FROM zoop GROUP BY year),
scaled AS (
 SELECT m.*, drought, index, (index - avg(index) OVER ()) / stddev_samp(index) OVER () AS index_s
 FROM matrix m LEFT JOIN year_types USING (year)),
taxa_long AS (
 SELECT year, drought, index, index_s, taxa, bpue FROM scaled UNPIVOT INCLUDE NULLS
  (bpue FOR taxa IN ("All taxa", "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))),
modelled AS (
 SELECT *, CASE WHEN taxa = 'LARGE' THEN bpue WHEN bpue > 0 THEN ln(bpue) END AS y FROM taxa_long)"""

LM = f"""{TAXA}, sums AS (
 SELECT taxa, regr_count(y, index_s)::BIGINT AS n, regr_slope(y, index_s) AS slope,
  regr_intercept(y, index_s) AS intercept, regr_r2(y, index_s) AS r2, regr_sxx(y, index_s) AS sxx,
  regr_sxy(y, index_s) AS sxy, regr_syy(y, index_s) AS syy, regr_avgx(y, index_s) AS avgx
 FROM modelled GROUP BY taxa),
lm AS (
 SELECT *, slope / se_slope AS t_slope, intercept / se_intercept AS t_intercept, (slope / se_slope) ** 2 AS f_value
 FROM (
  SELECT *, sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1 / n + avgx * avgx / sxx) AS se_intercept,
   1 - (1 - r2) * (n - 1) / df_resid AS adj_r2
  FROM (SELECT *, n - 2 AS df_resid, sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) AS sigma FROM sums)))"""

BOX = f"""{PLACED_SEASON}, quartiles AS (
 SELECT season, region, quantile_cont(secchi, 0.25) AS q1, quantile_cont(secchi, 0.5) AS median,
  quantile_cont(secchi, 0.75) AS q3 FROM seasonal_rows GROUP BY season, region),
fenced AS (
 SELECT r.season, r.region, secchi, q1, median, q3,
  secchi BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
 FROM seasonal_rows r JOIN quartiles USING (season, region))"""


DATUMS = f"""{OBS}, {EDGES}, {GRID_EDGES}, stations AS (SELECT station, x, y, count(*) AS n FROM obs GROUP BY ALL),
{", ".join(f"{on_grid('stations', d)}, {located_on_grid(d, 'at_' + d)}" for d in DATUM)},
datums AS (
 SELECT station, n, a.subregion AS subregion_wgs84, b.subregion AS subregion_nad83, c.subregion AS subregion_nad27
 FROM stations LEFT JOIN at_wgs84 a USING (x, y) LEFT JOIN at_nad83 b USING (x, y) LEFT JOIN at_nad27 c USING (x, y))"""


def renamed(ctes: str, prefix: str, names: str) -> str:
    """The same CTEs under other names, so that they can appear twice in a query."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"{prefix}\1", ctes)


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def qr(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


INDEX_OUT = f"SELECT variable, season, year, {snap('value')} AS value, n FROM index"
RATIO_COLUMNS = [f"{s}_{label}" for s in SCENARIOS for label, _ in BAND]

ORACLE: dict[str, str] = {
    "nearest_noon": q(
        f"""{OBS_T}, long AS (
 SELECT source, source || ' ' || station AS station, datetime, date, obs_id, 'temperature' AS variable,
  temperature AS value FROM obs_t WHERE temperature IS NOT NULL), {noon("long")}""",
        f"SELECT source, station, date, obs_id, {snaps('value tod noon_diff')} FROM chosen",
    ),
    "drop_high_outliers": q(
        f"{PLACED}, spread AS (SELECT subregion, avg(secchi) AS m, nullif(stddev_samp(secchi), 0) AS s FROM placed GROUP BY 1)",
        """SELECT source, station, date, subregion, secchi FROM placed JOIN spread USING (subregion)
 WHERE (secchi - m) / s < 1.5""",
    ),
    "season_year": q(
        f"{OBS}, rows AS (SELECT {SEASON} AS season, CASE WHEN month = 12 THEN year + 1 ELSE year END AS year, secchi FROM obs)",
        f"SELECT season, year, count(*) AS n, {snap('avg(secchi)')} AS secchi FROM rows GROUP BY season, year",
    ),
    "season_levels": q(
        f"{OBS}, rows AS (SELECT {SEASON} AS season FROM obs)",
        """SELECT season, CASE season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 WHEN 'Fall' THEN 4 END AS ord,
 count(*) AS n FROM rows GROUP BY season""",
    ),
    "seasonal_index_strict": q(index("strict"), INDEX_OUT),
    "seasonal_index_relaxed": q(index("relaxed"), INDEX_OUT),
    "yearly_index": q(
        index("relaxed", "year"), f"SELECT variable, region, year, {snap('value')} AS value, n FROM index"
    ),
    "index_table_multi": q(
        TABLE,
        f"SELECT season, year, {snaps('temperature secchi salinity')}, n_temperature, n_secchi, n_salinity FROM index_table",
    ),
    "index_table_year": q(
        f"""{index("relaxed", "year")}, wide AS (
 SELECT region, year, {", ".join(f"any_value(value) FILTER (variable = '{v}') AS {v}, any_value(n) FILTER (variable = '{v}') AS n_{v}" for v in ("temperature", "secchi", "salinity"))}
 FROM index GROUP BY region, year)""",
        f"""SELECT region, year, {snaps('temperature secchi salinity')}, n_temperature, n_secchi, n_salinity
 FROM (SELECT r_name AS region, y::INT AS year FROM region CROSS JOIN range(1995, 2003) t(y)) LEFT JOIN wide USING (region, year)""",
    ),
    "index_window": q(
        f"""{usable("secchi")}, {ELIGIBILITY},
eligible AS (SELECT u.*, e.region FROM usable u JOIN eligibility e USING (subregion, season) WHERE long_term),
{monthly("eligible", "region")}, {seasonal("region", "relaxed")}""",
        f"""SELECT variable, season, year, {snap(strict("value"))} AS value, sum(n)::BIGINT AS n
 FROM seasonal WHERE year IN (1996, 1997, 1998) GROUP BY variable, season, year""",
    ),
    "survey_years": q(
        OBS, f"SELECT source, year, count(*) AS n, {snap('avg(secchi)')} AS secchi FROM obs WHERE source IN ('A', 'N') AND year <= 1998 GROUP BY 1, 2"
    ),
    "survey_long_term": q(
        OBS,
        f"""SELECT source, year, count(*) AS n, {snap('avg(salinity)')} AS salinity FROM obs
 WHERE source IN (SELECT source FROM obs GROUP BY source HAVING count(*) * 3 < (SELECT count(*) FROM obs)) GROUP BY 1, 2""",
    ),
    "numbered_lines": """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS place FROM lineitem""",
    "first_seen_stations": """SELECT l_suppkey, first_row, row_number() OVER (ORDER BY first_row) AS level FROM (
 SELECT l_suppkey, min(n) AS first_row
 FROM (SELECT l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
 WHERE l_suppkey NOT IN (1, 2) GROUP BY l_suppkey)""",
    "region_rows": """SELECT r_name AS region, n_name AS subregion, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "shifted_years": q(
        OBS,
        f"""SELECT (year + CASE WHEN month = 12 THEN 1 ELSE 0 END)::INT AS yearadj, month, count(*) AS n, {snap('avg(secchi)')} AS secchi
 FROM obs GROUP BY 1, 2""",
    ),
    "index_n_long": q(
        TABLE,
        """SELECT season, year, 'temperature' AS variable, n_temperature AS n FROM index_table
 UNION ALL SELECT season, year, 'secchi', n_secchi FROM index_table
 UNION ALL SELECT season, year, 'salinity', n_salinity FROM index_table""",
    ),
    "index_wide": q(
        TABLE,
        f"""SELECT year, {snap("any_value(temperature) FILTER (season = 'Summer')")} AS "temperature_Summer",
 {snap("any_value(temperature) FILTER (season = 'Fall')")} AS "temperature_Fall",
 {snap("any_value(secchi) FILTER (season = 'Fall')")} AS "secchi_Fall",
 {snap("any_value(salinity) FILTER (season = 'Winter')")} AS "salinity_Winter" FROM index_table GROUP BY year""",
    ),
    "salinity_field": q(FIELD, f"SELECT season, subregion, year, {snaps('sal_mean sal_sd')}, n FROM field"),
    "salinity_zone_flags": q(
        FIELD,
        f"""SELECT season, subregion, year, {snaps('sal_mean sal_sd')}, n, sal_mean BETWEEN 0.5 AND 6 AS low_sal,
 sal_mean - sal_sd <= 6 AND sal_mean + sal_sd >= 0.5 AS low_sal_sd FROM field""",
    ),
    "low_salinity_zone": q(ZONE, "SELECT * FROM zone"),
    "seasonal_index_zone": q(
        f"""{renamed(ZONE, "sal_", "usable chosen located timed long inside spread")},
{usable("temperature, secchi").split(f"{EDGES}, ", 1)[1]},
eligible AS (
 SELECT u.*, r_name AS region FROM usable u JOIN zone z USING (season, subregion, year)
  JOIN nation ON n_name = subregion JOIN region ON n_regionkey = r_regionkey WHERE long_term OR short_term),
{monthly("eligible", "region")}, {seasonal("region", "strict")}""",
        f"""SELECT variable, season, year, {snap(strict("value"))} AS value, sum(n)::BIGINT AS n
 FROM seasonal WHERE year BETWEEN 1975 AND 2021 GROUP BY variable, season, year""",
    ),
    "region_eligibility": q(
        f"{PLACED}, {ELIGIBILITY}",
        """SELECT subregion, season, long_term, short_term FROM eligibility
 WHERE subregion IN (SELECT subregion FROM placed)""",
    ),
    "sampling_effort": q(
        EFFORT, "SELECT variable, season, subregion, year, n_months, n, long_term, short_term FROM effort"
    ),
    "effort_min": q(EFFORT, "SELECT * FROM effort_min"),
    "effort_vs_index": q(
        f"""{EFFORT}, eligible AS (
 SELECT u.*, e.region FROM usable u JOIN eligibility e USING (subregion, season) WHERE long_term),
{monthly("eligible", "region", "r_monthly")}, {seasonal("region", "strict", "r_")},
index AS (
 SELECT variable, year, season, {strict("value")} AS value FROM r_seasonal WHERE year BETWEEN 1975 AND 2021
 GROUP BY variable, season, year),
full_effort AS (SELECT variable, year, season FROM effort_min WHERE n_months_min >= 3),
indexed AS (SELECT variable, year, season FROM index WHERE value IS NOT NULL)""",
        """SELECT *, 'effort only' AS side FROM (SELECT * FROM full_effort EXCEPT SELECT * FROM indexed)
 UNION ALL SELECT *, 'index only' FROM (SELECT * FROM indexed EXCEPT SELECT * FROM full_effort)""",
    ),
    "effort_vs_relaxed_index": q(
        f"""{EFFORT}, eligible AS (
 SELECT u.*, e.region FROM usable u JOIN eligibility e USING (subregion, season) WHERE long_term),
{monthly("eligible", "region", "r_monthly")}, {seasonal("region", "relaxed", "r_")},
index AS (
 SELECT variable, year, season, {strict("value")} AS value FROM r_seasonal WHERE year BETWEEN 1975 AND 2021
 GROUP BY variable, season, year),
full_effort AS (SELECT variable, year, season FROM effort_min WHERE n_months_min >= 3),
indexed AS (SELECT variable, year, season FROM index WHERE value IS NOT NULL)""",
        """SELECT *, 'effort only' AS side FROM (SELECT * FROM full_effort EXCEPT SELECT * FROM indexed)
 UNION ALL SELECT *, 'index only' FROM (SELECT * FROM indexed EXCEPT SELECT * FROM full_effort)""",
    ),
    "assign_subregion": q(
        f"{OBS_T}, {EDGES}, {located('obs_t')}", "SELECT obs_id, subregion FROM obs_t JOIN located USING (x, y)"
    ),
    "assign_subregion_projected": q(
        f"{OBS_T}, {EDGES}, {GRID_EDGES}, {on_grid('obs_t', 'wgs84')}, {located_on_grid('wgs84', 'located')}",
        "SELECT obs_id, subregion FROM obs_t JOIN located USING (x, y)",
    ),
    "seasonal_index_projected": q(
        f"""{usable("salinity", f"{GRID_EDGES}, {on_grid('chosen', 'nad27')}, {located_on_grid('nad27', 'located')}")}, {ELIGIBILITY},
eligible AS (SELECT u.*, e.region FROM usable u JOIN eligibility e USING (subregion, season) WHERE long_term),
{monthly("eligible", "region")}, {seasonal("region", "relaxed")}""",
        f"""SELECT variable, season, year, {snap(strict("value"))} AS value, sum(n)::BIGINT AS n
 FROM seasonal WHERE year BETWEEN 1975 AND 2021 GROUP BY variable, season, year""",
    ),
    "datum_check": q(DATUMS, "SELECT * FROM datums"),
    "datum_unmatched": q(
        DATUMS, "SELECT * FROM datums WHERE subregion_wgs84 IS NULL OR subregion_nad83 IS NULL OR subregion_nad27 IS NULL"
    ),
    "grid_positions": q(
        f"{OBS}, {', '.join(on_grid('obs', d) for d in DATUM)}",
        f"""SELECT station, {", ".join(f"{snap(f'{d}.{axis}', 2)} AS {axis}_{short}" for short in DATUM for d, axis in ((f"grid_{short}", "east"), (f"grid_{short}", "north")))}
 FROM (SELECT DISTINCT station, x, y FROM obs) JOIN grid_wgs84 USING (x, y) JOIN grid_nad83 USING (x, y) JOIN grid_nad27 USING (x, y)""",
    ),
    "water_year_flow": q(
        WATER,
        f"SELECT date, {snaps(' '.join(FLOWS), 1)}, wy, wdoy, {snaps(' '.join(f'{f}_cum {f}_sum' for f in FLOWS), 1)} FROM water",
    ),
    "month_starts": q(
        WATER,
        """SELECT strftime(date, '%b') AS month, min(wdoy) AS day_min, min(wdoy) + 15 AS month_label
 FROM water GROUP BY 1""",
    ),
    "drought_series": q(SERIES, "SELECT * FROM series"),
    "flow_with_series": q(
        f"{WATER}, {SERIES}",
        f"""SELECT date, wy, wdoy, drought, series_id, series_year, series_year2,
 {snap("inflowtotal / nullif(inflowtotal_sum, 0)", 9)} AS inflowtotal_share,
 {snap("inflowtotal_cum / nullif(inflowtotal_sum, 0)", 9)} AS inflowtotal_cum_share
 FROM water JOIN series ON wy = year""",
    ),
    "mysid_union": q(MYSIDS, f"SELECT sampleid, taxlifestage, sizeclass, {snap('bpue_mysid')} AS bpue_mysid FROM mysids"),
    "plankton_biomass": q(
        biomass(), f"SELECT sampleid, station, x, y, {snap('salsurf')} AS salsurf, date, year, ibmr, {snap('bpue')} AS bpue FROM biomass"
    ),
    "plankton_biomass_lenient": q(
        biomass(lenient=True),
        f"SELECT sampleid, station, x, y, {snap('salsurf')} AS salsurf, date, year, ibmr, {snap('bpue')} AS bpue FROM biomass",
    ),
    "biomass_covariates": q(
        f"""{placed_biomass()}, dated AS (
 SELECT *, dayofyear(date)::INT AS doy, ln(1 + bpue) AS bpue_log1p FROM placed_biomass)""",
        f"""SELECT sampleid, ibmr, subregion, month, doy, {snap('bpue_log1p')} AS bpue_log1p,
 {snap("(salsurf - avg(salsurf) OVER ()) / stddev_samp(salsurf) OVER ()")} AS salsurf_s,
 {snap("(doy - avg(doy) OVER ()) / stddev_samp(doy) OVER ()")} AS doy_s FROM dated""",
    ),
    "sample_size": q(
        f"""{placed_biomass()}, per_sample AS (
 SELECT sampleid, year, month, station,
  CASE WHEN subregion IN ('NATION_0', 'NATION_1') THEN 'NATION_0+1' ELSE subregion END AS subregion, sum(bpue) AS bpue
 FROM placed_biomass WHERE year >= 1995 GROUP BY ALL)""",
        f"SELECT year, month, subregion, {snap('avg(bpue)')} AS mean_bpue, count(*) AS samplesize FROM per_sample GROUP BY year, month, subregion",
    ),
    "composition": q(
        f"""{placed_biomass("category")}, totals AS (
 SELECT month, subregion, category, sum(bpue) AS bpue FROM placed_biomass WHERE year >= 1996 GROUP BY ALL)""",
        f"""SELECT month, subregion, category, {snap('bpue')} AS bpue,
 {snap("bpue / nullif(sum(bpue) OVER (PARTITION BY month, subregion), 0)")} AS prop FROM totals""",
    ),
    "scenario_means": q(MEANS, "SELECT * FROM scenario_means"),
    "salinity_correction": q(
        CORRECTED, f"SELECT sampleid, ibmr, month, tenths, scenario, {snaps('correction bpue_adj')} FROM corrected"
    ),
    "corrected_summary": q(
        CORRECTED,
        f"""SELECT ibmr, month, scenario, {snap(strict("bpue_adj", "sum"), 4)} AS bpue_sum,
 {snap(strict("bpue_adj", "stddev_samp"), 4)} AS bpue_sd FROM corrected GROUP BY ibmr, month, scenario""",
    ),
    "targets_out_of_range": q(
        MEANS,
        """SELECT scenario, list_sort(list(DISTINCT tenths)) AS outside FROM (
 SELECT scenario, round_even(salinity * 10, 0)::INT AS tenths
 FROM scenario_means UNPIVOT (salinity FOR scenario IN (a_bn_base, a_bn_gates))) WHERE tenths NOT BETWEEN 0 AND 25 GROUP BY scenario""",
    ),
    "out_of_range_keys": q(ORDINARY, "SELECT tenths FROM ordinary EXCEPT SELECT tenths FROM conversions"),
    "monthly_salinity_grid": q(
        f"""{PLACED}, data AS (SELECT region, month, secchi / 5 AS salsurf FROM placed),
limits AS (
 SELECT region, month, quantile_cont(salsurf, 0.005) AS l, quantile_cont(salsurf, 0.995) AS u FROM data GROUP BY 1, 2),
span AS (
 SELECT region, round_even(min(salsurf) * 10, 0)::INT AS lo, round_even(max(salsurf) * 10, 0)::INT AS hi
 FROM data GROUP BY 1),
steps AS (SELECT region, unnest(range(lo, hi + 1))::INT AS tenths FROM span)""",
        """SELECT s.region, m.month, dayofyear(make_date(2001, m.month, 15))::INT AS doy, s.tenths, s.tenths / 10.0::DOUBLE AS salsurf
 FROM steps s CROSS JOIN (SELECT t::INT AS month FROM range(1, 13) r(t)) m
 JOIN limits l ON l.region = s.region AND l.month = m.month WHERE s.tenths / 10.0::DOUBLE BETWEEN l AND u""",
    ),
    "scenario_ratio": q(
        RATIO,
        "SELECT region, year, month, ibmr, "
        + ", ".join(f"CASE WHEN isinf({c}) THEN {c} ELSE {snap(c)} END AS {c}" for c in RATIO_COLUMNS)
        + " FROM ratios",
    ),
    "missing_results": q(
        RATIO,
        " UNION ALL ".join(
            f"SELECT region, year, month, ibmr, '{s}' AS scenario, {s}_median IS NULL AS missing FROM ratios"
            for s in SCENARIOS
        ),
    ),
    "signed_logs": q(
        f"""{OBS}, logs AS (
 SELECT source, year, avg(sign(secchi - 50) * ln(1 + abs(secchi - 50))) AS log FROM obs GROUP BY ALL)""",
        f"SELECT source, year, {snap('log')} AS log, {snap('sign(log) * (exp(abs(log)) - 1)')} AS back FROM logs",
    ),
    "priority_parts": """SELECT split_part(o_orderpriority, '-', 1) AS rank, split_part(o_orderpriority, '-', 2) AS label,
 replace(o_orderpriority, 'E', '') AS short, count(*) AS n FROM orders GROUP BY ALL""",
    "tagged_sources": q(
        f"""{OBS_T}, {OBS}, tagged AS (
 SELECT 'timed' AS origin, station, year, temperature, NULL AS secchi FROM obs_t
 UNION ALL SELECT 'whole', station, year, temperature, secchi FROM obs)""",
        f"""SELECT origin, year, count(*) AS n, count(secchi) AS n_secchi, {snap('avg(temperature)')} AS temperature
 FROM tagged GROUP BY ALL""",
    ),
    "filled_days": q(
        f"""{OBS}, daily AS (SELECT source, year, date, min(temperature) AS low FROM obs GROUP BY ALL)""",
        """SELECT source, year, date, last_value(CASE WHEN day(date) % 3 = 0 THEN low END::DOUBLE IGNORE NULLS)
 OVER (PARTITION BY source, year ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM daily""",
    ),
    "yearly_band": q(
        f"""{OBS}, means AS (SELECT source, year, avg(secchi) AS mean, stddev_samp(secchi) AS sd FROM obs GROUP BY ALL)""",
        f"""SELECT source, year, {snaps('mean sd')}, {snap('mean - sd')} AS ymin, {snap('mean + sd')} AS ymax FROM means""",
    ),
    "far_values": q(
        f"""{OBS}, powers AS (SELECT source, station, date, datetime, pow(secchi::DOUBLE, 5.0) AS power FROM obs),
quartiles AS (SELECT source, quantile_cont(power, 0.25) AS q1, quantile_cont(power, 0.75) AS q3 FROM powers GROUP BY source)""",
        f"""SELECT source, station, date, datetime, {snap('power', 2)} AS power FROM powers JOIN quartiles USING (source)
 WHERE NOT power BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    ),
    "draw_band": q(
        f"{DRAWS}, ordered AS (SELECT ibmr, month, region2, tenths, list_sort(draws) AS s FROM draws)",
        f"SELECT ibmr, month, region2, tenths, {', '.join(f'{snap(quantile(chr(115), p), 9)} AS {label}' for label, p in BAND)} FROM ordered",
    ),
    "draws_long": q(
        f"""{DRAWS}, long AS (
 SELECT ibmr, month, generate_subscripts(draws, 1)::INT AS draw, unnest(draws) AS fit FROM draws)""",
        f"SELECT ibmr, month, draw, {snap('avg(fit)', 8)} AS fit FROM long GROUP BY ibmr, month, draw",
    ),
    "draws_restored": q(
        f"""{DRAWS}, long AS (
 SELECT ibmr, month, region2, tenths, generate_subscripts(draws, 1)::INT AS draw, unnest(draws) AS fit FROM draws)""",
        f"""SELECT ibmr, month, region2, tenths, max(draw) AS n, count(*)::INT AS held, max(draw) AS last,
 {snap('sum(fit::DOUBLE * draw)')} AS weighted FROM long WHERE fit > -0.1 GROUP BY ibmr, month, region2, tenths""",
    ),
    "surface_grid": q(
        f"""{SURFACE_ROWS}, limits AS (
 SELECT region2, month, quantile_cont(salsurf, 0.005) AS l, quantile_cont(salsurf, 0.995) AS u FROM surface_rows GROUP BY 1, 2),
steps AS (
 SELECT region2, unnest(range(round_even(min(salsurf) * 10, 0)::INT, round_even(max(salsurf) * 10, 0)::INT + 1))::INT AS tenths
 FROM surface_rows GROUP BY region2),
grid AS (
 SELECT s.region2, m.month, dayofyear(make_date(2001, m.month, 15))::INT AS doy, s.tenths, s.tenths / 10.0::DOUBLE AS salsurf
 FROM steps s CROSS JOIN (SELECT t::INT AS month FROM range(1, 13) r(t)) m
 JOIN limits l ON l.region2 = s.region2 AND l.month = m.month WHERE s.tenths / 10.0::DOUBLE BETWEEN l AND u)""",
        f"""SELECT region2, month, doy, tenths, {snap('salsurf')} AS salsurf,
 {snap('(salsurf - sm) / ss')} AS salsurf_s, {snap('(doy - dm) / ds')} AS doy_s FROM grid CROSS JOIN stats""",
    ),
    "surface_knots": q(
        f"""{SURFACE_ROWS}, scaled AS (
 SELECT ibmr, region2, year, (salsurf - sm) / ss AS s, (doy - dm) / ds AS d FROM surface_rows CROSS JOIN stats),
k AS (SELECT i::INT AS knot FROM range(0, 5) r(i)),
sal AS (SELECT ibmr, region2, quantile_cont(s, [0, 0.25, 0.5, 0.75, 1]) AS q FROM (SELECT DISTINCT ibmr, region2, s FROM scaled) GROUP BY 1, 2),
day AS (SELECT ibmr, region2, quantile_cont(d, [0, 0.25, 0.5, 0.75, 1]) AS q FROM (SELECT DISTINCT ibmr, region2, d FROM scaled) GROUP BY 1, 2),
years AS (SELECT ibmr, region2, count(DISTINCT year)::INT AS n_years FROM scaled GROUP BY 1, 2)""",
        f"""SELECT ibmr, region2, n_years, knot, {snap('sal.q[knot + 1]')} AS sal_knots, {snap('day.q[knot + 1]')} AS day_knots
 FROM sal JOIN day USING (ibmr, region2) JOIN years USING (ibmr, region2) CROSS JOIN k""",
    ),
    "recent_year_labels": q(
        f"""{LABELLED}, recent AS (
 SELECT *, CASE WHEN year = 2000 THEN '2000' WHEN year = 2001 THEN '2001' ELSE drought END AS drought_recent,
  CASE WHEN year = 2000 THEN '2000' WHEN year = 2001 THEN '2001' ELSE yr_type END AS yr_type_recent FROM labelled)""",
        f"""SELECT drought, drought_recent, yr_type_recent, season, region, count(*) AS n,
 {snap('avg(temperature)')} AS temperature FROM recent GROUP BY ALL""",
    ),
    "anova2_cells": q(CELLS, f"SELECT model, a, b, n, {snaps('sum_y sum_y2 max_y')} FROM cells"),
    "anova2": qr(ANOVA, f"SELECT model, parameter, {snaps('sum_sq f_value p_value', 3)}, df FROM anova"),
    "anova_stack": qr(
        ANOVA,
        f"""SELECT parameter, {snaps('sum_sq f_value', 3)}, df, model,
 CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE round_even(p_value, 4)::DOUBLE::VARCHAR END AS p_text FROM anova""",
    ),
    "partial_r2": qr(FIT, f"SELECT model, parameter, {snap('sum_sq / (sum_sq + rss)')} AS partial_r2 FROM effects"),
    "marginal_means": qr(
        FIT,
        f"""SELECT model, 'a' AS factor, x.a AS level, {snap('x.effect + m.effect')} AS emmean, df, max_y
 FROM a_effects x JOIN (SELECT model, avg(effect) AS effect FROM b_effects GROUP BY model) m USING (model)
  JOIN residual USING (model) JOIN (SELECT model, a, max(max_y) AS max_y FROM cells GROUP BY model, a) t USING (model, a)
 UNION ALL
 SELECT model, 'b', x.b, {snap('x.effect + m.effect')}, df, max_y
 FROM b_effects x JOIN (SELECT model, avg(effect) AS effect FROM a_effects GROUP BY model) m USING (model)
  JOIN residual USING (model) JOIN (SELECT model, b, max(max_y) AS max_y FROM cells GROUP BY model, b) t USING (model, b)""",
    ),
    "fitted_resid": qr(
        FIT,
        f"""SELECT source, station, date, {snap('temperature')} AS temperature, {snap('fit')} AS fitted,
 {snap('temperature - fit')} AS resid FROM labelled JOIN fitted ON model = 'Regional_Drought' AND a = drought AND b = region""",
    ),
    "grouped_lm_p": q(
        f"""{LM}, {f_tails("lm", "taxa", "f_value", "1", "df_resid", "tails_f")},
{f_tails("lm", "taxa", "(t_intercept * t_intercept)", "1", "df_resid", "tails_i")}""",
        f"""SELECT taxa, {snap('f.p')} AS p_slope, {snap('i.p')} AS p_intercept, {snap('f.p')} AS p_f
 FROM tails_f f JOIN tails_i i USING (taxa)""",
    ),
    "taxa_long": q(TAXA, f"SELECT year, drought, {snaps('index index_s')}, taxa, {snap('bpue')} AS bpue FROM taxa_long"),
    "grouped_lm": q(
        LM,
        f"""SELECT taxa, n, {snaps('slope intercept r2 sxx sxy syy', 5)}, df_resid,
 {snaps('sigma se_slope se_intercept adj_r2 t_slope t_intercept f_value', 5)} FROM lm WHERE df_resid >= 0""",
    ),
    "grouped_lm_resid": q(
        LM,
        f"""SELECT taxa, year, {snap("y - (intercept + slope * index_s)", 4)} AS resid
 FROM modelled JOIN sums USING (taxa) WHERE y IS NOT NULL AND index_s IS NOT NULL""",
    ),
    "box_summary": q(
        BOX,
        f"""SELECT season, region, {snaps('q1 median q3')}, {snap("min(secchi) FILTER (inside)")} AS whisker_low,
 {snap("max(secchi) FILTER (inside)")} AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n
 FROM fenced GROUP BY season, region, q1, median, q3""",
    ),
    "histogram_counts": q(
        f"""{PLACED}, span AS (
 SELECT region, (max(secchi) - min(secchi)) / 14 AS width, min(secchi) - (max(secchi) - min(secchi)) / 28 AS first FROM placed GROUP BY 1),
edges AS (SELECT region, b::INT AS bin, first + (b - 1) * width AS lo, first + b * width AS hi, width FROM span CROSS JOIN range(1, 16) r(b)),
counted AS (
 SELECT e.region, e.bin, count(*) AS n FROM edges e JOIN placed p
  ON p.region = e.region AND p.secchi > lo + 1e-8 * width AND p.secchi <= hi + 1e-8 * width GROUP BY 1, 2)""",
        f"""SELECT e.region, e.bin, {snap("lo")} AS bin_low, {snap("hi")} AS bin_high, coalesce(n, 0) AS n
 FROM edges e LEFT JOIN counted USING (region, bin)""",
    ),
    "csv_roundtrip": q(PLACED, "SELECT source, station, date, subregion, temperature, secchi FROM placed"),
    "csv_inferred": q(FLOW, "SELECT date, inflowtotal, export FROM flow"),
    "csv_by_headers": """SELECT year, n_sal_base, CASE WHEN year % 2 = 0 THEN n_sal_a ELSE 0 END AS n_sal_a,
 CASE WHEN year % 2 = 1 THEN n_sal_b ELSE 0 END AS n_sal_b, sal_base,
 CASE WHEN year % 2 = 0 THEN sal_a END AS sal_a, CASE WHEN year % 2 = 1 THEN sal_b END AS sal_b FROM (
 SELECT year, count(sal_base) AS n_sal_base, count(sal_a) FILTER (sal_a >= 0.4) AS n_sal_a, count(sal_b) AS n_sal_b,
  round_even(sum(sal_base), 1) AS sal_base, round_even(sum(sal_a) FILTER (sal_a >= 0.4), 1) AS sal_a, round_even(sum(sal_b), 1) AS sal_b
 FROM (SELECT year(l_shipdate)::INT AS year, (sum(l_linenumber) % 25)::DOUBLE / 10 AS sal_base,
   (sum(l_partkey) % 25)::DOUBLE / 10 AS sal_a, (sum(l_suppkey) % 31)::DOUBLE / 10 AS sal_b
  FROM lineitem GROUP BY l_suppkey % 2, year(l_shipdate), month(l_shipdate)) GROUP BY year)""",
    "csv_skip_preamble": q(FLOW, "SELECT date, inflowtotal, export FROM flow WHERE export IS NOT NULL"),
}
