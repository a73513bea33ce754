"""Assign points to sub-regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.geometry import (
    NAD83,
    Datum,
    edges_near_cell,
    geocentric,
    geodetic,
    ring_edges,
    similarity,
    touches,
    transverse_mercator,
)
from brackish.functions.strict import present
from brackish.operators.attach import attach

# A polygon is cut into cells along its bounding box; each cell keeps only the edges a
# point in it can meet. The largest polygon has this many cells a side, whatever the unit.
CELLS_A_SIDE = 32


def cell_size(polygons: DataFrame) -> float:
    """Side of a cell, from the longest side of any polygon's bounding box."""

    def side(axis: str):
        values = F.transform("ring", lambda p: p[axis])
        return F.array_max(values) - F.array_min(values)

    longest = polygons.agg(F.max(F.greatest(side("x"), side("y")).cast("double"))).first()[0]
    return longest / CELLS_A_SIDE if longest else 1.0


def cell_cover(polygons: DataFrame, cell: float, name: str = "subregion") -> DataFrame:
    """Cells of each polygon with the edges that matter there.

    ``polygons`` has the name and ``ring``, an array of points with x and y.
    """
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])

    def span(values):
        return F.sequence(
            F.floor(F.array_min(values) / cell).cast("long"), F.floor(F.array_max(values) / cell).cast("long")
        )

    cells = polygons.select(
        name, ring_edges(ring).alias("edges"), F.explode(span(xs)).alias("cell_x"), ys.alias("ys")
    ).select(name, "edges", "cell_x", F.explode(span(F.col("ys"))).alias("cell_y"))
    near = edges_near_cell(F.col("edges"), F.col("cell_x") * cell, F.col("cell_y") * cell, cell)
    return cells.select(name, "cell_x", "cell_y", near.alias("edges")).filter(F.size("edges") > 0)


def locate(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "x",
    y: str = "y",
    name: str = "subregion",
    cell: float | None = None,
    how: str = "left",
) -> DataFrame:
    """Left spatial join: each point with the polygons it lies in or on the border of.

    A point on a shared border meets both polygons; a point in none keeps a missing name.
    The cells follow from the polygons unless a size is given.
    """
    cell = cell or cell_size(polygons)
    cover = cell_cover(polygons, cell, name).groupBy("cell_x", "cell_y").agg(
        F.collect_list(F.struct(name, "edges")).alias("candidates")
    )
    celled = points.withColumns(
        {
            "cell_x": F.floor(F.col(x) / cell).cast("long"),
            "cell_y": F.floor(F.col(y) / cell).cast("long"),
        }
    )
    met = attach(celled, cover, ["cell_x", "cell_y"])
    hits = F.transform(
        F.filter("candidates", lambda c: touches(c["edges"], F.col(x), F.col(y))), lambda c: c[name]
    )
    explode = F.explode_outer if how == "left" else F.explode
    return met.select(*points.columns, explode(hits).alias(name))


def shift_datum(points: DataFrame, lon: str, lat: str, source: Datum, target: Datum) -> DataFrame:
    """``points`` with longitude and latitude taken from one datum to another, through geocentric metres.

    Each step is a projection of its own, so that no step's expression is repeated in the next.
    """
    if source == target:
        return points
    steps = (
        lambda x, y, z: geocentric(x, y, source),
        lambda x, y, z: similarity(x, y, z, source),
        lambda x, y, z: similarity(x, y, z, target, inverse=True),
    )
    at, names = (F.col(lon), F.col(lat), F.lit(0.0)), ("__cx", "__cy", "__cz")
    for step in steps:
        points = points.withColumns(dict(zip(names, step(*at))))
        at = tuple(F.col(n) for n in names)
    new_lon, new_lat = geodetic(*at, target)
    return points.withColumns({lon: new_lon, lat: new_lat}).drop(*names)


def with_grid_position(
    points: DataFrame,
    lon: str,
    lat: str,
    datum: Datum,
    grid: Datum = NAD83,
    zone: int = 10,
    names: tuple[str, str] = ("east", "north"),
) -> DataFrame:
    """``points`` with easting and northing in a zone of the grid's datum; longitude and latitude stay in their own."""
    held = points.withColumns({"__lon": F.col(lon), "__lat": F.col(lat)})
    moved = shift_datum(held, "__lon", "__lat", datum, grid)
    east, north = transverse_mercator(F.col("__lon"), F.col("__lat"), grid, zone)
    return moved.withColumns(dict(zip(names, (east, north)))).drop("__lon", "__lat")


def assign_subregion(
    rows: DataFrame,
    polygons: DataFrame,
    x: str = "x",
    y: str = "y",
    name: str = "subregion",
    cell: float | None = None,
    datum: Datum | None = None,
    keep: Sequence[str] | None = None,
    positions: DataFrame | None = None,
    grid: Datum = NAD83,
    zone: int = 10,
) -> DataFrame:
    """Rows with the sub-region they lie in; rows outside all polygons are dropped.

    With a datum, x and y are longitude and latitude in it, and are first taken to the polygons' grid: its datum, then its
    zone. ``keep`` limits the polygons to named sub-regions.

    Stations are visited again and again, so the polygons are met once per position and
    the answer is joined to the rows. ``positions`` is a table cheaper to read than
    ``rows`` that holds all their positions.
    """
    if keep is not None:
        polygons = polygons.filter(F.col(name).isin(list(keep)))

    def meet(points: DataFrame) -> DataFrame:
        if datum is None:
            return locate(points, polygons, x, y, name, cell, how="inner")
        projected = with_grid_position(points, x, y, datum, grid, zone, ("__east", "__north"))
        return locate(projected, polygons, "__east", "__north", name, cell, how="inner").drop("__east", "__north")

    source = rows if positions is None else positions
    return attach(rows, meet(source.select(x, y).dropna().distinct()), [x, y], "inner")


def datum_check(
    stations: DataFrame,
    polygons: DataFrame,
    datums: Mapping[str, Datum],
    lon: str = "lon",
    lat: str = "lat",
    name: str = "subregion",
    cell: float | None = None,
    grid: Datum = NAD83,
    zone: int = 10,
) -> DataFrame:
    """Sub-region of each station if its longitude and latitude were in each of ``datums``, side by side."""
    out = stations
    for label, datum in datums.items():
        placed = with_grid_position(out, lon, lat, datum, grid, zone, ("__east", "__north"))
        out = locate(placed, polygons, "__east", "__north", name, cell).withColumnRenamed(name, f"{name}_{label}")
        out = out.drop("__east", "__north")
    return out


def station_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations per station position."""
    return present(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def unmatched(checked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stations outside all polygons under any of the datums."""
    return checked.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
