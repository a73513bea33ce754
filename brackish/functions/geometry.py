"""Projection and point-in-polygon as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Datum:
    """Ellipsoid, and how its geocentric axes lie in those of the common datum.

    ``shift`` in metres, ``turn`` in seconds of arc as the rotation of a position, ``stretch`` in millionths: the seven
    parameters of a similarity; three of them are the shift alone.
    """

    radius: float
    flattening: float
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)
    stretch: float = 0.0


# Published ellipsoids and their published parameters to WGS 84.
WGS84 = Datum(6378137.0, 1 / 298.257223563)
NAD83 = Datum(
    6378137.0, 1 / 298.257222101, (-0.991, 1.9072, 0.5129), (0.02579, 0.00965, 0.01166)
)  # EPSG 1515, as rotations of a position
NAD27 = Datum(6378206.4, 1 / 294.978698214, (-8.0, 159.0, 175.0))  # western states


def geocentric(lon: Column, lat: Column, datum: Datum) -> tuple[Column, Column, Column]:
    """Geocentric metres of a point on the ellipsoid."""
    phi, lam = F.radians(lat), F.radians(lon)
    e2 = datum.flattening * (2 - datum.flattening)
    normal = datum.radius / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    flat = normal * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), normal * (1 - e2) * F.sin(phi)


def similarity(
    x: Column, y: Column, z: Column, datum: Datum, inverse: bool = False
) -> tuple[Column, Column, Column]:
    """Geocentric metres of ``datum`` in the common datum, or back. Rotations are small, so that their products vanish."""
    sign = -1.0 if inverse else 1.0
    (dx, dy, dz), scale = datum.shift, 1 + sign * datum.stretch * 1e-6
    rx, ry, rz = (sign * math.radians(t / 3600) for t in datum.turn)
    if inverse:
        x, y, z = x - dx, y - dy, z - dz
        dx = dy = dz = 0.0
    return (
        scale * (x - rz * y + ry * z) + dx,
        scale * (rz * x + y - rx * z) + dy,
        scale * (-ry * x + rx * y + z) + dz,
    )


def geodetic(x: Column, y: Column, z: Column, datum: Datum) -> tuple[Column, Column]:
    """Longitude and latitude of geocentric metres near the ellipsoid, by the closed form of one reduced latitude."""
    a, b = datum.radius, datum.radius * (1 - datum.flattening)
    e2, second = (a * a - b * b) / (a * a), (a * a - b * b) / (b * b)
    flat = F.sqrt(x * x + y * y)
    reduced = F.atan2(z * a, flat * b)
    sin, cos = F.sin(reduced), F.cos(reduced)
    lat = F.atan2(z + second * b * sin * sin * sin, flat - e2 * a * cos * cos * cos)
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def transverse_mercator(
    lon: Column, lat: Column, datum: Datum = WGS84, zone: int = 10
) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone, by the third-order Krueger series."""
    n = datum.flattening / (2 - datum.flattening)
    rectifying = datum.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    central = math.radians(zone * 6 - 183)
    e = 2 * math.sqrt(n) / (1 + n)

    phi, lam = F.radians(lat), F.radians(lon) - central
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - e * F.atanh(e * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = 0.9996 * rectifying
    return 500000.0 + scale * east, scale * north


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of points as array<struct<x1,y1,x2,y2>>; the ring closes itself."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def edges_near_cell(edges: Column, left: Column, bottom: Column, size: float) -> Column:
    """Edges a point of this cell can meet when looking east: all others never count."""
    return F.filter(
        edges,
        lambda e: (F.least(e["y1"], e["y2"]) <= bottom + size)
        & (F.greatest(e["y1"], e["y2"]) >= bottom)
        & (F.greatest(e["x1"], e["x2"]) >= left),
    )


def touches(edges: Column, x: Column, y: Column) -> Column:
    """Is the point inside the ring or on its border?"""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda total, e: total
        + (
            ((e["y1"] > y) != (e["y2"] > y))
            & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
        ).cast("int"),
    )
    on_border = F.exists(
        edges,
        lambda e: ((x - e["x1"]) * (e["y2"] - e["y1"]) == (y - e["y1"]) * (e["x2"] - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )
    return (crossings % 2 == 1) | on_border
