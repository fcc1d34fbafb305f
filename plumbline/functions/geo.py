"""Spherical geometry: unit vectors, distances and cells of a cube that is projected on the sphere.

A cell is one of 4**level equal-angle squares of a cube face. Its edges are great circles, so poles and the
180th meridian need no special care, and a cell lies inside a cap as soon as its four corners do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Largest change of a face coordinate per radian on the sphere: 4/pi times the square root of 2, rounded up.
FACE_RATE = 1.85


def usable(lat: Column, lon: Column) -> Column:
    """Both coordinates present, in range and not both 0; never null. NaN is out of range."""
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0))
    return F.coalesce(ok, F.lit(False))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def chord2(metres: float) -> float:
    """Squared chord of the unit sphere that spans ``metres`` of great circle."""
    return (2 * math.sin(metres / EARTH_M / 2)) ** 2


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula; null if a coordinate is."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def face_coordinates(x: Column, y: Column, z: Column, axis: int) -> tuple[Column, Column, Column]:
    """(face, s, t) of a direction seen from the face of ``axis`` on its own side; s and t in -1..1 on the face."""
    own, one, two = [(x, y, z), (y, x, z), (z, x, y)][axis]
    scale = F.lit(4 / math.pi)
    face = F.when(own >= 0, F.lit(axis)).otherwise(F.lit(axis + 3)).cast("long")
    depth = F.abs(own)
    return face, F.atan2(one, depth) * scale, F.atan2(two, depth) * scale


def home_face(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(face, s, t) on the face that the direction meets."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    scale = F.lit(4 / math.pi)
    own = F.when(on_x, x).when(on_y, y).otherwise(z)
    one = F.when(on_x, y).otherwise(x)
    two = F.when(on_x | on_y, z).otherwise(y)
    axis = F.when(on_x, 0).when(on_y, 1).otherwise(2)
    face = (axis + F.when(own >= 0, 0).otherwise(3)).cast("long")
    depth = F.abs(own)
    return face, F.atan2(one, depth) * scale, F.atan2(two, depth) * scale


def step(coordinate: Column, level: int) -> Column:
    """Index of a face coordinate at ``level``; clipped to the face."""
    n = 1 << level
    return F.least(F.greatest(F.floor((coordinate + 1) * (n / 2)), F.lit(0)), F.lit(n - 1)).cast("long")


def cell_id(level: int, face: Column, i: Column, j: Column) -> Column:
    """One number for a cell, distinct over all levels up to 24."""
    n = 1 << level
    return ((F.lit(level).cast("long") * 6 + face) * n + i) * n + j


def level_of(cell: Column, finest: int) -> Column:
    """The level of a cell number, up to ``finest``."""
    found = F.lit(0)
    for level in range(1, finest + 1):
        found = F.when(cell >= F.lit(level * 6 << 2 * level).cast("long"), level).otherwise(found)
    return found
