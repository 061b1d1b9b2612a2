"""Unit vectors, distances and rotations on the sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IAU rotation from ICRS to Galactic coordinates.
ICRS_TO_GALACTIC = (
    (-0.054875560416215368, -0.873437090234885049, -0.483835015548713227),
    (0.494109427875583674, -0.444829629960011178, 0.746982244497218891),
    (-0.867666149019004701, -0.198076373431201528, 0.455983776175066922),
)
GALACTIC_TO_ICRS = tuple(zip(*ICRS_TO_GALACTIC))


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return F.cos(ra) * F.cos(dec), F.sin(ra) * F.cos(dec), F.sin(dec)


def ra_of(x: Column, y: Column) -> Column:
    """In [0, 2 pi)."""
    a = F.atan2(y, x)
    return F.when(a < 0, a + F.lit(2 * math.pi)).otherwise(a)


def dec_of(z: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))


def dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u, v) -> tuple[Column, Column, Column]:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def normalised(u) -> tuple[Column, Column, Column]:
    n = F.sqrt(dot(u, u))
    return u[0] / n, u[1] / n, u[2] / n


def distance(u, v) -> Column:
    """Great-circle distance of unit vectors; products that leave [-1, 1] by rounding are clamped."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v))))


def rotated(u, matrix) -> tuple[Column, Column, Column]:
    return tuple(sum((F.lit(m) * c for m, c in zip(row[1:], u[1:])), F.lit(row[0]) * u[0]) for row in matrix)


def rotate_position(ra: Column, dec: Column, matrix) -> tuple[Column, Column]:
    x, y, z = rotated(unit_vector(ra, dec), matrix)
    return ra_of(x, y), dec_of(z)


def triangle_area(a, b, c) -> Column:
    """Spherical excess of the triangle a, b, c, by the tangent of half the solid angle, which keeps its digits in small triangles."""
    return 2 * F.atan2(F.abs(dot(a, cross(b, c))), 1 + dot(a, b) + dot(a, c) + dot(b, c))


def cap_area(radius: float) -> float:
    return 4 * math.pi * math.sin(radius / 2) ** 2
