"""The hierarchical triangular mesh: ids, names, corners, covers and sets of trixels.

An id has the root (8 to 15) in its leading four bits and two bits for each level below. Ids, corners and covers descend
the mesh in numpy, all rows of an Arrow batch together, a level at a time; the rest are SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship

MAX_LEVEL = 25
EPS = 1e-15
#: The octahedron's vertices, and each root's vertices from id 8 (S0) to 15 (N3).
VERTICES = ((0, 0, 1), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, -1))
ROOTS = ((1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 1), (1, 0, 4), (4, 0, 3), (3, 0, 2), (2, 0, 1))


_CORNERS = np.array([[VERTICES[i] for i in r] for r in ROOTS], float)  # 8 x 3 x 3
#: Rows that go through the mesh at a time.
LANES = 65_536


def _unit(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Normalised midpoints, 3 x rows."""
    m = p + q
    return m / np.sqrt(m[0] * m[0] + m[1] * m[1] + m[2] * m[2])


def _left(v: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether v lies left of the arc from p to q."""
    return v[0] * (p[1] * q[2] - p[2] * q[1]) + v[1] * (p[2] * q[0] - p[0] * q[2]) + v[2] * (p[0] * q[1] - p[1] * q[0]) >= -EPS


def _descend(corners: list[np.ndarray], digit: Callable[[list, list], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The children (corners a, b, c, each 3 x rows) that digit(corners, midpoints) chooses, and their digits."""
    a, b, c = corners
    mid = [_unit(b, c), _unit(a, c), _unit(a, b)]
    k = digit(corners, mid)
    u, v, w = mid
    pick = lambda *options: np.choose(k[None, :], options)
    return [pick(a, b, c, u), pick(w, u, v, v), pick(v, w, u, w)], k


def ids_of(v: np.ndarray, level: int) -> np.ndarray:
    """The trixels of a level that hold the unit vectors, 3 x rows."""
    x, y, z = (c > 0 for c in v)
    root = np.where(z, np.where(x, np.where(y, 7, 4), np.where(y, 6, 5)), np.where(x, np.where(y, 0, 3), np.where(y, 1, 2)))
    corners = [_CORNERS[root, i].T for i in range(3)]
    out = root.astype(np.int64) + 8

    def child(corners: list, mid: list) -> np.ndarray:
        (a, b, c), (p, q, r) = corners, mid
        inside = lambda i, j, k: _left(v, i, j) & _left(v, j, k) & _left(v, k, i)
        return np.where(inside(a, r, q), 0, np.where(inside(b, p, r), 1, np.where(inside(c, q, p), 2, 3)))

    for _ in range(level):
        corners, k = _descend(corners, child)
        out = out * 4 + k
    return out


def corners_of(ids: np.ndarray) -> list[np.ndarray]:
    """The corners a, b, c (each 3 x rows) of trixels of any level."""
    level = (np.frexp(ids.astype(float))[1] - 4) // 2
    root = ids >> (2 * level)
    corners = [_CORNERS[root - 8, i].T.copy() for i in range(3)]
    for depth in range(int(level.max(initial=0))):
        on = np.flatnonzero(level > depth)
        digit = (ids[on] >> (2 * (level[on] - depth - 1))) & 3
        new, _ = _descend([c[:, on] for c in corners], lambda *_: digit)  # noqa: B023
        for c, n in zip(corners, new):
            c[:, on] = n
    return corners


def _ship() -> None:
    """Columns don't know their session; the workers of the active one get the package."""
    if session := SparkSession.getActiveSession():
        ship(session)


def trixel_of(x: Column, y: Column, z: Column, level: int) -> Column:
    """The id of the trixel of a level that holds the unit vector; null for a null one."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level {level} isn't within 0 and {MAX_LEVEL}")
    _ship()

    @F.arrow_udf("bigint")
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        v = np.stack([e.to_numpy(zero_copy_only=False) for e in (a, b, c)])
        known = ~np.isnan(v).any(axis=0)
        out = np.concatenate([ids_of(v[:, k : k + LANES], level) for k in range(0, v.shape[1], LANES)] or [np.zeros(0, np.int64)])
        return pa.array(out, pa.int64(), mask=~known)

    return run(x, y, z)


def with_trixel(df: DataFrame, x: Column, y: Column, z: Column, level: int, name: str = "htm_id") -> DataFrame:
    """df with the id of the trixel of a level that holds the unit vector."""
    return df.withColumn(name, trixel_of(x, y, z, level))


def level_of(htm_id: Column) -> Column:
    return ((F.length(F.bin(htm_id)) - 4) / 2).cast("int")


def name_of(htm_id: Column) -> Column:
    """N or S and the base-4 digits."""
    digits = F.conv(htm_id.cast("string"), 10, 4)
    return F.concat(F.when(F.substring(digits, 1, 1) == "3", F.lit("N")).otherwise(F.lit("S")), F.substring(digits, 2, 40))


def id_of(name: Column) -> Column:
    digits = F.concat(F.when(F.upper(F.substring(name, 1, 1)) == "N", F.lit("3")).otherwise(F.lit("2")), F.substring(name, 2, 40))
    return F.when(name.rlike("^[NSns][0-3]+$"), F.conv(digits, 4, 10).cast("long"))


def vertices_of(htm_id: Column) -> Column:
    """Struct of the corners a, b, c (each x, y, z)."""
    _ship()

    @F.arrow_udf(f"{', '.join(f'{k} struct<x double, y double, z double>' for k in 'abc')}")
    def run(ids: pa.Array) -> pa.Array:
        known = ids.is_valid()
        corners = corners_of(ids.fill_null(8).to_numpy(zero_copy_only=False))
        parts = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in c], names=list("xyz")) for c in corners]
        return pa.StructArray.from_arrays(parts, names=list("abc"), mask=pc.invert(known))

    return run(htm_id)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, at the coarser level of the two; 0: one contains the other."""
    la, lb = level_of(a), level_of(b)
    low = F.least(la, lb)
    x, y = F.call_function("shiftright", a, 2 * (la - low)), F.call_function("shiftright", b, 2 * (lb - low))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def with_range(df: DataFrame, column: str) -> DataFrame:
    """df with lo and hi, the ids of level MAX_LEVEL that the trixel covers."""
    shift = F.lit(2) * (F.lit(MAX_LEVEL) - level_of(F.col(column)))
    lo = F.call_function("shiftleft", F.col(column), shift)
    return df.withColumns({"lo": lo, "hi": lo + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1})


def _ancestors(df: DataFrame, column: str) -> DataFrame:
    """(id, up): each id with itself and all trixels that contain it, 26 at most; containment becomes an equi-join."""
    up = F.transform(F.sequence(F.lit(0), level_of(F.col(column))), lambda k: F.call_function("shiftright", F.col(column), 2 * k))
    return df.select(F.col(column).alias("id"), F.explode(up).alias("up"))


def intersect_sets(a: DataFrame, b: DataFrame, column: str = "htm_id") -> DataFrame:
    """The finer ids of trixels that both sets cover."""
    one = _ancestors(a, column).join(b.select(F.col(column).alias("up")), "up", "left_semi").select(F.col("id").alias(column))
    two = _ancestors(b, column).join(a.select(F.col(column).alias("up")), "up", "left_semi").select(F.col("id").alias(column))
    return one.unionByName(two).distinct()


def unite_sets(a: DataFrame, b: DataFrame, column: str = "htm_id") -> DataFrame:
    """The coarser ids: those of either set that no other id contains."""
    every = a.select(column).unionByName(b.select(column)).distinct()
    covered = _ancestors(every, column).filter("id <> up").join(every.select(F.col(column).alias("up")), "up", "left_semi").select(F.col("id").alias(column))
    return every.join(covered, column, "left_anti")


def cone_covers(centres: np.ndarray, cos_radius: float, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of the trixels that cover the cones around the centres (rows x 3), by row and then id: whole trixels inside a cone,
    and those of `level` that it cuts. Never misses a part of a cone. All cones descend together, a level at a time."""
    radius = math.acos(max(-1.0, min(1.0, cos_radius)))
    n = len(centres)
    row, ids = np.repeat(np.arange(n), 8), np.tile(np.arange(8, 16), n)
    corners = [np.tile(_CORNERS[:, i], (n, 1)).T for i in range(3)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    arc = lambda p, q: np.arccos(np.clip(p[0] * q[0] + p[1] * q[1] + p[2] * q[2], -1.0, 1.0))
    for depth in range(level + 1):
        a, b, c = corners
        mid = a + b + c
        mid = mid / np.sqrt(mid[0] * mid[0] + mid[1] * mid[1] + mid[2] * mid[2])
        reach = np.maximum(np.maximum(arc(a, mid), arc(b, mid)), arc(c, mid))
        apart = arc(mid, centres[row].T)
        met = apart <= reach + radius + 1e-12
        whole = met & ((apart + reach <= radius - 1e-12) | (depth == level))
        found.append((row[whole], ids[whole]))
        on = np.flatnonzero(met & ~whole)
        if not len(on):
            break
        here = [v[:, on] for v in corners]
        children = [_descend(here, lambda *_, k=k: np.full(len(on), k))[0] for k in range(4)]  # noqa: B023
        corners = [np.concatenate([child[i] for child in children], axis=1) for i in range(3)]
        row, ids = np.tile(row[on], 4), np.concatenate([ids[on] * 4 + k for k in range(4)])
    row, ids = (np.concatenate([f[i] for f in found]) for i in range(2))
    order = np.lexsort((ids, row))
    return row[order], ids[order]


def cone_cover(centre, cos_radius: float, level: int) -> list[int]:
    """Ascending ids of one cone's cover."""
    return cone_covers(np.asarray(centre, float)[None, :], cos_radius, level)[1].tolist()


def cover_column(x: Column, y: Column, z: Column, cos_radius: float, level: int) -> Column:
    """Array of the ids that cover the cone around a unit vector; null for a null one."""
    _ship()

    @F.arrow_udf("array<bigint>")
    def cover(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        v = np.stack([e.to_numpy(zero_copy_only=False) for e in (a, b, c)], axis=1)
        known = ~np.isnan(v).any(axis=1)
        row, ids = cone_covers(v[known], cos_radius, level)
        counts = np.zeros(len(v), np.int64)
        counts[known] = np.bincount(row, minlength=int(known.sum()))
        ends = np.append(0, np.cumsum(counts))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()), mask=pa.array(~known))

    return cover(x, y, z)
