"""Joins by angular distance.

Two unit vectors lie within r exactly if their chord is at most 2 sin(r / 2). With cubic cells of that side, partners lie
in the same or a neighbouring cell, so the join is an equi-join on cells: one side goes to its 27 neighbours, the other
stays in its own, each pair meets once, and the dot product decides. No poles, no wrap of right ascension.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _check(radius: float) -> None:
    if not 0 < radius <= math.pi:
        raise ValueError(f"the radius must be in (0, pi], not {radius}")


def _cells(radius: float) -> list:
    side = 2 * math.sin(radius / 2) * (1 + 1e-9)
    return [F.floor(F.col(c) / side).cast("int") for c in ("ux", "uy", "uz")]


def cone_pairs(a: DataFrame, b: DataFrame, radius: float, dmag: list[float] | None = None, keep_a: tuple = (), keep_b: tuple = (), exact: bool = False, salts: int = 1) -> DataFrame:
    """id0, id1, dot, dist and the kept columns (prefixed a_, b_) of all pairs within radius whose magnitudes differ by dmag at most.

    `a` is the side that is copied to neighbouring cells; give the smaller one. exact compares squared chords, which is
    better below some arcseconds. salts > 1 deals each of b's cells over that many keys, for very dense fields."""
    _check(radius)
    cell = F.array(*_cells(radius))
    left = a.select(F.col("obj_id").alias("id0"), *[F.col(c).alias(f"_{c}") for c in ("ux", "uy", "uz")], F.col("mags").alias("_m0"), *[F.col(c).alias(f"a_{c}") for c in keep_a], cell.alias("_c"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    for k in range(3):
        left = left.withColumn(f"_d{k}", F.explode(steps)).withColumn(f"c{k}", F.col("_c")[k] + F.col(f"_d{k}")).drop(f"_d{k}")
    left = left.drop("_c").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = b.select(F.col("obj_id").alias("id1"), "ux", "uy", "uz", F.col("mags").alias("_m1"), *[F.col(c).alias(f"b_{c}") for c in keep_b], *[x.alias(f"c{k}") for k, x in enumerate(_cells(radius))], F.pmod(F.xxhash64("obj_id"), F.lit(salts)).cast("int").alias("salt"))
    dot = F.col("ux") * F.col("_ux") + F.col("uy") * F.col("_uy") + F.col("uz") * F.col("_uz")
    near = dot >= F.lit(math.cos(radius))
    if exact:
        near = (F.col("ux") - F.col("_ux")) ** 2 + (F.col("uy") - F.col("_uy")) ** 2 + (F.col("uz") - F.col("_uz")) ** 2 <= F.lit(4 * math.sin(radius / 2) ** 2)
    for k, d in enumerate(dmag or []):
        near = near & (F.abs(F.col("_m0")[k] - F.col("_m1")[k]) <= d)
    keys = ["c0", "c1", "c2", "salt"]
    # Sides grow with the input, and a small compressed file may hold many rows: by its size alone Spark would broadcast one through the driver.
    met = left.join(right.hint("merge"), [left[k] == right[k] for k in keys] + [near])
    return met.select("id0", "id1", dot.alias("dot"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))).alias("dist"), *[f"a_{c}" for c in keep_a], *[f"b_{c}" for c in keep_b])


def best_match(a: DataFrame, b: DataFrame, radius: float, dmag: list[float] | None = None, **options) -> DataFrame:
    """For each row of b with a partner the nearest of a (id0, dist); ties go to the smaller id0."""
    pairs = cone_pairs(a, b, radius, dmag, **options)
    return pairs.groupBy("id1").agg(F.max(F.struct("dot", (-F.col("id0")).alias("n"), "dist")).alias("m")).select((-F.col("m.n")).alias("id0"), "id1", F.col("m.dist").alias("dist"))


def match_count(a: DataFrame, b: DataFrame, radius: float, dmag: list[float] | None = None, **options) -> DataFrame:
    """(id1, n): partners in a of every row of b, 0 included."""
    n = cone_pairs(a, b, radius, dmag, **options).groupBy("id1").agg(F.count("*").alias("n"))
    return b.select(F.col("obj_id").alias("id1")).join(n.hint("merge"), "id1", "left").select("id1", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cone_join(a: DataFrame, b: DataFrame, radius: float, dmag: list[float] | None = None, how: str = "all", **options) -> DataFrame:
    """how: all, best, count; semi or anti (rows of b with or without a partner); left (every row of b with all its partners)."""
    if how == "best":
        return best_match(a, b, radius, dmag, **options)
    if how == "count":
        return match_count(a, b, radius, dmag, **options)
    pairs = cone_pairs(a, b, radius, dmag, **options)
    if how == "all":
        return pairs
    if how in ("semi", "anti"):
        return b.join(pairs.select(F.col("id1").alias("obj_id")).hint("merge"), "obj_id", f"left_{how}")
    if how == "left":
        return b.select(F.col("obj_id").alias("id1")).join(pairs.hint("merge"), "id1", "left")
    raise ValueError(f"unknown join {how}")


def probe(a: DataFrame, ra: float, dec: float, radius: float, limit: int | None = None) -> DataFrame:
    """The rows of a within radius of one position."""
    _check(radius)
    x, y, z = math.cos(ra) * math.cos(dec), math.sin(ra) * math.cos(dec), math.sin(dec)
    out = a.filter(F.col("ux") * x + F.col("uy") * y + F.col("uz") * z >= math.cos(radius))
    return out.limit(limit) if limit else out
