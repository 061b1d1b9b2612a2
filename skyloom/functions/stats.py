"""Aggregates: population moments, circular statistics, class impurity. Each returns a Column for agg() unless it says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(x: Column, y: Column) -> dict[str, Column]:
    return {"mean": F.avg(x), "var": F.var_pop(x), "std": F.stddev_pop(x), "cov": F.covar_pop(x, y), "corr": F.corr(x, y), "abserr": F.avg(F.abs(x - y))}


def cov_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def circ_mean(x: Column) -> Column:
    return F.atan2(F.sum(F.sin(x)), F.sum(F.cos(x)))


def circ_r(x: Column) -> Column:
    """Mean resultant length."""
    s, c = F.sum(F.sin(x)), F.sum(F.cos(x))
    return F.sqrt(s * s + c * c) / F.count(x)


def circ_var(x: Column) -> Column:
    return F.lit(1.0) - circ_r(x)


def circ_diff(x: Column, y: Column) -> Column:
    return F.atan2(F.sin(x - y), F.cos(x - y))


def circ_abserr(x: Column, y: Column) -> Column:
    return F.avg(F.abs(circ_diff(x, y)))


def circ_corr(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, corr) in one pass: sin(x - mean) is sin x cos mean - cos x sin mean, so the sums of products of sines and cosines suffice; null if a variable is constant."""
    sx, cx, sy, cy = F.sin(x), F.cos(x), F.sin(y), F.cos(y)
    sums = {"sx": sx, "cx": cx, "sy": sy, "cy": cy, "ss": sx * sy, "sc": sx * cy, "cs": cx * sy, "cc": cx * cy, "xss": sx * sx, "xsc": sx * cx, "xcc": cx * cx, "yss": sy * sy, "ysc": sy * cy, "ycc": cy * cy}
    g = df.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    g = g.withColumns({"a": F.atan2("sx", "cx"), "b": F.atan2("sy", "cy")})
    cov = "ss * cos(a) * cos(b) - sc * cos(a) * sin(b) - cs * sin(a) * cos(b) + cc * sin(a) * sin(b)"
    vx, vy = (f"({p}ss * cos({m}) * cos({m}) - 2 * {p}sc * cos({m}) * sin({m}) + {p}cc * sin({m}) * sin({m}))" for p, m in (("x", "a"), ("y", "b")))
    return g.select(*keys, F.expr(f"try_divide({cov}, sqrt(greatest({vx} * {vy}, 0D)))").alias("corr"))


def circ_confidence(r: Column, n: Column, sigma: float) -> Column:
    """Half-width of the mean direction's confidence interval from resultant length and count; -1 if it can't be given."""
    c2, big = F.lit(sigma * sigma), r * n
    low = F.sqrt((2 * n * (2 * big * big - n * c2)) / (4 * n - c2))
    high = F.sqrt(n * n - (n * n - big * big) * F.exp(c2 / n))
    t = F.when(r >= 0.9, high).when(r > F.sqrt(c2 / 2 / n), low)
    return F.coalesce(F.acos(F.least(F.lit(1.0), t / big)), F.lit(-1.0))


def circ_kappa(r: Column, n: Column, as_published: bool = False) -> Column:
    """Von Mises concentration with the small-sample correction; as_published takes (n - 1)^3 in it, the default keeps the reference behaviour, (1 - n)^3."""
    k = F.when(r < 0.53, r * (2 + r * r * (1 + r * r * F.lit(5.0 / 6)))).when(r < 0.85, -0.4 + 1.39 * r + F.try_divide(F.lit(0.43), 1 - r)).otherwise(F.try_divide(F.lit(1.0), (3 - 4 * r + r * r) * r))
    m = (n - 1) if as_published else (1 - n)
    small = F.when(k < 2, F.greatest(F.lit(0.0), k - F.try_divide(F.lit(2.0), k * n))).otherwise(k * m * m * m / (1 + n * n) / n)
    return F.when(n <= 15, small).otherwise(k)


def class_counts(df: DataFrame, y: str, *keys: str) -> DataFrame:
    """(keys, y, n)."""
    return df.groupBy(*keys, y).agg(F.count("*").alias("n"))


def impurity(counts: DataFrame, y: str, *keys: str) -> DataFrame:
    """From class_counts: total, mode (the largest of equals) with its share, entropy in nats, and Gini impurity."""
    t = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", y)).alias("m"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"))
    return t.select(*keys, "total", F.col(f"m.{y}").alias("mode"), (F.col("m.n") / F.col("total")).alias("share"), (F.log("total") - F.col("nl") / F.col("total")).alias("entropy"), (1 - F.col("n2") / (F.col("total").cast("double") * F.col("total"))).alias("gini"))


TWO_PI = 2 * math.pi
