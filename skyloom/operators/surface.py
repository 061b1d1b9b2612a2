"""Counts on the sphere and in the plane: density for each trixel, and two-dimensional class grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..functions import trixel as T


def trixel_density(cat: DataFrame, level: int = 10) -> DataFrame:
    """htm_id, htm_name, ra and dec of the centre, n, area, density of each trixel that holds objects."""
    n = T.with_trixel(cat, F.col("ux"), F.col("uy"), F.col("uz"), level).groupBy("htm_id").agg(F.count("*").alias("n"))
    v = n.withColumn("t", T.vertices_of(F.col("htm_id")))
    corner = lambda k: tuple(F.col(f"t.{k}.{c}") for c in "xyz")
    a, b, c = corner("a"), corner("b"), corner("c")
    mid = S.normalised(tuple(x + y + z for x, y, z in zip(a, b, c)))
    area = S.triangle_area(a, b, c)
    return v.select("htm_id", T.name_of(F.col("htm_id")).alias("htm_name"), S.ra_of(mid[0], mid[1]).alias("ra"), S.dec_of(mid[2]).alias("dec"), "n", area.alias("area"), (F.col("n") / area).alias("density"))


def grid_build(rows: DataFrame, xstep: float = 0.01, ystep: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """From (class 0 or 1, x, y): (ix, iy, p), the share of class 1 by class-wise relative counts, and a header row xmin, ymin, xstep, ystep, nx, ny."""
    header = rows.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.sum((F.col("class") == 1).cast("long")).alias("n1"), F.sum((F.col("class") == 0).cast("long")).alias("n0"))
    cells = rows.join(F.broadcast(header)).groupBy(F.floor((F.col("x") - F.col("xmin")) / xstep).alias("ix"), F.floor((F.col("y") - F.col("ymin")) / ystep).alias("iy")).agg(
        F.sum((F.col("class") == 1).cast("long")).alias("c1"), F.sum((F.col("class") == 0).cast("long")).alias("c0"), F.first("n1").alias("n1"), F.first("n0").alias("n0"))
    a, b = F.coalesce(F.try_divide("c1", "n1"), F.lit(0.0)), F.coalesce(F.try_divide("c0", "n0"), F.lit(0.0))
    grid = cells.select("ix", "iy", (a / (a + b)).alias("p"))
    last = grid.agg((F.max("ix") + 1).alias("mx"), (F.max("iy") + 1).alias("my"))
    nx, ny = F.ceil((F.col("xmax") - F.col("xmin")) / xstep), F.ceil((F.col("ymax") - F.col("ymin")) / ystep)
    head = header.join(F.broadcast(last)).select("xmin", "ymin", F.lit(xstep).alias("xstep"), F.lit(ystep).alias("ystep"), F.greatest(nx, "mx").alias("nx"), F.greatest(ny, "my").alias("ny"))
    return grid, head


def grid_predict(points: DataFrame, grid: DataFrame, header: DataFrame) -> DataFrame:
    """points with p, -1 outside the grid or in an empty cell. A grid is broadcast only while Spark finds it small."""
    d = points.join(F.broadcast(header.select("xmin", "ymin", "xstep", "ystep")))
    d = d.withColumns({"ix": F.floor((F.col("x") - F.col("xmin")) / F.col("xstep")), "iy": F.floor((F.col("y") - F.col("ymin")) / F.col("ystep"))})
    return d.join(grid, ["ix", "iy"], "left").select(*points.columns, F.coalesce("p", F.lit(-1.0)).alias("p"))


def save_grid(grid: DataFrame, header: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").parquet(f"{path}/cells")
    header.write.mode("overwrite").parquet(f"{path}/header")


def load_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(grid, header) as grid_build gives them."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/header")


def triangle_cells(triangles: DataFrame, x: tuple[float, float, int], y: tuple[float, float, int]) -> DataFrame:
    """The cells (ix, iy) of a grid, (from, to, cells) along x and y, that each triangle of x0, y0, x1, y1, x2, y2 meets, border
    included; with all other columns of triangles. A cell and a triangle are apart exactly if the axes or a side of the
    triangle part them."""
    (xa, xb, nx), (ya, yb, ny) = x, y
    dx, dy = (xb - xa) / nx, (yb - ya) / ny
    keep = [c for c in triangles.columns if c not in {f"{a}{k}" for a in "xy" for k in range(3)}]
    first = lambda c, low, step, n: F.greatest(F.lit(0), F.ceil((F.least(*[F.col(f"{c}{k}") for k in range(3)]) - low) / step).cast("int") - 1)
    last = lambda c, low, step, n: F.least(F.lit(n - 1), F.floor((F.greatest(*[F.col(f"{c}{k}") for k in range(3)]) - low) / step).cast("int"))
    d = triangles.withColumns({"_a": first("x", xa, dx, nx), "_b": last("x", xa, dx, nx), "_c": first("y", ya, dy, ny), "_d": last("y", ya, dy, ny)}).filter("_a <= _b AND _c <= _d")
    d = d.withColumn("ix", F.explode(F.sequence("_a", "_b"))).withColumn("iy", F.explode(F.sequence("_c", "_d")))
    left, low = F.lit(xa) + F.col("ix") * F.lit(dx), F.lit(ya) + F.col("iy") * F.lit(dy)
    turn = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    met = F.lit(True)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        # The corner of the cell that lies furthest to the inner side of the side i-j.
        ex, ey = (F.col(f"x{j}") - F.col(f"x{i}")) * F.signum(turn), (F.col(f"y{j}") - F.col(f"y{i}")) * F.signum(turn)
        cx, cy = left + F.when(ey < 0, dx).otherwise(0.0), low + F.when(ex > 0, dy).otherwise(0.0)
        met = met & (ex * (cy - F.col(f"y{i}")) - ey * (cx - F.col(f"x{i}")) >= 0)
    return d.filter(met).select(*keep, "ix", "iy")
