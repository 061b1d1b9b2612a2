"""Generated tables: parameter grids, chance alignments and simulated lens configurations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lens import NSIEG, LensModel
from ..functions.optimise import nelder_mead
from ..storage import ship

PARAMETERS = ("b", "e", "te", "g", "tg", "s")


def parse_range(text: str | float) -> tuple[float, float, int]:
    """(from, to, n intervals) of `1.5` or `[from:n:to]`."""
    text = str(text).strip()
    if m := re.fullmatch(r"\[([^:\]]+):(\d+):([^:\]]+)\]", text):
        low, n, high = float(m[1]), int(m[2]), float(m[3])
    else:
        low = high = float(text)
        n = 0
    if high < low or (n == 0 and low != high):
        raise ValueError(f"not a range: {text}")
    return low, high, n


def range_values(spark: SparkSession, text: str | float, name: str) -> DataFrame:
    """(name_i, name): the n + 1 values."""
    low, high, n = parse_range(text)
    step = F.lit((high - low)) * F.col("id") / F.lit(float(max(n, 1)))
    return spark.range(n + 1).select(F.col("id").alias(f"{name}_i"), (F.lit(low) + step).alias(name))


def parameter_grid(spark: SparkSession, **ranges: str | float) -> DataFrame:
    """All combinations of PARAMETERS, with model_id; an angle isn't varied where its size (e for te, g for tg) is exactly 0.
    The grid is the result asked for, made from option ranges on the driver's side of the plan, not a join of data."""
    grid = None
    for name in PARAMETERS:
        values = range_values(spark, ranges[name], name)
        grid = values if grid is None else grid.crossJoin(values)
    grid = grid.filter(~((F.col("e_i") == 0) & (F.col("e") == 0) & (F.col("te_i") > 0)) & ~((F.col("g_i") == 0) & (F.col("g") == 0) & (F.col("tg_i") > 0)))
    key = None
    for name in PARAMETERS:
        n = parse_range(ranges[name])[2] + 1
        key = F.col(f"{name}_i") if key is None else key * n + F.col(f"{name}_i")
    return grid.select(key.alias("model_id"), *PARAMETERS)


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), from the MD5 of the keys as text, so the same under any partitioning and on any engine."""
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary")), 1, 13)
    return (F.conv(bits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal by Box and Muller from two hashed uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit(0), *keys))) * F.cos(F.lit(2 * np.pi) * uniform(seed, F.lit(1), *keys))


def contaminants(spark: SparkSession, n: int = 1_000_000, n_images: int = 4, max_mag: float = 3.0, seed: int = 1) -> DataFrame:
    """config_id, nimg, x, y, mag: positions uniform in the unit disc, magnitudes uniform in [0, max_mag]."""
    d = spark.range(n * n_images).select(F.floor(F.col("id") / n_images).alias("config_id"), F.lit(n_images).alias("nimg"), "id")
    r, a = F.sqrt(uniform(seed, F.lit("r"), "id")), F.lit(2 * np.pi) * uniform(seed, F.lit("a"), "id")
    return d.select("config_id", "nimg", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), (F.lit(max_mag) * uniform(seed, F.lit("m"), "id")).alias("mag"))


def source_map(p: tuple, xr: tuple, yr: tuple, eps: float, model: LensModel = NSIEG) -> np.ndarray:
    """Triangles of the image plane with their source-plane corners, (k, 2, 3, 2): two for each grid cell, halved along their first edge where the magnification changes sign until no side exceeds eps."""
    (x0, x1, nx), (y0, y1, ny) = xr, yr
    x, y = np.meshgrid(np.linspace(x0, x1, nx + 1), np.linspace(y0, y1, ny + 1), indexing="ij")
    v = np.stack([x, y], axis=-1)
    # Each triangle's first two corners span its longest edge.
    low = np.stack([v[1:, :-1], v[:-1, 1:], v[:-1, :-1]], axis=-2).reshape(-1, 3, 2)
    high = np.stack([v[:-1, 1:], v[1:, :-1], v[1:, 1:]], axis=-2).reshape(-1, 3, 2)
    todo, done = np.concatenate([low, high]), []
    while len(todo):
        j = model.jacobian(p, todo[..., 0], todo[..., 1])
        sign = j[0] * j[3] - j[1] * j[2] > 0
        side = np.sqrt(((todo - np.roll(todo, -1, axis=1)) ** 2).sum(-1)).max(1)
        cut = (sign.any(1) & ~sign.all(1)) & (side >= eps)
        done.append(todo[~cut])
        t = todo[cut]
        mid = (t[:, 0] + t[:, 1]) / 2
        todo = np.concatenate([np.stack([t[:, 2], t[:, 0], mid], 1), np.stack([t[:, 1], t[:, 2], mid], 1)])
    t = np.concatenate(done)
    ax, ay = model.alpha(p, t[..., 0], t[..., 1])
    return np.stack([t, np.stack([t[..., 0] - ax, t[..., 1] - ay], axis=-1)], axis=1)


class SourceGrid:
    """Buckets of the source plane that list the triangles whose bounding boxes meet them."""

    def __init__(self, triangles: np.ndarray, n: int = 128):
        self.t, src = triangles, triangles[:, 1]
        self.low, high = np.percentile(src.reshape(-1, 2), [2, 98], axis=0)
        self.step = np.maximum((high - self.low) / n, 1e-12)
        self.n = n
        a = np.clip(np.floor((src.min(1) - self.low) / self.step), -1, n).astype(int)
        b = np.clip(np.floor((src.max(1) - self.low) / self.step), -1, n).astype(int)
        span = b - a + 1
        count = span[:, 0] * span[:, 1]
        owner = np.repeat(np.arange(len(src)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ix, iy = a[owner, 0] + k // span[owner, 1], a[owner, 1] + k % span[owner, 1]
        key = (ix + 1) * (n + 2) + iy + 1
        order = np.argsort(key, kind="stable")
        self.owner, self.at = owner[order], np.searchsorted(key[order], np.arange((n + 2) ** 2 + 1))

    def holding(self, x: float, y: float) -> np.ndarray:
        i, j = np.clip(np.floor((np.array([x, y]) - self.low) / self.step), -1, self.n).astype(int) + 1
        k = i * (self.n + 2) + j
        pick = self.owner[self.at[k] : self.at[k + 1]]
        s = self.t[pick, 1]
        side = (np.roll(s, -1, 1)[..., 0] - s[..., 0]) * (y - s[..., 1]) - (np.roll(s, -1, 1)[..., 1] - s[..., 1]) * (x - s[..., 0])
        return pick[(side >= -1e-15).all(1) | (side <= 1e-15).all(1)]


def images_of(p: tuple, grid: SourceGrid, xs: float, ys: float, sdf_stop: float, model: LensModel = NSIEG) -> list[tuple]:
    """(x, y, mag, sdf) of a source's images, brightest first. sdf_stop ends the search for an image; none is left out for its
    sdf, so a caller filters by that. Images that lie at one place within 1e-5 are one."""
    def residual(v: np.ndarray) -> np.ndarray:
        ax, ay = model.alpha(p, v[..., 0], v[..., 1])
        return (v[..., 0] - ax - xs) ** 2 + (v[..., 1] - ay - ys) ** 2

    start = grid.t[grid.holding(xs, ys), 0]
    if not len(start):
        return []
    found = nelder_mead(residual, start, max_iterations=1024, stop_at=sdf_stop)
    # Newton's steps finish what the simplex has brought near.
    for _ in range(8):
        ax, ay = model.alpha(p, found[:, 0], found[:, 1])
        dx, dy = xs - (found[:, 0] - ax), ys - (found[:, 1] - ay)
        a, b, c, d = model.jacobian(p, found[:, 0], found[:, 1])
        det = a * d - b * c
        with np.errstate(invalid="ignore", divide="ignore"):
            new = found + np.stack([(d * dx - b * dy) / det, (a * dy - c * dx) / det], axis=1)
        better = np.nan_to_num(residual(new), nan=np.inf) < residual(found)
        found = np.where(better[:, None], new, found)
    sdf = residual(found)
    kept: list[int] = []
    for k in np.argsort(sdf, kind="stable"):
        if all(((found[k] - found[j]) ** 2).sum() > 1e-10 for j in kept):
            kept.append(k)
    f = found[kept]
    a, b, c, d = model.jacobian(p, f[:, 0], f[:, 1])
    mag = 2.5 * np.log10(np.abs(a * d - b * c))
    order = np.argsort(mag, kind="stable")
    return [(float(f[k, 0]), float(f[k, 1]), float(mag[k]), float(sdf[kept[k]])) for k in order]


SIMULATED = "model_id long, xs_i int, ys_i int, b double, e double, te double, g double, tg double, s double, xs double, ys double, nimg int, x double, y double, mag double, sdf double"


def simulate(grid: DataFrame, xs: str, ys: str, x: str, y: str, nmin: int = 1, nmax: int | None = None, eps: float = 1e-3, sdf: float = 1e-31, model: LensModel = NSIEG) -> DataFrame:
    """A row for each image of each source of each model of the grid (te and tg in degrees), for configurations of nmin
    to nmax - 1 images. A model's triangles are made once for all its sources; a task handles a model at a time.
    model: the kind of lens, which takes the grid's parameters."""
    ship(grid.sparkSession)
    xr, yr = parse_range(x), parse_range(y)
    xr, yr = (xr[0], xr[1], xr[2]), (yr[0], yr[1], yr[2])
    sx, sy = parse_range(xs), parse_range(ys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m in part.itertuples(index=False):
                p = (m.b, m.e, np.radians(m.te), m.g, np.radians(m.tg), m.s)
                sources, rows = SourceGrid(source_map(p, xr, yr, eps, model)), []
                for i in range(sx[2] + 1):
                    for j in range(sy[2] + 1):
                        u, v = (r[0] + k * (r[1] - r[0]) / max(r[2], 1) for r, k in ((sx, i), (sy, j)))
                        got = images_of(p, sources, u, v, sdf, model)
                        if nmin <= len(got) and (nmax is None or len(got) < nmax):
                            rows += [(m.model_id, i, j, m.b, m.e, m.te, m.g, m.tg, m.s, u, v, len(got), *r) for r in got]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIMULATED.split(", ")])

    return grid.select("model_id", *PARAMETERS).mapInPandas(run, SIMULATED)
