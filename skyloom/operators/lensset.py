"""Learning sets from image configurations: noise, order by magnitude, selection, normalisation and wide columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.generators import normal

#: Lens and source parameters, and what they are for observed images, which have none.
LENS = {"b": 1.0, "e": 0.0, "te": 0.0, "g": 0.0, "tg": 0.0, "s": 0.0, "xs": 0.0, "ys": 0.0}
#: Fixed value: the columns of a learning set.
OUTPUT = "class,b,e,te,g,tg,s,xs,ys,xd,yd,x1,y1,m1,x2,y2,m2,x3,y3,m3,x4,y4,m4"


def parse_output(text: str) -> list[str]:
    """Column tokens of an output list: class, nimg, b, e, te, g, tg, s, xs, ys, xd, yd, xN, yN, mN."""
    out = [t.strip() for t in text.split(",")]
    for t in out:
        if not re.fullmatch(r"class|nimg|b|e|te|g|tg|s|xs|ys|xd|yd|[xym][1-9]\d*", t):
            raise ValueError(f"unknown column {t!r}")
    return out


def configurations(images: DataFrame, *lens: str) -> DataFrame:
    """config_id, images (array of mag, x, y by magnitude) and the lens columns, from a row for each image. Lens columns that
    differ within a configuration end the query."""
    conf = images.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("mag", "x", "y"))).alias("images"), *[f(c).alias(f"{n}_{c}") for c in lens for n, f in (("lo", F.min), ("hi", F.max))])
    one = lambda c: F.when(F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")), F.col(f"lo_{c}")).otherwise(F.raise_error(F.concat(F.lit(f"{c} differs within configuration "), F.col("config_id").cast("string"))))
    return conf.select("config_id", "images", *[one(c).alias(c) for c in lens])


def max_separation(images: Column) -> Column:
    d = F.transform(images, lambda a: F.array_max(F.transform(images, lambda b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))))
    return F.sqrt(F.array_max(d))


def with_noise(conf: DataFrame, n: int = 1, xy: float = 0.0, mag: float = 0.0, relative: bool = False, seed: int = 1) -> DataFrame:
    """n noisy realisations of each configuration, in order of the noisy magnitudes; relative scales positions' noise by the largest separation."""
    d = conf.withColumn("_scale", max_separation(F.col("images")) * xy if relative else F.lit(float(xy)))

    def noisy(r: Column) -> Column:
        key = lambda i, k: normal(seed, F.col("config_id"), r, i, F.lit(k))
        return F.array_sort(F.transform("images", lambda v, i: F.struct((v["mag"] + key(i, 0) * mag).alias("mag"), (v["x"] + key(i, 1) * F.col("_scale")).alias("x"), (v["y"] + key(i, 2) * F.col("_scale")).alias("y"))))

    # Out of an explode, noise is drawn once for each image, not once for each column made from it.
    d = d.withColumn("_r", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.struct(r.alias("realisation"), noisy(r).alias("images")))))
    return d.withColumns({"realisation": F.col("_r.realisation"), "images": F.col("_r.images")}).drop("_scale", "_r")


def select_images(conf: DataFrame, indices: list[int]) -> DataFrame:
    """The images at these places from 1, in order, of the configurations that have them all."""
    places = sorted(set(indices))
    return conf.filter(F.size("images") >= places[-1]).withColumn("images", F.array(*[F.col("images")[k - 1] for k in places]))


def normalise(conf: DataFrame) -> DataFrame:
    """Positions recentred on the brightest image, turned and scaled so that the faintest kept one is (1, 0); magnitudes from the
    brightest; xd, yd (the deflector, from 0, 0) and, where they are there, source and lens parameters alike."""
    d = conf.withColumns({"_o": F.col("images")[0], "_l": F.element_at("images", -1)})
    d = d.withColumns({"_dx": F.col("_l.x") - F.col("_o.x"), "_dy": F.col("_l.y") - F.col("_o.y")})
    d = d.withColumn("_r2", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    turn = lambda x, y: (F.try_divide(x * F.col("_dx") + y * F.col("_dy"), F.col("_r2")), F.try_divide(y * F.col("_dx") - x * F.col("_dy"), F.col("_r2")))

    def image(v: Column) -> Column:
        x, y = turn(v["x"] - F.col("_o.x"), v["y"] - F.col("_o.y"))
        return F.struct((v["mag"] - F.col("_o.mag")).alias("mag"), x.alias("x"), y.alias("y"))

    xd, yd = turn(-F.col("_o.x"), -F.col("_o.y"))
    new = {"images": F.transform("images", image), "xd": xd, "yd": yd}
    if "xs" in conf.columns:
        new["xs"], new["ys"] = turn(F.col("xs") - F.col("_o.x"), F.col("ys") - F.col("_o.y"))
    if "b" in conf.columns:
        angle = F.atan2("_dy", "_dx") * (180 / math.pi)
        new |= {"b": F.try_divide("b", F.sqrt("_r2")), "s": F.try_divide("s", F.sqrt("_r2")), "te": F.col("te") - angle, "tg": F.col("tg") - angle}
    return d.withColumns(new).drop("_o", "_l", "_dx", "_dy", "_r2")


def spherical(conf: DataFrame) -> DataFrame:
    """x multiplied by the cosine of the first image's y."""
    c = F.cos(F.col("images")[0]["y"])
    return conf.withColumn("images", F.transform("images", lambda v: F.struct(v["mag"], (v["x"] * c).alias("x"), v["y"])))


def wide(conf: DataFrame, output: str, simulated: bool = False) -> DataFrame:
    """config_id and a column for each token of output; class is 1 for simulated configurations, 0 for observed ones."""
    def column(t: str) -> Column:
        if t == "class":
            return F.lit(int(simulated))
        if t == "nimg":
            return F.size("images")
        if m := re.fullmatch(r"([xym])(\d+)", t):
            return F.get("images", F.lit(int(m[2]) - 1))["mag" if m[1] == "m" else m[1]]
        return F.col(t) if t in conf.columns else F.lit(0.0)

    return conf.select("config_id", *[column(t).alias(t) for t in parse_output(output)])


def dataset(images: DataFrame, input: str = "1,2,3,4", output: str = OUTPUT, norm: bool = False, sph: bool = False, n_noise: int = 1, xy_noise: float = 0.0, mag_noise: float = 0.0, relative: bool = False, seed: int = 1, simulated: bool = False) -> DataFrame:
    """The whole chain, from a row for each image to a row for each realisation."""
    places = [int(t) for t in input.split(",")]
    if norm and len(set(places)) < 2:
        raise ValueError("a normalisation needs two images")
    if xy_noise < 0 or mag_noise < 0:
        raise ValueError("noise must not be negative")
    conf = configurations(images, *[c for c in LENS if c in images.columns])
    conf = conf.withColumns({c: F.lit(v) for c, v in LENS.items() if c not in images.columns})
    conf = spherical(conf) if sph else conf
    if n_noise > 1 or xy_noise or mag_noise:
        conf = with_noise(conf, n_noise, xy_noise, mag_noise, relative, seed)
    conf = select_images(conf, places)
    return wide(normalise(conf) if norm else conf, output, simulated)
