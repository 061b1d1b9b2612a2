"""Catalogues: from text lines or from any DataFrame to rows with an id, unit vector, magnitudes and payload; and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import fixed, format_dec, format_ra, general, parse_dec, parse_ra
from ..functions.sphere import unit_vector


def catalog(df: DataFrame, obj_id: Column, ra: Column, dec: Column, mags: list[Column] | None = None, *keep: str) -> DataFrame:
    """obj_id, ra, dec, ux, uy, uz, mags and the columns in keep."""
    d = df.select(obj_id.cast("long").alias("obj_id"), ra.cast("double").alias("ra"), dec.cast("double").alias("dec"), F.array(*[m.cast("double") for m in mags or []]).cast("array<double>").alias("mags"), *keep)
    x, y, z = unit_vector(F.col("ra"), F.col("dec"))
    return d.withColumns({"ux": x, "uy": y, "uz": z})


def _or_fail(value: Column, what: str, line: Column) -> Column:
    """A value that can't be read ends the query, as a bad line ends the reference's programs."""
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"can't read {what}: "), line))).otherwise(value)


def parse_lines(lines: DataFrame, n_mags: int = 0, flags: bool = False, id_column: str | None = None) -> DataFrame:
    """Catalogue rows from a column `value` of lines `ra dec [mag ..] rest`. The payload `line` is the whole line; with flags
    a leading * (density only) or ! (cluster only) is taken off. Magnitudes of density-only rows aren't read. Without an id
    column, ids number the lines as they are read, which is stable for one read of one file only; in a stream they are hashes of
    the lines."""
    d = lines.withColumn("value", F.regexp_replace("value", "[\r\n]+$", ""))
    flag = F.regexp_extract("value", r"^\s*([*!]?)", 1) if flags else F.lit("")
    d = d.withColumns({"_flag": flag, "line": F.regexp_replace("value", r"^\s*[*!]", "") if flags else F.col("value")})
    d = d.filter(F.trim("line") != "").withColumn("_f", F.split(F.trim("line"), r"\s+"))
    field = lambda k: F.get("_f", F.lit(k))
    mags = [F.when(F.col("_flag") == "*", None).otherwise(_or_fail(field(2 + k).try_cast("double"), "a magnitude", F.col("line"))) for k in range(n_mags)]
    key = F.col(id_column) if id_column else F.xxhash64("value") if lines.isStreaming else F.monotonically_increasing_id()
    read = F.struct(_or_fail(parse_ra(field(0)), "a right ascension", F.col("line")).alias("ra"), _or_fail(parse_dec(field(1)), "a declination", F.col("line")).alias("dec"))
    # Out of an explode, positions are read once for each line, not once for each column made from them.
    d = d.withColumn("_id", key).withColumn("_p", F.explode(F.array(read)))
    d = d.withColumns({"_ra": F.col("_p.ra"), "_dec": F.col("_p.dec"), "use_cluster": F.col("_flag") != "*", "use_density": F.col("_flag") != "!"})
    tail = F.regexp_replace("line", r"^\s*\S+\s+\S+", "")
    return catalog(d.withColumn("tail", tail), F.col("_id"), F.col("_ra"), F.col("_dec"), mags, "line", "tail", "use_cluster", "use_density")


def read_catalog(spark: SparkSession, path: str, n_mags: int = 0, flags: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), n_mags, flags)


def split_fields(lines: DataFrame, separator: str = " ") -> DataFrame:
    """fields: an array split at every single separator; consecutive separators give empty fields."""
    return lines.withColumn("fields", F.split("value", f"\\Q{separator}\\E", -1))


def read_delimited(spark: SparkSession, path: str, separator: str = " ", width: int | None = None) -> DataFrame:
    """fields of equal number in all rows: as many as the longest row has, which takes a scan of its own, or the given width; missing ones are empty."""
    d = split_fields(spark.read.text(path), separator)
    width = d.agg(F.max(F.size("fields"))).first()[0] or 0 if width is None else width
    return d.select(F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda k: F.coalesce(F.get("fields", k), F.lit(""))).alias("fields"))


def learning_set(df: DataFrame, row_id: Column, y: Column, attributes: list[Column], binary: bool = False) -> DataFrame:
    """row_id, y, x. With binary, y must be 0 or 1. Values that aren't numbers end the query."""
    number = lambda c: _or_fail(c.try_cast("double"), "a number", F.coalesce(c.cast("string"), F.lit("null")))
    d = df.select(row_id.alias("row_id"), number(y).alias("y"), F.array(*[number(a) for a in attributes]).alias("x"))
    return d.withColumn("y", F.when(F.col("y").isin(0.0, 1.0), F.col("y")).otherwise(F.raise_error(F.lit("a class must be 0 or 1")))) if binary else d


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows joined with weights (row_id, w), which must match one to one: a row or weight alone, or a second weight, ends the query."""
    one = weights.groupBy("row_id").agg(F.first("w").alias("w"), F.count("*").alias("_n"))
    both = rows.withColumn("_there", F.lit(True)).join(one, "row_id", "full_outer")
    matched = F.col("_there").isNotNull() & (F.col("_n") == 1)
    weight = F.when(matched, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no single weight for a row, or no row for a weight: "), F.col("row_id").cast("string"))))
    return both.select(*rows.columns, weight.alias("w"))


def parse_dmag(text: str) -> list[float]:
    """The largest magnitude differences of `a,b,..`; white space is allowed around a value, an empty one isn't."""
    out = []
    for k, part in enumerate(text.split(","), 1):
        try:
            out.append(float(part))
        except ValueError:
            raise ValueError(f"magnitude difference {k} isn't a number: {part!r}") from None
    return out


CONFIGURATION = ("b", "e", "te", "g", "tg", "s", "xs", "ys", "nimg", "x", "y", "mag", "sdf")
OBSERVATION = ("nimg", "x", "y", "mag")


def read_configurations(spark: SparkSession, path: str, observed: bool = False) -> DataFrame:
    """config_id and the fields of each image, from text rows of CONFIGURATION or, if observed, OBSERVATION; a first row that names
    the fields is left out. Consecutive rows with equal parameters and nimg form configurations of nimg rows each, in the order
    of their file; a row that can't be read, or a run of rows that isn't a multiple of nimg, ends the query.

    A file's rows are one sequence, so their numbers come from a window over the file; give many files for large sets."""
    names = OBSERVATION if observed else CONFIGURATION
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    d = d.withColumn("_f", F.split(F.trim("value"), r"\s+")).filter(F.trim("value") != "").filter(F.col("_f")[0] != names[0])
    number = lambda k, c: F.get("_f", F.lit(k)).try_cast("int" if c == "nimg" else "double")
    d = d.select("_file", "_at", "value", F.size("_f").alias("_n"), *[number(k, c).alias(c) for k, c in enumerate(names)])
    good = (F.col("_n") == len(names)) & (F.col("nimg") > 0)
    for c in names:
        good = good & F.col(c).isNotNull()
    d = d.withColumn("nimg", F.when(good, F.col("nimg")).otherwise(F.raise_error(F.concat(F.lit("can't read: "), F.col("value")))))
    same = F.struct(*[c for c in names if c not in ("x", "y", "mag", "sdf")])
    order = Window.partitionBy("_file").orderBy("_at")
    d = d.withColumn("_new", F.when(same.eqNullSafe(F.lag(same).over(order)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("_file", "_run")
    d = d.withColumns({"_k": F.row_number().over(run.orderBy("_at")) - 1, "_rows": F.count("*").over(run)})
    complete = F.when(F.col("_rows") % F.col("nimg") == 0, F.xxhash64("_file", "_run", F.floor(F.col("_k") / F.col("nimg")))).otherwise(F.raise_error(F.concat(F.lit("images are missing: "), F.col("value"))))
    return d.select(complete.alias("config_id"), *names)


def format_clusters(members: DataFrame, payload: str, with_density: bool = False) -> DataFrame:
    """value: `candidate_id nimg [density] payload`, and members, by which the rows of a cluster belong together."""
    return members.select(F.concat_ws(" ", "candidate_id", F.col("nimg").cast("string"), *([general(F.col("density"))] if with_density else []), payload).alias("value"), "members")


def format_trixels(density: DataFrame) -> DataFrame:
    """value: `name ra dec area density` of trixel_density, with the id to sort by."""
    return density.select(F.concat_ws(" ", "htm_name", format_ra(F.col("ra")), format_dec(F.col("dec")), general(F.col("area")), general(F.col("density"))).alias("value"), "htm_id")


def format_ids(rows: DataFrame, line: str = "line") -> DataFrame:
    """value: `htm_id line`."""
    return rows.select(F.concat_ws(" ", F.col("htm_id").cast("string"), line).alias("value"))


def format_images(images: DataFrame, digits: int = 6) -> DataFrame:
    """value: the fields of CONFIGURATION of simulated images, which read_configurations reads back."""
    fields = [general(F.col(c)) for c in CONFIGURATION[:8]] + [F.col("nimg").cast("string")] + [F.format_string(f"%+.{digits}e", c) for c in CONFIGURATION[9:]]
    return images.select(F.concat_ws(" ", *fields).alias("value"))


def format_matches(matches: DataFrame, line0: str = "line0", line1: str = "line1", with_distance: bool = False) -> DataFrame:
    """value: `[dist ]line0 line1`."""
    return matches.select(F.concat_ws(" ", *([general(F.col("dist"))] if with_distance else []), line0, line1).alias("value"))


def format_positions(df: DataFrame, form: str = "sph", digits: int = 6) -> DataFrame:
    """value: the converted position and the untouched tail. form: sph (radians), sphd (degrees), sex, cart, icrs2gal, gal2icrs."""
    from ..functions import sphere as S

    deg = 180 / 3.141592653589793
    if form == "sph":
        parts = [fixed(F.col("ra"), digits), fixed(F.col("dec"), digits)]
    elif form == "sphd":
        parts = [fixed(F.col("ra") * deg, digits), fixed(F.col("dec") * deg, digits)]
    elif form == "sex":
        parts = [format_ra(F.col("ra"), digits), format_dec(F.col("dec"), digits)]
    elif form == "cart":
        parts = [fixed(F.col(c), digits) for c in ("ux", "uy", "uz")]
    elif form in ("icrs2gal", "gal2icrs"):
        turned = S.rotate_position(F.col("ra"), F.col("dec"), S.ICRS_TO_GALACTIC if form == "icrs2gal" else S.GALACTIC_TO_ICRS)
        parts = [fixed(c, digits) for c in turned]
    else:
        raise ValueError(f"unknown conversion {form}")
    return df.select(F.concat(F.concat_ws(" ", *parts), F.col("tail")).alias("value"))


def region(df: DataFrame, ra: tuple[float, float] = (0.0, 360.0), dec: tuple[float, float] = (-90.0, 90.0), absb: float = 0.0, margin: float = 0.0, still: float | None = None) -> DataFrame:
    """Rows of df within the box of ra and dec and at a galactic latitude b of absb at least, all in degrees and widened by margin.

    With `still`, parallax, pmra and pmdec must be smaller than that in size; null ones drop the row. All terms are plain
    comparisons, which reach a Parquet scan."""
    kept = df.filter(F.col("ra").between(ra[0] - margin, ra[1] + margin) & F.col("dec").between(dec[0] - margin, dec[1] + margin))
    if absb - margin > 0:
        kept = kept.filter((F.col("b") >= absb - margin) | (F.col("b") <= margin - absb))
    for c in ("parallax", "pmra", "pmdec") if still is not None else ():
        kept = kept.filter((F.col(c) > -still) & (F.col(c) < still))
    return kept
