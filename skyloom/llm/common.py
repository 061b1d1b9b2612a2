"""What the corpus operators share: shared-folder tables, shipping of this package, and word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, settled  # noqa: F401

#: Runs of white space as the result contracts define it (blank and TAB to CR).
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, about (Spark's default, 64 MB, lets 10,000 texts go as one).
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets rows go to Python in batches of BATCH_BYTES, unless the session has a limit of its own. A batch is held outside the
    heap, with room to grow, and again in Python; which rows are sent doesn't change."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, in small batches of rows from then on."""
    small_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_skyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(), f"skyloom_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._skyloom_shipped = True


#: Size up to which a table of fewer files than cores is dealt anew.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is small and comes from few files: such a file may hold a single row group, which one
    task reads whatever the number of partitions. Larger tables have files and row groups enough and aren't shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def slices(batches, rows: int = 256):
    """Arrow batches in parts of few rows, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def whole_rows(df: DataFrame) -> DataFrame:
    """Packs each row into one struct, so that columns computed later can't clash with those of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def words_of(text: Column) -> Column:
    """The words between SPACES; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def is_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of doc_id as text, mod 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0
