"""Tables in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows for each file at least, where a table's rows are known to be bounded.
ROWS_PER_FILE = 250_000
#: Tables written within each open call of settled().
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the cluster's shared one, spark.checkpoint.dir. Only a local master, as in tests, may go without that setting."""
    conf = spark.sparkContext.getConf()
    given, app = conf.get("spark.checkpoint.dir", None), conf.get("spark.app.id", "local")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(given or 'file:/tmp/checkpoints').rstrip('/')}/{app}"


def materialise(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors, and gives joins a known size.

    Given the most rows that df may have, it is written in as many tasks as ROWS_PER_FILE asks for, or as there are cores
    if those are more, so that a small table dealt over many partitions isn't written as many tiny files. For tables whose
    last step is an aggregate or join on keys that don't repeat: nothing else comes into the fewer tasks."""
    if most_rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most_rows // ROWS_PER_FILE)))
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written = path
    if _scopes:
        _scopes[-1].append(path)
    return made


def settled(make: Callable[[], DataFrame], label: str, most_rows: int | None = None) -> DataFrame:
    """Writes what make() gives as materialise does, then deletes the tables that make() has written on the way to it."""
    _scopes.append([])
    try:
        made = materialise(make(), label, most_rows)
    finally:
        written = _scopes.pop()
    for path in written:
        if path != made._written:
            _delete(made.sparkSession, path)
    if _scopes:
        _scopes[-1].append(made._written)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(made: DataFrame) -> None:
    """Deletes what materialise wrote for this DataFrame; nothing that is still to be computed may read it."""
    _delete(made.sparkSession, made._written)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written with materialise, once its results have been taken."""
    _delete(spark, shared_dir(spark))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_skyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"skyloom_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._skyloom_shipped = True
