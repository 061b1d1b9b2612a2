"""Stateless streams: catalogue lines against a static catalogue, rows against a hyperplane or an ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.conejoin import cone_pairs
from ..operators import trees
from ..operators.linear import score
from ..sources.catalog import parse_lines
from ..storage import materialise


def stream_lines(spark: SparkSession, path: str, n_mags: int = 0, id_column: str | None = None) -> DataFrame:
    """A folder of text files as a stream of catalogue rows."""
    return parse_lines(spark.readStream.text(path), n_mags, id_column=id_column)


def stream_cone_join(static: DataFrame, stream: DataFrame, radius: float, dmag: list[float] | None = None, **options) -> DataFrame:
    """All partners in `static` of each streamed row; no state is kept, so no watermark is needed. The static side is written out once."""
    return cone_pairs(materialise(static, "static-catalogue"), stream, radius, dmag, **options)


def stream_scores(rows: DataFrame, weights: list[float]) -> DataFrame:
    return rows.withColumn("score", score(weights, [rows["x"][k] for k in range(len(weights) - 1)]))


def stream_predictions(rows: DataFrame, model: DataFrame, mode: str = "R") -> DataFrame:
    """(row_id, value, uncertainty) of each streamed row (row_id, x). The model goes to the tasks whole, so it must be small enough for that."""
    if model.count() > trees.MODEL_NODES:
        raise ValueError(f"a streamed model may have {trees.MODEL_NODES} nodes")
    return trees.predict(rows, model, mode)
