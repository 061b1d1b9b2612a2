"""Connected components by alternating large and small stars (Kiveris et al. 2014), as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import materialise

#: Most nodes whose least neighbour is broadcast.
HUBS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, to (node, comp): comp is the least node that a node is linked with. Nodes without an edge to another are left out.

    Neither a node's neighbours nor a component are ever gathered: each round joins the edges with the least neighbour of
    their node. A round is written to the shared folder, the round before it deleted, and the rounds end when one changes
    nothing."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialise(large, "edges", state[0])
        small = _with_least(large, state[0])
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, e = e, materialise(small, "edges", 2 * state[0])
        was, state = state, _state(e)
        discard(old)
        discard(large)
        if state == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """(u, v, m): rows with the least v of their u. Fewer than HUBS nodes u can have more than n_rows / HUBS rows; those are
    broadcast, so that no node's rows meet in one task, and the rest is joined on u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(1, n_rows // HUBS)
    hubs = least.filter(F.col("n") > most).drop("n")
    rest = least.filter(F.col("n") <= most).drop("n")
    return rows.join(F.broadcast(hubs), "u").unionByName(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(rest, "u"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
