"""Cases of the findings of round 2."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import angles as A
from skyloom.llm import bpe, common, quality_model
from skyloom.llm.common import whole_rows
from skyloom.operators import clusters as K
from skyloom.operators import conejoin as J
from skyloom.operators import linear as W
from skyloom.operators import trees as R
from skyloom.plans import queries as Q
from skyloom.sources import catalog as cat


def test_numbers_are_rounded_by_their_exact_value(spark):
    """format_string rounds 1.0005, which lies below the half, up."""
    values = [1.0005, 45.1635, -226.7205, 0.0005, 0.125, 0.375, 2.5, -0.0001, -0.0, 0.0, 359.9995, 59.9995, 1e-300, 4e11]
    d = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = d.select("v", *[A.fixed(F.col("v"), n).alias(f"f{n}") for n in (0, 2, 3, 7)], A.fixed(F.abs("v"), 3, 2).alias("wide")).collect()
    for r in got[:-1]:
        assert [r["f0"], r["f2"], r["f3"], r["wide"]] == [f"{r['v']:.0f}", f"{r['v']:.2f}", f"{r['v']:.3f}", f"{abs(r['v']):06.3f}"]
        assert r["f7"] == f"{r['v']:.7f}" or r["v"] > 1e8
    assert got[-1]["f3"] is None
    rad = 1.0005
    at = cat.catalog(spark.createDataFrame([(1, "")], "k long, tail string"), F.col("k"), F.lit(rad), F.lit(0.0005), None, "tail")
    assert cat.format_positions(at, "sph", 3).first()[0] == "1.000 0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_broadcast(spark, sf):
    """a file of 4 MB may hold a million rows, which the driver can't take."""
    assert "Broadcast" not in _plan(Q.neighbour_pairs(spark, sf))
    for how in ("all", "best", "count", "semi", "anti", "left"):
        assert "Broadcast" not in _plan(J.cone_join(Q.supp(spark, sf), Q.cust(spark, sf), 0.1, how=how))


def test_densities_are_not_broadcast(spark, sf):
    """F1"""
    assert "Broadcast" not in _plan(Q.cap_density(spark, sf))


def test_least_squares_takes_different_rows_only(spark):
    """F8: the driver got every row; rows that are equal are counted now, and too many different ones stay on the executors."""
    d = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 7 > 3).cast("double").alias("y"), F.array((F.col("id") % 11).cast("double") / 11).alias("x"), F.lit(1.0).alias("w"))
    got = []
    taken = type(d).toArrow
    try:
        type(d).toArrow = lambda self: got.append(taken(self)) or got[-1]
        here = W.fit(d, 1, local=True, max_iterations=20, alpha=0.05)
        assert [t.num_rows for t in got] == [22]
        apart = W.fit(d, 1, local=True, local_values=10, max_iterations=20, alpha=0.05)
        drawn = W.fit(d, 1, local=True, batch_size=500, max_iterations=5, alpha=0.05)
    finally:
        type(d).toArrow = taken
    whole = W.fit(d, 1, max_iterations=20, alpha=0.05)
    for other in (apart, whole):
        assert abs(here[0] - other[0]).max() < 1e-9 and abs(here[1] - other[1]) < 1e-6 and here[2] == other[2]
    same = W.fit(d, 1, batch_size=500, max_iterations=5, alpha=0.05)
    assert abs(drawn[0] - same[0]).max() < 1e-9 and drawn[2] == same[2]


def _written(monkeypatch, module):
    """The plans of the tables that a module writes."""
    plans, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label, *a: plans.append((label, _plan(df))) or write(df, label, *a))
    return plans


def test_roots_come_before_lists(spark, sf, monkeypatch):
    """no broadcast, and neighbours are listed for the roots that are left and what they name only."""
    plans = _written(monkeypatch, K)
    Q.cluster_max_parent(spark, sf)
    assert not [label for label, p in plans if "Broadcast" in p]
    labels = [label for label, _ in plans]
    assert labels.index("cluster-roots") < labels.index("cluster-wanted") < labels.index("cluster-forward")


def test_largest_cliques_are_not_written(spark, sf, monkeypatch):
    """no broadcast, and of triples only pairs and what they share are written on the way."""
    plans = _written(monkeypatch, K)
    found = Q.cluster_triples(spark, sf)
    assert not [label for label, p in plans if "Broadcast" in p] and "Broadcast" not in _plan(found)
    assert [label for label, _ in plans].count("cluster-state") == 2
    assert found.count() == K.clusters(Q.cust(spark, sf), Q.SEP).filter("nimg = 3").count()


def test_members_are_not_broadcast(spark, sf):
    """F2"""
    assert "Broadcast" not in _plan(Q.cluster_members(spark, sf))


def test_large_models_go_to_groups(spark):
    """a model beyond model_nodes was joined by broadcasts, a level a round; now rows and subtrees meet in groups."""
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("double").alias("y"), F.array((F.col("id") * 7 % 101).cast("double"), (F.col("id") % 13).cast("double")).alias("x"))
    odd = rows.select("row_id", "x").unionByName(spark.createDataFrame([(-1, [5.0]), (-2, [None, 3.0]), (-3, [float("nan"), 1.0])], "row_id long, x array<double>"))
    for mode in ("R", "C"):
        model = R.fit(rows, 2, mode, n_trees=3, seed=2, local_rows=100)
        read = lambda d: {r[0]: (round(r[1], 9), round(r[2], 9)) for r in d.collect()}
        assert read(R.predict(odd, model, mode)) == read(R.predict(odd, model, mode, model_nodes=0))
        apart = R.apply_trees(odd, model, local_rows=50)
        assert "Broadcast" not in _plan(apart) and apart.count() == 3 * 603
        assert read(R.combine(apart, mode)) == read(R.predict(odd, model, mode))


def test_greedy_rounds_are_not_broadcast(spark, sf, monkeypatch):
    """F7"""
    plans = _written(monkeypatch, K)
    Q.greedy_clusters(spark, sf)
    assert not [label for label, p in plans if "Broadcast" in p]


def _greedy_plain(spots, sep, dmag=None):
    """Cliques of three or more by trying all; spots: (id, unit vector, magnitude)."""
    linked = set()
    for a, p, m in spots:
        for b, q, n in spots:
            if a < b and p[0] * q[0] + p[1] * q[1] + p[2] * q[2] >= math.cos(sep) and (dmag is None or abs(m - n) <= dmag):
                linked.add((a, b))
    found = set()
    for root in {s[0] for s in spots}:
        members = [root]
        for j in sorted({s[0] for s in spots if s[0] > root}):
            if all((i, j) in linked for i in members):
                members.append(j)
        if len(members) > 2:
            found.add(tuple(members))
    return found


def test_greedy_cliques_take_no_rounds(spark, monkeypatch):
    """a clique of n objects took n rounds, each written and kept in the driver's plans; links, copies of ids, magnitudes, salts and small caches all give the same."""
    written = _written(monkeypatch, K)
    ids = spark.range(120).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") * 37 % 101).alias("a"), (F.col("id") * 53 % 97).alias("b"))
    ids = ids.unionAll(ids.filter("k % 5 = 0")).unionAll(ids.filter("k % 7 = 0").selectExpr("k", "a + 40", "b - 30")).unionAll(spark.createDataFrame([(None, 1, 1), (5000, None, 2)], "k long, a long, b long"))
    sky = cat.catalog(ids, F.col("k"), F.col("a") / 900, F.col("b") / 800, [(F.col("k") % 10).cast("double")])
    plain = [(r["obj_id"], (r["ux"], r["uy"], r["uz"]), r["mags"][0]) for r in sky.collect() if r["obj_id"] is not None and r["ux"] is not None]
    read = lambda d: sorted(tuple(r["members"]) for r in d.collect())
    for sep, dmag in ((0.03, None), (0.03, 3.0), (0.3, None)):
        want = sorted(_greedy_plain(plain, sep, dmag))
        assert len(want) > 20
        for salts in (1, 3):
            assert read(K.greedy_clusters(sky, sep, dmag and [dmag], salts=salts)) == want
    monkeypatch.setattr(K, "LINK_BYTES", 1)
    once = sky.filter("obj_id % 5 > 0 AND obj_id % 7 > 0")
    assert read(K.greedy_clusters(once, 0.3)) == sorted(_greedy_plain([s for s in plain if s[0] % 5 and s[0] % 7], 0.3))
    assert {label for label, _ in written} == {"greedy-objects"}
    assert max(len(m) for m in read(K.greedy_clusters(once, 0.3))) > 40 and len(written) == 8


def test_greedy_groups_are_not_broadcast(spark, sf):
    """F7"""
    assert "Broadcast" not in _plan(Q.greedy_clusters(spark, sf))


def test_only_texts_go_to_python_for_scores(spark):
    """The pipeline's classify sent each text twice, within its whole row, and got the rows back."""
    x = np.random.default_rng(1).random((400, len(quality_model.NAMES)))
    model = quality_model.fit(x, (x[:, 0] > 0.5).astype(float), n_trees=5)
    texts = [f"word {'x' * (k % 9)} {k} ." * (k % 50) for k in range(700)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "score long, Text string").coalesce(1)
    made = quality_model.scored(whole_rows(docs), model)
    kept = made.filter(F.col("score") >= 0.3).select("doc.*")
    for d in (made, kept):
        assert _plan(d).count("ArrowEvalPython") == 1 and "MapInArrow" not in _plan(d)
    want = model.score(np.array([quality_model.statistics((t or "").encode()) for t in texts], np.float32).astype(float))
    assert [(r["doc"]["score"], r["score"]) for r in made.collect()] == list(enumerate(want))
    assert kept.columns == ["score", "Text"] and [r[0] for r in kept.collect()] == np.flatnonzero(want >= 0.3).tolist()


def test_texts_go_to_python_in_small_batches(spark):
    """F1 pipeline: up to 10,000 texts went to a Python worker as one batch, outside the heap of an executor that had no room beside it."""
    own = spark.newSession()
    common.ship(own)
    texts = own.range(0, 6000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 1000)).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (type(b).from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches), "rows long, size long").collect()
    assert sum(r["rows"] for r in sizes) == 6000
    assert max(r["size"] for r in sizes) < 2 * common.BATCH_BYTES
    chosen = spark.newSession()
    chosen.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "5000000")
    common.ship(chosen)
    assert chosen.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "5000000"


def test_long_words_merge_like_short_ones():
    """F1 pipeline: one table of merges for words of any length, and no second one of tuples."""
    voc = bpe.vocabulary(None)
    assert not hasattr(voc, "merges")
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaaa", "Stra\u00dfenverkehrsordnung".encode(), b"x"):
        short, bpe.LONGEST = voc.merge(word), 0
        try:
            assert voc.merge(word) == short
        finally:
            bpe.LONGEST = 64
