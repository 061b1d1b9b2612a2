"""Every registered sky query against its SQL, and the rest for their own properties."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(name, same):
    same(Q.QUERIES[name], Q.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cone_uses_an_equi_join(spark, sf):
    plan = Q.cone_all(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cover_holds_the_cone(spark, sf):
    from skyloom.functions import trixel as T

    cat = Q.ords(spark, sf)
    ids = set(T.cone_cover(Q._P, math.cos(0.3), 6))
    inside = T.with_trixel(cat.join(Q.cone_probe(spark, sf), "obj_id"), F.col("ux"), F.col("uy"), F.col("uz"), 6).select("htm_id").collect()
    assert inside and all(any(r["htm_id"] >> (2 * k) in ids for k in range(7)) for r in inside)


def test_cone_and_complement(spark, sf):
    cat = Q.ords(spark, sf)
    from skyloom.operators.conejoin import probe

    a = probe(cat, 1.0, 0.5, 1.2).count()
    b = probe(cat, 1.0 + math.pi, -0.5, math.pi - 1.2).count()
    assert a + b == cat.count()


def test_images_solve_the_lens_equation(spark, sf):
    rows = Q.simulate_images(spark, sf).collect()
    assert rows and max(r["sdf"] for r in rows) < 1e-12
    assert {r["nimg"] for r in rows} <= {1, 2, 3, 4, 5}


def test_trees_learn_and_agree_under_any_partitioning(spark):
    from skyloom.operators import trees as R

    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).select("row_id", (F.col("a") * 2).alias("y"), F.array("a", "b").alias("x"))
    p = {r["row_id"]: round(r["value"], 9) for r in R.predict(rows, R.fit(rows, 2, n_trees=3, max_depth=6, k=2)).collect()}
    q = {r["row_id"]: round(r["value"], 9) for r in R.predict(rows, R.fit(rows.repartition(7), 2, n_trees=3, max_depth=6, k=2)).collect()}
    assert p == q and sum(abs(v - 2 * (k % 10)) for k, v in p.items()) / 300 < 2
    c = rows.withColumn("y", (F.col("x")[0] > 4).cast("double"))
    got = R.predict(c, R.fit(c, 2, "C", n_trees=3, max_depth=6), "C").join(c, "row_id").filter("value = y").count()
    assert got > 270


def test_least_squares_recovers_a_line(spark):
    from skyloom.operators import linear as W

    rows = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") / 100 - 1).alias("a")).select("row_id", (0.5 + 2 * F.col("a")).alias("y"), F.array("a").alias("x"), F.lit(1.0).alias("w"))
    w, cost, _ = W.fit(rows, 1, W.LINEAR, local=True, alpha=0.05, max_iterations=2000, eps=1e-12)
    assert abs(w[0] - 0.5) < 1e-3 and abs(w[1] - 2) < 1e-3


def test_simplex_finds_minima():
    import numpy as np

    from skyloom.functions.optimise import nelder_mead

    f = lambda v: (1 - v[..., 0]) ** 2 + 100 * (v[..., 1] - v[..., 0] ** 2) ** 2
    best = nelder_mead(f, np.array([[[-1.2, 1], [-1, 1], [-1.2, 1.3]], [[2, 2], [2.2, 2], [2, 2.5]]]), eps=1e-14)
    assert np.allclose(best, 1, atol=1e-4)


def test_angles(spark):
    from skyloom.functions import angles as A

    d = spark.createDataFrame([("30d",), ("-0:00:01",), ("23:59:59.9996",), ("6.2831853",), ("bad",), ("5parsec",), ("2'",), ('3"',), ("7h",)], "t string")
    r = {x["t"]: x for x in d.select("t", A.parse_ra(F.col("t")).alias("ra"), A.parse_angle(F.col("t")).alias("a")).collect()}
    assert abs(r["30d"]["ra"] - math.pi / 6) < 1e-12 and abs(r["-0:00:01"]["ra"] - (2 * math.pi - A.SECOND)) < 1e-12
    assert r["bad"]["ra"] is None and r["5parsec"]["a"] is None and abs(r["7h"]["a"] - 7 * A.HOUR) < 1e-12 and abs(r["2'"]["a"] - 2 * A.ARCMIN) < 1e-15


def test_catalogue_lines_and_stream(spark, tmp_path):
    from skyloom.sources.catalog import read_catalog
    from skyloom.streaming.matching import stream_cone_join, stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("* 1.0 0.5 x\n! 10d 20d 3.5 y z\n1:00:00 -2:30:00 4.5\n")
    rows = {r["line"].strip(): r for r in read_catalog(spark, str(tmp_path / "in"), 1, flags=True).collect()}
    assert len(rows) == 3 and not rows["1.0 0.5 x"]["use_cluster"] and not rows["10d 20d 3.5 y z"]["use_density"] and rows["1:00:00 -2:30:00 4.5"]["mags"] == [4.5]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b.txt").write_text("1.0 0.5\n2.0 0.1\n")
    static = read_catalog(spark, str(tmp_path / "s"))
    q = stream_cone_join(static, stream_lines(spark, str(tmp_path / "s")), 0.01).writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("met").count() == 2


def test_empty_catalogues(spark, sf):
    from skyloom.operators import clusters as K
    from skyloom.operators import conejoin as J

    none = Q.cust(spark, sf).limit(0)
    assert J.cone_join(none, Q.cust(spark, sf), 0.1, how="count").filter("n > 0").count() == 0
    assert K.clusters(none, 0.1).count() == 0


def test_threshold_needs_both_classes(spark):
    from skyloom.operators.linear import best_threshold

    frame = lambda rows: spark.createDataFrame(rows, "score double, y int")
    assert best_threshold(frame([])).collect() == []
    assert best_threshold(frame([(1.0, 1), (2.0, 1)])).collect() == []
    got = best_threshold(frame([(1.0, 0), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (None, 1), (float("nan"), 0), (9.0, None)])).first()
    assert (got["cut"], got["gain"]) == (2.0, 1.0)


def test_greedy_clusters_of_an_empty_catalogue(spark, sf):
    from skyloom.operators.clusters import greedy_clusters

    assert greedy_clusters(Q.cust(spark, sf).limit(0), Q.SEP).collect() == []


def test_tied_classes_are_kept(spark, sf, same):
    from skyloom.operators import trees as R

    assert same(Q.ert_combine_class, Q.SQL["ert_combine_class"]) == Q.table(spark, sf, "orders").count()
    # Halves whose sums differ in their last bits by the order of the trees.
    shares = [(1, 9), (2, 8), (3, 7), (7, 3), (8, 2), (9, 1)]
    for order in (shares, shares[::-1], shares[::2] + shares[1::2]):
        votes = spark.createDataFrame([(1, k, {0: a, 1: b}) for k, (a, b) in enumerate(order)], "row_id long, tree int, classes map<int,bigint>").coalesce(1)
        assert [(r["value"], round(r["uncertainty"], 9)) for r in R.combine(votes, "C").collect()] == [(0.0, 0.5)]


def test_all_positions_are_parsed(spark, sf, same):
    assert same(Q.position_parse, Q.SQL["position_parse"]) == Q.table(spark, sf, "part").count()
    zero = [r for r in Q.position_parse(spark, sf).collect() if r["p_partkey"] % 60 == 0]
    assert zero and all(r["ra"] == 0 for r in zero)


def test_registered_trees_grow_to_nmin(spark, sf, monkeypatch):
    from collections import Counter

    from skyloom.operators import trees as R

    fit, made = R.fit, []
    monkeypatch.setattr(R, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[0])
    Q.ert_fit_predict(spark, sf)
    leaves = Counter(r["tree"] for r in made[0].filter("leaf").collect())
    # No leaf holds 5 rows or more, as all y differ.
    assert len(leaves) == 10 and 4 * min(leaves.values()) >= Q.table(spark, sf, "customer").count()


def _plain_tree(task, x, y, key):
    """A tree by recursion and loops, as nested (attr, cut, left, right) or ("leaf", rows)."""
    import numpy as np

    from skyloom.operators import trees as R

    def bad(v):
        n = len(v)
        if task.mode == "R":
            return sum((a - sum(v) / n) ** 2 for a in v)
        if task.mode == "P":
            return n - math.hypot(sum(map(math.sin, v)), sum(map(math.cos, v)))
        share = [list(v).count(c) for c in set(v)]
        return sum(c * math.log(n / c) for c in share) if task.measure == "entropy" else n - sum(c * c for c in share) / n

    def node(rows, key):
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        alternatives = []
        if len(rows) >= task.nmin and y[rows].min() < y[rows].max():
            if task.exhaustive:
                for a in range(task.n_attributes):
                    v = sorted(set(x[rows, a]))
                    alternatives += [(a, (p + q) / 2) for p, q in zip(v, v[1:])]
            else:
                tried, cuts = R.random_cuts(task, np.array([key], np.uint64), lo[None], hi[None])
                alternatives = [(int(a), float(c)) for a, c in zip(tried[0], cuts[0]) if a >= 0]
        best = None
        for a, c in alternatives:
            left = [r for r in rows if x[r, a] < c]
            right = [r for r in rows if not x[r, a] < c]
            if left and right:
                found = (round((bad(y[left]) + bad(y[right])) / bad(y[rows]), 9), a, c, left, right)
                best = found if best is None or found[:3] < best[:3] else best
        if best is None:
            return "leaf", tuple(rows)
        keys = R._child_keys(np.array([key], np.uint64))[0]
        return best[1], best[2], node(best[3], keys[0]), node(best[4], keys[1])

    return node(list(range(len(y))), key)


def _as_nested(nodes, tree, at=0):
    n = nodes[tree, at]
    return ("leaf", round(n["value"], 9)) if n["leaf"] else (n["attr"], n["cut"], _as_nested(nodes, tree, n["left"]), _as_nested(nodes, tree, n["right"]))


@pytest.mark.parametrize("algorithm,mode,measure", [("extra", "R", "entropy"), ("extra", "P", "entropy"), ("extra", "C", "gini"), ("cart", "R", "entropy"), ("cart", "C", "entropy")])
def test_trees_against_plain_recursion(spark, algorithm, mode, measure):
    import numpy as np

    from skyloom.operators import trees as R

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (90, 3)).astype(float)
    y = x[:, 0] / 3 + rng.integers(0, 8, 90) / 8 if mode != "C" else (x[:, 0] + rng.integers(0, 6, 90)) // 6
    rows = spark.createDataFrame([(k, float(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y))], "row_id long, y double, x array<double>")
    options = dict(n_trees=2, k=2, nmin=4, seed=3, measure=measure, algorithm=algorithm)
    got = R.fit(rows, 3, mode, **options)
    nodes = {(r["tree"], r["node"]): r for r in got.collect()}
    # The same with nearly all nodes made by sums over all rows.
    spread = {(r["tree"], r["node"]): r for r in R.fit(rows.repartition(5), 3, mode, local_rows=40, **options).collect()}
    task = R.Task(mode, 3, 2, 4, 3, measure, algorithm == "cart", None, float(y.mean()) if mode == "R" else 0.0, tuple(sorted(set(y.astype(int)))) if mode == "C" else ())

    def mean(leaf):
        v = y[list(leaf)]
        if mode == "C" and algorithm == "cart":
            return float(max(set(v), key=lambda c: (list(v).count(c), c)))
        return math.atan2(np.sin(v).sum(), np.cos(v).sum()) if mode == "P" else v.mean()

    def valued(t):
        return ("leaf", round(mean(t[1]), 9)) if t[0] == "leaf" else (t[0], t[1], valued(t[2]), valued(t[3]))

    for tree in {t for t, _ in nodes}:
        plain = valued(_plain_tree(task, x, y, R.root_keys(3, [tree])[0]))
        assert _as_nested(nodes, tree) == plain == _as_nested(spread, tree)
    if algorithm == "cart":
        return
    assert len(R.load(spark, _saved(R, got)).collect()) == len(nodes)
    by_join = {r["row_id"]: (round(r["value"], 9), round(r["uncertainty"], 9)) for r in R.predict(rows, got, mode, model_nodes=0).collect()}
    by_array = {r["row_id"]: (round(r["value"], 9), round(r["uncertainty"], 9)) for r in R.predict(rows, got, mode).collect()}
    assert by_join == by_array and len(by_array) == 90


def _saved(R, model):
    import tempfile

    path = tempfile.mkdtemp()
    R.save(model, path)
    return path


def test_trees_of_any_depth(spark):
    from skyloom.operators import trees as R

    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("y"), F.array(F.pow(F.lit(2.0), -F.col("id").cast("double"))).alias("x"))
    model = R.fit(rows, 1, "R", n_trees=1, nmin=2)
    nodes = {r["node"]: r for r in model.collect()}
    depth = lambda at: 0 if nodes[at]["leaf"] else 1 + max(depth(nodes[at]["left"]), depth(nodes[at]["right"]))
    assert depth(0) > 62
    for way in (0, 1 << 20):
        assert R.predict(rows, model, model_nodes=way).join(rows, "row_id").filter("abs(value - y) > 1e-9").count() == 0


def test_trees_take_no_odd_rows(spark):
    from skyloom.operators import trees as R

    odd = spark.createDataFrame([(1, None, [1.0]), (2, 1.0, [None]), (3, 1.0, [float("nan")]), (4, 2.0, [1.0]), (5, 2.0, [2.0])], "row_id long, y double, x array<double>")
    model = R.fit(odd, 1, n_trees=2)
    assert {r["value"] for r in model.collect()} == {2.0}
    assert R.predict(odd, model).count() == 5
    with pytest.raises(ValueError):
        R.fit(odd.limit(1).filter("y > 0"), 1)
    assert R.best_split(odd.filter("row_id > 3"), 1).collect() == [(0, 1.5, 0.0)]
    assert R.best_split(odd.filter("row_id = 4"), 1).collect() == []


def test_streamed_predictions(spark, tmp_path):
    from skyloom.operators import trees as R
    from skyloom.streaming.matching import stream_predictions

    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("double").alias("y"), F.array((F.col("id") % 4).cast("double")).alias("x"))
    model = R.fit(rows, 1, n_trees=2, nmin=2)
    rows.write.parquet(str(tmp_path / "in"))
    q = stream_predictions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["row_id"], r["value"]) for r in spark.table("told").collect()} == {(k, float(k % 4)) for k in range(40)}


def test_least_squares_anywhere(spark):
    import numpy as np

    from skyloom.operators import linear as W

    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") / 100 - 1.5).alias("a"), F.lit(1.0).alias("w")).select("row_id", (F.col("a") > 0.2).cast("double").alias("y"), F.array("a").alias("x"), "w")
    for batch in (None, 60):
        a, b = (W.fit(rows, 1, batch_size=batch, local=where, alpha=0.05, max_iterations=12) for where in (True, False))
        assert np.allclose(a[0], b[0], atol=1e-9) and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] == 12


def test_delimited_sources(spark, tmp_path):
    from skyloom.sources import catalog as C

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("1 2  3\nx\n\n4 5 6 7 8\n")
    rows = [r["fields"] for r in C.read_delimited(spark, str(tmp_path / "d")).collect()]
    assert rows == [["1", "2", "", "3", ""], ["x", "", "", "", ""], ["", "", "", "", ""], ["4", "5", "6", "7", "8"]]
    assert [r["fields"] for r in C.read_delimited(spark, str(tmp_path / "d"), width=2).collect()][0] == ["1", "2"]
    d = spark.createDataFrame([(1, "0", "1.5"), (2, "1", "2")], "k long, y string, a string")
    assert [tuple(r) for r in C.learning_set(d, F.col("k"), F.col("y"), [F.col("a")], binary=True).orderBy("row_id").collect()] == [(1, 0.0, [1.5]), (2, 1.0, [2.0])]
    for bad in (spark.createDataFrame([(1, "2", "1")], d.schema), spark.createDataFrame([(1, "1", "z")], d.schema), spark.createDataFrame([(1, None, "1")], d.schema)):
        with pytest.raises(Exception, match="class must be|can't read"):
            C.learning_set(bad, F.col("k"), F.col("y"), [F.col("a")], binary=True).collect()
    w = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id long, w double")
    x = d.select(F.col("k").alias("row_id"), "a")
    assert sorted(tuple(r) for r in C.with_weights(x, w).collect()) == [(1, "1.5", 2.0), (2, "2", 3.0)]
    for other in (w.filter("row_id = 1"), w.unionByName(w.filter("row_id = 1")), w.unionByName(spark.createDataFrame([(9, 1.0)], w.schema))):
        with pytest.raises(Exception, match="no single weight"):
            C.with_weights(x, other).collect()


def test_magnitude_differences():
    from skyloom.sources.catalog import parse_dmag

    assert parse_dmag("0.5") == [0.5] and parse_dmag(" 1 , 2e-1,3") == [1.0, 0.2, 3.0]
    for bad in ("", "1,", "1,,2", "1;2", "a"):
        with pytest.raises(ValueError):
            parse_dmag(bad)


def test_text_configurations(spark, sf, tmp_path):
    from skyloom.operators import lensset as D
    from skyloom.sources import catalog as C

    images = Q.simulate_images(spark, sf)
    C.format_images(images, 12).coalesce(1).write.text(str(tmp_path / "sim"))
    back = C.read_configurations(spark, str(tmp_path / "sim"))
    key = ["b", "e", "te", "g", "tg", "s", "xs", "ys"]
    sizes = lambda d, k: sorted((r["nimg"], r["n"]) for r in d.groupBy(*k, "nimg").agg(F.count("*").alias("n")).collect())
    assert sizes(back, ["config_id"]) == sizes(images, ["model_id", "xs_i", "ys_i"])
    assert D.dataset(back, input="1", output="b,xs,x1,m1").count() == back.select("config_id").distinct().count()
    (tmp_path / "obs").mkdir()
    (tmp_path / "obs" / "o.txt").write_text("nimg x y mag\n2 0 0 1\n2 1 0 2\n2 0 1 3\n2 5 5 1\n3 1 1 1\n3 2 2 2\n3 3 3 3\n")
    got = C.read_configurations(spark, str(tmp_path / "obs"), observed=True)
    assert sorted(r["count"] for r in got.groupBy("config_id").count().collect()) == [2, 2, 3]
    wide = D.dataset(got, input="1,2", norm=True)
    assert wide.columns[1:] == D.OUTPUT.split(",") and wide.count() == 3
    for bad in ("2 0 0 1\n", "2 0 0\n2 0 0 1\n", "2 0 0 1 9\n2 0 0 1\n", "0 1 1 1\n"):
        (tmp_path / "obs" / "o.txt").write_text(bad)
        with pytest.raises(Exception, match="images are missing|can't read"):
            C.read_configurations(spark, str(tmp_path / "obs"), observed=True).collect()
    mixed = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 1.0)], "config_id long, b double, x double, y double, mag double")
    with pytest.raises(Exception, match="differs within"):
        D.dataset(mixed, input="1").collect()


def test_text_sinks(spark, sf):
    from skyloom.functions.angles import general
    from skyloom.operators import clusters as K
    from skyloom.operators import surface as G
    from skyloom.sources import catalog as C

    values = [0.0, 1.0, -2.5, 123456.7, 1234567.0, 1e-4, 9.99e-5, 1e300, 0.1 + 0.2, 100.0, 999999.5]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r["t"] for r in d.orderBy("k").select(general(F.col("v")).alias("t")).collect()] == ["%g" % v for v in values]
    cat = Q.cust(spark, sf)
    members = K.cluster_members(K.clusters(cat, 8 * Q.DEG, nmax=3, rdensity=Q.RADIUS), cat.withColumn("line", F.col("obj_id").cast("string")), "line")
    assert all(len(r["value"].split()) == 4 for r in C.format_clusters(members, "line", True).collect())
    density = G.trixel_density(cat, 3)
    assert all(len(r["value"].split()) == 5 and r["value"][0] in "NS" for r in C.format_trixels(density).collect())
    ids = C.format_ids(cat.select(F.lit(8).cast("long").alias("htm_id"), F.lit("a b").alias("line")))
    assert ids.first()["value"] == "8 a b"


def test_grids_are_kept(spark, sf, tmp_path):
    from skyloom.operators import surface as G

    grid, header = G.grid_build(Q._points(spark, sf), 5.0, 10000.0)
    G.save_grid(grid, header, str(tmp_path / "g"))
    points = Q._points(spark, sf)
    a, b = (G.grid_predict(points, *g).groupBy().agg(F.sum("p")).first()[0] for g in ((grid, header), G.load_grid(spark, str(tmp_path / "g"))))
    assert abs(a - b) < 1e-6


def test_cells_of_triangles(spark, sf):
    import numpy as np

    got = {}
    for r in Q.triangle_cells(spark, sf).collect():
        got.setdefault(r["id"], set()).add((r["ix"], r["iy"]))
    u, v = (a.ravel() for a in np.meshgrid(np.linspace(0, 1, 60), np.linspace(0, 1, 60)))
    u, v = u[u + v <= 1], v[u + v <= 1]
    for k in list(got)[:60]:
        c = [[((k * m) % n) / n * 10 - 0.003 for m, n in pair] for pair in (((17, 101), (29, 103)), ((37, 107), (53, 109)), ((71, 113), (89, 127)))]
        p = np.array(c[0])[:, None] + np.outer(np.array(c[1]) - c[0], u) + np.outer(np.array(c[2]) - c[0], v)
        inside = ((p >= 0) & (p < 10)).all(axis=0)
        assert {(int(a // 0.5), int(b // 0.5)) for a, b in p[:, inside].T} <= got[k]


def test_potential_and_deflection(spark):
    from skyloom.functions import lens as L

    h = 1e-5
    at = [(0, 0), (h, 0), (-h, 0), (0, h), (0, -h)]
    rows = [(k, 1.2, 0.3, 0.7, 0.1, 0.4, 0.15, 0.6 + dx, -0.35 + dy) for k, (dx, dy) in enumerate(at)]
    d = spark.createDataFrame(rows, "k int, b double, e double, te double, g double, tg double, s double, x double, y double")
    p = [r["potential"] for r in L.with_potential(d).orderBy("k").collect()]
    a = L.with_lens(d).orderBy("k").first()
    assert abs((p[1] - p[2]) / (2 * h) - a["ax"]) < 1e-7 and abs((p[3] - p[4]) / (2 * h) - a["ay"]) < 1e-7


def test_another_lens(spark):
    from skyloom.functions.lens import LensModel
    from skyloom.sources import generators as G

    grid = G.parameter_grid(spark, b="1", e="0", te="0", g="0", tg="0", s="0.1")
    point = LensModel(lambda p, x, y: (p[0] ** 2 * x / (x * x + y * y + 1e-12), p[0] ** 2 * y / (x * x + y * y + 1e-12)))
    rows = G.simulate(grid, "0.5", "0", "[-3:31:3]", "[-3:31:3]", eps=0.05, model=point).filter("sdf < 1e-15 AND abs(x) > 0.01").collect()
    # A point lens has its images at (u +- sqrt(u * u + 4)) / 2.
    assert sorted(round(r["x"], 4) for r in rows) == [round((0.5 - math.sqrt(4.25)) / 2, 4), round((0.5 + math.sqrt(4.25)) / 2, 4)]


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace

    from skyloom.storage import shared_dir

    session = lambda master, given: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d: given.get(k, d))))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", {}))
    assert shared_dir(session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:/x/", "spark.app.id": "a"})) == "hdfs:/x/a"
    assert shared_dir(session("local[2]", {})).startswith("file:")


def test_tables_can_be_deleted(spark):
    from pathlib import Path

    from skyloom.storage import discard, materialise, settled

    made = materialise(spark.range(3), "trial")
    place = Path(made._written.removeprefix("file:"))
    assert made.count() == 3 and place.exists()
    discard(made)
    assert not place.exists()
    on_the_way = []

    def make():
        on_the_way.append(materialise(spark.range(5), "trial"))
        inner = settled(lambda: materialise(on_the_way[0].filter("id > 1"), "trial"), "trial")
        on_the_way.append(inner)
        return inner.filter("id > 2")

    made = settled(make, "trial")
    assert sorted(r["id"] for r in made.collect()) == [3, 4]
    assert not any(Path(t._written.removeprefix("file:")).exists() for t in on_the_way)


def test_sky_queries_stand_alone(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "skyloom.llm", None)
    assert set(__spark_entry__.queries()) == set(Q.QUERIES)


def test_covers_of_many_cones():
    import numpy as np

    from skyloom.functions import trixel as T

    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    row, ids = T.cone_covers(v, math.cos(0.2), 5)
    for k in range(20):
        assert ids[row == k].tolist() == T.cone_cover(v[k], math.cos(0.2), 5)
    p = rng.normal(size=(3, 4000))
    p /= np.linalg.norm(p, axis=0)
    deep = T.ids_of(p, 5)
    for k in range(20):
        inside = (v[k] @ p) >= math.cos(0.2)
        covered = np.isin(deep, ids[row == k]) | np.any([np.isin(deep >> (2 * j), ids[row == k]) for j in range(1, 6)], axis=0)
        assert covered[inside].all()
    a, b, c = T.corners_of(deep)
    assert (T.ids_of((a + b + c) / np.linalg.norm(a + b + c, axis=0), 5) == deep).all()
