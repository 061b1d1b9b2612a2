"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it.

The tables have no positions, so catalogues are derived from keys and amounts by the same arithmetic in both engines.
Floats are rounded, because sums add up in different orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import lens as L
from ..functions import sphere as S
from ..functions import stats as C
from ..functions import trixel as T
from ..operators import clusters as K
from ..operators import conejoin as J
from ..operators import lensset as D
from ..operators import linear as W
from ..operators import surface as G
from ..operators import trees as R
from ..sources import catalog as cat
from ..sources import generators as gen

DEG = math.pi / 180
SEP, RADIUS = 2.5 * DEG, 5 * DEG
LEVEL = 8
WEIGHTS = (0.1, 0.02, -0.00002, 1.5, -2.0)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = PRELUDE + (sql if sql.startswith("SELECT") else f", {sql}")
        return f

    return register


def _sky(key: str, height: str, low: float, span: float, table: str, name: str) -> str:
    return f"""{name} AS (SELECT *, cos(ra) * cos(dec) AS ux, sin(ra) * cos(dec) AS uy, sin(dec) AS uz FROM (SELECT {key}::BIGINT AS obj_id,
        2 * pi() * ((({key} * 1103515245 + 12345) % 2147483648)::DOUBLE / 2147483648) AS ra, asin(2 * (({height}::DOUBLE + {-low}) / {span}) - 1) AS dec, (({key} * 69069 + 1) % 1000)::DOUBLE / 100 AS mag FROM {table}))"""


PRELUDE = "WITH RECURSIVE " + ", ".join([
    _sky("c_custkey", "c_acctbal", -1000, 11000, "customer", "cust"), _sky("s_suppkey", "s_acctbal", -1000, 11000, "supplier", "supp"), _sky("o_orderkey", "o_totalprice", 1000, 499000, "orders", "ords"),
    f"nb AS (SELECT a.obj_id AS a, b.obj_id AS b FROM cust a JOIN cust b ON a.obj_id < b.obj_id AND a.ux * b.ux + a.uy * b.uy + a.uz * b.uz >= {math.cos(SEP)!r}::DOUBLE)",
    f"pr AS (SELECT s.obj_id AS id0, c.obj_id AS id1, s.mag AS m0, c.mag AS m1, s.ux * c.ux + s.uy * c.uy + s.uz * c.uz AS dot FROM supp s, cust c)",
    "ang AS (SELECT event_type, 2 * pi() * (floor(epoch(ts))::BIGINT % 86400)::DOUBLE / 86400 AS x, 2 * pi() * ((floor(epoch(ts))::BIGINT + user_id * 7) % 86400)::DOUBLE / 86400 AS y FROM events)",
    "img AS (SELECT l_orderkey::BIGINT AS config_id, l_quantity::DOUBLE AS x, l_tax::DOUBLE * 100 AS y, l_extendedprice::DOUBLE / 10000 AS mag FROM lineitem)",
    "ln AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS c, l_quantity::DOUBLE AS x0, l_extendedprice::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3 FROM lineitem)",
]) + " "


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sky(df: DataFrame, key: str, height: str, low: float, span: float) -> DataFrame:
    ra = F.lit(2 * math.pi) * (((F.col(key) * 1103515245 + 12345) % 2147483648).cast("double") / 2147483648)
    dec = F.asin(2 * ((F.col(height).cast("double") + F.lit(float(-low))) / F.lit(float(span))) - 1)
    return cat.catalog(df, F.col(key), ra, dec, [((F.col(key) * 69069 + 1) % 1000).cast("double") / 100])


def cust(s, d):
    return sky(table(s, d, "customer"), "c_custkey", "c_acctbal", -1000, 11000)


def supp(s, d):
    return sky(table(s, d, "supplier"), "s_suppkey", "s_acctbal", -1000, 11000)


def ords(s, d):
    return sky(table(s, d, "orders"), "o_orderkey", "o_totalprice", 1000, 499000)


def r6(c, n: int = 6):
    return F.round(c, n) + 0.0


def q6(c: str, n: int = 6) -> str:
    return f"(round({c}, {n}) + 0.0)"


DIST = "acos(greatest(-1, least(1, dot)))"
NEAR = f"dot >= {math.cos(RADIUS)!r}::DOUBLE"


# Joins by distance


@query(f"SELECT id0, id1, {q6(DIST)} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY dot DESC, id0) AS k FROM pr WHERE {NEAR}) WHERE k = 1")
def cone_best(s, d):
    return J.best_match(supp(s, d), cust(s, d), RADIUS).select("id0", "id1", r6("dist").alias("dist"))


@query(f"SELECT id0, id1, {q6(DIST)} AS dist FROM pr WHERE {NEAR}")
def cone_all(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS).select("id0", "id1", r6("dist").alias("dist"))


@query(f"SELECT id0, id1 FROM pr WHERE dot >= {math.cos(10 * DEG)!r}::DOUBLE AND abs(m0 - m1) <= 2")
def cone_dmag(s, d):
    return J.cone_join(supp(s, d), cust(s, d), 10 * DEG, [2.0]).select("id0", "id1")


@query(f"SELECT id1, count(*) FILTER ({NEAR}) AS n FROM pr GROUP BY id1")
def cone_count(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS, how="count")


@query(f"SELECT id1 AS obj_id FROM pr GROUP BY id1 HAVING count(*) FILTER ({NEAR}) = 0")
def cone_anti(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS, how="anti").select("obj_id")


@query(f"SELECT DISTINCT id1 AS obj_id FROM pr WHERE {NEAR}")
def cone_semi(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS, how="semi").select("obj_id")


@query(f"SELECT c.obj_id AS id1, p.id0 FROM cust c LEFT JOIN (SELECT * FROM pr WHERE {NEAR}) p ON p.id1 = c.obj_id")
def cone_left(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS, how="left").select("id1", "id0")


@query(f"SELECT id0, id1 FROM pr WHERE {NEAR}")
def cone_exact_salted(s, d):
    return J.cone_join(supp(s, d), cust(s, d), RADIUS, exact=True, salts=4).select("id0", "id1")


_P = (math.cos(1.0) * math.cos(0.5), math.sin(1.0) * math.cos(0.5), math.sin(0.5))


@query(f"SELECT obj_id FROM ords WHERE ux * {_P[0]!r}::DOUBLE + uy * {_P[1]!r}::DOUBLE + uz * {_P[2]!r}::DOUBLE >= {math.cos(0.3)!r}::DOUBLE")
def cone_probe(s, d):
    return J.probe(ords(s, d), 1.0, 0.5, 0.3).select("obj_id")


@query(f"SELECT a.obj_id, {q6(f'count(*) / {S.cap_area(RADIUS)!r}::DOUBLE')} AS density FROM cust a JOIN cust b ON a.ux * b.ux + a.uy * b.uy + a.uz * b.uz >= {math.cos(RADIUS)!r}::DOUBLE GROUP BY a.obj_id")
def cap_density(s, d):
    return K.root_density(cust(s, d), RADIUS).select("obj_id", r6("density").alias("density"))


# Clusters


@query("SELECT a, b FROM nb")
def neighbour_pairs(s, d):
    return K.neighbour_pairs(cust(s, d), SEP)


@query("SELECT members FROM (WITH RECURSIVE f AS (SELECT a, list(b ORDER BY b) AS next FROM nb GROUP BY a), s AS (SELECT [a] AS m, next AS c FROM f UNION ALL SELECT list_append(s.m, s.c[1]), list_filter(s.c[2:], lambda x: list_contains(coalesce(f.next, []), x)) FROM s LEFT JOIN f ON f.a = s.c[1] WHERE len(s.c) > 0) SELECT array_to_string(m, ',') AS members FROM s WHERE len(c) = 0 AND len(m) >= 3)")
def greedy_clusters(s, d):
    return K.greedy_clusters(cust(s, d), SEP).select(F.expr("array_join(transform(members, x -> CAST(x AS STRING)), ',')").alias("members"))


_TRIPLES = "t3 AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM nb x JOIN nb y ON y.a = x.b JOIN nb z ON z.a = x.a AND z.b = y.b), t4 AS (SELECT t.*, n.b AS d FROM t3 t JOIN nb n ON n.a = t.c JOIN nb m ON m.a = t.a AND m.b = n.b JOIN nb k ON k.a = t.b AND k.b = n.b)"
_MEMBERS = "array_join(transform(members, x -> CAST(x AS STRING)), ',')"


@query("t AS (SELECT 1), " + _TRIPLES + " SELECT concat_ws(',', a, b, c) AS members FROM t3")
def cluster_triples(s, d):
    return K.clusters(cust(s, d), SEP, nmax=3).select(F.expr(_MEMBERS).alias("members"))


@query("t AS (SELECT 1), " + _TRIPLES + ", dens AS (SELECT a.obj_id, count(*) AS n FROM cust a JOIN cust b ON a.ux * b.ux + a.uy * b.uy + a.uz * b.uz >= " + repr(math.cos(RADIUS)) + "::DOUBLE GROUP BY a.obj_id), deg AS (SELECT a, count(*) + 1 AS n FROM (SELECT a FROM nb UNION ALL SELECT b FROM nb) GROUP BY a), al AS (SELECT a, 3 AS nimg, concat_ws(',', a, b, c) AS members FROM t3 UNION ALL SELECT a, 4, concat_ws(',', a, b, c, d) FROM t4) SELECT members, nimg::INTEGER AS nimg, " + q6(f"dens.n / {S.cap_area(RADIUS)!r}::DOUBLE") + " AS density FROM al JOIN dens ON obj_id = al.a JOIN deg ON deg.a = al.a WHERE deg.n <= 5 AND dens.n / " + repr(S.cap_area(RADIUS)) + "::DOUBLE < 400")
def cluster_max_parent(s, d):
    return K.clusters(cust(s, d), SEP, nmax=4, max_parent_size=5, rdensity=RADIUS, dmax=400.0).select(F.expr(_MEMBERS).alias("members"), "nimg", r6("density").alias("density"))


def _fmt(v: str, big: float, mid: float, low: float) -> tuple[str, str, str]:
    a = f"floor({v} / {big!r}::DOUBLE)"
    rest = f"greatest(0, {v} - {a} * {big!r}::DOUBLE)"
    b = f"floor({rest} / {mid!r}::DOUBLE)"
    last = f"greatest(0, {rest} - {b} * {mid!r}::DOUBLE) / {low!r}::DOUBLE"
    return f"lpad({a}::BIGINT::VARCHAR, 2, '0')", f"lpad({b}::BIGINT::VARCHAR, 2, '0')", f"printf('%06.3f', {last})"


_RA = "concat_ws(':', " + ", ".join(_fmt("ra", A.HOUR, A.MINUTE, A.SECOND)) + ")"
_DEC = "CASE WHEN dec < 0 THEN '-' ELSE '+' END || concat_ws(':', " + ", ".join(_fmt("abs(dec)", A.DEGREE, A.ARCMIN, A.ARCSEC)) + ")"


_TRIPLE_SKY = "tm AS (SELECT concat_ws(',', a, b, c) AS members, unnest([a, b, c]) AS obj_id, unnest([1, 2, 3])::BIGINT AS cluster_seq FROM t3), tz AS (SELECT members, sum(ux) AS x, sum(uy) AS y, sum(uz) AS z FROM tm JOIN cust USING (obj_id) GROUP BY members), tp AS (SELECT members, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS ra, asin(z / sqrt(x * x + y * y + z * z)) AS dec FROM tz)"


@query("t AS (SELECT 1), " + _TRIPLES + f", {_TRIPLE_SKY} SELECT members, obj_id, cluster_seq, regexp_replace({_RA} || {_DEC}, '[:.]', '', 'g') AS candidate_id FROM tm JOIN tp USING (members)")
def cluster_members(s, d):
    c = cust(s, d)
    return K.cluster_members(K.clusters(c, SEP, nmax=3), c).select(F.expr(_MEMBERS).alias("members"), "obj_id", "cluster_seq", "candidate_id")


@query(f"SELECT obj_id, {_RA} AS ra_text, {_DEC} AS dec_text FROM cust")
def sexagesimal_format(s, d):
    return cust(s, d).select("obj_id", A.format_ra(F.col("ra")).alias("ra_text"), A.format_dec(F.col("dec")).alias("dec_text"))


@query(f"SELECT obj_id, regexp_replace({_RA} || {_DEC}, '[:.]', '', 'g') AS id FROM cust")
def cluster_identifier(s, d):
    return cust(s, d).select("obj_id", A.identifier(F.col("ra"), F.col("dec")).alias("id"))


_UNITS = list(A.UNITS)


@query("SELECT p_partkey, " + q6("(p_partkey % 1000)::DOUBLE / 8 * (CASE (p_partkey % 13)::INT " + " ".join(f"WHEN {k} THEN {A.UNITS[u]!r}::DOUBLE" for k, u in enumerate(_UNITS)) + " END)", 12) + " AS angle FROM part")
def angle_parse(s, d):
    unit = F.element_at(F.array(*[F.lit(u.upper() if k % 2 else u) for k, u in enumerate(_UNITS)]), (F.col("p_partkey") % 13 + 1).cast("int"))
    text = F.concat(((F.col("p_partkey") % 1000).cast("double") / 8).cast("string"), unit)
    return table(s, d, "part").select("p_partkey", r6(A.parse_angle(text), 12).alias("angle"))


_RA_VALUE = f"(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) * ((p_partkey % 20) * {A.HOUR!r}::DOUBLE + (p_partkey % 60) * {A.MINUTE!r}::DOUBLE + (p_partkey % 60) * {A.SECOND!r}::DOUBLE) + (CASE WHEN p_partkey % 2 = 0 OR (p_partkey % 60 = 0) THEN 0 ELSE 2 * pi() END)"
_DEC_VALUE = f"CASE WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) * ((p_partkey % 130) * {A.DEGREE!r}::DOUBLE + (p_partkey % 59) * {A.ARCMIN!r}::DOUBLE + (p_partkey % 59) * {A.ARCSEC!r}::DOUBLE) WHEN p_partkey % 3 = 1 THEN (p_partkey % 401 - 200) * {A.DEGREE!r}::DOUBLE ELSE (p_partkey % 7 - 3) / 2.0::DOUBLE END"
_FOLDED = "CASE WHEN abs(d) <= pi() / 2 THEN d WHEN d + pi() / 2 - floor((d + pi() / 2) / (2 * pi())) * 2 * pi() <= pi() THEN d - floor((d + pi() / 2) / (2 * pi())) * 2 * pi() ELSE pi() - d + floor((d + pi() / 2) / (2 * pi())) * 2 * pi() END"


@query(f"SELECT p_partkey, {q6('r', 9)} AS ra, {q6(_FOLDED, 9)} AS dec FROM (SELECT p_partkey, {_RA_VALUE} AS r, {_DEC_VALUE} AS d FROM part)")
def position_parse(s, d):
    p = F.col("p_partkey")
    sign = F.when(p % 2 == 0, F.lit("")).otherwise(F.lit("-"))
    ra = F.concat(sign, F.concat_ws(":", (p % 20).cast("string"), (p % 60).cast("string"), (p % 60).cast("string")))
    sexagesimal = F.concat(sign, F.concat_ws(":", (p % 130).cast("string"), (p % 59).cast("string"), (p % 59).cast("string")))
    dec = F.when(p % 3 == 0, sexagesimal).when(p % 3 == 1, F.concat((p % 401 - 200).cast("string"), F.lit("d"))).otherwise(((p % 7 - 3) / F.lit(2.0)).cast("string"))
    return table(s, d, "part").select("p_partkey", r6(A.parse_ra(ra), 9).alias("ra"), r6(A.parse_dec(dec), 9).alias("dec"))


@query("SELECT obj_id, " + ", ".join(f"{q6(c, 9)} AS {c}" for c in ("ux", "uy", "uz")) + " FROM cust")
def to_cart(s, d):
    return cust(s, d).select("obj_id", *[r6(c, 9).alias(c) for c in ("ux", "uy", "uz")])


@query(f"SELECT obj_id, {q6('ra', 8)} AS ra, {q6('dec', 8)} AS dec FROM cust")
def to_sph_roundtrip(s, d):
    return cust(s, d).select("obj_id", r6(S.ra_of(F.col("ux"), F.col("uy")), 8).alias("ra"), r6(S.dec_of(F.col("uz")), 8).alias("dec"))


def _rot_sql(m) -> str:
    x, y, z = (" + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(row, ("ux", "uy", "uz"))) for row in m)
    return f"SELECT obj_id, {q6(f'CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2 * pi() ELSE atan2({y}, {x}) END')} AS lon, {q6(f'asin(greatest(-1, least(1, {z})))')} AS lat FROM ords"


def _rot(s, d, m):
    lon, lat = S.rotate_position(F.col("ra"), F.col("dec"), m)
    return ords(s, d).select("obj_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(_rot_sql(S.ICRS_TO_GALACTIC))
def icrs2gal(s, d):
    return _rot(s, d, S.ICRS_TO_GALACTIC)


@query(_rot_sql(S.GALACTIC_TO_ICRS))
def gal2icrs(s, d):
    return _rot(s, d, S.GALACTIC_TO_ICRS)


# Mesh


def _walk_sql(source: str) -> str:
    """A point's trixels level by level, with corners p, q, r and midpoints d, e, f."""
    roots = ", ".join("(" + ", ".join([str(8 + k)] + [f"{float(x)}::DOUBLE" for i in r for x in T.VERTICES[i]]) + ")" for k, r in enumerate(T.ROOTS))
    names = ", ".join(f"{o}{c}" for o in "pqr" for c in "xyz")
    length = lambda a, b: "sqrt(" + " + ".join(f"({a}{c} + {b}{c})**2" for c in "xyz") + ")"
    mids = ", ".join(f"({a}{c} + {b}{c}) / {length(a, b)} AS {o}{c}" for o, a, b in ("dqr", "epr", "fpq") for c in "xyz")
    side = lambda a, b: f"ux * ({a}y * {b}z - {a}z * {b}y) + uy * ({a}z * {b}x - {a}x * {b}z) + uz * ({a}x * {b}y - {a}y * {b}x) >= -1e-15"
    tri = lambda a, b, c: f"{side(a, b)} AND {side(b, c)} AND {side(c, a)}"
    new = ", ".join(f"CASE k WHEN 0 THEN {t[0]}{c} WHEN 1 THEN {t[1]}{c} WHEN 2 THEN {t[2]}{c} ELSE {t[3]}{c} END AS {o}{c}" for o, t in (("p", "pqrd"), ("q", "fdee"), ("r", "efdf")) for c in "xyz")
    octant = "CASE WHEN uz > 0 THEN CASE WHEN ux > 0 THEN CASE WHEN uy > 0 THEN 15 ELSE 12 END ELSE CASE WHEN uy > 0 THEN 14 ELSE 13 END END ELSE CASE WHEN ux > 0 THEN CASE WHEN uy > 0 THEN 8 ELSE 11 END ELSE CASE WHEN uy > 0 THEN 9 ELSE 10 END END END"
    return f"""roots(id, {names}) AS (VALUES {roots}), walk AS (SELECT 0 AS level, obj_id, ux, uy, uz, r.id::BIGINT AS id, {names} FROM {source} JOIN roots r ON r.id = {octant}
        UNION ALL SELECT level + 1, obj_id, ux, uy, uz, id * 4 + k, {new} FROM (SELECT *, CASE WHEN {tri("p", "f", "e")} THEN 0 WHEN {tri("q", "d", "f")} THEN 1 WHEN {tri("r", "e", "d")} THEN 2 ELSE 3 END AS k
        FROM (SELECT *, {mids} FROM walk WHERE level < {LEVEL}))), tri AS (SELECT * FROM walk WHERE level = {LEVEL})"""


_WALK = _walk_sql("ords")
_NAME = "CASE WHEN id >> {0} >= 12 THEN 'N' ELSE 'S' END || ((id >> {0}) & 3)::VARCHAR || array_to_string(list_transform(range({1} - 1, -1, -1), lambda k: ((id >> (2 * k)::INT) & 3)::VARCHAR), '')".format(2 * LEVEL, LEVEL)


def _ids(s, d):
    return T.with_trixel(ords(s, d), F.col("ux"), F.col("uy"), F.col("uz"), LEVEL)


@query(_WALK + " SELECT obj_id, id AS htm_id FROM tri")
def htm_id(s, d):
    return _ids(s, d).select("obj_id", "htm_id")


@query(_WALK + f" SELECT DISTINCT id AS htm_id, {_NAME} AS name, id AS back FROM tri")
def htm_name(s, d):
    n = _ids(s, d).select("htm_id").distinct().withColumn("name", T.name_of(F.col("htm_id")))
    return n.withColumn("back", T.id_of(F.col("name")))


@query("SELECT o_orderkey, ((o_orderkey % 12))::INTEGER AS level FROM orders")
def htm_level(s, d):
    made = F.call_function("shiftleft", (F.col("o_orderkey") % 8 + 8).cast("long"), (2 * (F.col("o_orderkey") % 12)).cast("int"))
    return table(s, d, "orders").select("o_orderkey", T.level_of(made).alias("level"))


@query(_WALK + " SELECT DISTINCT id AS htm_id, " + ", ".join(f"{q6(o + c, 9)} AS {o}{c}" for o in "pqr" for c in "xyz") + " FROM tri")
def htm_vertices(s, d):
    v = _ids(s, d).select("htm_id").distinct().withColumn("t", T.vertices_of(F.col("htm_id")))
    return v.select("htm_id", *[r6(f"t.{k}.{c}", 9).alias(f"{o}{c}") for o, k in zip("pqr", "abc") for c in "xyz"])


def _area_sql() -> str:
    """The spherical excess by the solid angle's tangent."""
    dot = lambda a, b: "(" + " + ".join(f"{a}{c} * {b}{c}" for c in "xyz") + ")"
    volume = "abs(px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx))"
    return f"2 * atan2({volume}, 1 + {dot('p', 'q')} + {dot('p', 'r')} + {dot('q', 'r')})"


_CENTRE = "atan2(py + qy + ry, px + qx + rx)"
_HEIGHT = "(pz + qz + rz) / sqrt((px + qx + rx)**2 + (py + qy + ry)**2 + (pz + qz + rz)**2)"


@query(_WALK + f" SELECT id AS htm_id, {_NAME} AS htm_name, n, {q6(f'CASE WHEN {_CENTRE} < 0 THEN {_CENTRE} + 2 * pi() ELSE {_CENTRE} END', 9)} AS ra, {q6(f'asin({_HEIGHT})', 9)} AS dec, {q6(_area_sql(), 12)} AS area, {q6(f'n / ({_area_sql()})', 3)} AS density FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id) AS k FROM tri) WHERE k = 1")
def htm_density(s, d):
    return G.trixel_density(ords(s, d), LEVEL).select("htm_id", "htm_name", "n", r6("ra", 9).alias("ra"), r6("dec", 9).alias("dec"), r6("area", 12).alias("area"), r6("density", 3).alias("density"))


_SETS = "sa AS (SELECT DISTINCT (2048 + o_orderkey % 400)::BIGINT AS h FROM orders), sb AS (SELECT DISTINCT (512 + o_custkey % 300)::BIGINT AS h FROM orders) "


def _sets(s, d):
    o = table(s, d, "orders")
    return o.select((F.lit(2048) + F.col("o_orderkey") % 400).cast("long").alias("htm_id")).distinct(), o.select((F.lit(512) + F.col("o_custkey") % 300).cast("long").alias("htm_id")).distinct()


@query(_SETS + "SELECT sa.h AS htm_id FROM sa WHERE (sa.h >> 2) IN (SELECT h FROM sb)")
def htm_and(s, d):
    return T.intersect_sets(*_sets(s, d))


@query(_SETS + "SELECT h AS htm_id FROM sb UNION SELECT h FROM sa WHERE (h >> 2) NOT IN (SELECT h FROM sb)")
def htm_or(s, d):
    return T.unite_sets(*_sets(s, d))


@query("SELECT o_orderkey, CASE WHEN (2048 + o_orderkey % 400) >> 2 < 512 + o_custkey % 300 THEN -1 WHEN (2048 + o_orderkey % 400) >> 2 > 512 + o_custkey % 300 THEN 1 ELSE 0 END::INTEGER AS c FROM orders")
def htm_compare(s, d):
    return table(s, d, "orders").select("o_orderkey", T.compare((F.lit(2048) + F.col("o_orderkey") % 400).cast("long"), (F.lit(512) + F.col("o_custkey") % 300).cast("long")).alias("c"))


COVER_LEVEL = 6


def _cover_sql() -> str:
    """Trixels that meet a cone, level by level; kind 1 descends, 2 belongs to the cover."""
    roots = ", ".join("(" + ", ".join([str(8 + k)] + [f"{float(x)}::DOUBLE" for i in r for x in T.VERTICES[i]]) + ")" for k, r in enumerate(T.ROOTS))
    names = ", ".join(f"{o}{c}" for o in "pqr" for c in "xyz")
    length = lambda a, b: "sqrt(" + " + ".join(f"({a}{c} + {b}{c})**2" for c in "xyz") + ")"
    mids = ", ".join(f"({a}{c} + {b}{c}) / {length(a, b)} AS {o}{c}" for o, a, b in ("dqr", "epr", "fpq") for c in "xyz")
    new = ", ".join(f"CASE k WHEN 0 THEN {t[0]}{c} WHEN 1 THEN {t[1]}{c} WHEN 2 THEN {t[2]}{c} ELSE {t[3]}{c} END AS {o}{c}" for o, t in (("p", "pqrd"), ("q", "fdee"), ("r", "efdf")) for c in "xyz")
    sums = ", ".join(f"p{c} + q{c} + r{c} AS s{c}" for c in "xyz")
    arc = lambda a, b: f"acos(greatest(-1, least(1, ({' + '.join(f'{a}{c} * {b}{c}' for c in 'xyz')}) / sqrt(sx * sx + sy * sy + sz * sz))))"
    radius = f"{math.acos(math.cos(SEP))!r}::DOUBLE"
    kind = f"CASE WHEN apart > reach + {radius} + 1e-12 THEN 0 WHEN apart + reach <= {radius} - 1e-12 OR level = {COVER_LEVEL} THEN 2 ELSE 1 END AS kind"
    judged = lambda rows: f"SELECT level, obj_id, ux, uy, uz, id, {names}, {kind} FROM (SELECT *, greatest({arc('p', 's')}, {arc('q', 's')}, {arc('r', 's')}) AS reach, {arc('u', 's')} AS apart FROM (SELECT *, {sums} FROM ({rows})))"
    return f"""cr(id, {names}) AS (VALUES {roots}), cv AS ({judged(f"SELECT 0 AS level, obj_id, ux, uy, uz, cr.id::BIGINT AS id, {names} FROM supp, cr")}
        UNION ALL {judged(f"SELECT level + 1 AS level, obj_id, ux, uy, uz, id * 4 + k AS id, {new} FROM (SELECT *, {mids} FROM cv WHERE kind = 1), range(4) n(k)")})"""


@query(_cover_sql() + " SELECT obj_id, id AS htm_id FROM cv WHERE kind = 2")
def cone_cover(s, d):
    return supp(s, d).select("obj_id", F.explode(T.cover_column(F.col("ux"), F.col("uy"), F.col("uz"), math.cos(SEP), COVER_LEVEL)).alias("htm_id"))


# Statistics


@query("SELECT l_returnflag, " + ", ".join(f"{q6(e, 4)} AS {n}" for n, e in (("mean", "avg(l_quantity::DOUBLE)"), ("var", "var_pop(l_quantity::DOUBLE)"), ("std", "stddev_pop(l_quantity::DOUBLE)"), ("cov", "covar_pop(l_quantity::DOUBLE, l_discount::DOUBLE)"), ("corr", "corr(l_quantity::DOUBLE, l_discount::DOUBLE)"), ("abserr", "avg(abs(l_quantity::DOUBLE - l_discount::DOUBLE))"))) + " FROM lineitem GROUP BY l_returnflag")
def pop_stats(s, d):
    m = C.moments(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(*[r6(v, 4).alias(k) for k, v in m.items()])


@query("SELECT i, j, round(v, 4) + 0.0 AS cov FROM (SELECT 'x0' AS i, 'x0' AS j, covar_pop(x0, x0) AS v FROM ln UNION ALL SELECT 'x0', 'x2', covar_pop(x0, x2) FROM ln UNION ALL SELECT 'x2', 'x2', covar_pop(x2, x2) FROM ln)")
def cov_matrix(s, d):
    return C.cov_matrix(_lines(s, d), ["x0", "x2"]).select("i", "j", r6("cov", 4).alias("cov"))


def _angles(s, d):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(s, d, "events")
    turn = lambda v: F.lit(2 * math.pi) * (v % 86400).cast("double") / 86400
    return e.select("event_type", turn(t).alias("x"), turn(t + F.col("user_id") * 7).alias("y"))


_N = "SELECT event_type, count(*) AS n, sqrt(sum(sin(x))**2 + sum(cos(x))**2) / count(*) AS r FROM ang GROUP BY event_type"


@query(f"SELECT event_type, {q6('atan2(sum(sin(x)), sum(cos(x)))')} AS m FROM ang GROUP BY event_type")
def circ_mean(s, d):
    return _angles(s, d).groupBy("event_type").agg(r6(C.circ_mean(F.col("x"))).alias("m"))


@query(f"SELECT event_type, {q6('r')} AS r, {q6('1 - r')} AS v FROM ({_N})")
def circ_r_var(s, d):
    return _angles(s, d).groupBy("event_type").agg(r6(C.circ_r(F.col("x"))).alias("r"), r6(C.circ_var(F.col("x"))).alias("v"))


@query(f"SELECT event_type, {q6('sum(sin(x - mx) * sin(y - my)) / sqrt(sum(sin(x - mx)**2) * sum(sin(y - my)**2))')} AS corr FROM (SELECT *, atan2(sum(sin(x)) OVER w, sum(cos(x)) OVER w) AS mx, atan2(sum(sin(y)) OVER w, sum(cos(y)) OVER w) AS my FROM ang WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type")
def circ_corr(s, d):
    return C.circ_corr(_angles(s, d), "x", "y", "event_type").select("event_type", r6("corr").alias("corr"))


@query(f"SELECT event_type, {q6('avg(abs(atan2(sin(x - y), cos(x - y))))')} AS e FROM ang GROUP BY event_type")
def circ_abserr(s, d):
    return _angles(s, d).groupBy("event_type").agg(r6(C.circ_abserr(F.col("x"), F.col("y"))).alias("e"))


def _rn(s, d):
    # Angles squeezed towards their type's hour, so that resultant lengths cover the branches.
    a = _angles(s, d).withColumn("z", F.col("x") * F.when(F.col("event_type") < "m", 0.1).otherwise(0.5))
    return a.groupBy("event_type").agg(C.circ_r(F.col("z")).alias("r"), F.count("*").alias("n"))


_Z = "rn AS (SELECT event_type, count(*)::DOUBLE AS n, sqrt(sum(sin(z))**2 + sum(cos(z))**2) / count(*) AS r FROM (SELECT *, x * CASE WHEN event_type < 'm' THEN 0.1 ELSE 0.5 END AS z FROM ang) GROUP BY event_type) "


@query(_Z + f"SELECT event_type, {q6('coalesce(acos(least(1, (CASE WHEN r >= 0.9 THEN sqrt(n * n - (n * n - r * n * r * n) * exp(4 / n)) WHEN r > sqrt(4 / 2 / n) THEN sqrt((2 * n * (2 * r * n * r * n - n * 4)) / (4 * n - 4)) END) / (r * n))), -1)')} AS c FROM rn")
def circ_conf(s, d):
    return _rn(s, d).select("event_type", r6(C.circ_confidence(F.col("r"), F.col("n"), 2.0)).alias("c"))


_KAPPA = "CASE WHEN r < 0.53 THEN 2 * r + r**3 + 5 * r**5 / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / nullif(r**3 - 4 * r**2 + 3 * r, 0) END"


@query(_Z + f"SELECT event_type, {q6(_KAPPA)} AS kappa FROM rn")
def circ_kappa(s, d):
    return _rn(s, d).select("event_type", r6(C.circ_kappa(F.col("r"), F.col("n"))).alias("kappa"))


_FEW = "fw AS (SELECT event_type, part, n, r, " + _KAPPA + " AS k FROM (SELECT event_type, floor(x * 400)::BIGINT % 200 AS part, count(*)::DOUBLE AS n, round(sqrt(sum(sin(y))**2 + sum(cos(y))**2) / count(*), 9) AS r FROM ang GROUP BY ALL) WHERE n >= 2) "
_SMALL = "CASE WHEN n > 15 THEN k WHEN k < 2 THEN greatest(0, k - 2 / (k * n)) ELSE k * (1 - n)**3 / (1 + n * n) / n END"


@query(_FEW + f"SELECT event_type, part, n::BIGINT AS n, {q6(f'({_SMALL}) / (1 + abs({_SMALL}))')} AS kappa FROM fw")
def circ_kappa_few(s, d):
    """Groups of few angles, with the small-sample correction. r is rounded, so that equal angles have no kappa on either side; k / (1 + |k|) keeps the large ones comparable."""
    part = (F.floor(F.col("x") * 400) % 200).alias("part")
    g = _angles(s, d).groupBy("event_type", part).agg(F.round(C.circ_r(F.col("y")), 9).alias("r"), F.count("*").alias("n")).filter("n >= 2")
    k = C.circ_kappa(F.col("r"), F.col("n"))
    return g.select("event_type", "part", "n", r6(k / (1 + F.abs(k))).alias("kappa"))


@query("SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def class_counts(s, d):
    return C.class_counts(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


_IMP = "SELECT l_linestatus, sum(n)::BIGINT AS total, arg_max(l_returnflag, (n, l_returnflag)) AS mode, {0} AS share, {1} AS entropy, {2} AS gini FROM (SELECT *, sum(n) OVER (PARTITION BY l_linestatus) AS t FROM (SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)) GROUP BY l_linestatus".format(q6("max(n) / sum(n)"), q6("-sum(n / t * ln(n / t))"), q6("sum(n / t * (1 - n / t))"))


@query(_IMP)
def class_impurity(s, d):
    t = C.impurity(C.class_counts(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")
    return t.select("l_linestatus", "total", "mode", *[r6(c).alias(c) for c in ("share", "entropy", "gini")])


# Trees


def _lines(s, d):
    x = [F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    t = table(s, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("c"), *[v.alias(f"x{k}") for k, v in enumerate(x)])
    return t.withColumn("x", F.array("x0", "x1", "x2", "x3"))


def _sides(s, d, y):
    return _lines(s, d).select(F.lit(1).alias("k"), (F.col("x0") < 25).alias("left"), y.alias("y"))


@query(f"SELECT {q6('-sum(n * v) / sum(n)')} AS score FROM (SELECT count(*) AS n, var_pop(x1 / 1000) AS v FROM ln GROUP BY x0 < 25)")
def split_quality_reg(s, d):
    return R.side_score(_sides(s, d, F.col("x1") / 1000), "R", ["k"], "left").select(r6("score").alias("score"))


@query(f"SELECT {q6('-sum(n - r) / sum(n)')} AS score FROM (SELECT count(*) AS n, sqrt(sum(sin(x1 / 1000))**2 + sum(cos(x1 / 1000))**2) AS r FROM ln GROUP BY x0 < 25)")
def split_quality_circ(s, d):
    return R.side_score(_sides(s, d, F.col("x1") / 1000), "P", ["k"], "left").select(r6("score").alias("score"))


_CLASS = "(SELECT *, sum(n) OVER (PARTITION BY l) AS t FROM (SELECT x0 < 25 AS l, c, count(*)::DOUBLE AS n FROM ln GROUP BY ALL))"


@query(f"SELECT {q6('sum(n * ln(n / t)) / sum(n)')} AS entropy, {q6('-sum(n * (1 - n / t)) / sum(n)')} AS gini FROM {_CLASS}")
def split_quality_class(s, d):
    y = _sides(s, d, F.col("c"))
    a = R.side_score(y, "C", ["k"], "left").select("k", r6("score").alias("entropy"))
    return a.join(R.side_score(y, "C", ["k"], "left", "gini").select("k", r6("score").alias("gini")), "k").drop("k")


@query("cand AS (SELECT a.attr, a.v, lead(a.v) OVER (PARTITION BY a.attr ORDER BY a.v) AS nxt FROM (SELECT DISTINCT 0 AS attr, x0 AS v FROM ln UNION SELECT DISTINCT 2, x2 FROM ln UNION SELECT DISTINCT 3, x3 FROM ln) a), sc AS (SELECT k.attr, (k.v + k.nxt) / 2 AS cut, (SELECT -sum(n * vp) / sum(n) FROM (SELECT count(*) AS n, var_pop(x1 / 1000) AS vp FROM ln GROUP BY (CASE k.attr WHEN 0 THEN x0 WHEN 2 THEN x2 ELSE x3 END) <= k.v)) AS score FROM cand k WHERE nxt IS NOT NULL) SELECT (CASE attr WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END)::INTEGER AS attr, " + q6("cut") + " AS cut FROM sc ORDER BY round(score, 9) DESC, attr, cut LIMIT 1")
def cart_best_split(s, d):
    rows = _lines(s, d).select((F.col("x1") / 1000).alias("y"), F.array("x0", "x2", "x3").alias("x"))
    return R.best_split(rows, 3).select("attr", r6("cut").alias("cut"))


def _best_cut_sql(sides: str) -> str:
    """Every cut of x0, x2 and x3, scored by `sides`: the parts' scores of rows ln grouped by side l."""
    return ("cand AS (SELECT a.attr, a.v, lead(a.v) OVER (PARTITION BY a.attr ORDER BY a.v) AS nxt FROM (SELECT DISTINCT 0 AS attr, x0 AS v FROM ln UNION SELECT DISTINCT 1, x2 FROM ln UNION SELECT DISTINCT 2, x3 FROM ln) a), "
        f"sc AS (SELECT k.attr, (k.v + k.nxt) / 2 AS cut, ({sides}) AS score FROM cand k WHERE nxt IS NOT NULL) "
        f"SELECT attr::INTEGER AS attr, {q6('cut')} AS cut, {q6('score')} AS score FROM sc ORDER BY round(sc.score, 9) DESC, sc.attr, sc.cut LIMIT 1")


_SIDE = "(CASE k.attr WHEN 0 THEN x0 WHEN 1 THEN x2 ELSE x3 END) <= k.v"


@query(_best_cut_sql(f"SELECT -sum(n - r) / sum(n) FROM (SELECT count(*) AS n, sqrt(sum(sin(x1 / 1000))**2 + sum(cos(x1 / 1000))**2) AS r FROM ln GROUP BY {_SIDE})"))
def cart_best_split_circ(s, d):
    rows = _lines(s, d).select((F.col("x1") / 1000).alias("y"), F.array("x0", "x2", "x3").alias("x"))
    return R.best_split(rows, 3, "P").select("attr", r6("cut").alias("cut"), r6("score").alias("score"))


@query(_best_cut_sql(f"SELECT -sum(n * (1 - (a * a + b * b) / (n * n))) / sum(n) FROM (SELECT count(*)::DOUBLE AS n, sum(c)::DOUBLE AS a, sum(1 - c)::DOUBLE AS b FROM ln GROUP BY {_SIDE})"))
def cart_best_split_class(s, d):
    rows = _lines(s, d).select(F.col("c").alias("y"), F.array("x0", "x2", "x3").alias("x"))
    return R.best_split(rows, 3, "C", "gini").select("attr", r6("cut").alias("cut"), r6("score").alias("score"))


_VOTES = "v AS (SELECT o_orderkey AS row_id, t, ((o_orderkey * 31 + t * 17) % 97)::DOUBLE / 10 AS value, ((o_orderkey + t) % 7 + 1) AS n0, ((o_orderkey * t) % 5 + 1) AS n1 FROM orders, range(5) r(t)) "


def _votes(s, d):
    o, t = F.col("row_id"), F.col("t")
    v = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t"))
    return v.select("row_id", t.alias("tree"), (((o * 31 + t * 17) % 97).cast("double") / 10).alias("value"), F.create_map(F.lit(0), (o + t) % 7 + 1, F.lit(1), (o * t) % 5 + 1).alias("classes"))


@query(_VOTES + f"SELECT row_id, {q6('avg(value)')} AS value, {q6('stddev_pop(value)')} AS uncertainty FROM v GROUP BY row_id")
def ert_combine_reg(s, d):
    return R.combine(_votes(s, d), "R").select("row_id", r6("value").alias("value"), r6("uncertainty").alias("uncertainty"))


@query(_VOTES + f"SELECT row_id, {q6('any_value(m)')} AS value, {q6('sqrt(avg(atan2(sin(value - m), cos(value - m))**2))')} AS uncertainty FROM (SELECT *, atan2(sum(sin(value)) OVER w, sum(cos(value)) OVER w) AS m FROM v WINDOW w AS (PARTITION BY row_id)) GROUP BY row_id")
def ert_combine_periodic(s, d):
    return R.combine(_votes(s, d), "P").select("row_id", r6("value").alias("value"), r6("uncertainty").alias("uncertainty"))


@query(_VOTES + f"SELECT row_id, CASE WHEN round(p0, 12) >= round(1 - p0, 12) THEN 0.0 ELSE 1.0 END::DOUBLE AS value, {q6('1 - greatest(p0, 1 - p0)')} AS uncertainty FROM (SELECT row_id, avg(n0::DOUBLE / (n0 + n1)) AS p0 FROM v GROUP BY row_id)")
def ert_combine_class(s, d):
    c = R.combine(_votes(s, d), "C")
    return c.select("row_id", (F.col("value") + 0.0).alias("value"), r6("uncertainty").alias("uncertainty"))


@query()
def ert_fit_predict(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("y"), F.array((F.col("c_acctbal").cast("double") + F.col("c_custkey") % 7), (F.col("c_custkey") % 11).cast("double")).alias("x"))
    return R.predict(rows, R.fit(rows, 2, "R", seed=1), "R")


# Grids, least squares


def _points(s, d):
    return _lines(s, d).select(F.col("c").alias("class"), F.col("x0").alias("x"), F.col("x1").alias("y"))


_GRID = "h AS (SELECT min(x0) AS xmin, min(x1) AS ymin, sum(c)::DOUBLE AS n1, sum(1 - c)::DOUBLE AS n0 FROM ln), cl AS (SELECT floor((x0 - xmin) / 5)::BIGINT AS ix, floor((x1 - ymin) / 10000)::BIGINT AS iy, (sum(c) / any_value(n1)) / (sum(c) / any_value(n1) + sum(1 - c) / any_value(n0)) AS p FROM ln, h GROUP BY ALL) "


@query(_GRID + f"SELECT ix, iy, {q6('p')} AS p FROM cl")
def pgrid_build(s, d):
    return G.grid_build(_points(s, d), 5.0, 10000.0)[0].select("ix", "iy", r6("p").alias("p"))


@query(_GRID + f", q AS (SELECT o_orderkey, (o_orderkey % 70)::DOUBLE AS x, o_totalprice::DOUBLE / 3 AS y FROM orders) SELECT o_orderkey, {q6('coalesce(p, -1)')} AS p FROM q CROSS JOIN h LEFT JOIN cl ON ix = floor((x - xmin) / 5) AND iy = floor((y - ymin) / 10000)")
def pgrid_predict(s, d):
    q = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 70).cast("double").alias("x"), (F.col("o_totalprice").cast("double") / 3).alias("y"))
    return G.grid_predict(q, *G.grid_build(_points(s, d), 5.0, 10000.0)).select("o_orderkey", r6("p").alias("p"))


_SCORE = f"{WEIGHTS[0]!r}::DOUBLE + " + " + ".join(f"{w!r}::DOUBLE * x{k}" for k, w in enumerate(WEIGHTS[1:]))


def _rows(s, d):
    return _lines(s, d).select("l_orderkey", F.col("c").cast("double").alias("y"), "x", (1.0 + F.col("l_orderkey") % 3).alias("w"))


_FIT = f"z AS (SELECT *, 1 + l_orderkey % 3 AS w, 1 / (1 + exp(-({_SCORE}))) AS f FROM ln) "
_GRADS = ", ".join(f"sum(w * w * (f - c) * f * (1 - f) * {x}) AS g{k}" for k, x in enumerate(["1", "x0", "x1", "x2", "x3"]))


@query(_FIT + f", t AS (SELECT 0.5 * sum((w * (f - c))**2) AS cost, {_GRADS} FROM z) SELECT {q6('cost', 3)} AS cost, {q6('g0', 3)} AS g0, {q6('g1', 3)} AS g1, {q6('g2 / 1000000', 6)} AS g2_millions, {q6('g3', 3)} AS g3, {q6('g4', 3)} AS g4 FROM t")
def adam_cost_grad(s, d):
    return W.cost_gradient(_rows(s, d), list(WEIGHTS)).select(*[r6(c, 3).alias(c) for c in ("cost", "g0", "g1", "g3", "g4")], r6(F.col("g2") / 1_000_000).alias("g2_millions"))


@query(_FIT + f", t AS (SELECT {_GRADS} FROM z), g AS (SELECT unnest([g0, g1, g2, g3, g4]) AS g, unnest([0, 1, 2, 3, 4]) AS k FROM t) SELECT k::INTEGER AS k, {q6('CASE k ' + ' '.join(f'WHEN {k} THEN {w!r}::DOUBLE' for k, w in enumerate(WEIGHTS)) + ' END - 0.001 * g / (abs(g) + 1e-8)', 9)} AS w FROM g")
def adam_one_step(s, d):
    import numpy as np

    rows = _rows(s, d)
    w, _, _ = W.adam(lambda v, step: ((r := W.cost_gradient(rows, list(v)).first())["cost"], np.array(r[1:], float)), np.array(WEIGHTS), max_iterations=1)
    return s.createDataFrame([(k, round(float(x), 9) + 0.0) for k, x in enumerate(w)], "k int, w double")


@query(f"SELECT count(*) FILTER (p AND c = 1) AS tp, count(*) FILTER (p AND c = 0) AS fp, count(*) FILTER (c = 1) AS np, count(*) FILTER (c = 0) AS nn, {q6('count(*) FILTER (p = (c = 1)) / count(*)')} AS accuracy FROM (SELECT *, {_SCORE} > 0 AS p FROM ln)")
def split_confusion(s, d):
    return W.confusion(_rows(s, d), list(WEIGHTS)).select("tp", "fp", "np", "nn", r6("accuracy").alias("accuracy"))


@query("z AS (SELECT x0 AS score, sum(sum(c)) OVER (ORDER BY x0) AS p, sum(sum(1 - c)) OVER (ORDER BY x0) AS q, sum(sum(c)) OVER () AS np, sum(sum(1 - c)) OVER () AS nq FROM ln GROUP BY x0), g AS (SELECT score, round(q / nq - p / np, 12) AS gain FROM z) SELECT score AS cut, round(gain, 9) AS gain FROM g ORDER BY g.gain DESC, score LIMIT 1")
def best_threshold(s, d):
    return W.best_threshold(_lines(s, d).select(F.col("x0").alias("score"), F.col("c").alias("y"))).select("cut", F.round("gain", 9).alias("gain"))


_COUNTED = "z AS (SELECT x0 AS score, sum(sum(c)) OVER (ORDER BY x0)::DOUBLE AS p, sum(sum(1 - c)) OVER (ORDER BY x0)::DOUBLE AS q, sum(sum(c)) OVER ()::DOUBLE AS np, sum(sum(1 - c)) OVER ()::DOUBLE AS nq FROM ln GROUP BY x0)"
_PLOGP = lambda a, b: f"CASE WHEN {a} > 0 THEN ({a}) * ln(({a}) / (({a}) + ({b}))) ELSE 0 END"


@query(_COUNTED + f", g AS (SELECT score, ({_PLOGP('p', 'q')} + {_PLOGP('q', 'p')} + {_PLOGP('np - p', 'nq - q')} + {_PLOGP('nq - q', 'np - p')}) / (np + nq) AS gain FROM z) SELECT score AS cut, round(gain, 9) AS gain FROM g ORDER BY round(g.gain, 12) DESC, score LIMIT 1")
def best_threshold_information(s, d):
    return W.best_threshold(_lines(s, d).select(F.col("x0").alias("score"), F.col("c").alias("y")), "information").select("cut", F.round("gain", 9).alias("gain"))


@query("m AS (SELECT (avg(x0) FILTER (c = 1) + avg(x0) FILTER (c = 0)) / 2 AS cut FROM ln) SELECT round(any_value(cut), 9) AS cut, round(avg((x0 > cut)::INT) FILTER (c = 1) - avg((x0 > cut)::INT) FILTER (c = 0), 9) AS gain FROM ln, m")
def best_threshold_mean(s, d):
    return W.best_threshold(_lines(s, d).select(F.col("x0").alias("score"), F.col("c").alias("y")), "mean").select(F.round("cut", 9).alias("cut"), F.round("gain", 9).alias("gain"))


@query("SELECT obj_id, ra, d1 AS dec, b FROM (SELECT c_custkey::BIGINT AS obj_id, (c_custkey * 7 % 360)::DOUBLE AS ra, (c_custkey * 13 % 181 - 90)::DOUBLE AS d1, (c_custkey * 29 % 181 - 90)::DOUBLE AS b, (c_custkey % 3)::DOUBLE AS pm FROM customer) WHERE ra BETWEEN 49 AND 201 AND d1 BETWEEN -41 AND 31 AND abs(b) >= 19 AND pm < 0.5")
def region_filter(s, d):
    k = F.col("c_custkey")
    t = table(s, d, "customer").select(k.cast("long").alias("obj_id"), (k * 7 % 360).cast("double").alias("ra"), (k * 13 % 181 - 90).cast("double").alias("dec"), (k * 29 % 181 - 90).cast("double").alias("b"), F.lit(0.0).alias("parallax"), (k % 3).cast("double").alias("pmra"), F.lit(0.0).alias("pmdec"))
    return cat.region(t, (50, 200), (-40, 30), 20, 1, still=0.5).select("obj_id", "ra", "dec", "b")


_ADAM = """dd AS (SELECT (x0 - 25) / 25 AS x, (x0 > 25)::INT AS y, count(*) * (any_value(n) / CASE WHEN x0 > 25 THEN any_value(p) ELSE any_value(n) - any_value(p) END)**2 AS w2 FROM ln, (SELECT count(*)::DOUBLE AS n, sum((x0 > 25)::INT)::DOUBLE AS p FROM ln) GROUP BY x0),
    it AS (SELECT 0 AS step, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS m0, 0::DOUBLE AS m1, 0::DOUBLE AS v0, 0::DOUBLE AS v1, NULL::DOUBLE AS cost, FALSE AS done
    UNION ALL SELECT CASE WHEN stop THEN step ELSE step + 1 END, CASE WHEN stop THEN w0 ELSE w0 - 0.05 * (n0 / (1 - 0.9::DOUBLE**(step + 1))) / (sqrt(u0 / (1 - 0.999::DOUBLE**(step + 1))) + 1e-8) END,
        CASE WHEN stop THEN w1 ELSE w1 - 0.05 * (n1 / (1 - 0.9::DOUBLE**(step + 1))) / (sqrt(u1 / (1 - 0.999::DOUBLE**(step + 1))) + 1e-8) END, n0, n1, u0, u1, now, stop
    FROM (SELECT *, coalesce(abs(now - cost) <= 1e-6, FALSE) OR step >= 300 AS stop, 0.9 * m0 + 0.1 * g0 AS n0, 0.9 * m1 + 0.1 * g1 AS n1, 0.999 * v0 + 0.001 * g0 * g0 AS u0, 0.999 * v1 + 0.001 * g1 * g1 AS u1
        FROM (SELECT step, w0, w1, m0, m1, v0, v1, cost, 0.5 * sum(w2 * (f - y)**2) AS now, sum(w2 * (f - y) * f * (1 - f)) AS g0, sum(w2 * (f - y) * f * (1 - f) * x) AS g1
            FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x))) AS f FROM it, dd WHERE NOT done) GROUP BY ALL)))"""


@query(_ADAM + f" SELECT {q6('w0', 4)} AS w0, {q6('w1', 4)} AS w1, {q6('cost', 2)} AS cost, step::INTEGER AS steps FROM it WHERE done")
def split_fit(s, d):
    rows = _lines(s, d).select(F.col("l_orderkey").alias("row_id"), (F.col("x0") > 25).cast("double").alias("y"), F.array((F.col("x0") - 25) / 25).alias("x"))
    w, cost, steps = W.split(rows, 1, balance=True, local=True, max_iterations=300, alpha=0.05)
    return s.createDataFrame([(round(float(w[0]), 4) + 0.0, round(float(w[1]), 4) + 0.0, round(cost, 2) + 0.0, steps)], "w0 double, w1 double, cost double, steps int")


# Lens sets


def _images(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("config_id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_tax").cast("double") * 100).alias("y"), (F.col("l_extendedprice").cast("double") / 10000).alias("mag"))


def _conf(source: str, key: str, *more: str) -> str:
    """The four brightest images of each configuration side by side."""
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY mag, x, y) AS k FROM {source}), c4 AS (SELECT {key}, " + ", ".join(f"max({c}) FILTER (k = {k}) AS {n}{k}" for k in (1, 2, 3, 4) for n, c in (("x", "x"), ("y", "y"), ("m", "mag"))) + f" FROM o GROUP BY {key} HAVING count(*) >= 4) "


_CONF = _conf("img", "config_id")
_WIDE = [f"{n}{k}" for k in (1, 2, 3, 4) for n in "xym"]


@query(_CONF + "SELECT config_id, 0::INTEGER AS class, 4::INTEGER AS nimg, " + ", ".join(f"{q6(c)} AS {c}" for c in _WIDE) + " FROM c4")
def lens_wide(s, d):
    t = D.dataset(_images(s, d), output="class,nimg," + ",".join(_WIDE))
    return t.select("config_id", "class", "nimg", *[r6(c).alias(c) for c in _WIDE])


@query(_conf("(SELECT config_id, mag, x * cos(arg_min(y, (mag, x, y)) OVER (PARTITION BY config_id)) AS x, y FROM img)", "config_id") + "SELECT config_id, " + ", ".join(f"{q6(c)} AS {c}" for c in _WIDE) + " FROM c4")
def lens_spherical(s, d):
    t = D.dataset(_images(s, d), output=",".join(_WIDE), sph=True)
    return t.select("config_id", *[r6(c).alias(c) for c in _WIDE])


_R2 = "((x4 - x1)**2 + (y4 - y1)**2)"
_TURNED = lambda x, y: (f"(({x} - x1) * (x4 - x1) + ({y} - y1) * (y4 - y1)) / nullif({_R2}, 0)", f"(({y} - y1) * (x4 - x1) - ({x} - x1) * (y4 - y1)) / nullif({_R2}, 0)")


def _normalised(digits: int) -> str:
    """All columns of a learning set of observed images."""
    angle = "-atan2(y4 - y1, x4 - x1) * 180 / pi()"
    size = f"sqrt(nullif({_R2}, 0))"
    cols = {"b": f"1 / {size}", "e": "0::DOUBLE", "te": angle, "g": "0::DOUBLE", "tg": angle, "s": f"0 / {size}"}
    for p in ("s", "d"):
        cols[f"x{p}"], cols[f"y{p}"] = _TURNED("0", "0")
    for k in (1, 2, 3, 4):
        cols[f"x{k}"], cols[f"y{k}"] = _TURNED(f"x{k}", f"y{k}")
        cols[f"m{k}"] = f"m{k} - m1"
    return "0::INTEGER AS class, " + ", ".join(f"{q6(v, digits)} AS {c}" for c, v in cols.items())


def _rounded_set(t: DataFrame, digits: int) -> DataFrame:
    return t.select("config_id", *[c if c == "class" else r6(c, digits).alias(c) for c in D.OUTPUT.split(",")])


@query(_CONF + f"SELECT config_id, {_normalised(6)} FROM c4")
def lens_normalise(s, d):
    return _rounded_set(D.dataset(_images(s, d), norm=True), 6)


@query(f"SELECT a.config_id, {q6('sqrt(max((a.x - b.x)**2 + (a.y - b.y)**2))')} AS sep FROM img a JOIN img b ON a.config_id = b.config_id GROUP BY a.config_id")
def lens_max_sep(s, d):
    return D.configurations(_images(s, d)).select("config_id", r6(D.max_separation(F.col("images"))).alias("sep"))


def _uniform_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


def _normal_sql(seed: int, *keys: str) -> str:
    return f"sqrt(-2 * ln({_uniform_sql(seed, '0', *keys)})) * cos(2 * pi() * {_uniform_sql(seed, '1', *keys)})"


_NOISY = (
    "sp AS (SELECT a.config_id, sqrt(max((a.x - b.x)**2 + (a.y - b.y)**2)) AS sep FROM img a JOIN img b ON a.config_id = b.config_id GROUP BY a.config_id), "
    "pl AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY mag, x, y) - 1 AS i FROM img), "
    "nz AS (SELECT config_id, realisation, " + ", ".join(f"{c} + {_normal_sql(3, 'config_id', 'realisation', 'i', str(k))} * {size} AS {c}" for k, (c, size) in enumerate((("mag", "0.02"), ("x", "sep * 0.01"), ("y", "sep * 0.01")))) + " FROM pl JOIN sp USING (config_id), range(2) r(realisation)), "
)


@query(_NOISY + _conf("nz", "config_id, realisation") + f"SELECT config_id, {_normalised(4)} FROM c4")
def lens_noise(s, d):
    return _rounded_set(D.dataset(_images(s, d), n_noise=2, xy_noise=0.01, mag_noise=0.02, relative=True, seed=3, norm=True), 4)


# Lens models and generators


_GRIDS = {"b": "[1:2:2]", "e": "[0:2:0.6]", "te": "[0:3:90]", "g": "[0:1:0.1]", "tg": "[0:1:45]", "s": "[0.1:1:0.2]"}


@query("SELECT " + ", ".join(f"{q6(c)} AS {c}" for c in gen.PARAMETERS) + " FROM (SELECT 1 + i / 2.0::DOUBLE AS b FROM range(3) r(i)), (SELECT i AS ei, i * 0.3::DOUBLE AS e FROM range(3) r(i)), (SELECT i AS ti, i * 30.0::DOUBLE AS te FROM range(4) r(i)), (SELECT i AS gi, i * 0.1::DOUBLE AS g FROM range(2) r(i)), (SELECT i AS tgi, i * 45.0::DOUBLE AS tg FROM range(2) r(i)), (SELECT 0.1 + i * 0.1::DOUBLE AS s FROM range(2) r(i)) WHERE NOT (ei = 0 AND ti > 0) AND NOT (gi = 0 AND tgi > 0)")
def param_grid(s, d):
    return gen.parameter_grid(s, **_GRIDS).select(*[r6(c).alias(c) for c in gen.PARAMETERS])


_LENS = "le AS (SELECT o_orderkey AS id, 1 + (o_orderkey % 5) / 10.0::DOUBLE AS b, (o_orderkey % 7) / 10.0::DOUBLE AS e, (o_orderkey % 31) / 10.0::DOUBLE AS te, (o_orderkey % 3) / 10.0::DOUBLE AS g, (o_orderkey % 29) / 10.0::DOUBLE AS tg, 0.1 + (o_orderkey % 4) / 10.0::DOUBLE AS s, (o_orderkey % 41) / 20.0::DOUBLE - 1.01 AS x, (o_orderkey % 37) / 18.0::DOUBLE - 1.03 AS y FROM orders), f1 AS (SELECT *, cos(te) * x + sin(te) * y AS u, cos(te) * y - sin(te) * x AS v, 1 - e AS q FROM le), f2 AS (SELECT *, sqrt(q * q * (s * s + u * u) + v * v) AS psi, sqrt(1 - q * q) AS f FROM f1), f3 AS (SELECT *, CASE WHEN e = 0 THEN b * u / (s + psi) ELSE b * q / f * atan(f * u / (psi + s)) END AS au, CASE WHEN e = 0 THEN b * v / (s + psi) ELSE b * q / f * atanh(f * v / (psi + q * q * s)) END AS av FROM f2), f4 AS (SELECT *, cos(te) * au - sin(te) * av + g * (cos(2 * tg) * x + sin(2 * tg) * y) AS ax, sin(te) * au + cos(te) * av + g * (sin(2 * tg) * x - cos(2 * tg) * y) AS ay FROM f3) "


def _lens(s, d):
    o = F.col("o_orderkey")
    part = lambda n, k: (o % n).cast("double") / k
    t = table(s, d, "orders").select(o.alias("id"), (1 + part(5, 10.0)).alias("b"), part(7, 10.0).alias("e"), part(31, 10.0).alias("te"), part(3, 10.0).alias("g"), part(29, 10.0).alias("tg"), (0.1 + part(4, 10.0)).alias("s"), (part(41, 20.0) - 1.01).alias("x"), (part(37, 18.0) - 1.03).alias("y"))
    return L.with_lens(t)


@query(_LENS + f"SELECT id, {q6('ax')} AS ax, {q6('ay')} AS ay FROM f4")
def nsieg_alpha(s, d):
    return _lens(s, d).select("id", r6("ax").alias("ax"), r6("ay").alias("ay"))


@query(_LENS + ", dq AS (SELECT *, (q * q * cos(te) * u - sin(te) * v) / psi AS p0, (q * q * sin(te) * u + cos(te) * v) / psi AS p1, b * q / ((psi + s)**2 + f * f * u * u) AS kx, b * q / ((psi + q * q * s)**2 - f * f * v * v) AS ky FROM f2), dj AS (SELECT *, kx * ((psi + s) * cos(te) - u * p0) AS x0, kx * ((psi + s) * sin(te) - u * p1) AS x1, ky * (-(psi + q * q * s) * sin(te) - v * p0) AS y0, ky * ((psi + q * q * s) * cos(te) - v * p1) AS y1 FROM dq), jj AS (SELECT id, 1 - (cos(te) * x0 - sin(te) * y0 + g * cos(2 * tg)) AS a, cos(te) * x1 - sin(te) * y1 + g * sin(2 * tg) AS b2, 1 - (sin(te) * x1 + cos(te) * y1 - g * cos(2 * tg)) AS c FROM dj) SELECT id, " + q6("a * c - b2 * b2") + " AS det FROM jj")
def nsieg_mu(s, d):
    return _lens(s, d).select("id", r6(1 / F.col("mu")).alias("det"))


@query(_LENS + f"SELECT id, {q6('(0.1 - (x - ax))**2 + (0.2 - (y - ay))**2')} AS sdf FROM f4")
def nsieg_sdf(s, d):
    dx, dy = 0.1 - (F.col("x") - F.col("ax")), 0.2 - (F.col("y") - F.col("ay"))
    return _lens(s, d).select("id", r6(dx * dx + dy * dy).alias("sdf"))


@query()
def simulate_images(s, d):
    grid = gen.parameter_grid(s, b="1", e="[0.2:1:0.4]", te="30", g="0.1", tg="60", s="0.1")
    return gen.simulate(grid, "[0:2:0.2]", "[0:2:0.2]", "[-2:40:2]", "[-2:40:2]", eps=0.02)


_DRAWN = {k: _uniform_sql(1, f"'{k}'", "id") for k in "ram"}


@query(f"SELECT id // 4 AS config_id, 4::INTEGER AS nimg, {q6('r * cos(a)', 9)} AS x, {q6('r * sin(a)', 9)} AS y, {q6('mag', 9)} AS mag FROM (SELECT id, sqrt({_DRAWN['r']}) AS r, 2 * pi() * {_DRAWN['a']} AS a, 3 * {_DRAWN['m']} AS mag FROM range(4000) t(id))")
def contaminants(s, d):
    return gen.contaminants(s, 1000, 4, 3.0, 1).select("config_id", "nimg", *[r6(c, 9).alias(c) for c in ("x", "y", "mag")])


_POTENTIAL = "FROM (SELECT *, (au * u + av * v) - b * q * s * ln(sqrt((psi + s)**2 + (1 - q * q) * u * u) / ((1 + q) * s)) + g * (cos(2 * tg) * (x * x - y * y) / 2 + sin(2 * tg) * x * y) AS potential FROM f3 WHERE e > 0)"


@query(_LENS + f"SELECT id, {q6('b * q / (2 * psi)')} AS kappa, {q6('potential')} AS potential {_POTENTIAL}")
def nsieg_potential(s, d):
    t = _lens(s, d).filter("e > 0").select("id", "b", "e", "te", "g", "tg", "s", "x", "y")
    return L.with_potential(t).select("id", r6("kappa").alias("kappa"), r6("potential").alias("potential"))


_EDGE = lambda i, j: f"(x{j} - x{i}) * sg * (cy + CASE WHEN (x{j} - x{i}) * sg > 0 THEN 0.5 ELSE 0 END - y{i}) - (y{j} - y{i}) * sg * (cx + CASE WHEN (y{j} - y{i}) * sg < 0 THEN 0.5 ELSE 0 END - x{i}) >= 0"
_CORNER = {f"{a}{k}": f"((c_custkey * {m}) % {n}) / {n}.0::DOUBLE * 10 - 0.003" for (a, k), m, n in zip(((a, k) for k in range(3) for a in "xy"), (17, 29, 37, 53, 71, 89), (101, 103, 107, 109, 113, 127))}


@query("tr AS (SELECT c_custkey AS id, " + ", ".join(f"{v} AS {c}" for c, v in _CORNER.items()) + " FROM customer), ts AS (SELECT *, sign((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS sg FROM tr), "
       "tc AS (SELECT ts.*, ix, iy, ix * 0.5::DOUBLE AS cx, iy * 0.5::DOUBLE AS cy FROM ts, range(20) a(ix), range(20) b(iy)) SELECT id, ix::INTEGER AS ix, iy::INTEGER AS iy FROM tc WHERE greatest(x0, x1, x2) >= cx AND least(x0, x1, x2) <= cx + 0.5 AND greatest(y0, y1, y2) >= cy AND least(y0, y1, y2) <= cy + 0.5 AND " + " AND ".join(_EDGE(i, j) for i, j in ((0, 1), (1, 2), (2, 0))))
def triangle_cells(s, d):
    c = F.col("c_custkey")
    corner = {f"{a}{k}": (c * m % n) / F.lit(float(n)) * 10 - F.lit(0.003) for (a, k), m, n in zip(((a, k) for k in range(3) for a in "xy"), (17, 29, 37, 53, 71, 89), (101, 103, 107, 109, 113, 127))}
    t = table(s, d, "customer").select(c.alias("id"), *[v.alias(k) for k, v in corner.items()])
    return G.triangle_cells(t, (0.0, 10.0, 20), (0.0, 10.0, 20))


@query("SELECT l_orderkey AS id, concat_ws(',', a, b, c) AS subset FROM (SELECT l_orderkey, list(l ORDER BY l) AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber AS l FROM lineitem) GROUP BY l_orderkey), LATERAL (SELECT i, j, k, v[i] AS a, v[j] AS b, v[k] AS c FROM range(1, 8) x(i), range(1, 8) y(j), range(1, 8) z(k) WHERE i < j AND j < k AND k <= len(v))")
def k_subsets(s, d):
    v = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("v"))
    return K.subsets(v, 3, "v").select("id", F.expr("array_join(transform(subset, x -> CAST(x AS STRING)), ',')").alias("subset"))


def _parsed(text: str, big: float, mid: float, low: float) -> str:
    return f"(split_part({text}, ':', 1)::DOUBLE * {big!r}::DOUBLE + split_part({text}, ':', 2)::DOUBLE * {mid!r}::DOUBLE + split_part({text}, ':', 3)::DOUBLE * {low!r}::DOUBLE)"


def _written(ra: str, dec: str, digits: int) -> tuple[str, str]:
    longer = lambda t: t.replace("%06.3f", f"%0{digits + 3}.{digits}f")
    return longer(_RA).replace("ra", ra), longer("concat_ws(':', " + ", ".join(_fmt("abs(dec)", A.DEGREE, A.ARCMIN, A.ARCSEC)) + ")").replace("dec", dec)


_LINES = f"tx AS (SELECT obj_id, mag, dec < 0 AS south, {_written('ra', 'dec', 6)[0]} AS a, {_written('ra', 'dec', 6)[1]} AS b FROM cust), back AS (SELECT mag, {_parsed('a', A.HOUR, A.MINUTE, A.SECOND)} AS ra, CASE WHEN south THEN -1 ELSE 1 END * {_parsed('b', A.DEGREE, A.ARCMIN, A.ARCSEC)} AS dec FROM tx) "


def _catalogue_lines(s, d):
    lines = cust(s, d).select("obj_id", F.concat(A.format_ra(F.col("ra"), 6), F.lit(" "), A.format_dec(F.col("dec"), 6), F.lit(" "), F.col("mags")[0].cast("string"), F.lit(" tail")).alias("value"))
    return cat.parse_lines(lines, 1, id_column="obj_id")


@query(_LINES + "SELECT printf('%.6f', ra) || ' ' || printf('%.6f', dec) || ' ' || mag::VARCHAR || ' tail' AS value FROM back")
def text_catalogue(s, d):
    """Lines written from a catalogue and parsed again: positions and payload survive."""
    return cat.format_positions(_catalogue_lines(s, d), "sph", 6)


@query(_LINES + "SELECT printf('%.3f', ra * 180 / pi()) || ' ' || printf('%.3f', dec * 180 / pi()) || ' ' || mag::VARCHAR || ' tail' AS degrees, printf('%.7f', cos(ra) * cos(dec)) || ' ' || printf('%.7f', sin(ra) * cos(dec)) || ' ' || printf('%.7f', sin(dec)) || ' ' || mag::VARCHAR || ' tail' AS cart FROM back")
def position_forms(s, d):
    c = _catalogue_lines(s, d)
    both = c.withColumn("tail", F.concat(F.col("tail"), F.lit("|"), F.col("obj_id").cast("string")))
    form = lambda f, n: cat.format_positions(both, f, n).select(F.split_part("value", F.lit("|"), F.lit(2)).alias("id"), F.split_part("value", F.lit("|"), F.lit(1)).alias(f))
    return form("sphd", 3).join(form("cart", 7), "id").select(F.col("sphd").alias("degrees"), "cart")


@query(f"SELECT printf('%g', {DIST}) || ' s' || id0 || ' c' || id1 AS value FROM pr WHERE {NEAR}")
def match_lines(s, d):
    lines = lambda t, p: t.withColumn("line", F.concat(F.lit(p), F.col("obj_id").cast("string")))
    met = J.cone_pairs(lines(supp(s, d), "s"), lines(cust(s, d), "c"), RADIUS, keep_a=("line",), keep_b=("line",))
    return cat.format_matches(met, "a_line", "b_line", with_distance=True)


@query()
def cart_fit_predict(s, d):
    """One CART tree of the customers' balances, and its predictions."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("y"), F.array((F.col("c_acctbal").cast("double") + F.col("c_custkey") % 7), (F.col("c_custkey") % 11).cast("double")).alias("x"))
    return R.predict(rows, R.fit(rows, 2, "R", algorithm="cart"), "R")
