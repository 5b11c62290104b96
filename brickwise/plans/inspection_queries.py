"""Queries over plans, criteria, meshes, references and bricks, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwise.operators import bricks, cells, decide, hardening, histogram, inspect, materials, noise, plan, region, report, shape, synthetic, walls
from brickwise.operators.blocks import BX, block_columns
from brickwise.operators.volume import voxelise
from brickwise.plans.volumes import HALF, PARTS, SMALL, parts, small_phantom, table, texture

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {PARTS} SELECT grey::BIGINT AS v, count(*)::BIGINT AS n FROM vox GROUP BY 1")
def brick_histogram(spark, sf_dir):
    return bricks.histogram(bricks.pack(parts(spark, sf_dir)))


@query(f"WITH {PARTS} SELECT x, y, z, grey FROM vox")
def brick_voxels(spark, sf_dir):
    return bricks.unpack(bricks.pack(parts(spark, sf_dir)))


@query()
def brick_sieve(spark, sf_dir):
    return bricks.unpack(bricks.sieve(bricks.pack(texture(spark, sf_dir)), (HALF,) * 3, 990.0))


ELEMENTS = """e AS (SELECT n_name AS element, CASE n_nationkey % 3 WHEN 0 THEN 'plane' WHEN 1 THEN 'cylinder' ELSE 'sphere' END AS kind,
  n_nationkey::DOUBLE AS cx, (n_regionkey * 2)::DOUBLE AS cy, (n_nationkey * 7 % 5)::DOUBLE AS cz,
  CASE n_nationkey // 3 % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 0 END AS dx, CASE n_nationkey // 3 % 3 WHEN 1 THEN 0.6::DOUBLE ELSE 0 END AS dy, CASE n_nationkey // 3 % 3 WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 1 ELSE 0 END AS dz,
  (n_nationkey % 4 + 1)::DOUBLE AS radius, (n_nationkey / 100)::DOUBLE AS form, 6.0::DOUBLE AS length, (n_nationkey / 50)::DOUBLE AS worst, n_nationkey AS k FROM nation)"""


def elements(spark, sf_dir):
    k = F.col("n_nationkey")
    turn = F.floor(k / 3) % 3
    pick = lambda a, b, c: F.when(turn == 0, F.lit(a)).when(turn == 1, F.lit(b)).otherwise(F.lit(c))
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("element"),
        F.when(k % 3 == 0, "plane").when(k % 3 == 1, "cylinder").otherwise("sphere").alias("kind"),
        k.cast("double").alias("cx"), (F.col("n_regionkey") * 2).cast("double").alias("cy"), (k * 7 % 5).cast("double").alias("cz"),
        pick(1.0, 0.0, 0.0).alias("dx"), pick(0.0, 0.6, 0.0).alias("dy"), pick(0.0, 0.8, 1.0).alias("dz"),
        (k % 4 + 1).cast("double").alias("radius"), (k / 100).alias("form"), F.lit(6.0).alias("length"), (k / 50).alias("worst"), k.alias("k"),
    )


@query(
    f"""WITH {ELEMENTS}, p AS (SELECT a.*, b.kind AS bk, b.cx AS bcx, b.cy AS bcy, b.cz AS bcz, b.dx AS bdx, b.dy AS bdy, b.dz AS bdz FROM e a JOIN e b ON b.k = (a.k + 1) % 25),
d AS (SELECT *, bcx - cx AS vx, bcy - cy AS vy, bcz - cz AS vz, dx * bdx + dy * bdy + dz * bdz AS dot FROM p),
v AS (SELECT *, vx * dx + vy * dy + vz * dz AS along, vx * bdx + vy * bdy + vz * bdz AS back, sqrt(vx * vx + vy * vy + vz * vz) AS straight, degrees(acos(greatest(least(dot, 1.0), -1.0))) AS angle FROM d)
SELECT k::INT AS number, CASE k % 5 WHEN 0 THEN 'diameter' WHEN 1 THEN 'distance' WHEN 2 THEN 'angle' WHEN 3 THEN 'coordinate' ELSE 'flatness' END AS kind, round(CASE k % 5
  WHEN 0 THEN 2 * radius
  WHEN 1 THEN CASE WHEN kind = 'plane' THEN abs(along) WHEN bk = 'plane' THEN abs(back) WHEN kind = 'cylinder' THEN sqrt(greatest(straight * straight - along * along, 0)) WHEN bk = 'cylinder' THEN sqrt(greatest(straight * straight - back * back, 0)) ELSE straight END
  WHEN 2 THEN CASE WHEN kind = 'cylinder' AND bk = 'cylinder' THEN least(angle, 180 - angle) WHEN kind = 'cylinder' OR bk = 'cylinder' THEN 90 - least(angle, 180 - angle) ELSE angle END
  WHEN 3 THEN cy ELSE form END, 6) AS measured FROM v"""
)
def characteristic_values(spark, sf_dir):
    e = elements(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("diameter", "distance", "angle", "coordinate", "flatness")))
    rows = e.alias("a").join(e.alias("b"), F.col("b.k") == (F.col("a.k") + 1) % 25)
    kind = F.get(kinds, (F.col("a.k") % 5).cast("int"))
    chars = rows.select(F.col("a.k").cast("int").alias("number"), kind.alias("kind"), F.col("a.element").alias("a"), F.col("b.element").alias("b"), F.lit(None).cast("string").alias("datum"), F.when(kind == "coordinate", F.lit(1)).alias("axis"))
    got = plan.characteristic_values(chars, e.drop("k"))
    return got.select("number", "kind", F.round("measured", 6).alias("measured"))


@query(
    f"""WITH {ELEMENTS}, p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 25)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y, (l_quantity % 6)::DOUBLE AS z, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS nx, CASE WHEN l_linenumber % 2 = 0 THEN 0.0::DOUBLE ELSE 1 END AS nz FROM lineitem),
w AS (SELECT p.*, e.*, x - cx AS wx, y - cy AS wy, z - cz AS wz FROM p, e), a AS (SELECT *, wx * dx + wy * dy + wz * dz AS along FROM w),
f AS (SELECT *, wx - along * dx AS ax, wy - along * dy AS ay, wz - along * dz AS az, sqrt(greatest(wx * wx + wy * wy + wz * wz, 1e-30)) AS far FROM a), o AS (SELECT *, sqrt(greatest(ax * ax + ay * ay + az * az, 1e-30)) AS off FROM f),
g AS (SELECT element, CASE kind WHEN 'plane' THEN along WHEN 'cylinder' THEN off - radius ELSE far - radius END AS deviation, CASE kind WHEN 'plane' THEN nx * dx + nz * dz WHEN 'cylinder' THEN (nx * ax + nz * az) / off ELSE (nx * wx + nz * wz) / far END AS facing,
  CASE kind WHEN 'plane' THEN off <= 2.5 WHEN 'cylinder' THEN abs(along) <= 2.5 ELSE true END AS inside FROM o)
SELECT element, count(*)::BIGINT AS n, round(sum(deviation), 5) AS total FROM g WHERE abs(deviation) <= 0.75 AND abs(facing) >= cos(radians(30)) AND inside GROUP BY 1"""
)
def extract_points(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 25).cast("double").alias("x"), (F.col("l_suppkey") % 10).cast("double").alias("y"), (F.col("l_quantity") % 6).cast("double").alias("z"), F.when(even, 1.0).otherwise(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(even, 0.0).otherwise(1.0).alias("nz"))
    # Equal points lie equally: each place meets the elements once and counts as often as it occurs.
    places = p.groupBy("x", "y", "z", "nx", "ny", "nz").agg(F.count("*").alias("often"))
    got = plan.extract_points(places, elements(spark, sf_dir).drop("k"), 0.75, 0.5)
    return got.groupBy("element").agg(F.sum("often").alias("n"), F.round(F.sum(F.col("deviation") * F.col("often")), 5).alias("total"))


PORES = """pores AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS x, (l_partkey % 50)::DOUBLE AS y, (l_suppkey % 50)::DOUBLE AS z, (l_extendedprice / 1024)::DOUBLE AS volume, l_discount::DOUBLE AS size, (l_tax * 10)::DOUBLE AS equivalent, (l_tax * 20)::DOUBLE AS enclosing, (1 - l_discount)::DOUBLE AS sphericity, (0.5 + l_tax)::DOUBLE AS compactness, (l_quantity / 2)::DOUBLE AS surface, l_returnflag FROM lineitem)"""
ZONES = """zones AS (SELECT n_name AS zone, (n_nationkey * 2)::DOUBLE AS x0, (n_nationkey * 2 + 9)::DOUBLE AS x1, (n_regionkey * 10)::DOUBLE AS y0, (n_regionkey * 10 + 7)::DOUBLE AS y1, 3.0::DOUBLE AS z0, 30.0::DOUBLE AS z1 FROM nation)"""
LOOSE = "loose AS (SELECT (s_suppkey % 50)::DOUBLE AS x, (s_nationkey * 2)::DOUBLE AS y, (s_suppkey % 40)::DOUBLE AS z, (s_suppkey % 9)::DOUBLE AS void FROM supplier)"
#: Limits by criterion of the query below; the smallest pore that counts is 0.03.
BOUNDS = {"max_pore_size_mm": 0.09, "max_pore_count": 40, "max_porosity_percent": 60.0, "max_global_porosity_percent": 50.0, "max_pore_volume_mm3": 80.0, "max_enclosing_diameter_mm": 1.5, "max_equivalent_diameter_mm": 0.9, "min_sphericity": 0.91, "min_compactness": 0.505, "min_surface_distance_mm": 0.75}


def _bounded(name: str, measured: str, pore: str) -> str:
    sign = "<=" if name.startswith("max") else ">="
    bound = BOUNDS.get(name, 0.0)
    return f"SELECT zone, '{name}' AS criterion, round(({measured})::DOUBLE, 3) AS measured, {bound}::DOUBLE AS bound, ({measured}) {sign} {bound} AS ok, {pore}::BIGINT AS pore FROM r"


@query(
    f"""WITH {PORES}, {ZONES}, {LOOSE}, kept AS (SELECT * FROM pores WHERE l_returnflag <> 'A'), t AS (SELECT z.zone, k.id, k.volume, k.size, k.equivalent, k.enclosing, k.sphericity, k.compactness, k.surface FROM zones z JOIN kept k ON k.x >= z.x0 AND k.x < z.x1 AND k.y >= z.y0 AND k.y < z.y1 AND k.z >= z.z0 AND k.z < z.z1),
s AS (SELECT zone, count(*) FILTER (size >= 0.03) AS counted, sum(volume) AS void, """
    + ", ".join(f"max({c}) AS m_{c}, arg_min(id, ({'-' if o == 'max' else ''}{c}, id)) AS i_{c}" if o == "max" else f"min({c}) AS m_{c}, arg_min(id, ({c}, id)) AS i_{c}" for c, o in (("size", "max"), ("volume", "max"), ("enclosing", "max"), ("equivalent", "max"), ("sphericity", "min"), ("compactness", "min"), ("surface", "min")))
    + """ FROM t GROUP BY 1),
l AS (SELECT z.zone, count(*) AS loose, sum(l.void) AS lvoid FROM zones z JOIN loose l ON l.x >= z.x0 AND l.x < z.x1 AND l.y >= z.y0 AND l.y < z.y1 AND l.z >= z.z0 AND l.z < z.z1 GROUP BY 1),
r AS (SELECT zones.zone, s.* EXCLUDE (zone), l.* EXCLUDE (zone), (SELECT sum(volume) FROM kept) + (SELECT sum(void) FROM loose) AS every FROM zones JOIN s USING (zone) LEFT JOIN l USING (zone))
"""
    + " UNION ALL ".join([
        _bounded("max_pore_size_mm", "m_size", "i_size"), _bounded("max_pore_count", "counted", "NULL"), _bounded("max_porosity_percent", "100 * (void + coalesce(lvoid, 0)) / 500", "NULL"), _bounded("max_global_porosity_percent", "100 * every / 90000", "NULL"),
        _bounded("max_pore_volume_mm3", "m_volume", "i_volume"), _bounded("max_enclosing_diameter_mm", "m_enclosing", "i_enclosing"), _bounded("max_equivalent_diameter_mm", "m_equivalent", "i_equivalent"),
        _bounded("min_sphericity", "m_sphericity", "i_sphericity"), _bounded("min_compactness", "m_compactness", "i_compactness"), _bounded("min_surface_distance_mm", "m_surface", "i_surface"),
        "SELECT zone, 'loosening' AS criterion, coalesce(loose, 0)::DOUBLE AS measured, 0.0::DOUBLE AS bound, coalesce(loose, 0) = 0 AS ok, NULL::BIGINT AS pore FROM r",
    ])
)
def acceptance_criteria(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"), (F.col("l_suppkey") % 50).cast("double").alias("z"),
        (F.col("l_extendedprice") / 1024).alias("volume_mm3"), F.col("l_discount").alias("size_mm"), (F.col("l_tax") * 10).alias("equivalent"), (F.col("l_tax") * 20).alias("enclosing"),
        (1 - F.col("l_discount")).alias("sphericity"), (0.5 + F.col("l_tax")).alias("compactness"), (F.col("l_quantity") / 2).alias("surface_distance"), "l_returnflag",
    )
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    box = {"x0": k * 2, "x1": k * 2 + 9, "y0": r * 10, "y1": r * 10 + 7, "z0": F.lit(3), "z1": F.lit(30)}
    limits = [F.lit(BOUNDS.get(c)).cast("double").alias(f"limit_{c}") for c in inspect.CRITERIA if c != "loosening"]
    z = n.select(F.col("n_name").alias("zone"), *[v.cast("double").alias(c) for c, v in box.items()], F.lit(500.0).alias("part_mm3"), F.lit(0.03).alias("count_min_size_mm"), F.lit(False).alias("allow_loosening"), *limits)
    s = table(spark, sf_dir, "supplier")
    loose = s.select((F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_nationkey") * 2).cast("double").alias("y"), (F.col("s_suppkey") % 40).cast("double").alias("z"), (F.col("s_suppkey") % 9).cast("double").alias("void_mm3"))
    got = inspect.criteria(z, p, loose, 90_000.0, F.col("l_returnflag") == "A")
    # The SQL has the zones that hold a pore.
    some = got.where("criterion = 'max_pore_size_mm' and pore is not null").select("zone")
    return got.join(some, "zone", "left_semi").select("zone", "criterion", F.round("measured", 3).alias("measured"), "bound", "ok", "pore")


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")
def pores_by_volume(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return inspect.numbered(rows, "key", "o_totalprice").select("key", "id", "place")


@query(
    f"""WITH {PARTS}, m AS (SELECT x // 4 AS bx, y // 4 AS b_y, z // 4 AS bz, CASE WHEN grey < 30 THEN 1 ELSE 2 END AS material, count(*) AS n, sum(grey) AS s FROM vox GROUP BY 1, 2, 3, 4),
t AS (SELECT *, sum(n) OVER (PARTITION BY bx, b_y, bz) AS total FROM m), l AS (SELECT material, coalesce(avg(s / n) FILTER (n >= total - total // 16), sum(s) / sum(n)) AS level FROM t GROUP BY 1)
SELECT bx, b_y AS "by", bz, sum(n)::BIGINT AS n, round((sum(n * level) / sum(n))::DOUBLE, 6) AS reference FROM t JOIN l USING (material) GROUP BY 1, 2, 3"""
)
def material_reference(spark, sf_dir):
    v = parts(spark, sf_dir)
    labels = v.select("x", "y", "z", F.when(F.col("grey") < 30, 1).otherwise(2).alias("material"))
    return inspect.material_reference(v, labels, 4).select(*BX, "n", F.round("reference", 6).alias("reference"))


TRIANGLES = """tri AS (SELECT c_custkey AS id, (c_custkey % 97) AS x1, c_nationkey AS y1, (c_custkey % 97) + 1 AS x2, c_nationkey AS y2, (c_custkey % 97) AS x3, c_nationkey + 1 AS y3 FROM customer),
corner AS (SELECT id, x1 AS x, y1 AS y FROM tri UNION ALL SELECT id, x2, y2 FROM tri UNION ALL SELECT id, x3, y3 FROM tri),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM corner a JOIN corner b USING (x, y)),
r AS (SELECT id, id AS root FROM tri UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), cc AS (SELECT id, min(root) AS component FROM r GROUP BY 1)"""


def triangles(spark, sf_dir):
    x, y, zero = F.col("c_custkey") % 97, F.col("c_nationkey"), F.lit(0.0)
    places = {"x1": x, "y1": y, "z1": zero, "x2": x + 1, "y2": y, "z2": zero, "x3": x, "y3": y + 1, "z3": zero}
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[v.cast("double").alias(c) for c, v in places.items()])


@query(f"WITH RECURSIVE {TRIANGLES} SELECT id, component FROM cc")
def mesh_components(spark, sf_dir):
    return walls.mesh_components(triangles(spark, sf_dir)).select("id", "component")


@query(f"WITH RECURSIVE {TRIANGLES} SELECT id FROM cc WHERE component = (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def outer_skin(spark, sf_dir):
    return walls.outer_skin(triangles(spark, sf_dir)).select("id")


@query(
    """WITH RECURSIVE p AS (SELECT c_custkey AS id, (c_custkey % 50)::DOUBLE AS x, (c_nationkey * 2)::DOUBLE AS y, (c_custkey % 7)::DOUBLE AS z, abs(c_acctbal)::DOUBLE / 1000 AS t FROM customer), m AS (SELECT * FROM p WHERE t < 4),
e AS (SELECT a.id AS a, b.id AS b FROM m a, m b WHERE a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4.0),
r AS (SELECT id, id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), cc AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT row_number() OVER (ORDER BY count(*) DESC, root)::INT AS region, count(*)::BIGINT AS n, min(t) AS least, round(avg(x), 6) AS cx, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size FROM cc JOIN m USING (id) GROUP BY root"""
)
def thin_regions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_nationkey") * 2).cast("double").alias("y"), (F.col("c_custkey") % 7).cast("double").alias("z"), (F.abs("c_acctbal") / 1000).alias("thickness"))
    return walls.thin_regions(p, 4.0, 2.0).select("region", "n", "least", F.round("cx", 6).alias("cx"), "size")


@query(
    """WITH m AS (SELECT c_custkey AS id, (c_custkey % 50)::DOUBLE AS x, c_nationkey::DOUBLE AS y, abs(c_acctbal)::DOUBLE / 1000 AS t FROM customer), q AS (SELECT (s_suppkey % 50)::DOUBLE + 0.25 AS x, s_nationkey::DOUBLE AS y, abs(s_acctbal)::DOUBLE / 1000 AS t FROM supplier),
d AS (SELECT m.id, (m.x - q.x) * (m.x - q.x) + (m.y - q.y) * (m.y - q.y) AS d2, q.t FROM m, q WHERE (m.x - q.x) * (m.x - q.x) + (m.y - q.y) * (m.y - q.y) <= 9.0), b AS (SELECT id, arg_min(t, (d2, t)) AS nominal FROM d GROUP BY 1)
SELECT m.id, nominal, round(m.t - nominal, 6) AS difference FROM m LEFT JOIN b USING (id)"""
)
def nominal_thickness(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    m = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"), (F.abs("c_acctbal") / 1000).alias("thickness"))
    q = s.select((F.col("s_suppkey") % 50 + 0.25).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"), (F.abs("s_acctbal") / 1000).alias("thickness"))
    return walls.against_nominal(m, q, 3.0).select("id", "nominal", F.round("difference", 6).alias("difference"))


@query("SELECT count(*)::BIGINT AS n, round(sum(v * w) / sum(w), 6) AS mean, round(sqrt(greatest(sum(v * v * w) / sum(w) - (sum(v * w) / sum(w)) * (sum(v * w) / sum(w)), 0)), 6) AS deviation, min(v) AS least, max(v) AS most FROM (SELECT o_totalprice::DOUBLE / 1000 AS v, (o_custkey % 7 + 1)::DOUBLE AS w FROM orders)")
def comparison_statistics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("v"), (F.col("o_custkey") % 7 + 1).cast("double").alias("w"))
    got = report.statistics(o, "v", "w")
    return got.select("n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most")


@query(
    f"""WITH {PARTS}, h AS (SELECT grey // 4 AS b, count(*) AS n FROM vox WHERE grey < 96 GROUP BY 1), r AS (SELECT range AS b FROM range(24)), c AS (SELECT r.b + 1 AS e, sum(coalesce(n, 0)) OVER (ORDER BY r.b) AS w, sum(coalesce(n, 0) * r.b) OVER (ORDER BY r.b) AS s FROM r LEFT JOIN h USING (b)),
g AS (SELECT p.e AS p, q.e AS q, t.e AS t, p.s * p.s / p.w + (q.s - p.s) * (q.s - p.s) / (q.w - p.w) + (t.s - q.s) * (t.s - q.s) / (t.w - q.w) + (a.s - t.s) * (a.s - t.s) / (a.w - t.w) AS score
  FROM c p JOIN c q ON q.e > p.e JOIN c t ON t.e > q.e JOIN c a ON a.e = 24 WHERE t.e < 24 AND p.w > 0 AND q.w > p.w AND t.w > q.w AND a.w > t.w)
SELECT max(score)::DOUBLE > 0 AS found, round(max(score)::DOUBLE, 3) AS score FROM g"""
)
def multi_otsu_4(spark, sf_dir):
    """The score of four classes' cuts: cuts of one score are equally good. Bins of fewer than four values have no such cuts, hence nulls."""
    import numpy as np

    n = decide.counts_of(histogram.grey_histogram(parts(spark, sf_dir).where("grey < 96")))
    cells_ = n[:96].reshape(24, 4).sum(1)
    if np.count_nonzero(cells_) < 4:
        return spark.createDataFrame([(None, None)], "found boolean, score double")
    spread = np.zeros(65536, dtype=np.int64)
    spread[: len(cells_)] = cells_
    edges = [0, *map(int, decide.multi_otsu(spread, 4)), 24]
    score = sum(float((cells_[a:b] * np.arange(a, b)).sum()) ** 2 / max(int(cells_[a:b].sum()), 1) for a, b in zip(edges, edges[1:], strict=False))
    return spark.createDataFrame([(score > 0, round(score, 3))], "found boolean, score double")


PRICES = "h AS (SELECT floor(l_extendedprice / 2)::BIGINT AS v, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)"


def prices(spark, sf_dir):
    """lineitem's prices as grey values."""
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 2).cast("int").alias("grey"))
    return decide.counts_of(histogram.grey_histogram(rows))


@query(
    f"""WITH {PRICES}, c AS (SELECT v, (sum(n) OVER w)::DOUBLE AS n0, (sum(v * n) OVER w)::DOUBLE AS s0, (sum(n) OVER ())::DOUBLE AS na, (sum(v * n) OVER ())::DOUBLE AS sa FROM h WINDOW w AS (ORDER BY v)),
o AS (SELECT v + 0.5::DOUBLE AS otsu FROM c WHERE n0 < na ORDER BY n0 * (na - n0) * (s0 / n0 - (sa - s0) / (na - n0)) * (s0 / n0 - (sa - s0) / (na - n0)) DESC, v LIMIT 1),
t AS (SELECT v, CASE WHEN v IN (0, 65535) THEN 0 ELSE n END AS n FROM h), u AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER () AS total FROM t),
e AS (SELECT min(v) FILTER (up > total // 1000) AS lo, min(v) FILTER (up >= total - total // 1000) AS hi FROM u), g AS (SELECT lo, hi, greatest(1, (hi - lo + 256) // 256)::BIGINT AS width FROM e),
r AS (SELECT unnest(range((hi - lo) // width + 1)) AS b FROM g), k AS (SELECT b, coalesce(sum(n), 0)::DOUBLE AS n FROM r CROSS JOIN g LEFT JOIN u ON u.v BETWEEN lo AND hi AND (u.v - lo) // width = b GROUP BY b),
w AS (SELECT p.b, sum(q.n * exp(-0.5 * pow((q.b - p.b) / 1.5, 2))) / sum(exp(-0.5 * pow((q.b - p.b) / 1.5, 2))) AS s FROM k p JOIN k q ON abs(q.b - p.b) <= 5 GROUP BY p.b),
x AS (SELECT b, s, lag(s) OVER (ORDER BY b) AS before, lead(s) OVER (ORDER BY b) AS after, lo + b * width + (width - 1) / 2.0::DOUBLE AS centre FROM w, g),
peaks AS (SELECT b, s FROM x, o WHERE s >= before AND s > after AND centre < otsu), air AS (SELECT p.b, (SELECT q.b FROM peaks q WHERE q.b < p.b ORDER BY q.s DESC, q.b LIMIT 1) AS a FROM peaks p),
valleys AS (SELECT a, air.b, (SELECT x.b FROM x WHERE x.b BETWEEN a AND air.b ORDER BY x.s, x.b LIMIT 1) AS v FROM air WHERE a IS NOT NULL),
deep AS (SELECT z.centre FROM valleys JOIN x l ON l.b = a JOIN x m ON m.b = valleys.b JOIN x z ON z.b = v WHERE least(l.s, m.s) - z.s >= 0.05 * (SELECT max(s) FROM x) ORDER BY valleys.b LIMIT 1)
SELECT coalesce((SELECT centre FROM deep), otsu)::DOUBLE AS threshold, otsu FROM o"""
)
def air_threshold(spark, sf_dir):
    n = prices(spark, sf_dir)
    return spark.createDataFrame([(decide.air_threshold(n), decide.otsu_of(n))], "threshold double, otsu double")


@query(
    f"""WITH {PRICES}, g AS (SELECT min(v) AS first, greatest(1.0::DOUBLE, (max(v) + 1 - min(v)) / 256.0::DOUBLE) AS width FROM h),
k AS (SELECT least(floor((v - first) / width), 255)::INT AS b, sum(n)::DOUBLE AS n, sum(n * v)::DOUBLE AS s FROM h, g GROUP BY 1),
c AS (SELECT i, coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s FROM range(257) r(i) LEFT JOIN k ON b < i GROUP BY i), z AS (SELECT n, s FROM c WHERE i = 256),
score AS (SELECT p.i AS p, q.i AS q, CASE WHEN p.n > 0 THEN p.s * p.s / p.n ELSE 0 END + CASE WHEN q.n > p.n THEN (q.s - p.s) * (q.s - p.s) / (q.n - p.n) ELSE 0 END + CASE WHEN z.n > q.n THEN (z.s - q.s) * (z.s - q.s) / (z.n - q.n) ELSE 0 END AS t
  FROM c p JOIN c q ON p.i < q.i CROSS JOIN z WHERE p.i > 0 AND q.i < 256)
SELECT first + p * width AS low, first + q * width AS high FROM score, g ORDER BY t DESC, q, p LIMIT 1"""
)
def multi_otsu_cuts(spark, sf_dir):
    """The two cuts of three classes, on bins of a fractional width."""
    return spark.createDataFrame([tuple(decide.multi_otsu(prices(spark, sf_dir), 3))], "low double, high double")


def _morton_sql(bits: int) -> str:
    return " + ".join(f"((b{c} >> {b}) & 1) * {1 << (3 * b + k)}" for b in range(bits) for k, c in enumerate("xyz"))


@query(
    f"""WITH {PARTS}, b AS (SELECT grey, x // 16 AS bx, y // 16 AS b_y, z // 16 AS bz FROM vox), c AS (SELECT grey, {_morton_sql(3).replace("(by ", "(b_y ")} AS code FROM b),
r AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT code FROM c)), g AS (SELECT grey FROM c JOIN r USING (code) WHERE k % greatest(1, n // 16) = 0 AND grey > 30)
SELECT coalesce((SELECT grey FROM (SELECT grey, row_number() OVER (ORDER BY grey) - 1 AS i, count(*) OVER () AS n FROM g) WHERE i = n // 2), 30)::DOUBLE AS level"""
)
def brick_material_level(spark, sf_dir):
    return spark.createDataFrame([(decide.material_level(parts(spark, sf_dir), 30.0, side=16),)], "level double")


@query(
    """WITH t AS (SELECT (l_suppkey % 50)::INT AS label, floor(l_extendedprice / 2)::INT AS grey, (l_quantity::INT // 17)::INT AS found FROM lineitem),
b AS (SELECT label, least(greatest(grey, 0), 65535) // 16 AS bin, count(*) AS n FROM t WHERE label > 0 GROUP BY ALL), c AS (SELECT label, bin, sum(n) OVER (PARTITION BY label ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY label) AS total FROM b),
m AS (SELECT label, (min(bin) + 0.5) * 16 AS median FROM c WHERE 2 * seen >= total GROUP BY label)
SELECT CASE WHEN median >= 19000 THEN 2 WHEN median >= 18500 THEN 1 ELSE 0 END::INT AS truth, found, count(*)::BIGINT AS n FROM t LEFT JOIN m USING (label) GROUP BY ALL"""
)
def component_majority(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).cast("int").alias("label"), F.floor(F.col("l_extendedprice") / 2).cast("int").alias("grey"), F.floor(F.col("l_quantity").cast("int") / 17).cast("int").alias("found"))
    return materials.confusion(materials.scored(rows, [18_500.0, 19_000.0]))


SOLIDS = {
    "ball": {"region": [{"sphere": {"center_mm": [30, 30, 30], "radius_mm": 17.5}}]},
    "drilled": {"box_mm": [[4, 5, 6], [50, 47.5, 60]], "region": {"exclude": [{"cylinder": {"from_mm": [0, 20, 20], "to_mm": [64, 24, 40], "radius_mm": 9}}]}},
    "both": {"region": [{"cylinder": {"from_mm": [10, 10, 0], "to_mm": [10, 12, 64], "radius_mm": 8}}, {"sphere": {"center_mm": [48, 48, 48], "radius_mm": 12}}]},
    "whole": {},
}


def _rod(a, b, r):
    axis = [q - p for p, q in zip(a, b, strict=True)]
    length = sum(v * v for v in axis)
    t = "(" + " + ".join(f"(p{c} - {p}) * {v}" for c, p, v in zip("xyz", a, axis, strict=True)) + f") / {length}::DOUBLE"
    away = " + ".join(f"pow(p{c} - {p} - {t} * {v}, 2)" for c, p, v in zip("xyz", a, axis, strict=True))
    return f"({t} BETWEEN 0 AND 1 AND {away} <= {r * r})"


@query(
    f"""WITH {PARTS}, v AS (SELECT grey, x + 0.5::DOUBLE AS px, y + 0.5::DOUBLE AS py, z + 0.5::DOUBLE AS pz FROM vox),
r AS (SELECT 'ball' AS name, grey, pow(px - 30, 2) + pow(py - 30, 2) + pow(pz - 30, 2) <= 306.25 AS inside FROM v
UNION ALL SELECT 'drilled', grey, px >= 4 AND px < 50 AND py >= 5 AND py < 47.5 AND pz >= 6 AND pz < 60 AND NOT {_rod((0, 20, 20), (64, 24, 40), 9)} FROM v
UNION ALL SELECT 'both', grey, {_rod((10, 10, 0), (10, 12, 64), 8)} OR pow(px - 48, 2) + pow(py - 48, 2) + pow(pz - 48, 2) <= 144 FROM v
UNION ALL SELECT 'whole', grey, true FROM v)
SELECT name, count(*) FILTER (inside)::BIGINT AS voxels, round(coalesce(sum(grey - 1) FILTER (inside), 0) / 99.0::DOUBLE, 6) AS volume_mm3 FROM r GROUP BY name"""
)
def region_volumes(spark, sf_dir):
    found = region.region_volumes(parts(spark, sf_dir), {n: region.Region.of_zone(z) for n, z in SOLIDS.items()}, 100.0, 1.0)
    return found.withColumn("volume_mm3", F.round("volume_mm3", 6))


@query(
    """WITH vox AS (SELECT (l_partkey % 64 // 4)::INT AS x, (l_suppkey % 64 // 4)::INT AS y, (l_orderkey % 64 // 4)::INT AS z, sum(l_quantity::INT)::BIGINT AS grey FROM lineitem GROUP BY ALL),
full_ AS (SELECT x // 8 AS i, y // 8 AS j, z // 8 AS k FROM vox GROUP BY 1, 2, 3 HAVING count(*) = 512 AND avg(grey) >= 10), f AS (SELECT vox.*, i, j, k FROM vox JOIN full_ ON x // 8 = i AND y // 8 = j AND z // 8 = k),
o AS (SELECT a.r AS dx, b.r AS dy, c.r AS dz FROM range(-3, 4) a(r), range(-3, 4) b(r), range(-3, 4) c(r) WHERE (c.r, b.r, a.r) > (0, 0, 0)),
p AS (SELECT dx, dy, dz, count(*) AS n, sum((a.grey - b.grey) * (a.grey - b.grey))::DOUBLE AS s FROM f a CROSS JOIN o JOIN f b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND a.i = b.i AND a.j = b.j AND a.k = b.k GROUP BY 1, 2, 3),
g AS (SELECT sqrt(sum(s) / sum(n) / 2) AS sigma FROM p WHERE greatest(abs(dx), abs(dy), abs(dz)) = 3)
SELECT dx::INT AS dx, dy::INT AS dy, dz::INT AS dz, n::BIGINT AS n, round(s / n, 6) AS variance, round(sigma, 6) AS sigma, round(1 - s / n / (2 * sigma * sigma), 6) AS correlation FROM p, g"""
)
def noise_model(spark, sf_dir):
    at = lambda c: F.floor(F.col(c) % 64 / 4).cast("int")
    volume = voxelise(table(spark, sf_dir, "lineitem"), at("l_partkey"), at("l_suppkey"), at("l_orderkey"), F.col("l_quantity"))
    return noise.noise_model(volume, 10.0).select("dx", "dy", "dz", "n", *[F.round(c, 6).alias(c) for c in ("variance", "sigma", "correlation")])


@query()
def porosity_analysis(spark, sf_dir):
    s = synthetic.Scan(synthetic.box((4.0, 3.0, 3.0)), size=48, pitch=0.25, balls=[((1.0, 0.0, 0.0), 0.6), ((-2.0, 1.0, 0.5), 0.7)], noise=100.0)
    packed = synthetic.scan(spark, s)
    t = decide.otsu_of(decide.counts_of(bricks.histogram(packed)))
    return inspect.analyse(bricks.unpack(bricks.sieve(packed, (s.size,) * 3, t)), (s.size,) * 3, (s.pitch,) * 3).pores


@query()
def stacked_cell_overhang(spark, sf_dir):
    voxels = bricks.unpack(synthetic.stacked_cell(spark, (40, 36, 30), 3, 5, 5))
    return cells.stacked_overhang(cells.stacked_layers(voxels, 9000, 14_000, 100), 6)


@query()
def direction_families(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    b = e.select(F.col("vec_id").cast("int").alias("bx"), F.lit(0).alias("by"), F.lit(0).alias("bz"), F.lit(1).cast("long").alias("n"), F.transform("v", lambda v: v / length).alias("direction"))
    return shape.direction_families(b, 3).select("bx", "family")


@query()
def beam_hardening(spark, sf_dir):
    return hardening.correct(small_phantom(spark, sf_dir), SMALL.size, 2, 1000.0, 20_000.0).select("x", "y", "z", F.round("value", 3).alias("value"))


@query(f"WITH {PARTS} SELECT x // 8 AS bx, y // 8 AS b_y, z // 8 AS bz, count(*)::BIGINT AS n FROM vox GROUP BY 1, 2, 3")
def brick_counts(spark, sf_dir):
    got = bricks.unpack(bricks.pack(parts(spark, sf_dir))).groupBy(*block_columns(8)).agg(F.count("*").alias("n"))
    return got.withColumnRenamed("by", "b_y")
