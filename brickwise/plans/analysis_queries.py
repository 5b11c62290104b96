"""Queries of the analyses: porosity, materials, filters, surfaces, dimensions, batteries and evaluation, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import offsets
from brickwise.operators import battery, blocks, evaluate, filters, materials, porosity, surface
from brickwise.operators.components import components
from brickwise.operators.histogram import upper_median, weighted_percentiles
from brickwise.plans.grid_queries import BLOCKS, OFF, SPARSE, reach, sparse
from brickwise.plans.volumes import PARTS, parts, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it must equal."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r"\bby\b", '"by"', sql)
        return f

    return add


SEEDS = "seeds AS (SELECT a.x, a.y, a.z, a.grey, count(b.x) < 6 AS seed FROM (SELECT * FROM vox WHERE grey < {t}) a CROSS JOIN " + OFF[6] + " o(dx, dy, dz) LEFT JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL)"
DENSE = "vox AS (SELECT (l_partkey % 12)::INT AS x, (l_suppkey % 12)::INT AS y, (l_orderkey % 12)::INT AS z, sum(l_quantity::INT)::INT AS grey FROM lineitem GROUP BY ALL)"


def dense(spark, sf_dir):
    """lineitem over 12^3 voxels: nearly all of them are active."""
    from brickwise.operators.volume import voxelise

    rows = table(spark, sf_dir, "lineitem")
    return voxelise(rows, F.col("l_partkey") % 12, F.col("l_suppkey") % 12, F.col("l_orderkey") % 12, F.col("l_quantity"))


MID = "cut AS (SELECT quantile_disc(grey, 0.03) AS t FROM vox)"


def low_cut(voxels):
    return voxels.agg(F.expr("percentile_disc(0.03) within group (order by grey)").alias("t")).first()["t"]


@query(f"WITH {PARTS}, {SEEDS.format(t=6)} SELECT * FROM seeds")
def pore_candidates_seeds(spark, sf_dir):
    return porosity.candidates(parts(spark, sf_dir), 6)


@query(
    f"""WITH RECURSIVE {DENSE}, {MID}, {SEEDS.format(t='(SELECT t FROM cut)')}, {reach(26, 'seeds')}
SELECT component, count(*)::BIGINT AS n, sum(grey)::BIGINT AS grey, bool_or(seed) AS outside FROM k JOIN cc USING (key) GROUP BY 1"""
)
def pores(spark, sf_dir):
    v = dense(spark, sf_dir)
    found = porosity.labelled_candidates(v, low_cut(v), brick=8)
    return found.groupBy("component").agg(F.count("*").alias("n"), F.sum("grey").alias("grey"), F.bool_or("outside").alias("outside"))


@query(
    f"""WITH RECURSIVE {DENSE}, {MID}, m AS (SELECT * FROM vox WHERE grey < (SELECT t FROM cut)), {reach(26)},
shell AS (SELECT DISTINCT component, x + dx AS x, y + dy AS y, z + dz AS z FROM k JOIN cc USING (key), (SELECT * FROM {OFF[26]} o(dx, dy, dz) UNION ALL SELECT 0, 0, 0)),
f AS (SELECT component, x, y, z, CASE WHEN grey IS NULL THEN 1.0::DOUBLE ELSE (2000.0::DOUBLE - grey) / 1990.0 END AS f FROM shell LEFT JOIN vox USING (x, y, z))
SELECT component, round(sum(f), 5) AS volume_mm3, round(sum(least(greatest(f, 0), 1) * x) / sum(least(greatest(f, 0), 1)), 5) AS cx FROM f GROUP BY 1"""
)
def pore_volumes(spark, sf_dir):
    v = dense(spark, sf_dir)
    found = components(v.where(F.col("grey") < low_cut(v)), 26, brick=8)
    got = porosity.pore_volumes(v, found, 2000.0, 10.0)
    return got.select("component", F.round("volume_mm3", 5).alias("volume_mm3"), F.round("cx", 5).alias("cx"))


@query(
    f"""WITH {DENSE}, b AS (SELECT x // 2 AS bx, y // 2 AS by, z // 2 AS bz, count(*) AS n, sum(grey) AS s, sum(grey * grey) AS q, count(*) FILTER (grey < 500) AS below FROM vox GROUP BY 1, 2, 3),
m AS (SELECT (s / n)::DOUBLE AS mean, ((n * q - s * s) / (n * n))::DOUBLE AS v FROM b WHERE n = 8 AND below <= 6)
SELECT round(list_sort(list(mean))[count(*) // 2 + 1], 6) AS level, round(sqrt(list_sort(list(v))[count(*) // 2 + 1]), 6) AS sigma FROM m HAVING count(*) > 0"""
)
def material_level_noise(spark, sf_dir):
    s = blocks.block_statistics(dense(spark, sf_dir), 500, 2)
    return porosity.material_level(s, 6, 8).select(F.round("level", 6).alias("level"), F.round("sigma", 6).alias("sigma"))


@query("SELECT floor(p_size / 2)::INT AS bin, round(list_sort(list(p_retailprice))[count(*) // 2 + 1]::DOUBLE, 6) AS level FROM part GROUP BY 1 HAVING count(*) >= 4")
def depth_levels(spark, sf_dir):
    return porosity.depth_levels(table(spark, sf_dir, "part"), "p_retailprice", "p_size").select("bin", F.round("level", 6).alias("level"))


@query(
    """WITH l AS (SELECT floor(p_size / 2)::INT AS bin, list_sort(list(p_retailprice))[count(*) // 2 + 1]::DOUBLE AS v FROM part GROUP BY 1 HAVING count(*) >= 4), c AS (SELECT (bin + 0.5) * 2.0 AS d, v FROM l),
p AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q FROM lineitem), v AS (SELECT DISTINCT q FROM p),
e AS (SELECT q, max(d) FILTER (d <= q) AS lo, min(d) FILTER (d > q) AS hi FROM v, c GROUP BY 1), j AS (SELECT * FROM p JOIN e USING (q))
SELECT l_orderkey, l_linenumber, round(CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (q - lo) / (hi - lo) END, 5) AS level FROM j LEFT JOIN c a ON a.d = lo LEFT JOIN c b ON b.d = hi"""
)
def level_at_depth(spark, sf_dir):
    levels = porosity.depth_levels(table(spark, sf_dir, "part"), "p_retailprice", "p_size")
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return porosity.level_at_depth(points, "l_quantity", levels).select("l_orderkey", "l_linenumber", F.round("level", 5).alias("level"))


@query(
    f"""WITH RECURSIVE {PARTS}, b AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, count(*) AS n, sum(grey) / count(*) AS mean FROM vox GROUP BY 1, 2, 3), d AS (SELECT x, y, z, (60.0 - mean)::DOUBLE / 55.0 AS deficit FROM b WHERE n = 3),
m AS (SELECT * FROM d WHERE deficit > greatest(0.85::DOUBLE, 5.0 * (4.0::DOUBLE * sqrt(3.0::DOUBLE) / 3 / 55.0))), {reach(26)}, z AS (SELECT component FROM cc GROUP BY 1 HAVING count(*) >= 2)
SELECT k.x AS bx, k.y AS by, k.z AS bz, round(deficit, 6) AS deficit, component AS zone FROM k JOIN cc USING (key) SEMI JOIN z USING (component)"""
)
def zones_flagged(spark, sf_dir):
    s = blocks.block_statistics(parts(spark, sf_dir), 5, 2)
    got = porosity.flag_zones(s, 60.0, 5.0, 4.0, 0.85, 5.0, 3, 8)
    return got.select("bx", "by", "bz", F.round("deficit", 6).alias("deficit"), "zone")


@query(f"WITH {PARTS} SELECT round(((sum(grey) - 2.0 * count(*)) / 58.0 * 0.001)::DOUBLE, 6) AS volume_mm3 FROM vox")
def part_volume(spark, sf_dir):
    return porosity.part_volume(parts(spark, sf_dir), 60.0, 2.0, 0.001).select(F.round("volume_mm3", 6).alias("volume_mm3"))


REGIONS = "(SELECT n_name AS name, (n_nationkey * 2)::INT AS x0, (n_regionkey * 10)::INT AS y0, 5 AS z0, (n_nationkey * 2 + 11)::INT AS x1, (n_regionkey * 10 + 17)::INT AS y1, 40 AS z1 FROM nation)"


def regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.selectExpr("n_name AS name", "n_nationkey * 2 AS x0", "n_regionkey * 10 AS y0", "5 AS z0", "n_nationkey * 2 + 11 AS x1", "n_regionkey * 10 + 17 AS y1", "40 AS z1")


@query(f"WITH {PARTS} SELECT name, round(((sum(grey) - 2.0 * count(*)) / 58.0)::DOUBLE, 6) AS volume FROM vox JOIN {REGIONS} r ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1 GROUP BY 1")
def region_part_volume(spark, sf_dir):
    return porosity.region_part_volume(parts(spark, sf_dir), regions(spark, sf_dir), 60.0, 2.0).select("name", F.round("volume", 6).alias("volume"))


@query(
    f"""WITH {PARTS}, c AS (SELECT x // 4 AS x, y // 4 AS y, z // 4 AS z, sum(grey) AS s, count(*) AS n FROM vox GROUP BY 1, 2, 3), g AS (SELECT (i % 13)::INT AS x, (i // 13 % 13)::INT AS y, (i // 169)::INT AS z FROM range(2197) r(i)),
p AS (SELECT g.x, g.y, g.z, round(((60.0 * sum(n) - sum(s)) / (sum(n) * 58.0))::DOUBLE, 9) AS p FROM g JOIN c ON c.x BETWEEN g.x AND g.x + 3 AND c.y BETWEEN g.y AND g.y + 3 AND c.z BETWEEN g.z AND g.z + 3 GROUP BY 1, 2, 3)
SELECT (x * 4)::INT AS x, (y * 4)::INT AS y, (z * 4)::INT AS z, p AS porosity FROM p ORDER BY p DESC, p.z, p.y, p.x LIMIT 1"""
)
def reference_porosity_cube(spark, sf_dir):
    return porosity.reference_porosity(parts(spark, sf_dir), 16, 4, 64, 60.0, 2.0)


@query(
    f"""WITH RECURSIVE {PARTS}, m AS (SELECT * FROM vox WHERE grey >= 95), {reach(26)}, f AS (SELECT component, x, y, z FROM k JOIN cc USING (key)),
n AS (SELECT component, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) + 1 AS size FROM f GROUP BY 1),
a AS (SELECT a.component, sum(2 - 2 * (b.x IS NOT NULL)::INT) AS faces FROM f a CROSS JOIN (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dx, dy, dz) LEFT JOIN f b ON b.component = a.component AND b.x = a.x - dx AND b.y = a.y - dy AND b.z = a.z - dz GROUP BY 1)
SELECT component, n::BIGINT AS n, round(faces * 0.25::DOUBLE * 2 / 3, 6) AS area, round(pow(6 * n * 0.125::DOUBLE / pi(), 1 / 3.0), 6) AS equivalent_diameter, round(least(1.0::DOUBLE, pow(pi(), 1 / 3.0) * pow(6 * n * 0.125::DOUBLE, 2 / 3.0) / (faces * 0.25::DOUBLE * 2 / 3)), 6) AS sphericity, (size * 0.5)::DOUBLE AS size FROM n JOIN a USING (component)"""
)
def pore_shapes(spark, sf_dir):
    got = porosity.pore_shapes(components(sparse(spark, sf_dir, 95), 26, brick=32), 0.5)
    return got.select("component", "n", F.round("area", 6).alias("area"), F.round("equivalent_diameter", 6).alias("equivalent_diameter"), F.round("sphericity", 6).alias("sphericity"), "size")


@query(f"WITH RECURSIVE {PARTS}, m AS (SELECT * FROM vox WHERE grey >= 110), {reach(26)}, f AS (SELECT component, x, y, z FROM k JOIN cc USING (key)) SELECT a.component AS a, b.component AS b, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))::BIGINT AS gap2 FROM f a JOIN f b ON a.component < b.component AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND abs(a.z - b.z) <= 6 GROUP BY 1, 2 HAVING gap2 <= 36")
def smallest_pore_gap(spark, sf_dir):
    return porosity.smallest_gap(components(sparse(spark, sf_dir, 110), 26, brick=32), 6)


@query("""WITH f AS (SELECT c_nationkey AS component, (c_custkey * 37 % 1009)::INT AS x, (c_nationkey * 40 + c_custkey % 7)::INT AS y, (floor(abs(c_acctbal)) % 977)::INT AS z FROM customer),
g AS (SELECT a.component AS a, b.component AS b, sqrt(pow(0.5 * greatest(abs(a.x - b.x) - 1, 0), 2) + pow(greatest(abs(a.y - b.y) - 1, 0), 2) + pow(2.0 * greatest(abs(a.z - b.z) - 1, 0), 2)) AS gap FROM f a JOIN f b ON a.component < b.component)
SELECT a::BIGINT AS a, b::BIGINT AS b, round(gap, 9) AS gap FROM g ORDER BY gap, a, b LIMIT 1""")
def closest_pores(spark, sf_dir):
    """Nations as pores, customers as their voxels."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("component"), (F.col("c_custkey") * 37 % 1009).cast("int").alias("x"), (F.col("c_nationkey") * 40 + F.col("c_custkey") % 7).cast("int").alias("y"), (F.floor(F.abs("c_acctbal")) % 977).cast("int").alias("z"))
    return porosity.closest_pores(rows, (0.5, 1.0, 2.0)).withColumn("gap", F.round("gap", 9))


@query(
    f"""WITH {PARTS}, o AS (SELECT * FROM {OFF[26]} o(dx, dy, dz) UNION ALL SELECT 0, 0, 0), m AS (SELECT a.x, a.y, a.z, a.grey, count(*) FILTER (b.grey > 30) AS c, sum(b.grey) FILTER (b.grey > 30) AS s FROM vox a, o, vox b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND a.grey > 30 GROUP BY ALL)
SELECT x, y, z, CASE WHEN s::DOUBLE / c > 70 THEN 2 ELSE 1 END::INT AS material FROM m WHERE c >= 4"""
)
def segment_materials(spark, sf_dir):
    return materials.segment(parts(spark, sf_dir), 30.0, [70.0], least=4)


@query(
    f"""WITH RECURSIVE {PARTS}, g AS (SELECT x, y, z FROM vox WHERE grey > 35), r AS (SELECT x, y, z, 0 AS k FROM vox WHERE grey > 90 UNION SELECT g.x, g.y, g.z, r.k + 1 FROM r, {OFF[6]} o(dx, dy, dz), g WHERE g.x = r.x + dx AND g.y = r.y + dy AND g.z = r.z + dz AND r.k < 2)
SELECT DISTINCT x, y, z FROM r"""
)
def hysteresis_growth(spark, sf_dir):
    v = parts(spark, sf_dir)
    return materials.grow(v.where("grey > 90"), v.where("grey > 35"), 2)


@query(f"WITH {PARTS} SELECT (grey // 40)::INT AS material, count(*)::BIGINT AS voxels, round((count(*) * 0.008)::DOUBLE, 6) AS volume_mm3 FROM vox GROUP BY 1")
def material_counts(spark, sf_dir):
    return materials.counts(parts(spark, sf_dir).select(F.floor(F.col("grey") / 40).cast("int").alias("material")), 0.008).select("material", "voxels", F.round("volume_mm3", 6).alias("volume_mm3"))


@query("WITH p AS (SELECT (l_quantity > 25)::INT + (l_quantity > 40)::INT AS t, (l_extendedprice > 30000)::INT + (l_extendedprice > 55000)::INT AS p FROM lineitem) SELECT c::INT AS class, round(CASE WHEN count(*) FILTER (t = c) + count(*) FILTER (p = c) = 0 THEN 1.0 ELSE 2.0 * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) END::DOUBLE, 6) AS dice FROM p, range(3) r(c) GROUP BY c")
def confusion_dice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    t = (F.col("l_quantity") > 25).cast("int") + (F.col("l_quantity") > 40).cast("int")
    p = (F.col("l_extendedprice") > 30000).cast("int") + (F.col("l_extendedprice") > 55000).cast("int")
    return materials.dice(materials.confusion(rows.select(t.alias("truth"), p.alias("found"))), 3).select("class", F.round("dice", 6).alias("dice"))


@query("SELECT (l_quantity > 25)::INT AS truth, (l_extendedprice > 30000)::INT AS found, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("truth"), (F.col("l_extendedprice") > 30000).cast("int").alias("found"))
    return materials.confusion(rows)


MEASURE = f"""WITH RECURSIVE {SPARSE}, {reach(6)}, f AS (SELECT component, x, y, z, grey FROM k JOIN cc USING (key))
SELECT component, count(*)::BIGINT AS voxels, round((count(*) * 0.125)::DOUBLE, 6) AS volume_mm3, round((avg(x) * 0.5)::DOUBLE, 6) AS cx, round((avg(y) * 0.5)::DOUBLE, 6) AS cy, round((avg(z) * 0.5)::DOUBLE, 6) AS cz, ((min(x) - 0.5) * 0.5)::DOUBLE AS min_x_mm, ((max(x) + 0.5) * 0.5)::DOUBLE AS max_x_mm
FROM f GROUP BY 1 HAVING count(*) >= 3"""


@query(MEASURE)
def measure_objects(spark, sf_dir):
    got = materials.measure(components(sparse(spark, sf_dir), 6, brick=16), 0.5, least=3)
    return got.select("component", "voxels", F.round("volume_mm3", 6).alias("volume_mm3"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")], "min_x_mm", "max_x_mm")


@query("SELECT l_linenumber, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_middle_median(spark, sf_dir):
    return upper_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linenumber"])


@query("WITH m AS (SELECT l_linenumber AS k, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY 1), d AS (SELECT l_linenumber AS k, abs(l_extendedprice - m) AS d FROM lineitem JOIN m ON k = l_linenumber) SELECT k AS l_linenumber, round(1.4826 * list_sort(list(d))[count(*) // 2 + 1], 6) AS sigma FROM d GROUP BY 1")
def mad_sigma(spark, sf_dir):
    return filters.mad_sigma(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linenumber"]).select("l_linenumber", F.round("sigma", 6).alias("sigma"))


@query("WITH b AS (SELECT l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM b) SELECT s::DOUBLE AS share, min(v) AS value FROM c, (VALUES (0.01), (0.05), (0.5), (0.95), (0.99)) q(s) WHERE c >= s::DOUBLE * t GROUP BY 1")
def wall_thickness_stats(spark, sf_dir):
    return weighted_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", [0.01, 0.05, 0.5, 0.95, 0.99])


@query("SELECT bin, round(sum(w)::DOUBLE, 4) AS weight FROM (SELECT least(floor(l_extendedprice / 2500.0), 39)::INT AS bin, l_quantity AS w FROM lineitem) GROUP BY 1")
def weighted_histogram(spark, sf_dir):
    return surface.weighted_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 100000.0, 40).select("bin", F.round("weight", 4).alias("weight"))


@query("SELECT event_id, CASE WHEN d <= -2 THEN 0 WHEN d >= 2 THEN 15 WHEN d < 0 THEN least(greatest(1 + floor((d + 2) / (4.0 / 14)), 1), 7) ELSE least(greatest(1 + floor((d + 2) / (4.0 / 14)), 8), 14) END::INT AS code FROM (SELECT event_id, ((value - 50) / 10)::DOUBLE AS d FROM events)")
def surface_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 10).alias("d"))
    return surface.encode(rows, "d", 2.0, 4).select("event_id", "code")


@query("SELECT round(sum(CASE WHEN c = 0 THEN 1.0 WHEN c = 15 THEN 0.0 ELSE least(greatest(0.5 - (-2 + (c - 0.5) * (4.0 / 14)), 0), 1) END)::DOUBLE * 0.001, 6) AS volume_mm3 FROM (SELECT l_partkey % 16 AS c FROM lineitem)")
def surface_volume(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 16).cast("int").alias("code"))
    return surface.volume_of_codes(codes, 2.0, 4, 0.001).select(F.round("volume_mm3", 6).alias("volume_mm3"))


@query(f"WITH {PARTS}, g AS (SELECT a.x, a.y, a.z, max(CASE WHEN o.dx = 1 THEN b.grey END) - max(CASE WHEN o.dx = -1 THEN b.grey END) AS gx, max(CASE WHEN o.dy = 1 THEN b.grey END) - max(CASE WHEN o.dy = -1 THEN b.grey END) AS gy, max(CASE WHEN o.dz = 1 THEN b.grey END) - max(CASE WHEN o.dz = -1 THEN b.grey END) AS gz, count(*) AS n FROM vox a, {OFF[6]} o(dx, dy, dz), vox b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT x // 16 AS bx, y // 16 AS by, z // 16 AS bz, count(*)::BIGINT AS n, sum(gx * gx)::BIGINT AS xx, sum(gy * gy)::BIGINT AS yy, sum(gz * gz)::BIGINT AS zz, sum(gx * gy)::BIGINT AS xy, sum(gx * gz)::BIGINT AS xz, sum(gy * gz)::BIGINT AS yz FROM g WHERE n = 6 GROUP BY 1, 2, 3")
def structure_tensor_blocks(spark, sf_dir):
    return filters.structure_tensors(parts(spark, sf_dir), 16)


@query(f"WITH {PARTS} SELECT dx, dy, dz, count(*)::BIGINT AS n, round(avg((a.grey - b.grey) * (a.grey - b.grey))::DOUBLE, 6) AS variance FROM vox a, {OFF[26]} o(dx, dy, dz), vox b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND (dz, dy, dx) > (0, 0, 0) GROUP BY ALL")
def noise_pair_variance(spark, sf_dir):
    return filters.pair_variances(parts(spark, sf_dir)).select("dx", "dy", "dz", "n", F.round("variance", 6).alias("variance"))


@query("WITH b AS (SELECT round(p_size / 4.0)::INT AS bin, p_retailprice AS v FROM part), l AS (SELECT bin, list_sort(list(v))[count(*) // 2 + 1] AS level FROM b GROUP BY 1 HAVING count(*) >= 8) SELECT bin, round(level::DOUBLE, 6) AS level, round((level / (SELECT list_sort(list(level))[count(*) // 2 + 1] FROM l WHERE bin > 0.8 * (SELECT max(bin) FROM l)))::DOUBLE, 6) AS relative FROM l")
def cupping_profile(spark, sf_dir):
    got = filters.cupping_profile(table(spark, sf_dir, "part"), "p_retailprice", "p_size", 4.0)
    return got.select("bin", F.round("level", 6).alias("level"), F.round("relative", 6).alias("relative"))


@query("WITH b AS (SELECT round(p_size / 4.0)::INT AS bin, p_retailprice AS v FROM part), l AS (SELECT bin, list_sort(list(v))[count(*) // 2 + 1] AS level FROM b GROUP BY 1 HAVING count(*) >= 8), s AS (SELECT arg_min(level, bin) AS surface FROM l) SELECT p_partkey, round((p_retailprice * greatest(surface / coalesce(level, surface), 0.1))::DOUBLE, 5) AS value FROM part CROSS JOIN s LEFT JOIN l ON bin = round(p_size / 4.0)::INT")
def depth_correction(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    levels = filters.cupping_profile(p, "p_retailprice", "p_size", 4.0)
    return filters.depth_correction(p, "p_retailprice", "p_size", 4.0, levels).select("p_partkey", F.round("value", 5).alias("value"))


@query("WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz, embedding[4]::DOUBLE AS qx, embedding[5]::DOUBLE AS qy, embedding[6]::DOUBLE AS qz FROM embeddings) SELECT count(*)::BIGINT AS n, " + ", ".join(f"round(sum({a} * {b}), 4) AS s_{a}_{b}" for a in ("px", "py", "pz") for b in ("qx", "qy", "qz")) + ", " + ", ".join(f"round(sum({a}), 4) AS s_{a}" for a in ("px", "py", "pz", "qx", "qy", "qz")) + " FROM v")
def rigid_fit_sums(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(*[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("px", "py", "pz", "qx", "qy", "qz"))])
    got = surface.fit_sums(pairs)
    return got.select("n", *[F.round(c, 4).alias(c) for c in got.columns if c != "n"])


@query("SELECT a.vec_id AS a, arg_min(b.vec_id, (a.embedding[1] - b.embedding[1])::DOUBLE ** 2 + (a.embedding[2] - b.embedding[2])::DOUBLE ** 2 + (a.embedding[3] - b.embedding[3])::DOUBLE ** 2) AS nearest FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1")
def nearest_neighbour(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return surface.nearest(points.where("id % 20 = 0"), points).select(F.col("id").alias("a"), "nearest")


@query("WITH v AS (SELECT date_trunc('hour', ts) AS h, floor(avg(value) * 1000 + 0.5) / 1000 AS v FROM events GROUP BY 1), s AS (SELECT h, v, lag(v) OVER (ORDER BY h) AS b, lead(v) OVER (ORDER BY h) AS a FROM v) SELECT epoch(h)::BIGINT AS hour, round(CASE WHEN a IS NULL OR b IS NULL THEN v ELSE (b + 2 * v + a) / 4 END::DOUBLE, 7) AS smooth FROM s")
def smoothing_121(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour")).agg((F.floor(F.avg("value") * 1000 + 0.5) / 1000).alias("v"))
    return battery.smooth(v, "hour", "v").select("hour", F.round("smooth", 7).alias("smooth"))


PEAKS = """v AS (SELECT floor(epoch(ts) / 86400)::BIGINT AS day, floor(avg(value)::DOUBLE * 1000 + 0.5) / 1000 AS v FROM events GROUP BY 1), n AS (SELECT day, v, lag(v) OVER (ORDER BY day) AS b, lead(v) OVER (ORDER BY day) AS a FROM v), p AS (SELECT day, v FROM n WHERE v > coalesce(b, -1e300) AND v >= coalesce(a, -1e300)),
w AS (SELECT p.day, p.v, coalesce((SELECT min(x.v) FROM v x WHERE x.day < p.day AND x.day > coalesce((SELECT max(y.day) FROM v y WHERE y.day < p.day AND y.v > p.v), -1)), p.v) AS lo, coalesce((SELECT min(x.v) FROM v x WHERE x.day > p.day AND x.day < coalesce((SELECT min(y.day) FROM v y WHERE y.day > p.day AND y.v > p.v), 99999999)), p.v) AS hi FROM p)"""


@query(f"WITH {PEAKS} SELECT day, round(v, 6) AS v, round(v - greatest(lo, hi), 6) AS prominence FROM w WHERE v - greatest(lo, hi) >= 0.5")
def radial_profile_peaks(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg((F.floor(F.avg("value") * 1000 + 0.5) / 1000).alias("v"))
    return battery.peaks(v.withColumn("profile", F.lit(0)), ["profile"], "day", "v", 0.5).select("day", F.round("v", 6).alias("v"), F.round("prominence", 6).alias("prominence"))


@query("WITH s AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS s, sum(v * v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS q, sum(v) OVER () AS sa, sum(v * v) OVER () AS qa FROM (SELECT s_acctbal::DOUBLE AS v FROM supplier)), w AS (SELECT *, round(q - s * s / k + (qa - q) - (sa - s) * (sa - s) / (n - k), 3) AS ss FROM s WHERE k < n) SELECT k::BIGINT AS low_count, round(s / k, 6) AS low_mean, round((sa - s) / (n - k), 6) AS high_mean FROM w ORDER BY ss, k LIMIT 1")
def two_class_split(spark, sf_dir):
    got = battery.two_classes(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").cast("double").alias("v")), "v")
    return got.select("low_count", F.round("low_mean", 6).alias("low_mean"), F.round("high_mean", 6).alias("high_mean"))


@query("WITH p AS (SELECT l_linenumber AS section, l_quantity::DOUBLE AS x, (l_partkey % 97)::DOUBLE AS y FROM lineitem) SELECT section, count(*)::BIGINT AS n, " + ", ".join(f"sum({e})::DOUBLE AS {n}" for n, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("syy", "y * y"), ("sxy", "x * y"), ("sxr", "x * (x * x + y * y)"), ("syr", "y * (x * x + y * y)"), ("sr", "x * x + y * y"))) + " FROM p GROUP BY 1")
def circle_fit_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("section"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 97).cast("double").alias("y"))
    return battery.circle_sums(rows, ["section"])


@query("WITH d AS (SELECT user_id, event_id, epoch(ts)::DOUBLE - lag(epoch(ts)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), m AS (SELECT user_id, list_sort(list(gap))[count(*) // 2 + 1] AS usual FROM d WHERE gap IS NOT NULL GROUP BY 1) SELECT user_id, event_id FROM d JOIN m USING (user_id) WHERE gap > 1.6 * usual")
def layer_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return battery.gaps(e, ["user_id"], "us", "event_id", 1.6).select("user_id", "event_id")


@query("WITH o AS (SELECT o_orderkey, o_orderpriority AS edge, (o_totalprice / 1000)::DOUBLE AS v FROM orders) SELECT edge, count(*)::BIGINT AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, arg_min(o_orderkey, (v, o_orderkey)) AS worst FROM o GROUP BY 1")
def edge_overhang_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("edge"), (F.col("o_totalprice") / 1000).alias("v"))
    got = battery.edge_summary(o, "edge", "v", "o_orderkey")
    return got.select("edge", "n", "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "worst")


@query(f"WITH RECURSIVE {PARTS}, m AS (SELECT * FROM vox WHERE grey > 70), {reach(6)} SELECT component, count(*)::BIGINT AS n, round(pow(6 * count(*) / pi(), 1 / 3.0), 6) AS equivalent_diameter FROM cc GROUP BY 1 HAVING count(*) >= 2")
def particles_and_voids(spark, sf_dir):
    return battery.particles(parts(spark, sf_dir).where("grey > 70"), 2).select("component", "n", F.round("equivalent_diameter", 6).alias("equivalent_diameter"))


@query("WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS x, (s_nationkey * 2)::DOUBLE AS y, abs(s_acctbal)::DOUBLE / 1000 AS size FROM supplier) SELECT s.id FROM p s WHERE s.size < 3 AND EXISTS (SELECT 1 FROM p l WHERE l.size >= 8 AND sqrt((s.x - l.x) * (s.x - l.x) + (s.y - l.y) * (s.y - l.y)) < 0.5 * l.size)")
def pieces_in_structures(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    p = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_nationkey") * 2).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.abs("s_acctbal") / 1000).alias("size"))
    return battery.inside_structures(p.where("size < 3"), p.where("size >= 8"), 10.0).select("id")


PORES = "SELECT p_partkey AS id, (p_size * 1.0)::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y, (p_partkey % 31)::DOUBLE AS z, (p_retailprice / 1000)::DOUBLE AS volume, ((p_partkey % 17) / 10.0)::DOUBLE AS size FROM part"


def pore_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"), (F.col("p_partkey") % 31).cast("double").alias("z"), (F.col("p_retailprice") / 1000).alias("volume"), (F.col("p_partkey") % 17 / 10.0).alias("size"))


@query(
    f"""WITH p AS ({PORES}), z AS (SELECT n_name AS zone, (n_nationkey * 2)::DOUBLE AS x0, (n_nationkey * 2 + 12)::DOUBLE AS x1, (n_regionkey * 8)::DOUBLE AS y0, (n_regionkey * 8 + 15)::DOUBLE AS y1, (0.9 + n_regionkey * 0.2)::DOUBLE AS max_size, (10 + n_nationkey)::BIGINT AS max_count FROM nation),
m AS (SELECT zone, max_size, max_count, count(p.id) FILTER (volume > 0.95) AS n, coalesce(max(size) FILTER (volume > 0.95), 0) AS largest, arg_max(p.id, (size, -p.id)) FILTER (volume > 0.95) AS worst, count(p.id) FILTER (volume <= 0.95) AS skipped FROM z LEFT JOIN p ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2, 3)
SELECT zone, n::BIGINT AS pores, skipped::BIGINT AS disregarded, largest::DOUBLE AS largest, CASE WHEN largest > 0 THEN worst END AS worst, NOT (largest > max_size) AS size_ok, NOT (n > max_count) AS count_ok FROM m"""
)
def acceptance_evaluation(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    zones = n.selectExpr("n_name AS zone", "double(n_nationkey * 2) AS x0", "double(n_nationkey * 2 + 12) AS x1", "double(n_regionkey * 8) AS y0", "double(n_regionkey * 8 + 15) AS y1", "double(0.9 + n_regionkey * 0.2) AS max_size", "bigint(10 + n_nationkey) AS max_count")
    return evaluate.acceptance(zones, pore_table(spark, sf_dir), F.col("volume") <= 0.95)


@query(
    """WITH k AS (SELECT p_partkey AS id, 'PG ' || (p_size / 10.0)::VARCHAR || '/Dp' || replace((p_partkey % 9 / 10.0)::VARCHAR, '.', ',') || '/U Vp' || (p_partkey % 5)::VARCHAR || ' / Z ' || (p_size % 7)::VARCHAR AS key FROM part)
SELECT id, symbol, disregard, replace(number, ',', '.')::DOUBLE AS value FROM (SELECT id, regexp_extract(t, '^(U?) *(PROI|PG|PV|Vp|Daq|Dp|Psi|Gap|da|C|Z) *([0-9.,]+)$', 2) AS symbol, regexp_extract(t, '^(U?) *(PROI|PG|PV|Vp|Daq|Dp|Psi|Gap|da|C|Z) *([0-9.,]+)$', 1) = 'U' AS disregard, regexp_extract(t, '^(U?) *(PROI|PG|PV|Vp|Daq|Dp|Psi|Gap|da|C|Z) *([0-9.,]+)$', 3) AS number FROM (SELECT id, trim(unnest(string_split(key, '/'))) AS t FROM k))"""
)
def porosity_key_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lit("PG "), F.format_string("%.1f", F.col("p_size") / 10.0), F.lit("/Dp"), F.replace(F.format_string("%.1f", F.col("p_partkey") % 9 / 10.0), F.lit("."), F.lit(",")), F.lit("/U Vp"), (F.col("p_partkey") % 5).cast("string"), F.lit(" / Z "), (F.col("p_size") % 7).cast("string"))
    return evaluate.parse_keys(p.select(F.col("p_partkey").alias("id"), key.alias("key")), "id", "key")


@query("WITH m AS (SELECT s_suppkey AS id, radians(s_suppkey * 37 % 180) AS a FROM supplier), q AS (SELECT r_regionkey AS need, radians(r_regionkey * 40) AS a FROM region) SELECT need, arg_min(id, (round(least(abs(m.a - q.a), pi() - abs(m.a - q.a)), 9), id)) AS id, round(degrees(min(least(abs(m.a - q.a), pi() - abs(m.a - q.a)))), 5) AS angle FROM q, m GROUP BY 1")
def fibre_requirement_match(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.radians(F.col("s_suppkey") * 37 % 180).alias("a"))
    need = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("need"), F.radians(F.col("r_regionkey") * 40).alias("a"))
    return evaluate.match_families(need, found).select("need", "id", F.round(F.degrees("angle"), 5).alias("angle"))


@query("WITH c AS (SELECT p_partkey AS number, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_retailprice::DOUBLE END AS measured, (900 + p_size * 4)::DOUBLE AS nominal, CASE WHEN p_size % 13 = 0 THEN NULL ELSE 100.0 END::DOUBLE AS tolerance FROM part) SELECT number, round(measured - nominal, 6) AS deviation, CASE WHEN measured IS NULL THEN 'not measured' WHEN tolerance IS NULL THEN 'unrated' WHEN abs(measured - nominal) > tolerance THEN 'fail' ELSE 'pass' END AS rating FROM c")
def characteristic_rating(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 11 != 0, F.col("p_retailprice").cast("double")).alias("measured"), (900 + F.col("p_size") * 4).cast("double").alias("nominal"), F.when(F.col("p_size") % 13 != 0, F.lit(100.0)).alias("tolerance"))
    return evaluate.rate(rows).select("number", F.round("deviation", 6).alias("deviation"), "rating")


@query("SELECT o_custkey AS object, o_orderpriority AS type, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS step FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def latest_artifact_per_object(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return evaluate.latest(o, ["o_custkey", "o_orderpriority"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey").select(F.col("o_custkey").alias("object"), F.col("o_orderpriority").alias("type"), F.col("value").alias("step"))


@query(f"WITH {PARTS} SELECT x, y, z, grey FROM vox WHERE ((x >= 5 AND x < 30 AND y >= 10 AND y < 40 AND z >= 0 AND z < 60) OR (x - 40) * (x - 40) + (y - 30) * (y - 30) + (z - 30) * (z - 30) <= 144) AND NOT ((y - 25) * (y - 25) + (z - 20) * (z - 20) <= 36 AND x BETWEEN 0 AND 64)")
def inspection_region_filter(spark, sf_dir):
    from brickwise.operators.region import Ball, Block, Cylinder, Region

    region = Region([Block((5, 10, 0), (30, 40, 60)), Ball((40, 30, 30), 12)], [Cylinder((0, 25, 20), (64, 25, 20), 6)])
    return parts(spark, sf_dir).where(region.contains(F.col("x"), F.col("y"), F.col("z")))


@query("WITH t AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE / 1000 AS d1, (s_nationkey - 12)::DOUBLE AS d2, (s_suppkey % 7 - 3)::DOUBLE AS d3 FROM supplier) SELECT id, ((d1 < 0) <> (d2 < 0))::INT + ((d2 < 0) <> (d3 < 0))::INT + ((d3 < 0) <> (d1 < 0))::INT AS ends, round(CASE WHEN (d1 < 0) <> (d2 < 0) THEN d1 / (d1 - d2) END, 6) AS t12 FROM t WHERE (d1 < 0) <> (d2 < 0) OR (d2 < 0) <> (d3 < 0)")
def mesh_plane_cut(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    t = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal").cast("double") / 1000).alias("d1"), (F.col("s_nationkey") - 12).cast("double").alias("d2"), (F.col("s_suppkey") % 7 - 3).cast("double").alias("d3"))
    return surface.plane_cut(t).select("id", "ends", F.round("t12", 6).alias("t12"))


@query("SELECT s_suppkey AS id, round(0.6 * s_suppkey - 0.8 * s_nationkey + 5, 6)::DOUBLE AS x, round(0.8 * s_suppkey + 0.6 * s_nationkey - 2, 6)::DOUBLE AS y, round(s_acctbal + 1, 6)::DOUBLE AS z FROM supplier")
def rigid_transform(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.col("s_acctbal").cast("double").alias("z"))
    moved = surface.transform(s, [0.6, -0.8, 0.0, 5.0, 0.8, 0.6, 0.0, -2.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    return moved.select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {PARTS} SELECT a.x, a.y, a.z, a.grey, b.label FROM vox a JOIN (SELECT x, y, z, grey % 5 AS label FROM vox WHERE grey % 5 > 0) b USING (x, y, z)")
def label_grey_join(spark, sf_dir):
    v = parts(spark, sf_dir)
    labels = v.where("grey % 5 > 0").select("x", "y", "z", (F.col("grey") % 5).alias("label"))
    return v.join(labels, ["x", "y", "z"])


@query("SELECT round(avg(sqrt((l_extendedprice - l_quantity * 1500) ** 2))::DOUBLE, 4) AS mean_abs, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2))::DOUBLE, 4) AS rmse, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2) FILTER (l_quantity > 25))::DOUBLE, 4) AS rmse_material FROM lineitem")
def denoise_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("found"), (F.col("l_quantity") * 1500).alias("truth"), (F.col("l_quantity") > 25).alias("material"))
    got = filters.score(rows)
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


@query("SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from brickwise.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))


@query("WITH r AS (SELECT CASE WHEN p_size % 11 = 0 THEN 'not measured' WHEN p_size % 13 = 0 THEN 'unrated' WHEN abs(p_retailprice - (900 + p_size * 4)) > 100 THEN 'fail' ELSE 'pass' END AS rating FROM part) SELECT count(*) FILTER (rating = 'pass')::BIGINT AS passed, count(*) FILTER (rating = 'fail')::BIGINT AS failed, count(*) FILTER (rating = 'not measured')::BIGINT AS not_measured, count(*) FILTER (rating = 'unrated')::BIGINT AS unrated, count(*) FILTER (rating IN ('fail', 'not measured')) = 0 AS accepted FROM r")
def first_article_decision(spark, sf_dir):
    from brickwise.operators.report import first_article

    p = table(spark, sf_dir, "part")
    rows = p.select(F.when(F.col("p_size") % 11 != 0, F.col("p_retailprice").cast("double")).alias("measured"), (900 + F.col("p_size") * 4).cast("double").alias("nominal"), F.when(F.col("p_size") % 13 != 0, F.lit(100.0)).alias("tolerance"))
    return first_article(evaluate.rate(rows))


@query("WITH e AS (SELECT o_orderpriority AS edge, min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders GROUP BY 1), m AS (SELECT min(lo) AS a, max(hi) AS b, max(hi - lo) AS c FROM e) SELECT 'min_overhang_mm' AS criterion, round(a, 4) AS measured, 2000.0::DOUBLE AS bound, a >= 2000 AS ok FROM m UNION ALL SELECT 'max_overhang_mm', round(b, 4), 400000.0, b <= 400000 FROM m UNION ALL SELECT 'max_edge_spread_mm', round(c, 4), 600000.0, c <= 600000 FROM m")
def battery_report(spark, sf_dir):
    from brickwise.operators import report

    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("edge"), F.col("o_totalprice").cast("double").alias("overhang_mm"))
    got = report.battery_report(o, {"min_overhang_mm": 2000.0, "max_overhang_mm": 400000.0, "max_edge_spread_mm": 600000.0})
    return got.select("criterion", F.round("measured", 4).alias("measured"), "bound", "ok")
