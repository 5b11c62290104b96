"""Queries over voxels, blocks and histograms, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from brickwise.functions.keys import morton, natural_key, offsets
from brickwise.operators import blocks, bricks, distance, histogram, volume
from brickwise.operators.components import component_statistics, components, faces, keep_largest
from brickwise.operators.generate import phantom_volume
from brickwise.operators.graph import stage
from brickwise.operators.ranking import ranks
from brickwise.plans.volumes import BOX, FLAGSHIP, HALF, PARTS, SMALL, TEXTURE, parts, phantom_sql, small_phantom, table, texture

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it must equal."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r"\bby\b", '"by"', sql)  # a block column that is a keyword there
        return f

    return add


OFF = {n: "(VALUES " + ", ".join(str(o) for o in offsets(n)) + ")" for n in (6, 18, 26)}
OTSU = """hist AS (SELECT grey::BIGINT AS v, count(*)::BIGINT AS n FROM vox GROUP BY 1),
cum AS (SELECT v, (sum(n) OVER w)::DOUBLE AS n0, (sum(v * n) OVER w)::DOUBLE AS s0, (sum(n) OVER ())::DOUBLE AS na, (sum(v * n) OVER ())::DOUBLE AS sa FROM hist WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
score AS (SELECT *, n0 * (na - n0) * (s0 / n0 - (sa - s0) / (na - n0)) * (s0 / n0 - (sa - s0) / (na - n0)) AS b FROM cum WHERE n0 < na),
otsu AS (SELECT v + 0.5::DOUBLE AS threshold, s0 / n0 AS air_level FROM score ORDER BY b DESC, v LIMIT 1)"""


def sparse(spark, sf_dir, above: int = 70):
    """The bright voxels of the parts volume: few enough to fall into many components."""
    return parts(spark, sf_dir).where(F.col("grey") >= above)


SPARSE = PARTS + ", m AS (SELECT * FROM vox WHERE grey >= 70)"


def reach(count: int, mask: str = "m", extra: str = "") -> str:
    """Recursive SQL: the least voxel key of each component of a mask."""
    return f"""k AS (SELECT *, x + (y << 21) + (z::BIGINT << 42) AS key FROM {mask}),
e AS (SELECT a.key AS a, b.key AS b FROM k a, {OFF[count]} o(dx, dy, dz), k b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz {extra}),
r AS (SELECT key, key AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key WHERE r.root < e.b),
cc AS (SELECT key, min(root) AS component FROM r GROUP BY key)"""


@query(f"WITH {phantom_sql(SMALL)} SELECT * FROM vox")
def phantom_voxels(spark, sf_dir):
    return small_phantom(spark, sf_dir)


@query(f"SELECT round({phantom_volume(SMALL)}::DOUBLE, 6) AS volume_mm3")
def phantom_material_volume(spark, sf_dir):
    return spark.range(1).select(F.round(F.lit(phantom_volume(SMALL)), 6).alias("volume_mm3"))


@query(f"WITH {PARTS} SELECT grey::BIGINT AS v, count(*)::BIGINT AS n FROM vox GROUP BY 1")
def grey_histogram(spark, sf_dir):
    return histogram.grey_histogram(parts(spark, sf_dir))


@query(f"WITH {PARTS}, {OTSU} SELECT threshold, round(air_level, 6) AS air_level FROM otsu")
def otsu_threshold(spark, sf_dir):
    return histogram.otsu(histogram.grey_histogram(parts(spark, sf_dir))).select("threshold", F.round("air_level", 6).alias("air_level"))


@query("WITH hist AS (SELECT floor(o_totalprice / 100)::BIGINT AS v, count(*)::BIGINT AS n FROM orders GROUP BY 1) SELECT round((sum(v * n) / sum(n))::DOUBLE, 6) AS air_level FROM hist WHERE v < 2000")
def air_level(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100).alias("v"))
    return histogram.air_level(histogram.grey_histogram(rows, "v"), 2000).select(F.round("air_level", 6).alias("air_level"))


BINS = """hist AS (SELECT floor(o_totalprice / 100)::BIGINT AS v, count(*)::BIGINT AS n FROM orders GROUP BY 1),
c AS (SELECT v, n, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS total FROM hist),
ends AS (SELECT min(v) FILTER (c > total // 1000) AS lo, min(v) FILTER (c >= total - total // 1000) AS hi FROM c),
g AS (SELECT *, greatest(1, (hi - lo + 256) // 256) AS width FROM ends),
full_ AS (SELECT b.bin::INT AS bin, coalesce(sum(h.n), 0) AS n FROM (SELECT unnest(range((hi - lo) // width + 1)) AS bin, lo, hi, width FROM g) b LEFT JOIN hist h ON h.v >= b.lo AND h.v <= b.hi AND (h.v - b.lo) // b.width = b.bin GROUP BY 1),
bins AS (SELECT a.bin, (sum(b.n * exp(-0.5 * power((b.bin - a.bin) / 1.5, 2))) / sum(exp(-0.5 * power((b.bin - a.bin) / 1.5, 2))))::DOUBLE AS s FROM full_ a JOIN full_ b ON b.bin BETWEEN a.bin - 5 AND a.bin + 5 GROUP BY 1)"""


@query(f"WITH {BINS} SELECT bin, round(s, 6) AS s FROM bins")
def air_threshold_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100).alias("v"))
    return histogram.smoothed_bins(histogram.grey_histogram(rows, "v")).select("bin", F.round("s", 6).alias("s"))


@query(
    f"""WITH {BINS}, n AS (SELECT bin, s, lag(s) OVER (ORDER BY bin) AS b, lead(s) OVER (ORDER BY bin) AS a FROM bins),
p AS (SELECT bin, s FROM n WHERE s > coalesce(b, -1) AND s >= coalesce(a, -1) AND s >= 0.005 * (SELECT max(s) FROM bins)),
l AS (SELECT p.bin, coalesce((SELECT min(x.s) FROM bins x WHERE x.bin < p.bin AND x.bin > coalesce((SELECT max(w.bin) FROM bins w WHERE w.bin < p.bin AND w.s > p.s), -1)), 0.0) AS lo,
  coalesce((SELECT min(x.s) FROM bins x WHERE x.bin > p.bin AND x.bin < coalesce((SELECT min(w.bin) FROM bins w WHERE w.bin > p.bin AND w.s > p.s), 1000000)), 0.0) AS hi FROM p)
SELECT p.bin, round(p.s, 6) AS s FROM p JOIN l USING (bin) WHERE greatest(lo, hi) <= 0.8 * p.s"""
)
def suggest_materials_peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100).alias("v"))
    return histogram.peaks(histogram.smoothed_bins(histogram.grey_histogram(rows, "v"))).select("bin", F.round("s", 6).alias("s"))


@query(
    f"""WITH {PARTS}, hist AS (SELECT grey::BIGINT AS v, count(*)::BIGINT AS n FROM vox GROUP BY 1), e AS (SELECT min(v) AS lo, greatest(1, (max(v) - min(v) + 64) // 64) AS w FROM hist),
c AS (SELECT bin, lo, w, sum(n) AS n, sum(n * bin) AS m FROM (SELECT (v - lo) // w AS bin, lo, w, n FROM hist, e) GROUP BY ALL),
t AS (SELECT bin, lo, w, (sum(n) OVER o)::DOUBLE AS n0, (sum(m) OVER o)::DOUBLE AS s0, (sum(n) OVER ())::DOUBLE AS na, (sum(m) OVER ())::DOUBLE AS sa FROM c WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
p AS (SELECT a.bin AS p, b.bin AS q, a.lo, a.w, round(a.s0 * a.s0 / a.n0 + (b.s0 - a.s0) * (b.s0 - a.s0) / (b.n0 - a.n0) + (b.sa - b.s0) * (b.sa - b.s0) / (b.na - b.n0), 4) AS s FROM t a JOIN t b ON a.bin < b.bin AND b.n0 < b.na)
SELECT (lo + (p + 1) * w)::BIGINT AS t1, (lo + (q + 1) * w)::BIGINT AS t2 FROM p ORDER BY s DESC, p, q LIMIT 1"""
)
def multi_otsu_3(spark, sf_dir):
    return histogram.multi_otsu_3(histogram.grey_histogram(parts(spark, sf_dir)), 64)


BLOCKS = "blk AS (SELECT x // 8 AS bx, y // 8 AS by, z // 8 AS bz, count(*) AS n, sum(grey) AS s, sum(grey * grey) AS q, max(grey) AS top, count(*) FILTER (grey > {t}) AS above, count(*) FILTER (grey < {t}) AS below FROM vox GROUP BY 1, 2, 3)"


@query(f"WITH {PARTS}, {BLOCKS.format(t=40)} SELECT bx, by, bz, n::BIGINT AS n, round((s / n)::DOUBLE, 6) AS mean, round(((n * q - s * s) / (n * n))::DOUBLE, 6) AS variance FROM blk")
def block_mean_variance(spark, sf_dir):
    got = blocks.block_statistics(parts(spark, sf_dir), 40)
    return got.select("bx", "by", "bz", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"WITH {PARTS}, {BLOCKS.format(t=60)} SELECT bx, by, bz, above >= 5 AS material FROM blk")
def block_classify(spark, sf_dir):
    return blocks.classify_blocks(parts(spark, sf_dir), 60, 5)


@query(f"WITH {PARTS}, r AS (SELECT x // 8 AS bx, y // 8 AS by, z // 8 AS bz, row_number() OVER (PARTITION BY x // 8, y // 8, z // 8 ORDER BY grey DESC, z, y, x) AS rank, grey FROM vox) SELECT bx, by, bz, rank::INT AS rank, grey FROM r WHERE rank <= 3")
def k_largest_per_block(spark, sf_dir):
    return blocks.k_largest(parts(spark, sf_dir), 3)


FLOOD = """air AS (SELECT bx, by, bz FROM blk WHERE above < 1), edge AS (SELECT * FROM air WHERE bx IN (0, {m}) OR by IN (0, {m}) OR bz IN (0, {m})),
flood AS (SELECT * FROM edge UNION SELECT a.bx, a.by, a.bz FROM flood f, """ + OFF[6] + """ o(dx, dy, dz), air a WHERE a.bx = f.bx + dx AND a.by = f.by + dy AND a.bz = f.bz + dz)"""
FINE = BLOCKS.replace('// 8', '// 4')


@query(f"WITH RECURSIVE {TEXTURE}, {FINE.format(t=970)}, {FLOOD.format(m=7)} SELECT * FROM flood")
def outside_air_blocks(spark, sf_dir):
    return blocks.outside_air(blocks.classify_blocks(texture(spark, sf_dir), 970, 1, 4), (8, 8, 8))


@query(f"WITH RECURSIVE {PARTS}, {BLOCKS.format(t=110)}, {FLOOD.format(m=7)} SELECT * FROM flood")
def outside_air_blocks_parts(spark, sf_dir):
    return blocks.outside_air(blocks.classify_blocks(parts(spark, sf_dir), 110), (8, 8, 8))


DILATE = "d0 AS ({start}), " + ", ".join(
    f"d{k} AS (SELECT DISTINCT d.x + dx AS x, d.y + dy AS y, d.z + dz AS z FROM d{k - 1} d, (SELECT * FROM {OFF[18]} o(dx, dy, dz) UNION ALL SELECT 0, 0, 0) WHERE d.x + dx BETWEEN 0 AND {{m}} AND d.y + dy BETWEEN 0 AND {{m}} AND d.z + dz BETWEEN 0 AND {{m}})" for k in (1, 2, 3)
)


@query(
    f"""WITH RECURSIVE {TEXTURE}, {FINE.format(t=990)}, {FLOOD.format(m=7)},
{DILATE.format(m=31, start="SELECT x, y, z FROM vox WHERE NOT EXISTS (SELECT 1 FROM flood f WHERE f.bx = x // 4 AND f.by = y // 4 AND f.bz = z // 4)")}
SELECT x, y, z, grey FROM vox JOIN d3 USING (x, y, z)"""
)
def sieve_voxels(spark, sf_dir):
    return blocks.sieve(texture(spark, sf_dir), 990, (HALF,) * 3, block=4).select("x", "y", "z", "grey")


@query(f"WITH {SPARSE}, {DILATE.format(m=63, start='SELECT x, y, z FROM m WHERE grey >= 120')} SELECT * FROM d3")
def margin_dilation(spark, sf_dir):
    return blocks.dilate(sparse(spark, sf_dir, 120), 3, 18, BOX)


@query(f"WITH {PARTS}, m AS (SELECT * FROM vox WHERE grey >= 5) SELECT a.x, a.y, a.z FROM m a, {OFF[6]} o(dx, dy, dz), m b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(*) = 6")
def erode(spark, sf_dir):
    return blocks.erode(sparse(spark, sf_dir, 5), 6)


@query(f"WITH {PARTS} SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, ((2 * sum(grey) + count(*)) // (2 * count(*)))::INT AS grey FROM vox GROUP BY 1, 2, 3")
def pyramid_level1(spark, sf_dir):
    return blocks.pyramid_level(parts(spark, sf_dir))


@query(f"WITH {PARTS}, l AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, (2 * sum(grey) + count(*)) // (2 * count(*)) AS grey FROM vox GROUP BY 1, 2, 3) SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, ((2 * sum(grey) + count(*)) // (2 * count(*)))::INT AS grey FROM l GROUP BY 1, 2, 3")
def pyramid_level2(spark, sf_dir):
    return blocks.pyramid_level(blocks.pyramid_level(parts(spark, sf_dir)))


@query(f"WITH {PARTS}, c AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, grey % 4 AS label, count(*) AS n FROM vox WHERE grey % 4 > 0 GROUP BY ALL) SELECT x, y, z, label::INT AS label FROM c QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) = 1")
def label_majority(spark, sf_dir):
    return blocks.majority_level(parts(spark, sf_dir).select("x", "y", "z", (F.col("grey") % 4).alias("label")))


@query(f"WITH {PARTS}, g AS (SELECT (10 + i % 20)::INT AS x, (5 + i // 20 % 10)::INT AS y, (30 + i // 200)::INT AS z FROM range(1600) r(i)) SELECT x, y, z, coalesce(grey, -1) AS grey FROM g LEFT JOIN vox USING (x, y, z)")
def region_read_fill(spark, sf_dir):
    return volume.read_region(parts(spark, sf_dir), ((10, 5, 30), (30, 15, 38)), -1)


@query(f"WITH {PARTS} SELECT p.s_suppkey, p.x, p.y, p.z, grey FROM (SELECT s_suppkey, (s_suppkey % 64)::INT AS x, (s_nationkey % 64)::INT AS y, (s_suppkey * 7 % 64)::INT AS z FROM supplier) p LEFT JOIN vox USING (x, y, z)")
def point_sample(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    points = s.select("s_suppkey", (F.col("s_suppkey") % 64).cast("int").alias("x"), (F.col("s_nationkey") % 64).cast("int").alias("y"), (F.col("s_suppkey") * 7 % 64).cast("int").alias("z"))
    return volume.point_sample(parts(spark, sf_dir), points).select("s_suppkey", "x", "y", "z", "grey")


@query(f"WITH {PARTS} SELECT v.x, v.y, v.grey, coalesce(b.grey >= 60, false) AS material FROM vox v LEFT JOIN vox b ON b.x = v.x AND b.y = v.y AND b.z = v.z AND b.grey >= 60 WHERE v.z = 17")
def slice_z(spark, sf_dir):
    v = parts(spark, sf_dir)
    overlay = v.where("grey >= 60").select("x", "y", "z", F.lit(True).alias("material"))
    return v.where("z = 17").join(overlay, ["x", "y", "z"], "left").select("x", "y", "grey", F.coalesce("material", F.lit(False)).alias("material"))


@query(f"WITH {PARTS}, p AS (SELECT (k % 40)::INT AS i, (k // 40)::INT AS j FROM range(1600) r(k)) SELECT i, j, coalesce(grey, 0) AS grey FROM p LEFT JOIN vox ON x = floor(3.25 + i * 1.25 + j * 0.25 + 0.5) AND y = floor(2.0 + i * 0.5 + j * 0.75 + 0.5) AND z = floor(1.0 + i * 0.25 + j * 1.0 + 0.5)")
def oblique_plane_nearest(spark, sf_dir):
    return volume.oblique_nearest(parts(spark, sf_dir), 40, 40, (3.25, 2.0, 1.0), (1.25, 0.5, 0.25), (0.25, 0.75, 1.0), 0)


@query(
    f"""WITH {PARTS}, p AS (SELECT (k % 40)::INT AS i, (k // 40)::INT AS j FROM range(1600) r(k)), c AS (SELECT i, j, 3.25 + i * 1.25 + j * 0.25 AS cx, 2.0 + i * 0.5 + j * 0.75 AS cy, 1.0 + i * 0.25 + j * 1.0 AS cz FROM p),
w AS (SELECT i, j, (floor(cx) + dx)::INT AS x, (floor(cy) + dy)::INT AS y, (floor(cz) + dz)::INT AS z, CASE dx WHEN 1 THEN cx - floor(cx) ELSE 1 - cx + floor(cx) END * CASE dy WHEN 1 THEN cy - floor(cy) ELSE 1 - cy + floor(cy) END * CASE dz WHEN 1 THEN cz - floor(cz) ELSE 1 - cz + floor(cz) END AS w
  FROM c, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) d(dz))
SELECT i, j, round(sum(w * coalesce(grey, 2))::DOUBLE, 6) AS value FROM w LEFT JOIN vox USING (x, y, z) GROUP BY i, j HAVING count(grey) > 0"""
)
def oblique_plane_trilinear(spark, sf_dir):
    got = volume.oblique_trilinear(parts(spark, sf_dir), 40, 40, (3.25, 2.0, 1.0), (1.25, 0.5, 0.25), (0.25, 0.75, 1.0), 2.0)
    return got.select("i", "j", F.round("value", 6).alias("value"))


@query(f"WITH {PARTS}, e AS (SELECT quantile_disc(grey, 0.005) AS lo, quantile_disc(grey, 0.995) AS hi FROM vox) SELECT x, y, z, floor(least(greatest((grey - lo) * 255.0 / greatest(hi - lo, 1), 0), 255) + 0.5)::INT AS byte FROM vox, e")
def volume_preview(spark, sf_dir):
    return volume.window_to_bytes(parts(spark, sf_dir))


@query(f"WITH {SPARSE} SELECT DISTINCT x // 16 AS bx, y // 16 AS by, z // 16 AS bz FROM m")
def occupied_bricks(spark, sf_dir):
    return volume.occupied_bricks(sparse(spark, sf_dir), 16)


@query(f"WITH {PARTS} SELECT x, y, z, grey FROM vox WHERE x * 0.5 + y * 1.0 - z * 0.25 <= 30 AND x * -1.0 <= -8")
def cut_plane_crop(spark, sf_dir):
    return volume.crop(parts(spark, sf_dir), [((0.5, 1.0, -0.25), 30.0), ((-1.0, 0.0, 0.0), -8.0)])


@query(f"WITH {PARTS} SELECT x, y, z, grey, (100.0 + 0.25 * grey)::DOUBLE AS value FROM vox")
def value_mapping(spark, sf_dir):
    return volume.map_values(parts(spark, sf_dir), 100.0, 0.25)


@query("SELECT event_id, (floor(least(greatest((value - 10.0) * 65535.0 / 80.0, 0.0), 65535.0) + 0.5))::INT AS grey, value < 10 OR value > 90 AS clipped FROM events")
def float_to_16_bit(spark, sf_dir):
    return volume.float_to_grey(table(spark, sf_dir, "events"), "value", 10.0, 90.0).select("event_id", "grey", "clipped")


@query(
    f"""WITH {PARTS}, n AS (SELECT *, CASE WHEN lead(z) OVER w = z + 1 THEN lead(grey) OVER w END AS high FROM vox WINDOW w AS (PARTITION BY x, y ORDER BY z))
SELECT x, y, z * 3 + k AS z, CASE k WHEN 0 THEN grey ELSE floor((grey * (3 - k) + high * k) / 3.0 + 0.5)::INT END AS grey FROM n, (VALUES (0), (1), (2)) s(k) WHERE k = 0 OR high IS NOT NULL"""
)
def interpolate_slices(spark, sf_dir):
    return volume.interpolate_slices(parts(spark, sf_dir), 3)


@query(f"WITH {PARTS} SELECT x, y, z, grey FROM vox WHERE z < 20 UNION ALL SELECT x, y, (z - 40 + 20)::INT AS z, grey FROM vox WHERE z >= 40")
def concat_volumes(spark, sf_dir):
    v = parts(spark, sf_dir)
    return volume.concatenate(v.where("z < 20"), v.where("z >= 40").withColumn("z", F.col("z") - 40), "z", 20)


@query(
    f"""WITH {PARTS}, g AS (SELECT (i % 64)::INT AS x, (i // 64 % 64)::INT AS y, (i // 4096)::INT AS z FROM range(262144) r(i)), f AS (SELECT x, y, z, coalesce(grey, 0) AS g FROM g LEFT JOIN vox USING (x, y, z)),
a AS (SELECT x, y, z, sum(g) OVER (PARTITION BY y, z ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM f), b AS (SELECT x, y, z, sum(g) OVER (PARTITION BY x, z ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM a)
SELECT x, y, z, (sum(g) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS grey FROM b"""
)
def box_filter(spark, sf_dir):
    return volume.box_filter(parts(spark, sf_dir), 1, BOX, 0)


@query(f"WITH {PARTS} SELECT y, z, sum(CASE WHEN grey >= 40 THEN 40 ELSE grey END)::BIGINT AS value FROM vox GROUP BY 1, 2")
def thickness_projection(spark, sf_dir):
    return volume.mip(parts(spark, sf_dir), "x", F.least(F.col("grey"), F.lit(40)))


@query("WITH RECURSIVE bits AS (SELECT s_suppkey, (s_suppkey % 64)::BIGINT AS x, (s_nationkey % 64)::BIGINT AS y, (s_suppkey * 7 % 64)::BIGINT AS z FROM supplier) SELECT s_suppkey, (" + " + ".join(f"(((x >> {b}) & 1) << {3 * b}) + (((y >> {b}) & 1) << {3 * b + 1}) + (((z >> {b}) & 1) << {3 * b + 2})" for b in range(8)) + ")::BIGINT AS code FROM bits")
def morton_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cells = s.select("s_suppkey", (F.col("s_suppkey") % 64).alias("x"), (F.col("s_nationkey") % 64).alias("y"), (F.col("s_suppkey") * 7 % 64).alias("z"))
    return cells.select("s_suppkey", morton(bits=8).alias("code"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+', ''), lpad(p_partkey::VARCHAR, 12, '0'))::INT AS place FROM part")
def natural_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace("p_brand", "[0-9]+", ""), F.lit("-"), F.col("p_partkey").cast("string"))
    return ranks(p.select("p_partkey", natural_key(name).alias("key")), [F.col("key")], "place").select("p_partkey", F.col("place").cast("int").alias("place"))


@query(f"WITH RECURSIVE {SPARSE}, {reach(6)} SELECT x, y, z, component FROM k JOIN cc USING (key)")
def components_6(spark, sf_dir):
    return components(sparse(spark, sf_dir), 6, brick=16)


@query(f"WITH RECURSIVE {PARTS}, m AS (SELECT * FROM vox WHERE grey >= 95), {reach(26)} SELECT x, y, z, component FROM k JOIN cc USING (key)")
def components_26(spark, sf_dir):
    return components(sparse(spark, sf_dir, 95), 26, brick=16)


STATS = "SELECT component, count(*)::BIGINT AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(z)::BIGINT AS sum_z, sum(x * y)::BIGINT AS sum_xy, sum(grey)::BIGINT AS sum_value, bool_or(x IN (0, 63) OR y IN (0, 63) OR z IN (0, 63)) AS touches_border FROM k JOIN cc USING (key) GROUP BY 1"


@query(f"WITH RECURSIVE {SPARSE}, {reach(6)} {STATS}")
def component_stats(spark, sf_dir):
    v = sparse(spark, sf_dir)
    labelled = components(v, 6, brick=16).join(v, ["x", "y", "z"])
    wanted = "component n min_x max_x min_y max_y min_z max_z sum_x sum_y sum_z sum_xy sum_value touches_border".split()
    return component_statistics(labelled, F.col("grey"), BOX).select(*wanted)


@query(f"WITH RECURSIVE {SPARSE}, {reach(6)}, t AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 3) SELECT x, y, z, component FROM k JOIN cc USING (key) SEMI JOIN t USING (component)")
def isolate_largest(spark, sf_dir):
    return keep_largest(components(sparse(spark, sf_dir), 6, brick=32), 3).select("x", "y", "z", "component")


@query(
    f"""WITH RECURSIVE {SPARSE}, {reach(6)}, f AS (SELECT component, x, y, z FROM k JOIN cc USING (key))
SELECT a.component, axis, (2 * count(*) - 2 * count(b.x))::BIGINT AS faces FROM f a CROSS JOIN (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) o(axis, dx, dy, dz) LEFT JOIN f b ON b.component = a.component AND b.x = a.x - dx AND b.y = a.y - dy AND b.z = a.z - dz GROUP BY 1, 2"""
)
def pore_faces_area(spark, sf_dir):
    return faces(components(sparse(spark, sf_dir), 6, brick=32))


@query(
    f"""WITH RECURSIVE {PARTS}, b AS (SELECT DISTINCT x // 4 AS bx, y // 4 AS by, z // 4 AS bz FROM vox WHERE grey >= 50), s AS (SELECT * FROM b WHERE bx = 0),
d AS (SELECT bx, by, bz, 0 AS depth FROM s UNION SELECT b.bx, b.by, b.bz, d.depth + 8 FROM d, {OFF[6]} o(dx, dy, dz), b WHERE b.bx = d.bx + dx AND b.by = d.by + dy AND b.bz = d.bz + dz AND d.depth < 32)
SELECT bx, by, bz, min(depth)::INT AS depth FROM d GROUP BY 1, 2, 3"""
)
def block_depth(spark, sf_dir):
    b = parts(spark, sf_dir).where("grey >= 50").select(*blocks.block_columns(4)).distinct()
    return blocks.block_depth(b, b.where("bx = 0"), 4).withColumn("depth", F.col("depth").cast("int"))


@query(
    f"""WITH {PARTS}, b AS (SELECT x // 8 AS bx, y // 8 AS b_y, z // 8 AS bz, least(count(*) * 2, 512) / 512.0::DOUBLE AS f FROM vox GROUP BY 1, 2, 3)
SELECT b.bx, b.b_y, b.bz, min(8 * (b.f + coalesce(n.f, 0)) - 4)::DOUBLE AS depth
FROM b, {OFF[6]} o(dx, dy, dz) LEFT JOIN b n ON n.bx = b.bx + dx AND n.b_y = b.b_y + dy AND n.bz = b.bz + dz
WHERE b.f >= 0.5 AND coalesce(n.f, 0) < 1 GROUP BY 1, 2, 3"""
)
def depth_seeds(spark, sf_dir):
    filled = parts(spark, sf_dir).groupBy(*blocks.block_columns(8)).agg(F.least(F.count("*") * 2, F.lit(512)).alias("n"))
    return blocks.depth_seeds(filled).withColumnRenamed("by", "b_y")


@query()
def distance_map(spark, sf_dir):
    return distance.distance_map(parts(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query()
def part_depths(spark, sf_dir):
    """How deep each block of the parts' volume lies, by all ways through blocks that are at least half full."""
    filled = stage(parts(spark, sf_dir).groupBy(*blocks.block_columns(4)).agg(F.least(F.count("*") * 2, F.lit(64)).alias("n")), "filled")
    return blocks.block_depth(filled.where("n >= 32"), blocks.depth_seeds(filled, 64, 4), step=4)


@query()
def flagship_porosity_phantom(spark, sf_dir):
    """The pores of the noise-free phantom: histogram, threshold, outside air, candidates and their components; those
    that touch removed voxels are outside air."""
    v = stage(bricks.phantom_bricks(spark, FLAGSHIP), "phantom")
    threshold = histogram.otsu(bricks.histogram(v)).first()["threshold"]
    return bricks.find_pores(v, (FLAGSHIP.size,) * 3, threshold).select("voxels")
