"""Queries whose operators are numerical kernels; they are held against brute force or known shapes in the tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brickwise.operators import battery, blocks, dimensional, filters, histogram, mixture, surface
from brickwise.operators.generate import add_noise, wound_cell
from brickwise.plans.volumes import BOX, HALF, PARTS, TEXTURE, parts, table, texture

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def gaussian_mixture(spark, sf_dir):
    return mixture.suggest_mixture(histogram.grey_histogram(parts(spark, sf_dir)))


@query
def noisy_phantom(spark, sf_dir):
    return add_noise(texture(spark, sf_dir), HALF, HALF, 50.0, 42)


@query
def non_local_means(spark, sf_dir):
    return filters.non_local_means(texture(spark, sf_dir), 200.0, search=3, brick=32)


@query
def gaussian_smooth(spark, sf_dir):
    return filters.gaussian_smooth(parts(spark, sf_dir), 1.0, 2).withColumn("value", F.round("value", 6))


@query
def thickness_map(spark, sf_dir):
    return filters.thickness_map(texture(spark, sf_dir).where("grey > 10"), 3, brick=16)


@query
def surface_mesh(spark, sf_dir):
    return surface.extract_surface(texture(spark, sf_dir), 985.0, 16)


@query
def surface_band_codes(spark, sf_dir):
    from brickwise.operators import levelset

    return levelset.surface_codes(texture(spark, sf_dir), 985.0, 2.0, 8, 16)


@query
def surface_points(spark, sf_dir):
    return surface.surface_points(texture(spark, sf_dir), 500.0).select("axis", *[F.round(c, 9).alias(c) for c in "xyz"])


@query
def fibre_families(spark, sf_dir):
    return filters.fibre_directions(filters.structure_tensors(texture(spark, sf_dir), 8), 8)


@query
def orientation_tensor(spark, sf_dir):
    return filters.orientation_tensor(fibre_families(spark, sf_dir))


@query
def reprojection(spark, sf_dir):
    return filters.reproject(texture(spark, sf_dir), HALF)


@query
def rigid_fit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(*[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("px", "py", "pz", "qx", "qy", "qz"))])
    return spark.createDataFrame([(surface.rigid_fit(pairs),)], "matrix array<double>")


@query
def icp_round(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    m = e.select(*[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz", "r"))])
    return surface.icp_sums(m, 0.01)


@query
def circle_fit(spark, sf_dir):
    a = F.col("l_partkey") % 360 * (math.pi / 180)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("section"), (5 + F.col("l_linenumber") * F.cos(a)).alias("x"), (7 + F.col("l_linenumber") * F.sin(a)).alias("y"))
    return battery.fit_circles(battery.circle_sums(rows, ["section"]), ["section"])


@query
def wound_cell_profiles(spark, sf_dir):
    profiles = battery.radial_profiles(wound_cell(spark), (31.5, 31.5), 36, 32)
    return battery.peaks(profiles, ["z", "angle"], "r", "grey", 2000.0)


@query
def fit_elements(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem")
    a, t = F.col("l_partkey") % 360 * (math.pi / 180), F.col("l_suppkey") % 50 / 10.0
    kind = F.element_at(F.array(*map(F.lit, ("plane", "sphere", "cylinder"))), (F.col("l_linenumber") - 1) % 3 + 1)
    rows = s.select(
        F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("element"),
        kind.alias("kind"),
        F.when(kind == "plane", t).when(kind == "sphere", 4 * F.cos(a) * F.cos(t)).otherwise(2 * F.cos(a)).alias("x"),
        F.when(kind == "plane", F.sin(a)).when(kind == "sphere", 4 * F.sin(a) * F.cos(t)).otherwise(2 * F.sin(a)).alias("y"),
        F.when(kind == "plane", F.lit(3.0)).when(kind == "sphere", 4 * F.sin(t)).otherwise(t).alias("z"),
    )
    return dimensional.fit_elements(rows)


@query
def air_margin(spark, sf_dir):
    return blocks.dilate(parts(spark, sf_dir).where("grey >= 120"), 1, 26, BOX)


@query
def compare_nominal(spark, sf_dir):
    from brickwise.operators import compare

    volume = texture(spark, sf_dir)
    mesh = compare.nominal_mesh(surface.extract_surface(volume, 990.0, 16))
    points = surface.surface_points(volume, 985.0).select("x", "y", "z")
    return compare.deviations(compare.mesh_distance(points, mesh), 0.1)


_AXES = " UNION ALL ".join(
    f"SELECT '{c}' AS axis, " + ", ".join(f"round(a.{d} + (500.0::DOUBLE - a.grey) / (b.grey - a.grey), 9) AS {d}" if d == c else f"a.{d}::DOUBLE AS {d}" for d in "xyz")
    + " FROM vox a JOIN vox b ON " + " AND ".join(f"b.{d} = a.{d}" + (" + 1" if d == c else "") for d in "xyz") + " WHERE (a.grey >= 500) <> (b.grey >= 500)"
    for c in "xyz"
)
SQL["surface_points"] = f"WITH {TEXTURE} {_AXES}"
_NEAR = "CROSS JOIN range({lo}, {hi}) i(dx) CROSS JOIN range({lo}, {hi}) j(dy) CROSS JOIN range({lo}, {hi}) k(dz)"
SQL["air_margin"] = f"WITH {PARTS} SELECT DISTINCT (x + dx)::INT AS x, (y + dy)::INT AS y, (z + dz)::INT AS z FROM vox {_NEAR.format(lo=-1, hi=2)} WHERE grey >= 120 AND x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63 AND z + dz BETWEEN 0 AND 63"
SQL["gaussian_smooth"] = f"""WITH {PARTS}, s AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, exp(-0.5 * (dx * dx + dy * dy + dz * dz)) AS w, grey FROM vox {_NEAR.format(lo=-2, hi=3)})
SELECT vox.x, vox.y, vox.z, round(sum(w * s.grey) / sum(w), 6) AS value FROM vox JOIN s ON s.x = vox.x AND s.y = vox.y AND s.z = vox.z GROUP BY ALL"""
