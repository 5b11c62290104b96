import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import plan, walls
from brickwise.operators.surface import extract_surface
from tests.test_compare import box_mesh


def slab(spark, thick, n=40):
    return spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.col("id") / n % n).cast("int").alias("y"), (F.col("id") / n**2).cast("int").alias("z")).withColumn("grey", F.when((F.col("x") >= 10) & (F.col("x") < 10 + thick), 20_000).otherwise(1000).cast("int"))


def faces(thick, lo=14, hi=26):
    return [(k, x, float(y), float(z), nx, 0.0, 0.0) for k, (x, nx, y, z) in enumerate((x, nx, y, z) for x, nx in ((9.5, -1.0), (9.5 + thick, 1.0)) for y in range(lo, hi) for z in range(lo, hi))]


POINT = "id long, x double, y double, z double, nx double, ny double, nz double"


def test_both_methods_measure_a_plate(spark):
    voxels = slab(spark, 7)
    points = spark.createDataFrame(faces(7), POINT)
    rays = walls.wall_by_rays(points, voxels, 10_500.0, 12, brick=16, fill=1000.0).collect()
    assert len(rays) == 288 and all(abs(r.thickness - 7) < 0.05 for r in rays)
    balls = [r.thickness for r in walls.wall_by_balls(points, 12, brick=16).collect() if 18 <= r.y <= 21 and 18 <= r.z <= 21]
    assert balls and all(abs(t - 7) < 0.3 for t in balls)
    assert all(r.thickness is None for r in walls.wall_by_rays(points, voxels, 10_500.0, 5, brick=16, fill=1000.0).collect())
    both = walls.against_nominal(spark.createDataFrame(rays), spark.createDataFrame([(9.5, 15.0, 15.0, 6.5)], "x double, y double, z double, thickness double"), 2.0).where("nominal is not null").collect()
    assert both and all(abs(r.difference - 0.5) < 0.05 for r in both)


def ball(radius, n=32, centre=15.3):
    x, y, z = np.mgrid[0:n, 0:n, 0:n] - centre
    return np.sqrt(x * x + y * y + z * z) - radius


def test_rays_need_a_surface_and_a_far_face():
    grey = 10_000 - 3000 * np.clip(ball(9.0), -2, 2)
    n = np.random.default_rng(0).normal(size=(500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    through = walls.ray_thickness(grey, 15.3 + 9 * n, n, 10_000.0, 24.0)
    assert np.abs(through - 18).max() < 0.05
    assert np.isnan(walls.ray_thickness(grey, 15.3 + 9 * n, n, 10_000.0, 17.0)).all()
    assert np.isnan(walls.ray_thickness(grey, 15.3 + 5 * n, n, 10_000.0, 24.0)).all()
    steep = np.array([[15.3, 15.3, 15.3 + 9.0]])
    slanting = np.array([[0.0, np.sin(1.3), np.cos(1.3)]])
    assert np.isnan(walls.ray_thickness(grey, steep, slanting, 10_000.0, 24.0)).all()
    assert len(walls.ray_thickness(grey, np.zeros((0, 3)), np.zeros((0, 3)), 10_000.0, 5.0)) == 0


def test_a_single_low_value_ends_no_wall():
    grey = np.full((40, 9, 9), 1000.0)
    grey[5:30] = 20_000
    grey[15] = 9000
    point, normal = np.array([[4.5, 4.0, 4.0]]), np.array([[-1.0, 0.0, 0.0]])
    assert walls.ray_thickness(grey, point, normal, 10_500.0, 30.0, step=1.0)[0] == pytest.approx(25, abs=0.6)
    grey[15:18] = 1000
    assert walls.ray_thickness(grey, point, normal, 10_500.0, 30.0, step=1.0)[0] == pytest.approx(10, abs=0.6)


def test_largest_balls_by_brute_force():
    rng = np.random.default_rng(1)
    top, bottom = rng.uniform(0, 30, (900, 3)), rng.uniform(0, 30, (900, 3))
    top[:, 2], bottom[:, 2] = 6 + 0.1 * top[:, 0] + rng.normal(0, 0.02, 900), 0
    points, normals = np.concatenate([top, bottom]), np.concatenate([np.tile([-0.0995, 0, 0.995], (900, 1)), np.tile([0, 0, -1.0], (900, 1))])
    got = walls.inscribed_diameters(points, normals, points, 12.0)
    for k in range(0, 1800, 37):
        best = 6.0
        for q in points:
            away = points[k] - q
            depth = away @ normals[k]
            if depth > 1e-9:
                r = away @ away / (2 * depth)
                if np.sqrt(away @ away) >= 2 * r * np.sin(np.radians(15)):
                    best = min(best, r)
        assert got[k] == pytest.approx(2 * best, rel=1e-12) if best < 6 else np.isnan(got[k])


@pytest.mark.parametrize("method", ["ray", "sphere"])
def test_thickness_of_a_whole_plate(spark, method):
    voxels = slab(spark, 6, 24)
    got = walls.wall_thickness(voxels, 10_500.0, 0.5, method, 12, 16, 1000.0).where("y between 5 and 6.5 and z between 5 and 6.5 and abs(nx) > 0.9").collect()
    assert len(got) > 20 and all(r.thickness == pytest.approx(3.0, abs=0.3) for r in got)
    with pytest.raises(ValueError):
        walls.wall_thickness(voxels, 1.0, method="guess")


def test_thin_regions(spark):
    rows = [(k, float(k), 0.0, 0.0, 1.0) for k in range(5)] + [(10 + k, 50.0 + k, 0.0, 0.0, 0.5) for k in range(3)] + [(20, 0.0, 9.0, 0.0, 5.0)]
    got = walls.thin_regions(spark.createDataFrame(rows, "id long, x double, y double, z double, thickness double"), 2.0, 1.5).orderBy("region").collect()
    assert [(r.region, r.n, r.least, r.size) for r in got] == [(1, 5, 1.0, 4.0), (2, 3, 0.5, 2.0)]


def cube(low, side):
    return box_mesh(np.full(3, float(side))) + low


def test_components_and_outer_skin(spark):
    t = np.concatenate([cube(np.zeros(3), 10.0), cube(np.full(3, 4.0), 2.0), cube(np.array([20.0, 0, 0]), 3.0)])
    rows = [(k, *x.ravel().tolist()) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in walls.CORNERS))
    assert {(r.id, r.component) for r in walls.mesh_components(df).select("id", "component").collect()} == {(k, k // 12 * 12) for k in range(36)}
    assert {r.id for r in walls.outer_skin(df).collect()} == set(range(12))


def test_display_mesh_and_material_mesh(spark):
    voxels = slab(spark, 8, 24)
    level, mesh = walls.display_mesh(voxels, 10_500.0, 1500, fill=1000.0)
    assert level >= 1 and mesh.count() <= 1500
    assert abs(mesh.agg(F.min("x1")).first()[0] - 9.5) < 1.5
    labels = voxels.select("x", "y", "z", F.when(F.col("grey") > 5000, 1).otherwise(2).alias("material"))
    assert walls.material_mesh(labels, 1).agg(F.min("x1"), F.max("x1")).first() == (9.5, 17.5)
    with pytest.raises(ValueError):
        walls.material_mesh(labels, 1, 3)


def test_features_of_a_design(spark):
    a = np.linspace(0, 2 * np.pi, 73)
    ring = np.c_[3 * np.cos(a), 3 * np.sin(a)]
    side = [t for k in range(72) for t in ([[*ring[k], 0], [*ring[k + 1], 0], [*ring[k + 1], 8]], [[*ring[k], 0], [*ring[k + 1], 8], [*ring[k], 8]])]
    cap = [[[0, 0, z], [*ring[k], z], [*ring[k + 1], z]] for z in (0, 8) for k in range(72)]
    got = plan.find_features(np.array(side + cap, float))
    assert sorted(got.kind) == ["cylinder", "plane", "plane"]
    c = got[got.kind == "cylinder"].iloc[0]
    assert abs(c.radius - 3) < 1e-3 and abs(abs(c.dz) - 1) < 1e-6 and abs(c.length - 8) < 1e-9
    box = plan.find_features(cube(np.zeros(3), 4.0))
    assert list(box.kind) == ["plane"] * 6


ELEMENT = "element string, kind string, cx double, cy double, cz double, dx double, dy double, dz double, radius double, form double, length double, worst double"


def test_plan_and_characteristics(spark):
    doc = {"elements": [{"id": n, "type": t} for n, t in (("A", "plane"), ("B", "cylinder"), ("C", "cylinder"), ("S", "sphere"))], "characteristics": [
        {"number": 1, "type": "diameter", "element": "B"}, {"number": 2, "type": "distance", "elements": ["B", "C"]}, {"number": 3, "type": "angle", "elements": ["A", "B"]},
        {"number": 4, "type": "coordinate", "element": "S", "axis": "y"}, {"number": 5, "type": "perpendicularity", "element": "B", "datum": "A"}, {"number": 6, "type": "flatness", "element": "A"},
        {"number": 7, "type": "position", "element": "C"}, {"number": 8, "type": "distance", "elements": ["A", "S"]}, {"number": 9, "type": "profile", "element": "S"}, {"number": 10, "type": "radius", "element": "S"},
    ]}
    e = [("A", "plane", 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.02, 10.0, 0.01), ("B", "cylinder", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.01, 6.0, 0.1), ("C", "cylinder", 3.0, 4.1, 0.0, 0.0, 0.0, 1.0, 1.0, 0.01, 6.0, 0.1), ("S", "sphere", 1.0, 2.0, 6.0, 0.0, 0.0, 0.0, 1.5, 0.0, 3.0, 0.2)]
    nominal = [(*r[:3], 4.0, *r[4:]) if r[0] == "C" else r for r in e]
    got = {r.number: r.measured for r in plan.characteristic_values(plan.parse_plan(spark, doc), spark.createDataFrame(e, ELEMENT), spark.createDataFrame(nominal, ELEMENT)).collect()}
    want = {1: 4.0, 2: float(np.hypot(3, 4.1)), 3: 90.0, 4: 2.0, 5: 0.0, 6: 0.02, 7: 0.2, 8: 5.0, 9: 0.4, 10: 1.5}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    for bad in ({"number": 1, "type": "colour", "element": "A"}, {"number": 1, "type": "distance", "element": "A"}, {"number": 1, "type": "flatness", "element": "Z"}, {"number": 1, "type": "parallelism", "element": "A"}, {"number": 1, "type": "coordinate", "element": "A"}):
        with pytest.raises(ValueError):
            plan.parse_plan(spark, doc | {"characteristics": [bad]})


def test_extraction_keeps_off_edges(spark):
    pts = [(float(x), 0.0, 0.1, 0.0, 0.0, 1.0) for x in range(-6, 7)] + [(0.0, 0.0, 3.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    e = spark.createDataFrame([("A", "plane", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 10.0, 0.0)], ELEMENT)
    got = plan.extract_points(spark.createDataFrame(pts, "x double, y double, z double, nx double, ny double, nz double"), e, 1.0, 1.0).collect()
    assert sorted(r.x for r in got) == [float(x) for x in range(-4, 5)] and {round(r.deviation, 9) for r in got} == {0.1}
