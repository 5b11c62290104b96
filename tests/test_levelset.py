import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import levelset, surface
from tests.test_compare import box_mesh


def ball(radius=6.0, n=20, centre=9.3):
    x, y, z = np.mgrid[0:n, 0:n, 0:n] - centre
    return np.sqrt(x * x + y * y + z * z) - radius


def volume_of(t):
    return float((t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6)


def voxels_of(spark, grey):
    x, y, z = (v.ravel().tolist() for v in np.indices(grey.shape))
    return spark.createDataFrame(list(zip(x, y, z, grey.ravel().tolist(), strict=True)), "x int, y int, z int, grey double").repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_triangles_wind_outward(seed):
    rng = np.random.default_rng(seed)
    grey = 10_000 - 3000 * ball(8.0 + seed, 28, 13 + rng.uniform(-0.5, 0.5))
    t = surface.iso_triangles(grey, 10_000.0)
    assert volume_of(t) == pytest.approx(4 / 3 * np.pi * (8.0 + seed) ** 3, rel=0.01)
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    away = t.mean(1) - t.reshape(-1, 3).mean(0)
    assert ((n * away).sum(1) >= -1e-9).all()


def test_random_values_make_a_closed_surface():
    """Every side of a triangle is met by another one that runs the other way."""
    grey = np.pad(np.random.default_rng(4).uniform(0, 1, (7, 8, 9)), 1)
    t = np.round(surface.iso_triangles(grey, 0.5), 9)
    sides = {}
    for a, b in ((0, 1), (1, 2), (2, 0)):
        for p, q in zip(map(tuple, t[:, a]), map(tuple, t[:, b]), strict=True):
            if p != q:
                sides[p, q] = sides.get((p, q), 0) + 1
    assert all(sides.get((q, p)) == n for (p, q), n in sides.items())


def test_distances_to_triangles():
    rng = np.random.default_rng(0)
    mesh = box_mesh(np.array([6.0, 4.0, 2.0]))
    p = rng.uniform(-3, 9, (400, 3))
    d2 = np.min([levelset.squared_distances(p, np.repeat(t[None], len(p), 0)) for t in mesh], axis=0)
    q = np.abs(p - [3, 2, 1]) - [3, 2, 1]
    assert np.sqrt(d2) == pytest.approx(np.abs(np.linalg.norm(np.maximum(q, 0), axis=1) + np.minimum(q.max(1), 0)), abs=1e-9)
    flat = np.array([[[0.0, 0, 0], [2, 0, 0], [4, 0, 0]], [[1.0, 1, 1]] * 3])
    assert levelset.squared_distances(np.array([[3.0, 2, 0], [1, 1, 3]]), flat).tolist() == [4, 4]


def test_bands_by_brute_force():
    rng = np.random.default_rng(2)
    t = rng.uniform(-1, 11, (40, 1, 3)) + rng.uniform(-1, 1, (40, 3, 3))
    got = levelset.band_distances(t, (10, 9, 8), 2.5)
    p = np.indices((10, 9, 8)).reshape(3, -1).T.astype(float)
    want = np.sqrt(np.min([levelset.squared_distances(p, np.repeat(x[None], len(p), 0)) for x in t], axis=0))
    assert got.ravel() == pytest.approx(np.where(want < 2.5, want, np.inf), abs=1e-12)
    assert np.isinf(levelset.band_distances(np.zeros((0, 3, 3)), (2, 2, 2), 1.0)).all()


def test_codes_keep_the_surface(spark):
    exact = ball()
    voxels = voxels_of(spark, 10_000 - 3000 * exact)
    codes = levelset.surface_codes(voxels, 10_000.0, 3.0, 8, brick=10, fill=-1e5).cache()
    back = {(r.x, r.y, r.z): r.distance for r in levelset.level_set(codes).collect()}
    assert len(back) == codes.count() and all(exact[k] <= 3.1 for k in back)
    near = [back[k] - exact[k] for k in back if abs(exact[k]) < 2.8]
    assert np.sqrt(np.mean(np.square(near))) < 0.05 and len(near) > 2000
    assert sum(exact[k] < -3.1 for k in back) == (exact < -3.1).sum() and all(back[k] == -3 for k in back if exact[k] < -3.1)
    got = surface.mesh_measures(levelset.surface_of_codes(codes, brick=10)).first()
    assert got.volume == pytest.approx(4 / 3 * np.pi * 216, rel=0.02) and got.area == pytest.approx(4 * np.pi * 36, rel=0.03)
    assert levelset.surface_codes(voxels, 1e9).count() == 0


def test_samples_have_outward_normals(spark):
    t = surface.extract_surface(voxels_of(spark, 10_000 - 3000 * ball(4.0, 14, 6.4)), 10_000.0, 8, -1e5)
    p = surface.surface_samples(t).select("x", "y", "z", "nx", "ny", "nz", "area").toPandas().to_numpy()
    away = p[:, :3] - 6.4
    assert ((away * p[:, 3:6]).sum(1) / np.linalg.norm(away, axis=1)).min() > 0.9
    assert np.linalg.norm(p[:, 3:6], axis=1) == pytest.approx(1.0) and p[:, 6].sum() == pytest.approx(4 * np.pi * 16, rel=0.03)
    assert t.agg(F.count("*")).first()[0] >= len(p)
