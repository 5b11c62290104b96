"""Operators against brute force and shapes known by construction."""

import numpy as np
import pytest

from brickwise.operators import blocks, components, dimensional, filters, mixture, porosity, surface
from brickwise.operators.generate import Phantom, add_noise, box_phantom, gaussian_noise, phantom_volume
from brickwise.operators.region import Region
from brickwise.plans.registry import OPERATIONS, Project
from brickwise.streaming.events import stream, windowed_counts

SMALL = Phantom(size=24, pitch=0.5)


def table(spark, array, name="grey"):
    at = np.argwhere(np.ones(array.shape))
    return spark.createDataFrame([(*map(int, p), int(array[tuple(p)])) for p in at], f"x int, y int, z int, {name} int")


def test_phantom_volume(spark):
    p = Phantom(size=48, pitch=0.25)
    got = porosity.part_volume(box_phantom(spark, p), p.material, p.air, p.pitch**3).first()[0]
    assert got == pytest.approx(phantom_volume(p), rel=0.002)


def test_noise_is_the_same_however_dealt(spark):
    v = box_phantom(spark, SMALL)
    a, b = (sorted(add_noise(v.repartition(k), 24, 24, 300.0, 7).collect()) for k in (1, 5))
    noise = gaussian_noise(7, np.arange(100_000))
    assert a == b and abs(noise.mean()) < 0.02 and abs(noise.std() - 1) < 0.02


def flood(mask, offsets):
    label, names = {}, 0
    for p in map(tuple, np.argwhere(mask)):
        if p not in label:
            stack, label[p] = [p], names
            while stack:
                q = stack.pop()
                for o in offsets:
                    r = tuple(a + b for a, b in zip(q, o, strict=True))
                    if r not in label and all(0 <= c < n for c, n in zip(r, mask.shape, strict=True)) and mask[r]:
                        label[r] = names
                        stack.append(r)
            names += 1
    return label


@pytest.mark.parametrize("count", [6, 26])
@pytest.mark.parametrize("brick", [3, 5, 64])
def test_components_against_a_serial_flood(spark, count, brick):
    from brickwise.functions.keys import offsets

    mask = np.random.default_rng(count).random((11, 9, 10)) < (0.28 if count == 6 else 0.1)
    df = table(spark, mask.astype(int)).where("grey = 1")
    got = {(r.x, r.y, r.z): r.component for r in components.components(df, count, brick=brick).collect()}
    want = flood(mask, offsets(count))
    assert got.keys() == want.keys() and len(set(zip(got.values(), (want[p] for p in got), strict=True))) == len(set(got.values())) == len(set(want.values()))


def test_sieve_keeps_inner_voids(spark):
    v = box_phantom(spark, SMALL)
    kept = {(r.x, r.y, r.z) for r in blocks.sieve(v, 10000.0, (24, 24, 24), 1, block=2).collect()}
    assert (12, 12, 12) in kept and (0, 0, 0) not in kept


def test_distance_transform_by_brute_force():
    mask = np.random.default_rng(3).random((7, 8, 6)) < 0.8
    out = np.argwhere(~mask)
    want = np.zeros(mask.shape)
    for p in np.argwhere(mask):
        want[tuple(p)] = ((out - p) ** 2).sum(1).min()
    assert (filters.distance_transform(mask) == want).all()


@pytest.mark.parametrize("brick", [8, 32])
def test_thickness_of_a_plate(spark, brick):
    v = np.zeros((16, 16, 12), dtype=int)
    v[:, :, 4:9] = 1
    got = filters.thickness_map(table(spark, v).where("grey = 1"), 4, brick=brick).collect()
    inner = {r.thickness for r in got if 4 <= r.x < 12 and 4 <= r.y < 12}
    assert inner == {5.5}


def test_denoising_lowers_the_error_and_ignores_bricks(spark):
    clean = box_phantom(spark, SMALL)
    noisy = add_noise(clean, 24, 24, 800.0, 3)
    a, b = ({(r.x, r.y, r.z): r.value for r in filters.non_local_means(noisy, 800.0, search=1, brick=k).collect()} for k in (8, 24))
    assert a.keys() == b.keys() and all(abs(a[p] - b[p]) < 1e-6 for p in a)
    truth = {(r.x, r.y, r.z): r.grey for r in clean.collect()}
    raw = {(r.x, r.y, r.z): r.grey for r in noisy.collect()}
    rmse = lambda v: np.sqrt(np.mean([(v[p] - truth[p]) ** 2 for p in truth]))
    assert rmse(a) < 0.7 * rmse(raw)


def test_back_projection_restores_a_disc():
    n = 48
    x, y = np.mgrid[:n, :n] - (n - 1) / 2
    image = ((x - 5) ** 2 + y**2 < 100).astype(float)
    angles = np.pi * np.arange(90) / 90
    back = filters.back_project(filters.project_slice(image, angles), angles)
    assert np.abs(back - image)[image == 1].mean() < 0.1 and np.abs(back).max() < 1.6


def test_mesh_of_a_ball(spark):
    x, y, z = np.mgrid[:20, :20, :20] - 9.5
    v = np.clip(1000 * (6.5 - np.sqrt(x**2 + y**2 + z**2)) + 5000, 0, 10000)
    for brick in (8, 32):
        got = surface.mesh_measures(surface.extract_surface(table(spark, v), 5000.0, brick)).first()
        assert got.area == pytest.approx(4 * np.pi * 6.5**2, rel=0.03)


def test_rigid_fit(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(50, 3))
    a = 0.7
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    q = p @ r.T + [1, 2, 3]
    m = np.array(surface.rigid_fit(spark.createDataFrame(np.c_[p, q].tolist(), "px double, py double, pz double, qx double, qy double, qz double"))).reshape(4, 4)
    assert np.allclose(m[:3, :3], r) and np.allclose(m[:3, 3], [1, 2, 3])
    with pytest.raises(ValueError):
        surface.rigid_fit(spark.createDataFrame([[float(k)] * 6 for k in range(5)], "px double, py double, pz double, qx double, qy double, qz double"))


def test_element_fits():
    rng = np.random.default_rng(5)
    a, t = rng.uniform(0, 6.28, 400), rng.uniform(-3, 3, 400)
    axis = np.array([0.6, 0.0, 0.8])
    u, v = np.array([0.8, 0, -0.6]), np.array([0, 1.0, 0])
    cyl = np.array([1, 2, 3]) + t[:, None] * axis + 2.5 * (np.cos(a)[:, None] * u + np.sin(a)[:, None] * v)
    cyl[:3] += 3
    got = dimensional.fit_element("cylinder", cyl + 0.001 * rng.normal(size=cyl.shape))
    assert got["radius"] == pytest.approx(2.5, abs=0.005) and abs(np.dot([got["dx"], got["dy"], got["dz"]], axis)) > 0.9999 and got["n"] <= 398
    with pytest.raises(ValueError):
        dimensional.fit_element("cone", cyl)


def test_mixture_finds_two_classes():
    v = np.arange(200.0)
    n = 1e5 * (0.3 * np.exp(-0.5 * ((v - 50) / 8) ** 2) + 0.7 * np.exp(-0.5 * ((v - 140) / 12) ** 2))
    m = mixture.fit_mixture(v, n, 2)
    assert np.allclose(m["mean"], [50, 140], atol=0.5) and np.allclose(m["sigma"], [8, 12], atol=0.5) and m["ambiguous"] < 0.01


def test_regions(spark):
    r = Region.parse({"include": [{"type": "box", "min": [0, 0, 0], "max": [4, 4, 4]}], "exclude": [{"type": "sphere", "center": [0, 0, 0], "radius": 2}]})
    from pyspark.sql import functions as F

    df = table(spark, np.zeros((6, 6, 6)))
    assert df.where(r.contains(F.col("x"), F.col("y"), F.col("z"))).count() == 64 - 11
    assert r.bounds() == ((0, 0, 0), (4, 4, 4))
    with pytest.raises(ValueError):
        Region.parse({"include": [{"type": "torus"}]})


def test_project_records_steps(spark, tmp_path):
    box_phantom(spark, SMALL).write.parquet(str(tmp_path / "scan"))
    p = Project.open(spark, str(tmp_path / "project"))
    with pytest.raises(ValueError, match="no dataset"):
        p.run("porosity")
    p.run("open_dataset", {"path": str(tmp_path / "scan")})
    p.run("sieve", {"size": 24, "margin": 1})
    done = p.run("porosity")
    assert done["inputs"] == {"dataset": 2} and p.result(done).count() >= 1
    again = Project.open(spark, str(tmp_path / "project"))
    assert [s["operation"] for s in again.steps] == ["open_dataset", "sieve", "porosity"]
    again.undo()
    assert again.latest("porosity") is None
    again.redo()
    assert again.latest("porosity")["id"] == 3
    assert OPERATIONS["sieve"].check({})["size"] == OPERATIONS["sieve"].check({"size": 0})["size"] == 0  # sizes are read from the voxels then
    for bad in ({"size": -1}, {"size": "a"}, {"size": 24, "nothing": 1}):
        with pytest.raises(ValueError):
            OPERATIONS["sieve"].check(bad)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(stream(spark, str(tmp_path / "in"), events.schema), late="400 days").writeStream.outputMode("complete").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("out").collect()) == sorted(windowed_counts(events).collect())
