import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import bricks, cells, decide, hardening, inspect, shape, synthetic
from brickwise.sources import metadata


def test_enclosing_ball_holds_all_and_is_smallest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 60):
        p = rng.normal(size=(n, 3))
        c, r = inspect.enclosing_ball(p)
        d = np.linalg.norm(p - c, axis=1)
        assert (d <= r + 1e-9).all()
        on = p[d >= r - 1e-7]
        # No direction brings the centre nearer to all points on the ball.
        assert n == 1 or np.linalg.norm((on - c).mean(0)) < r and not any((((on - c) @ u) > 1e-6 * r).all() for u in rng.normal(size=(300, 3)))


def test_characteristics_of_a_block(spark):
    rows = [(x, y, z, 5) for x in range(4) for y in range(2) for z in range(3)] + [(20, 20, 20, 7)]
    got = {r.component: r for r in inspect.characteristics(spark.createDataFrame(rows, "x int, y int, z int, component long"), (0.5, 0.5, 1.0)).collect()}
    assert got[5].n == 24 and got[5].volume_mm3 == 6.0 and got[5].size_mm == 3.0
    assert math.isclose(got[5].area, (2 * 6 * 0.5 + 2 * 12 * 0.5 + 2 * 8 * 0.25) * 2 / 3)
    ball = 2 * math.sqrt(0.75**2 + 0.25**2 + 1.0**2) + 2 / 3
    assert math.isclose(got[5].enclosing, ball) and math.isclose(got[5].compactness, 6 / (math.pi / 6 * ball**3))
    assert math.isclose(got[7].enclosing, 2 / 3)


def test_numbers_by_place_and_volume(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.permutation(500), rng.integers(0, 50, 500), strict=True)]
    got = inspect.numbered(spark.createDataFrame(rows, "key long, v double").repartition(7), "key", "v").collect()
    assert sorted((r.id, r.key) for r in got) == [(k + 1, k) for k in range(500)]
    assert [r.key for r in sorted(got, key=lambda r: r.place)] == [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.place for r in got) == list(range(1, 501))


def test_reference_by_material(spark):
    rows = [(x, y, z, 100 if x < 8 else 300, 1 if x < 8 else 2) for x in range(20) for y in range(8) for z in range(8)]
    v = spark.createDataFrame(rows, "x int, y int, z int, grey int, material int").withColumn("grey", F.when(F.col("x") >= 16, 340).otherwise(F.col("grey")).cast("int"))
    v = v.withColumn("material", F.when((F.col("x") >= 16) & (F.col("y") < 4), 1).otherwise(F.col("material")))
    got = {r.bx: (r.n, r.reference) for r in inspect.material_reference(v, v).collect()}
    assert got == {0: (512, 100.0), 1: (512, 300.0), 2: (256, 200.0)}


def test_zones_grow_by_their_rim_and_lose_the_ring(spark):
    rows = [(x, y, z, 0.02 + (0.3 if max(abs(x - 6), abs(y - 6), abs(z - 6)) == 0 else 0.1 if max(abs(x - 6), abs(y - 6), abs(z - 6)) == 1 else 0.0)) for x in range(13) for y in range(13) for z in range(13)]
    d = spark.createDataFrame(rows, "bx int, by int, bz int, deficit double")
    (z,) = inspect.grown_zones(d, d.where("deficit > 0.05"), 0.01, 2).collect()
    assert z.blocks == 27 and math.isclose(z.void, 0.3 + 26 * 0.1) and (round(z.cx, 9), round(z.cy, 9), round(z.cz, 9)) == (6, 6, 6)
    assert inspect.grown_zones(d, d.where("deficit > 0.3"), 0.01, 2).collect() == []


def test_analysis_of_a_scan_with_known_pores(spark):
    s = synthetic.Scan(synthetic.box((4.0, 3.0, 3.0)), size=64, pitch=0.2, balls=[((1.0, 0.0, 0.0), 0.5), ((-2.0, 1.0, 0.5), 0.7)], noise=100.0)
    packed = synthetic.scan(spark, s)
    t = decide.otsu_of(decide.counts_of(bricks.histogram(packed)))
    got = inspect.analyse(bricks.unpack(bricks.sieve(packed, (64,) * 3, t)), (64,) * 3, (s.pitch,) * 3)
    truth = synthetic.ground_truth(s)
    pores = got.pores.orderBy("place").collect()
    assert [r.place for r in pores] == [1, 2] and np.allclose([r.volume_mm3 for r in pores], sorted(truth.void_volume_mm3, reverse=True), rtol=0.05)
    (m,) = got.summary.collect()
    assert abs(m.material_level - 20_000) < 100 and abs(m.part_volume_mm3 - 8 * 6 * 6) < 0.02 * 288 and m.pores == 2 and m.zones == 0


def test_thirteen_criteria(spark):
    limits = {f"limit_{c}": 1.0 for c in inspect.CRITERIA if c != "loosening"}
    zone = {"zone": "a", "x0": 0.0, "y0": 0.0, "z0": 0.0, "x1": 40.0, "y1": 40.0, "z1": 40.0, "part_mm3": 100.0, "count_min_size_mm": 1.0, "allow_loosening": False}
    empty = zone | {"zone": "b", "z0": 50.0, "z1": 60.0}
    pores = [(1, 1.0, 1.0, 1.0, 2.0, 3.0, 1.5, 4.0, 0.8, 0.5, 2.0), (2, 30.0, 5.0, 39.0, 1.0, 0.5, 1.0, 1.2, 0.9, 0.2, 0.7), (3, 1.0, 1.0, 45.0, 9.0, 9.0, 9.0, 9.0, 0.1, 0.1, 0.1), (4, 2.0, 2.0, 2.0, 50.0, 50.0, 50.0, 50.0, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(pores, "id long, x double, y double, z double, volume_mm3 double, size_mm double, equivalent double, enclosing double, sphericity double, compactness double, surface_distance double")
    loose = spark.createDataFrame([(5.0, 5.0, 5.0, 4.0)], "x double, y double, z double, void_mm3 double")
    gaps = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1)], "a long, b long, gap_mm double")
    ref = spark.createDataFrame([("a", 0.9)], "zone string, porosity double")
    rows = inspect.criteria(spark.createDataFrame([zone | limits, empty | limits]), p, loose, 200.0, F.col("id") == 4, gaps, ref).collect()
    got = {(r.zone, r.criterion): (r.measured, r.ok, r.pore) for r in rows}
    assert len(rows) == 26
    a = {c: got["a", c] for c in inspect.CRITERIA}
    assert a == {
        "max_pore_size_mm": (3.0, False, 1), "max_pore_count": (1.0, True, None), "max_porosity_percent": (7.0, False, None), "loosening": (1.0, False, None), "max_global_porosity_percent": (8.0, False, None),
        "max_reference_porosity_percent": (0.9, True, None), "max_pore_volume_mm3": (2.0, False, 1), "max_enclosing_diameter_mm": (4.0, False, 1), "max_equivalent_diameter_mm": (1.5, False, 1),
        "min_sphericity": (0.8, False, 1), "min_compactness": (0.2, False, 2), "min_pore_gap_mm": (0.5, False, 1), "min_surface_distance_mm": (0.7, False, 2),
    }
    assert all(ok for (z, c), (_, ok, _) in got.items() if z == "b" and c != "max_global_porosity_percent")


def test_warp_bends_back(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 10, (4000, 3))
    off = 0.3 * np.sin(p[:, 0] * 0.6)
    q = p + np.c_[np.zeros(4000), np.zeros(4000), off]
    n = rng.normal(size=(4000, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    df = spark.createDataFrame(np.hstack([p, q, n]).tolist(), ", ".join(f"{c} double" for c in ("x", "y", "z", "qx", "qy", "qz", "nx", "ny", "nz")))
    warp = shape.fit_warp(df, shape.Warp.over(p.min(0), p.max(0), 6), 1e-3)
    assert np.abs(warp(p) - q).mean() < 0.01
    moved = shape.warped(df.select("x", "y", "z"), warp).toPandas().to_numpy()
    assert np.allclose(np.sort(moved[:, 2]), np.sort(warp(p)[:, 2]))


def test_families_of_directions(spark):
    rng = np.random.default_rng(3)
    axes = np.array([[1, 0, 0], [0, 1, 0.2]]) / np.linalg.norm([[1, 0, 0], [0, 1, 0.2]], axis=1, keepdims=True)
    rows = []
    for k in range(90):
        f = int(k % 3 == 0)
        d = axes[f] * rng.choice([-1, 1]) + 0.05 * rng.normal(size=3)
        rows.append((k, f, 0, 10, (d / np.linalg.norm(d)).tolist()))
    got = shape.direction_families(spark.createDataFrame(rows, "bx int, by int, bz int, n long, direction array<double>"), 2).collect()
    assert all(r.family == r.by for r in got)


def test_models_on_tiles(spark):
    one = np.zeros((1, 1, 3, 3, 3), np.float32)
    one[0, 0] = 1 / 27
    two = np.array([[[[[1.0]]]], [[[[-1.0]]]]], np.float32)
    layers = [{"type": "conv", "weight": one, "bias": np.zeros(1, np.float32), "relu": False}, {"type": "conv", "weight": two, "bias": np.array([-0.5, 0.5], np.float32), "relu": False}]
    back = shape.read_model(shape.write_model(layers))
    assert all((a["weight"] == b["weight"]).all() and a["type"] == b["type"] for a, b in zip(layers, back, strict=True))
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 2, (20, 18, 16))
    v = spark.createDataFrame([(int(x), int(y), int(z), int(grey[x, y, z])) for x, y, z in np.ndindex(grey.shape)], "x int, y int, z int, grey int")
    got = shape.apply_model(v, back, brick=8, halo=2).toPandas()
    wide = np.zeros((22, 20, 18))
    wide[1:-1, 1:-1, 1:-1] = grey
    mean = sum(wide[a : a + 20, b : b + 18, c : c + 16] for a in range(3) for b in range(3) for c in range(3)) / 27
    clear = np.abs(mean - 0.5) > 1e-6
    assert all(m == int(mean[x, y, z] <= 0.5) for x, y, z, m in got.itertuples(index=False) if clear[x, y, z])
    unet = [{"type": "conv", "weight": one, "bias": np.zeros(1, np.float32), "relu": True}, {"type": "maxpool"}, {"type": "upsample"}, {"type": "concat", "with": 0}]
    assert shape.infer(unet, np.ones((1, 8, 8, 8), np.float32)).shape == (2, 8, 8, 8)
    with pytest.raises(ValueError):
        shape.read_model(b"x" * 40)


def test_hardening_is_taken_out(spark):
    n = 33
    y, x = np.mgrid[:n, :n] - n // 2
    inside = x**2 + y**2 <= 12**2
    depth = np.clip(12 - np.sqrt(x**2 + y**2), 0, None)
    image = np.where(inside, 10_000 * (1 - 0.15 * (1 - np.exp(-depth / 5))), 0).astype(int)
    rows = [(int(b), int(a), z, int(image[a, b])) for a, b in np.ndindex(image.shape) for z in range(2)]
    v = spark.createDataFrame(rows, "x int, y int, z int, grey int")
    got = hardening.correct(v, n, 3, 0.0, float(image[inside].mean())).toPandas()
    core = (got.x - n // 2) ** 2 + (got.y - n // 2) ** 2 <= 10**2
    assert got.value[core].std() < 0.6 * got.grey[core].std()
    coarse = hardening.correct(v, n, 3, 0.0, float(image[inside].mean()), level=1).toPandas()
    assert len(coarse) == len(rows) and coarse.value[(coarse.x - n // 2) ** 2 + (coarse.y - n // 2) ** 2 <= 10**2].std() < 0.9 * got.grey[core].std()


def test_cells(spark):
    packed = synthetic.stacked_cell(spark)
    voxels = bricks.unpack(packed).cache()
    seen = cells.overview(voxels, 1500).first()
    assert (seen.type, seen.axis) == ("stacked", "z")
    layers = cells.stacked_layers(voxels.where("y > 20 and y < 30"), 9000, 14_000, 100, "y")
    got = cells.stacked_overhang(layers, 6).collect()
    assert {r.overhang for r in got} == {6.0} and len({r.layer for r in got}) == 5
    disc = spark.range(40 * 40 * 6).select((F.col("id") % 40).cast("int").alias("x"), (F.col("id") / 40 % 40).cast("int").alias("y"), (F.col("id") / 1600).cast("int").alias("z"))
    disc = disc.withColumn("grey", F.when((F.col("x") - 20) ** 2 + (F.col("y") - 20) ** 2 < 300, 9000).otherwise(0).cast("int"))
    seen = cells.overview(disc, 1000).first()
    assert (seen.type, seen.axis) == ("cylindrical", "z")
    image = voxels.where("y = 25").select(F.lit("c").alias("cell"), F.lit(1).alias("section"), "x", F.col("z").alias("y"), F.col("grey").cast("double").alias("value"))
    (r,) = cells.image_cells(image, 1500, 9000, 14_000, 100).collect()
    assert (r.type, r.layers, r.cathodes, r.least_overhang) == ("stacked", 11, 5, 6.0)


def test_sample_parts_and_overlap(spark):
    for name in ("housing", "bracket", "hub", "bellhousing"):
        g = np.linspace(-12, 12, 49)
        d = synthetic.sample_part(name)(g[None, None, :], g[None, :, None], g[:, None, None])
        assert 0.005 < (d < 0).mean() < 0.5
    g = np.arange(12) * 0.25
    x, y, z = np.meshgrid(g, g, g, indexing="ij")
    for r in (0.05, 0.3, 0.9):
        assert math.isclose(synthetic.ball_overlap(x, y, z, (1.3, 1.4, 1.5), r, 0.25).sum() * 0.25**3, 4 / 3 * math.pi * r**3, rel_tol=1e-9)


def tiff(entries):
    import struct

    body, extra = b"", b""
    at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        if kind == 2:
            raw = value.encode() + b"\0"
        elif kind == 5:
            raw = struct.pack("<II", *value)
        else:
            raw = struct.pack("<H", value)
        n = len(raw) if kind == 2 else 1
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, kind, n, at + len(extra))
            extra += raw
        else:
            body += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + b"\0" * 4 + extra


def test_voxel_sizes_of_tiff_tags(spark, tmp_path):
    cases = {
        "ome": ([(270, 2, '<Pixels PhysicalSizeX="2.5" PhysicalSizeXUnit="um" PhysicalSizeY="2.5" PhysicalSizeZ="5"/>')], (0.0025, 0.0025, 0.005)),
        "cm": ([(282, 5, (400, 1)), (283, 5, (200, 1)), (296, 3, 3)], (0.025, 0.05, None)),
        "inch": ([(282, 5, (254, 1)), (283, 5, (254, 1)), (296, 3, 2)], (0.1, 0.1, None)),
        "print": ([(282, 5, (300, 1)), (283, 5, (300, 1)), (296, 3, 2)], (None, None, None)),
        "lines": ([(270, 2, "ImageJ=1\nunit=mm\nspacing=0.6\n"), (282, 5, (3, 1)), (283, 5, (3, 1))], (1 / 3, 1 / 3, 0.6)),
    }
    for name, (entries, _) in cases.items():
        (tmp_path / f"{name}.tif").write_bytes(tiff(entries))
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.x_mm, r.y_mm, r.z_mm) for r in metadata.tiff_voxel_sizes(spark, str(tmp_path)).collect()}
    for name, (_, want) in cases.items():
        assert all(a is b or math.isclose(a, b) for a, b in zip(got[name], want, strict=True)), name


def test_volumes_projects_and_artifacts(spark, tmp_path):
    import gzip

    v = metadata.Volume("part", 10, 20, 30, 0.33, 0.33, 0.6, threshold=5000.0)
    metadata.write_volume(spark, v, f"{tmp_path}/v")
    back = metadata.read_volume(spark, f"{tmp_path}/v")
    assert back == v and back.voxel == (0.33, 0.33, 0.6) and back.size == (10, 20, 30)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.xml.gz").write_bytes(gzip.compress(b'<project><volume name="one" file="one.raw" dims="4 5 6" spacing="0.1 0.1 0.2"/><Volume><Name>two</Name><File>b.raw</File><Transform>1 0 0 5 0 1 0 0 0 0 1 0 0 0 0 1</Transform></Volume></project>'))
    rows = metadata.read_projects(spark, f"{tmp_path}/p").orderBy("place").collect()
    assert [(r.name, r.file, r.dims, r.voxel_mm) for r in rows] == [("one", "one.raw", [4, 5, 6], [0.1, 0.1, 0.2]), ("two", "b.raw", [], [])]
    assert rows[0].transform[0] == 1.0 and rows[1].transform[3] == 5.0
    spark.createDataFrame([(1, 2, 3, 1)], "x int, y int, z int, material int").write.parquet(f"{tmp_path}/m")
    assert metadata.open_artifact(spark, f"{tmp_path}/m", "materials").count() == 1
    with pytest.raises(ValueError):
        metadata.open_artifact(spark, f"{tmp_path}/m", "porosity")
    copy, hist = metadata.staged(spark.createDataFrame([(0, 0, 0, 7), (1, 0, 0, 7)], "x int, y int, z int, grey int"))
    assert copy.count() == 2 and [tuple(r) for r in hist.collect()] == [(7, 2)]
    assert len(list(metadata.preview_rounds(copy, 1))) == 3
