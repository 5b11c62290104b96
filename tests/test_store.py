import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators.blocks import pyramid_level
from brickwise.operators.generate import Phantom, box_phantom
from brickwise.plans.registry import Project
from brickwise.sources import store
from brickwise.sources.metadata import Volume

SIZE = (300, 70, 200)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Every seventh place of a volume of 5 x 2 x 4 bricks, in three levels."""
    folder = str(tmp_path_factory.mktemp("volume") / "v")
    n = SIZE[0] * SIZE[1] * SIZE[2]
    i = F.col("id")
    voxels = spark.range(0, n, 7).select((i % SIZE[0]).cast("int").alias("x"), (F.floor(i / SIZE[0]) % SIZE[1]).cast("int").alias("y"), F.floor(i / (SIZE[0] * SIZE[1])).cast("int").alias("z"), (i % 60_001).cast("int").alias("grey"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store, "ROW_GROUP", 2)  # a volume of 40 bricks is small
        store.write(voxels, Volume("part", *SIZE, 0.1, 0.2, 0.3), folder, 2)
    return voxels.cache(), store.open_volume(spark, folder)


def rows(df):
    return sorted(map(tuple, df.select("x", "y", "z", "grey").collect()))


def scanned(df):
    """Rows that the Parquet scan of a query gave, after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().get("numOutputRows").get().value()


def test_a_level_is_what_was_stored(stored):
    voxels, v = stored
    assert v.volume == Volume("part", *SIZE, 0.1, 0.2, 0.3) and v.levels() == 2
    assert v.voxels().exceptAll(voxels).isEmpty() and v.voxels().count() == voxels.count()
    coarse = pyramid_level(pyramid_level(voxels))
    assert rows(v.voxels(2)) == rows(coarse)


def test_a_box_leaves_other_bricks_unread(stored):
    voxels, v = stored
    low, high = (250, 3, 100), (290, 40, 128)
    inside = " and ".join(f"{c} >= {a} and {c} < {b}" for c, a, b in zip("xyz", low, high, strict=True))
    assert rows(v.voxels(0, low, high)) == rows(voxels.where(inside)) != []
    whole, part = v.bricks().select("bx", "by", "bz"), v.bricks(0, low, high).select("bx", "by", "bz")
    assert part.count() == 2 and whole.count() == 40
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(bx,3)" in plan
    assert scanned(whole) == 40 and scanned(part) <= 20
    assert rows(v.voxels(0, (5, 5, 5), (5, 9, 9))) == [] and rows(v.voxels(0, (900, 0, 0), (950, 9, 9))) == []


def test_previews_take_the_level_that_fits(stored):
    _, v = stored
    assert [v.preview(n)[0] for n in (300, 299, 150, 75, 3)] == [0, 1, 1, 2, 2]
    level, shades = v.preview(75)
    got = shades.agg(F.min("shade"), F.max("shade")).first()
    assert level == 2 and tuple(got) == (0, 255)


def test_empty_volume(spark, tmp_path):
    store.write(spark.createDataFrame([], "x int, y int, z int, grey int"), Volume(), str(tmp_path / "v"))
    v = store.open_volume(spark, str(tmp_path / "v"))
    assert v.voxels().collect() == [] and v.volume.size == (0, 0, 0)


def test_voxel_sizes_reach_later_steps(spark, tmp_path):
    p = Project.open(spark, str(tmp_path / "p"))
    box_phantom(spark, Phantom(size=24, pitch=0.5)).write.parquet(str(tmp_path / "scan"))
    p.run("open_dataset", {"path": str(tmp_path / "scan")})
    assert "volume" not in p.latest("dataset")
    p.run("store_volume", {"folder": str(tmp_path / "stored"), "levels": 1, "pitch": [0.5, 0.5, 0.5]})
    p.run("open_dataset", {"path": str(tmp_path / "stored")})
    p.run("segment_materials", {"threshold": 10_000})
    assert p.run("measure_objects")["parameters"]["pitch"] == 0.5
    assert p.run("wall_thickness", {"threshold": 10_000, "most": 8.0})["parameters"]["pitch"] == 0.5
    wall = p.result(p.latest("wall_thickness")).where("thickness is not null").agg(F.percentile("thickness", 0.5)).first()[0]
    assert wall == pytest.approx(1.5, abs=0.35)
    p.run("open_dataset", {"path": str(tmp_path / "stored"), "level": 1, "low": [0, 0, 0], "high": [6, 12, 12]})
    assert p.latest("dataset")["volume"]["pitch_x_mm"] == 1.0 and p.result(p.latest("dataset")).agg(F.max("x")).first()[0] == 5
    assert np.isclose(Project.open(spark, str(tmp_path / "p")).latest("dataset")["volume"]["pitch_z_mm"], 1.0)
    with pytest.raises(ValueError, match="no stored volume"):
        p.run("open_dataset", {"path": str(tmp_path / "scan"), "level": 1})


def test_materials_by_classes_and_families_of_fibres(spark, tmp_path):
    """A box of two halves of 20000 and 8000, and walls that run along y in one half and along z in the other."""
    i = F.col("id")
    x, y, z = (i % 32).cast("int"), (F.floor(i / 32) % 32).cast("int"), F.floor(i / 1024).cast("int")
    inside = (x >= 2) & (x < 30) & (y >= 2) & (y < 30) & (z >= 2) & (z < 30)
    grey = F.when(inside & (x < 16), 20_000).when(inside, 8000).otherwise(1000) + (i * 7919 % 601).cast("int")
    spark.range(32**3).select(x.alias("x"), y.alias("y"), z.alias("z"), grey.cast("int").alias("grey")).write.parquet(str(tmp_path / "two"))
    p = Project.open(spark, str(tmp_path / "p"))
    p.run("open_dataset", {"path": str(tmp_path / "two")})
    done = p.result(p.run("segment_materials", {"threshold": 4000, "classes": 2}))
    found = {(r.material, r.left): r.n for r in done.groupBy("material", (F.col("x") < 16).alias("left")).agg(F.count("*").alias("n")).collect()}
    assert found[2, True] > 0.9 * 14 * 28 * 28 and found[1, False] > 0.9 * 14 * 28 * 28
    stripes = F.when(F.col("y") < 16, F.sin(F.col("x") * 1.3 + F.col("y") * 0.0)).otherwise(F.sin(F.col("z") * 1.3)) + F.when(F.col("y") < 16, F.sin(F.col("z") * 1.1)).otherwise(F.sin(F.col("y") * 1.1))
    spark.range(32**3).select(x.alias("x"), y.alias("y"), z.alias("z")).withColumn("grey", (5000 + 1000 * stripes).cast("int")).write.parquet(str(tmp_path / "fibres"))
    p.run("open_dataset", {"path": str(tmp_path / "fibres")})
    rows = p.result(p.run("fibre_orientation", {"block": 16, "families": 2})).collect()
    assert len(rows) == 8 and {(r.by, r.family) for r in rows} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
