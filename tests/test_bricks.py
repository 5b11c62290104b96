import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import blocks, bricks, histogram, porosity
from brickwise.operators.components import label_brick
from brickwise.operators.generate import Phantom, box_phantom


@pytest.mark.parametrize("count", [6, 18, 26])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.2, 0.5, 0.95, 1.0])
def test_runs_label_like_voxels(share, count):
    mask = np.random.default_rng(0).random((7, 9, 11)) < share
    at, group, first = bricks.label(mask, count)
    assert (at == np.flatnonzero(mask)).all()
    if len(at):
        z, y, x = np.nonzero(mask)
        up = label_brick(x, y, z, np.zeros(len(x)), count)
        assert (at[up] == first[group]).all()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_voxel_view_is_the_inverse_of_packing(spark):
    voxels = box_phantom(spark, Phantom(size=20, pitch=0.6)).where("(x + y * z) % 3 != 0").withColumn("x", (F.col("x") + 55).cast("int"))
    assert rows(bricks.unpack(bricks.pack(voxels))) == rows(voxels)
    p = Phantom(size=40, pitch=0.3)
    assert rows(bricks.unpack(bricks.phantom_bricks(spark, p))) == rows(box_phantom(spark, p))


def test_sieve_and_pores_like_those_of_voxels(spark):
    n = 72
    p = Phantom(size=n, pitch=12.8 / n, pores=[(3.25, 0.0, 0.0, 0.6), (-3.25, 1.5, -1.0, 0.5), (0.5, -0.5, 3.25, 0.4), (0.0, 4.0, 0.0, 0.5)])
    packed = bricks.phantom_bricks(spark, p)
    voxels = box_phantom(spark, p)
    assert rows(bricks.histogram(packed)) == rows(histogram.grey_histogram(voxels))
    t = histogram.otsu(histogram.grey_histogram(voxels)).first()["threshold"]
    kept = blocks.sieve(voxels, t, (n,) * 3).cache()
    assert rows(bricks.unpack(bricks.sieve(packed, (n,) * 3, t))) == rows(kept.select("x", "y", "z", "grey"))
    found = porosity.find_pores(kept, t, 3).groupBy("component").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "z", "grey")])
    assert rows(bricks.find_pores(packed, (n,) * 3, t).select("voxels", "sx", "sy", "sz", "sg")) == rows(found.select("n", "x", "y", "z", "grey"))


@pytest.mark.parametrize("margin", [0, 8, 9, 17])
def test_wide_margins(spark, margin):
    n = 80
    voxels = box_phantom(spark, Phantom(size=n, pitch=0.5))
    t = 10_000.0
    want = blocks.sieve(voxels, t, (n,) * 3, margin).select("x", "y", "z", "grey")
    assert rows(bricks.unpack(bricks.sieve(bricks.pack(voxels), (n,) * 3, t, margin))) == rows(want)


def test_margins_that_need_more_than_neighbours_are_refused(spark):
    packed = bricks.phantom_bricks(spark, Phantom(size=16, pitch=0.8))
    for f in (lambda: bricks.sieve(packed, (16,) * 3, 1.0, 64), lambda: bricks.find_pores(packed, (16,) * 3, 1.0, 3, 64)):
        with pytest.raises(ValueError, match="margin"):
            f()
