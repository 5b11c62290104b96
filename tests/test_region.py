import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators.region import Region, region_volumes
from brickwise.plans.inspection_queries import SOLIDS


def cube(spark, n):
    i = F.col("id")
    return spark.range(n**3).select((i % n).cast("int").alias("x"), (F.floor(i / n) % n).cast("int").alias("y"), F.floor(i / n**2).cast("int").alias("z"), (1000 + i % 7).cast("int").alias("grey"))


@pytest.mark.parametrize("size", [4, 8])
def test_blocks_give_what_voxels_give(spark, size):
    voxel = (1.0, 0.9, 1.1)
    voxels = cube(spark, 40)
    regions = {n: Region.of_zone(z) for n, z in SOLIDS.items()} | {"nothing": Region.of_zone({"box_mm": [[100, 100, 100], [101, 101, 101]]})}
    got = {r.name: (r.voxels, r.volume_mm3) for r in region_volumes(voxels, regions, 2000.0, 0.0, voxel, size).collect()}
    at = [(F.col(c) + 0.5) * v for c, v in zip("xyz", voxel, strict=True)]
    for name, r in regions.items():
        n, s = voxels.where(r.contains(*at)).agg(F.count("*"), F.coalesce(F.sum("grey"), F.lit(0))).first()
        assert got[name] == (n, pytest.approx(s / 2000 * 0.99))
    assert got["nothing"] == (0, 0.0) and got["whole"][0] == 64_000


def test_a_cylinder_needs_its_border_only(spark):
    """A cylinder of 40 voxels across in a cube of one grey value: its volume, from voxels of mixed blocks alone."""
    n = 56
    zone = {"region": [{"cylinder": {"from_mm": [28.1, 27.9, 4], "to_mm": [28.1, 27.9, 52], "radius_mm": 20}}]}
    r = Region.of_zone(zone)
    whole = cube(spark, n).withColumn("grey", F.lit(1000)).cache()
    block = [F.floor(F.col(c) / 8).cast("int").alias(f"b{c}") for c in "xyz"]
    sums = whole.groupBy(*block).agg(F.count("*").alias("n"), F.sum("grey").alias("s"))
    low, high = ([F.col(f"b{c}") * 8 + d for c in "xyz"] for d in (0.5, 7.5))
    every, none = r.side(low, high)
    mixed = sums.where(~every & ~none).select("bx", "by", "bz")
    border = whole.select("*", *block).join(mixed, ["bx", "by", "bz"], "left_semi").select("x", "y", "z", "grey")
    assert border.count() < 0.7 * n**3 and sums.where(every).count() > 20
    got = region_volumes(border, {"c": r}, 1000.0, 0.0, sums=sums).first()
    inside = whole.where(r.contains(*[F.col(c) + 0.5 for c in "xyz"])).count()
    assert got.voxels == inside == got.volume_mm3 == pytest.approx(np.pi * 400 * 48, rel=5e-3)


def test_zones_of_orders():
    r = Region.of_zone(SOLIDS["drilled"])
    assert r.describe() == "box (4, 5, 6) to (50, 47.5, 60) without cylinder from (0, 20, 20) to (64, 24, 40) of radius 9"
    assert r.bounds() == ((4, 5, 6), (50, 47.5, 60)) and Region.of_zone({}).describe() == "the whole part"
    for bad in ({"box_mm": [[0, 0, 0], [0, 1, 1]]}, {"region": [{"sphere": {"center_mm": [0, 0], "radius_mm": 1}}]}, {"region": [{"sphere": {"center_mm": [0, 0, 0], "radius_mm": 0}}]}, {"region": [{"mesh": "part.stl"}]}, {"region": [7]}, {"region": [{"cylinder": {"from_mm": [0, 0, 0], "to_mm": [0, 0, 0], "radius_mm": 1}}]}):
        with pytest.raises(ValueError):
            Region.of_zone(bad)
