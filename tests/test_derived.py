import numpy as np
import pytest

from brickwise.operators import derived
from brickwise.sources import export, images
from tests.test_operators import table


def voxels(df):
    return {(r.x, r.y, r.z): r.grey for r in df.collect()}


def test_user_functions_do_not_see_bricks(spark):
    v = np.random.default_rng(0).integers(0, 1000, (9, 8, 7))
    df = table(spark, v).where("grey > 200")

    def mean(a, corner):
        m = np.isfinite(a).astype(float)
        a = np.nan_to_num(a)
        for axis in range(3):
            a, m = (sum(np.roll(q, k, axis) for k in (-1, 0, 1)) for q in (a, m))
        return np.where(a / np.maximum(m, 1) < 600, np.nan, a / np.maximum(m, 1))

    got = [voxels(derived.derive(df, mean, brick=k, halo=1)) for k in (3, 5, 32)]
    assert got[0] == got[1] == got[2] and 0 < len(got[0]) < df.count()
    with pytest.raises(Exception, match="shape"):
        derived.derive(df, lambda a, c: a[1:], brick=8).count()


def test_dataset_written_and_read_by_box(spark, tmp_path):
    v = np.random.default_rng(1).integers(1, 1000, (20, 18, 16))
    df = table(spark, v)
    derived.write_dataset(df, str(tmp_path / "d"), 1, 8)
    box = ((3, 4, 5), (15, 12, 9))
    got = derived.read_box(spark, str(tmp_path / "d"), 0, box, 8)
    assert voxels(got) == {(x, y, z): int(v[x, y, z]) for x in range(3, 15) for y in range(4, 12) for z in range(5, 9)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bx)" in plan
    assert derived.level_for_pixel(0.1, 0.45, 5) == 2
    few = derived.preview(df, 16, 4, 4)
    assert {r.z for r in few.collect()} == {2, 6, 10, 14}


def test_exports(spark, tmp_path):
    v = np.random.default_rng(2).integers(0, 60000, (6, 5, 4))
    df = table(spark, v)
    assert export.export_dicom(df, str(tmp_path / "dcm"), 6, 5, 0.25, "1.2.3") == 4
    assert voxels(images.read_dicom(spark, str(tmp_path / "dcm"))) == voxels(df)
    points = {c: np.arange(4.0) + k for k, c in enumerate(("x", "y", "z", "deviation"))}
    (tmp_path / "m.ply").write_bytes(export.encode_ply(points, np.array([[0, 1, 2], [1, 2, 3]])))
    rows = export.read_ply(spark, str(tmp_path), ["x", "deviation"]).collect()
    assert sorted((r.x, r.deviation) for r in rows) == [(k, k + 3) for k in range(4)]
    export.write_csv(df.limit(3), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
