import numpy as np
import pytest

from brickwise.operators.noise import material_blocks, noise_model


def frame(spark, grey):
    x, y, z = (v.ravel().tolist() for v in np.indices(grey.shape))
    return spark.createDataFrame(list(zip(x, y, z, grey.ravel().tolist(), strict=True)), "x int, y int, z int, grey int").repartition(4)


@pytest.fixture(scope="module")
def scan(spark):
    """A cube of 40 voxels in air, with noise whose neighbours along x are correlated by a half."""
    rng = np.random.default_rng(0)
    white = rng.normal(0, 300, (57, 56, 56))
    noise = (white[1:] + white[:-1]) / np.sqrt(2)
    part = np.zeros((56, 56, 56))
    part[8:48, 8:48, 8:48] = 1
    return np.round(1000 + 19_000 * part + noise).astype(int), frame(spark, np.round(1000 + 19_000 * part + noise).astype(int)).cache()


def test_correlated_noise(scan):
    _, voxels = scan
    got = {(r.dx, r.dy, r.dz): r for r in noise_model(voxels, 10_000.0, 3, 20).collect()}
    assert len(got) == 171
    sigma = got[1, 0, 0].sigma
    assert sigma == pytest.approx(300, rel=0.02)
    assert got[1, 0, 0].correlation == pytest.approx(0.5, abs=0.03)
    assert all(abs(r.correlation) < 0.06 for k, r in got.items() if k != (1, 0, 0))


def test_pairs_by_brute_force(scan):
    grey, voxels = scan
    inner = {(r.bx, r.by, r.bz) for r in material_blocks(voxels, 10_000.0, 27).collect()}
    assert inner == {(x, y, z) for x in (2, 3, 4) for y in (2, 3, 4) for z in (2, 3, 4)}
    assert material_blocks(voxels, 10_000.0, 28).count() == 125
    r = noise_model(voxels, 10_000.0, 2, 27).where("dx = -1 and dy = 2 and dz = 1").first()
    d = [(grey[8 * x + i, 8 * y + j, 8 * z + k] - grey[8 * x + i - 1, 8 * y + j + 2, 8 * z + k + 1]) ** 2 for x, y, z in inner for i in range(1, 8) for j in range(6) for k in range(7)]
    assert r.n == len(d) and r.variance == pytest.approx(np.mean(d))


def test_no_block(spark):
    assert noise_model(frame(spark, np.full((9, 9, 9), 5)), 100.0).collect() == []
    with pytest.raises(ValueError):
        noise_model(frame(spark, np.full((2, 2, 2), 5)), 1.0, 8)
