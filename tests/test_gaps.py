import numpy as np
import pytest

from brickwise.operators import materials, porosity


def brute(rows, voxel):
    best = None
    groups = {}
    for c, *p in rows:
        groups.setdefault(c, []).append(p)
    names = sorted(groups)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = np.abs(np.array(groups[a])[:, None] - np.array(groups[b])[None])
            gap = np.sqrt(((np.maximum(d - 1, 0) * voxel) ** 2).sum(2)).min()
            best = min(best or (np.inf,), (gap, a, b))
    return best


@pytest.mark.parametrize(("seed", "n", "extent", "voxel"), [(0, 6, 30, (1.0, 1.0, 1.0)), (1, 4, 400, (1.0, 1.0, 1.0)), (2, 5, 300, (0.2, 1.0, 3.0)), (3, 2, 1000, (1.0, 1.0, 1.0))])
def test_closest_pores_by_all_pairs(spark, seed, n, extent, voxel):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.integers(-extent, extent, 3)
        rows += [(c + 10, *map(int, centre + o)) for o in np.unique(rng.integers(-3, 4, (25, 3)), axis=0)]
    taken = {}
    rows = [r for r in rows if taken.setdefault(r[1:], r[0]) == r[0]]
    got = porosity.closest_pores(spark.createDataFrame(rows, "component long, x int, y int, z int"), voxel).collect()
    gap, a, b = brute(rows, np.array(voxel))
    assert len(got) == 1 and got[0].gap == pytest.approx(gap) and (got[0].a, got[0].b) == (a, b)


def test_fewer_than_two_pores(spark):
    one = spark.createDataFrame([(1, 0, 0, 0), (1, 5, 5, 5)], "component long, x int, y int, z int")
    assert porosity.closest_pores(one).collect() == [] and porosity.closest_pores(one.limit(0)).collect() == []


def test_component_truth_by_medians(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k in range(6) for v in rng.normal(1000 + 4000 * k, 900, 101 + k)]
    want = {}
    for k in range(1, 6):
        bins = sorted(min(max(v, 0), 65535) // 16 for j, v in rows if j == k)
        median = (bins[(len(bins) + 1) // 2 - 1] + 0.5) * 16
        want[k] = (len(bins), sum(median >= low for low in (6000, 14_000)))
    frame = spark.createDataFrame(rows, "label int, grey int").repartition(5)
    got = {r.label: (r.n, r.truth) for r in materials.component_truth(frame, [6000.0, 14_000.0]).collect()}
    assert got == want and {t for _, t in got.values()} == {0, 1, 2}
    assert {r.truth for r in materials.scored(frame, [6000.0]).where("label = 0").collect()} == {0}
