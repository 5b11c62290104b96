import heapq

import numpy as np
import pytest

from brickwise.operators import blocks, distance


def rows_of(spark, mask, shift=(0, 0, 0)):
    return spark.createDataFrame([tuple(int(v) for v in p + np.array(shift)) for p in np.argwhere(mask)], "x int, y int, z int").repartition(4)


def brute(mask, pitch=(1.0, 1.0, 1.0)):
    p = np.argwhere(np.pad(mask, 1)) * pitch
    holes = np.argwhere(~np.pad(mask, 1)) * pitch
    return np.array([((holes - q) ** 2).sum(1).min() for q in p])


@pytest.mark.parametrize("seed", range(6))
def test_envelopes_of_lines(seed):
    rng = np.random.default_rng(seed)
    f = np.where(rng.random((60, 40)) < 0.3 * (seed % 4), np.inf, rng.integers(0, 400, (60, 40)) if seed % 2 else rng.uniform(0, 50, (60, 40)))
    f[0] = np.inf
    pitch = 0.7 if seed > 2 else 1.0
    k = np.arange(40)
    want = (f[:, None, :] + (pitch * (k[:, None] - k)) ** 2).min(2)
    got = distance.lower_envelope(f, pitch)
    assert np.array_equal(np.isinf(got), np.isinf(want)) and got[np.isfinite(got)] == pytest.approx(want[np.isfinite(want)])


def test_a_long_line_costs_as_its_length():
    assert distance.lower_envelope(np.array([[0.0, *[np.inf] * 20_000, 0.0]])).max() == 10_000**2


@pytest.mark.parametrize(("share", "pitch"), [(0.9, (1.0, 1.0, 1.0)), (0.99, (0.5, 0.7, 1.2)), (1.0, (1.0, 1.0, 1.0))])
def test_map_over_strips(spark, share, pitch):
    mask = np.random.default_rng(3).random((20, 17, 15)) < share
    got = sorted((r.x, r.y, r.z, r.distance) for r in distance.distance_map(rows_of(spark, mask, (-5, 2, 30)), pitch, strip=8).collect())
    want = np.sqrt(brute(mask, pitch))
    assert [g[:3] for g in got] == [tuple(p + [-5, 2, 30]) for p in np.argwhere(mask).tolist() for p in [np.array(p)]]
    assert [g[3] for g in got] == pytest.approx(want)


def test_ridge_covers_what_all_balls_cover(spark):
    mask = np.ones((9, 12, 20), dtype=bool)
    mask[:, :, 8:] = False
    mask[3:6, 3:6, 8:18] = True
    d = distance.distance_map(rows_of(spark, mask)).cache()
    top = distance.ridge(d).collect()
    every = {(r.x, r.y, r.z): r.distance for r in d.collect()}
    assert 0 < len(top) < len(every) / 2
    place = np.array([(r.x, r.y, r.z) for r in top])
    reach = np.array([r.distance for r in top])
    assert all((np.linalg.norm(place - p, axis=1) < reach).any() for p in every)
    assert distance.distance_map(rows_of(spark, np.zeros((1, 1, 1), dtype=bool))).collect() == []


def dijkstra(inside, seeds):
    best, queue = dict(seeds), [(d, p) for p, d in seeds.items()]
    heapq.heapify(queue)
    while queue:
        d, p = heapq.heappop(queue)
        if d > best[p]:
            continue
        for axis in range(3):
            for side in (-1, 1):
                q = tuple(p[k] + side * (k == axis) for k in range(3))
                if q in inside and d + 8 < best.get(q, np.inf):
                    best[q] = d + 8
                    heapq.heappush(queue, (d + 8, q))
    return best


def test_depth_by_dijkstra(spark):
    rng = np.random.default_rng(0)
    inside = {tuple(p) for p in (np.argwhere(rng.random((32, 32, 32)) < 0.5) - 5).tolist()}
    seeds = {p: float(rng.integers(0, 60)) / 4 for p in sorted(inside)[::1500]}
    b = spark.createDataFrame(sorted(inside), "bx int, by int, bz int")
    s = spark.createDataFrame([(*p, d) for p, d in seeds.items()], "bx int, by int, bz int, depth double")
    got = {(r.bx, r.by, r.bz): r.depth for r in blocks.block_depth(b, s).collect()}
    want = dijkstra(inside, seeds)
    assert got == want and len(want) > 10_000 and max(want.values()) > 8 * 16
    assert {(r.bx, r.by, r.bz): r.depth for r in blocks.block_depth(b, s, 3).collect()} == {p: d for p, d in want.items() if d <= 24}


def test_depth_of_a_plane(spark):
    """A part up to x = 20 voxels: its third block is half full, and depths are those of the blocks' centres."""
    filled = spark.createDataFrame([(x, y, z, 512 if x < 2 else 256) for x in range(3) for y in range(-4, 5) for z in range(-4, 5)], "bx int, by int, bz int, n int")
    seeds = blocks.depth_seeds(filled)
    got = {(r.bx, r.by, r.bz): r.depth for r in blocks.block_depth(filled.where("n >= 256"), seeds).collect()}
    assert [got[x, 0, 0] for x in range(3)] == [4, 8, 0] and len(got) == 243
    none = filled.limit(0)
    assert blocks.block_depth(filled, none).collect() == [] and blocks.depth_seeds(none).collect() == []
