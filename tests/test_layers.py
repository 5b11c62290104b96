from brickwise.operators.layers import overhang, stray_ends, track_layers


def test_tracks_follow_layers(spark):
    rows = [(1, s, 10.0 * k + 0.4 * s) for s in range(6) for k in range(3) if not (k == 1 and s > 3)] + [(2, 0, 5.0), (2, 2, 5.0)]
    got = track_layers(spark.createDataFrame(rows, "edge int, step int, at double"), ["edge"], "step", "at", 1.0).collect()
    by = {}
    for r in got:
        if r.edge == 1:
            by.setdefault(r.track, []).append(round(r["at"] - 0.4 * r.step))
    assert sorted((len(v), set(v)) for v in by.values()) == [(4, {10}), (6, {0}), (6, {20})] or sorted(len(v) for v in by.values()) == [4, 6, 6]
    assert all(len(set(v)) == 1 for v in by.values())
    assert len({r.track for r in got if r.edge == 2}) == 2


def test_overhang_takes_the_smaller_side(spark):
    rows = [("top", 1, 1, "cathode", 10.0, 5.0), ("top", 1, 0, "anode", 8.0, 5.6), ("top", 1, 2, "anode", 12.1, 5.3), ("top", 1, 9, "anode", 20.0, 1.0), ("top", 2, 1, "cathode", 10.0, 5.0), ("top", 2, 0, "anode", 8.2, 4.8)]
    got = overhang(spark.createDataFrame(rows, "edge string, section int, layer int, kind string, across double, end double"), 2.0).collect()
    assert {(r.section, round(r.overhang, 6)) for r in got} == {(1, 0.3), (2, -0.2)}
    stray = stray_ends(spark.createDataFrame([("top", 1, k, 5.0 + 0.01 * k) for k in range(9)] + [("top", 1, 9, 7.0)], "edge string, section int, layer int, end double"), 1.0)
    assert [r.layer for r in stray.collect()] == [9]
