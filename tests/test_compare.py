import numpy as np
import pytest

from brickwise.operators import compare, report


def box_mesh(size):
    out = []
    for axis in range(3):
        for side in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            corner = lambda a, b, axis=axis, side=side, u=u, v=v: [size[axis] * side if k == axis else size[u] * a if k == u else size[v] * b for k in range(3)]
            quad = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
            quad = quad if side else quad[::-1]
            out += [[quad[0], quad[1], quad[2]], [quad[0], quad[2], quad[3]]]
    return np.array(out, dtype=float)


SIZE = np.array([6.0, 4.0, 2.0])


def test_signed_distance_to_a_box():
    mesh = compare.Mesh(box_mesh(SIZE))
    p = np.random.default_rng(0).uniform(-3, 8, (300, 3))
    d, near, _ = mesh.closest(p)
    q = np.abs(p - SIZE / 2) - SIZE / 2
    assert d == pytest.approx(np.linalg.norm(np.maximum(q, 0), axis=1) + np.minimum(q.max(1), 0), abs=1e-9)
    assert np.linalg.norm(p - near, axis=1) == pytest.approx(np.abs(d), abs=1e-9)
    with pytest.raises(ValueError):
        compare.Mesh(np.zeros((0, 3, 3)))


def test_alignment_restores_a_motion(spark):
    mesh = compare.Mesh(box_mesh(SIZE))
    rng = np.random.default_rng(1)
    t = mesh.t[rng.choice(len(mesh.t), 400, p=mesh.area / mesh.area.sum())]
    w = rng.dirichlet((1, 1, 1), 400)
    p = (t * w[:, :, None]).sum(1)
    a = 0.08
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    shifted = p @ r.T + [0.2, -0.1, 0.15]
    df = spark.createDataFrame(shifted.tolist(), "x double, y double, z double").coalesce(2)
    m = compare.align(df, mesh, rounds=15)
    back = compare.deviations(compare.mesh_distance(compare.moved(df, m), mesh), 0.01).first()
    assert back.rms < 1e-3 and back.within == 1.0
    assert len(compare.coarse_alignments(df, mesh)) == 24


def test_templates():
    data = {"name": "<part>", "zones": [{"n": 1, "ok": True}, {"n": 2, "ok": False}], "who": {"is": "me"}}
    text = "{{! note }}{{name}} {{{name}}} {{#zones}}{{n}}{{#ok}}+{{/ok}}{{^ok}}-{{/ok}};{{/zones}}{{^none}}no{{/none}} {{who.is}}"
    assert report.render(text, data) == "&lt;part&gt; <part> 1+;2-;no me"
    with pytest.raises(ValueError):
        report.render("{{#a}}", {})


def test_orders(spark):
    order = {"acceptance": {"zones": [{"name": "a", "box_mm": [[0, 0, 0], [1, 2, 3]], "max_pore_count": 4}]}}
    assert report.zones_of_order(spark, order).first().asDict() == {"zone": "a", "x0": 0.0, "x1": 1.0, "y0": 0.0, "y1": 2.0, "z0": 0.0, "z1": 3.0, "max_size": None, "max_count": 4}
    with pytest.raises(ValueError):
        report.zones_of_order(spark, {"acceptance": {"zones": [{"name": "b"}]}})
