import numpy as np

from brickwise.llm import embedding_dedup
from brickwise.llm.embedding_dedup import embedding_components
from brickwise.llm.hnsw import Graph


def brute(ids, vectors):
    x = np.array(vectors, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, True)
    reach = np.array(ids)
    while True:
        new = np.array([reach[row].min() for row in near])
        if (new == reach).all():
            return {i: (int(r.sum()) - 1, int(c), i == c) for i, r, c in zip(ids, near, reach, strict=True)}
        reach = new


def corpus():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 24))
    groups = [b + 0.12 * rng.normal(size=(k, 24)) for b, k in zip(rng.normal(size=(12, 24)), (2, 2, 3, 5, 9, 20, 40, 90, 150, 2, 3, 4), strict=True)]
    x = np.concatenate([base, *groups, base[:30], 3 * base[30:40]]).astype(np.float32)
    ids = (10 + rng.permutation(len(x))).tolist()
    return ids, x.tolist()


def test_against_brute_force(spark):
    ids, vectors = corpus()
    rows = [(i, v, 1, "x") for i, v in zip(ids, vectors, strict=True)]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 24), (5004, [float("nan")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (5006, [float("inf")] * 24), (5007, [1.0, 2.0]), (5008, [2.0, 4.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, 0, "y") for i, v in odd], "vec_id long, embedding array<float>, label int, id string").repartition(6)
    got = embedding_components(df, shards=3, shard_bytes=1).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    for i, _ in odd[:6]:
        assert by_id[i] == (0, i, True)
    assert by_id[5007] == (1, 5007, True) and by_id[5008] == (1, 5007, False) and by_id[None] == (0, None, True)
    want = brute(ids, vectors)
    same = np.mean([by_id[i] == w for i, w in want.items()])
    found = sum(by_id[i][0] for i in want) / sum(w[0] for w in want.values())
    assert same > 0.99 and 0.99 < found <= 1.0


def test_audits_widen_beams():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    shard = embedding_dedup.Shard.load(embedding_dedup.Shard(np.arange(3000), np.ones(3000, dtype=np.int64), x).dump(), 0.75)
    shard.beam = 1
    shard.audit(x[:64], np.arange(64))
    q, m = (np.concatenate(k) for k in zip(*shard.links(x[:800]), strict=True))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit[:800] @ unit.T >= 0.75).sum()
    assert len(q) >= 0.95 * want and len(set(zip(q.tolist(), m.tolist(), strict=True))) == len(q)


def test_rows_of_one_id_are_one_vertex(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a), (5, a), (5, b), (9, b), (7, b), (7, c), (7, c), (11, c), (20, [1.0, 1.0, 1.0])]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 2, 3), (7, 2, 3), (7, 2, 3), (7, 2, 3), (9, 2, 3), (11, 2, 3), (20, 0, 20)]
    assert {r.vec_id for r in got if r.kept} == {3, 20}


def test_double_components(spark):
    turn = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0]), (2, turn(0.9 + 1e-12)), (3, turn(-0.9 + 1e-12)), (4, [-1.0, 0.0])]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = Graph(x).search(x[:500], 64)
    best = np.argsort(-(x[:500] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist(), strict=True)]) > 0.9
    assert Graph(x[:0]).x.shape == (0, 16) and Graph(x[:1]).search(x[:3], 8)[0].tolist() == [[0]] * 3


def test_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_groups_and_failed_audits_end_exactly():
    rng = np.random.default_rng(3)
    hot, pair = rng.normal(size=16), rng.normal(size=(16, 16))
    x = np.concatenate([hot + 0.01 * rng.normal(size=(1500, 16)), *[p + 0.01 * rng.normal(size=(2, 16)) for p in pair]])
    shard = embedding_dedup.Shard(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.9)), strict=True))
    found = lambda: {p for q, m in shard.links(x) for p in zip(q.tolist(), m.tolist(), strict=True)}
    assert len(found()) > 1500**2
    shard.graph.search = lambda q, beam: (np.full((len(q), 1), -1), np.full((len(q), 1), -2.0))
    assert not found()
    shard.audit(x[-64:], np.arange(len(x))[-64:])
    assert found() == truth
