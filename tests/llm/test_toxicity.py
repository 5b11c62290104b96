import random

import numpy as np
from zlib import crc32

from brickwise.llm.boosting import Trees, isotonic
from brickwise.llm.toxicity import FEATURES, Weights, features, toxicity


def test_features_of_odd_texts():
    weights = Weights({"glorp": 2.0, "snar*": 1.5})
    assert features("", weights) == [0.0] * FEATURES
    assert features(" \n!!", weights) == [0.0] * FEATURES
    found = features("You IDIOT, you snarks! glorp 1d10t", weights)
    assert len(found) == FEATURES and found[6] == 2.0 and found[9] > 0 and found[15] >= 0


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, values = isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 < values[0] < values[-1] <= 1


def plain_tree(x, grad, hess, cuts, depth, ridge, least):
    """The best tree by trying every cut of every feature at every node: (feature, cut, left, right) or (grad, hess)."""
    if not depth:
        return grad.sum(), hess.sum()
    best, place = 1e-9, None
    for f, some in enumerate(cuts):
        for c in some:
            left = x[:, f] <= c
            hl, hr = hess[left].sum(), hess[~left].sum()
            if hl < least or hr < least:
                continue
            gain = grad[left].sum() ** 2 / (hl + ridge) + grad[~left].sum() ** 2 / (hr + ridge) - grad.sum() ** 2 / (hess.sum() + ridge)
            if gain > best + 1e-9:
                best, place = gain, (f, c)
    if place is None:
        return plain_tree(x, grad, hess, cuts, 0, ridge, least)
    left = x[:, place[0]] <= place[1]
    return (*place, *(plain_tree(x[s], grad[s], hess[s], cuts, depth - 1, ridge, least) for s in (left, ~left)))


def plain_value(tree, row, ridge, rate):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return rate * tree[0] / (tree[1] + ridge)


def test_trees_by_brute_force():
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=160), rng.integers(0, 4, 160), rng.normal(size=160).round(1), np.zeros(160)]
    y = (rng.random(160) < 1 / (1 + np.exp(-2 * x[:, 0] * (x[:, 1] - 1)))).astype(float)
    model = Trees(rounds=6, bins=12)
    got = model.fit(x, y).raw(x)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 12)[1:-1])) for f in range(4)]
    raw = np.full(160, np.log(y.mean() / (1 - y.mean())))
    for _ in range(6):
        p = 1 / (1 + np.exp(-raw))
        tree = plain_tree(x, y - p, p * (1 - p), cuts, 3, 1.0, 2.0)
        raw = raw + [plain_value(tree, row, 1.0, 0.1) for row in x]
    assert np.allclose(got, raw, atol=1e-9)


def test_isotonic_by_least_squares():
    rng = np.random.default_rng(8)
    x, y = np.sort(rng.normal(size=60)), (rng.random(60) < 0.5).astype(float)
    knots, values = isotonic(x, y)
    # The pooled means are max over starts of min over ends of the mean between.
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    edges = [0] + [i for i in range(1, 60) if want[i] != want[i - 1]] + [60]
    sums = [(y[a:b].sum() + 0.5 * y.mean()) / (b - a + 0.5) for a, b in zip(edges, edges[1:])]
    assert np.allclose(knots, [x[a:b].mean() for a, b in zip(edges, edges[1:])])
    assert np.allclose(values, np.maximum.accumulate(sums))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = Trees().fit(x[:1000], y[:1000])
    assert ((model.raw(x[1000:]) > 0) == y[1000:]).mean() > 0.95


def corpus(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = rnd.choices(words, k=rnd.randint(5, 120))
        toxic = i % 5 == 0
        if toxic:
            text[::4] = rnd.choices(["zorbulon", "zorbulina", "idiot", "trash"], k=len(text[::4]))
        rows.append((i, " ".join(text), "en", 7))
        labels.append((i, int(toxic), 1))
    rows += [(1000, None, None, None), (1001, "", "x", 1), (1002, "word " * 50000, "x", 1), (3, "again", "x", 1), (None, "idiot", "x", 1)]
    labels += [(None, 1, 1), (4, None, 1), (5, 1, 1), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity(docs, labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97


def test_without_labels_and_without_rows(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).collect() == []
