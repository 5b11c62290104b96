import random
from collections import Counter

import numpy as np

from brickwise.llm.quality import Shapes, Space, Sparse, _latent, quality, terms


def corpus(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        text = rnd.choices(words, k=rnd.randint(5, 120))
        junk = i % 6 == 0
        if junk:
            text = [w + rnd.choice(["***", "&&&"]) for w in text] if i % 12 else [text[0]] * len(text)
        rows.append((i, " ".join(text), "en", 7))
        labels.append((i, int(not junk), 0))
    rows += [(1000, None, None, None), (1001, "", "x", 1), (1002, "word " * 50000, "x", 1), (3, "again", "x", 1), (None, "a b c", "x", 1)]
    labels += [(None, 1, 1), (4, None, 1), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = quality(docs, labels).collect()
    assert len(got) == 705 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert np.mean([r.predicted == int(r.doc_id % 6 != 0) for r in held]) > 0.97


def test_votes_are_exact():
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors, some = unit(rng.normal(size=(90, 8))), unit(rng.normal(size=(40, 8)))
    labels = (rng.random(90) < 0.7).astype(float)
    space = Space({}, np.zeros(0), np.zeros((0, 8), np.float32), vectors, labels)
    for v, s in zip(some, space.vote(some), strict=True):
        near = sorted(zip((vectors @ v).tolist(), labels.tolist(), strict=True), reverse=True)[:15]
        w = [max(c, 0) ** 4 for c, _ in near]
        assert abs(s - (sum(a * y for a, (_, y) in zip(w, near, strict=True)) + 0.01 * labels.mean()) / (sum(w) + 0.01)) < 1e-5


def test_latent_space_by_dense_singular_vectors():
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(60, 12, replace=False)), rng.integers(1, 9, 12).astype(float)) for _ in range(80)] + [(np.zeros(0, np.int64), np.zeros(0))]
    idf, basis = _latent(rows, 60, 5)
    dense = np.zeros((81, 60))
    df = np.array([sum(t in at for at, _ in rows) for t in range(60)])
    assert np.allclose(idf, np.log(82 / (1 + df)) + 1)
    for k, (at, n) in enumerate(rows[:-1]):
        dense[k, at] = (1 + np.log(n)) * idf[at]
        dense[k] /= np.linalg.norm(dense[k])
    want = np.linalg.svd(dense)[2][:5]
    assert np.allclose(np.abs(basis.T @ want.T).max(axis=1), 1, atol=0.05)
    some = rng.normal(size=(60, 3)).astype(np.float32)
    matrix = Sparse([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense], 60)
    assert np.allclose(matrix.times(some), dense @ some, atol=1e-4)
    assert np.allclose(matrix.turned_times(dense[:, :3].astype(np.float32)), dense.T @ dense[:, :3], atol=1e-4)


def test_terms():
    assert terms("", Shapes()) == Counter({"\x01length0": 1})
    found = terms("Word word, x### | 12-34", Shapes())
    assert found["word"] == 2 and found["\x02a###"] == 1 and found["\x020-0"] == 1


def test_without_labels_and_without_rows(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.0}
    assert quality(docs.limit(0), labels).collect() == []
