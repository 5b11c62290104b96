import random
import re
from collections import Counter

from brickwise.llm.decontaminate import benchmark_leaks, needed_stride


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(text, size=5):
    words = words_of(text)
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def alike(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            size = min(5, len(words_of(item)))
            g, want = (grams(t, size) if size else [] for t in (text, item))
            if want and g:
                m = len(want)
                best = max((alike(g[s : s + m], want), -s) for s in range(max(1, len(g) - m + 1)))
                if best[0] >= 0.8 - 1e-12:
                    out.add((doc_id, item_id, round(best[0], 9), -best[1]))
    return out


def corpus():
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(150)]
    some = lambda k: rnd.choices(words, k=k)
    items = [(i, some(rnd.randint(9, 60))) for i in range(30)]
    docs = []
    for d in range(120):
        text = some(rnd.randint(1, 150))
        for _ in range(rnd.randint(0, 2)):
            piece = list(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(piece))
                piece[at : at + 1] = rnd.choice([[], ["changed"], [piece[at], "more"]])
            at = rnd.randint(0, len(text))
            text[at:at] = piece
        docs.append((d, " ".join(text).capitalize()))
    docs += [(500, " ".join(items[0][1])), (501, " ".join(items[1][1][:-1])), (502, None), (503, ""), (504, "one two three"), (500, " ".join(items[0][1]))]
    docs += [(506, "Only, " + items[4][1][0] + "! so " + items[5][1][2]), (507, items[5][1][2])]
    docs += [(505, "filler words " * 20000 + " ".join(items[2][1]).upper())]
    items = [(i, ", ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "only " + items[4][1][0]), (94, items[5][1][2]), (95, "never seen"), (93, ", ".join(items[3][1]))]
    return docs, items


def test_stride_is_safe():
    assert needed_stride([1], 0.8) == 1
    assert 4 <= needed_stride(list(range(11, 60)), 0.8) <= 6


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as m").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = benchmark_leaks(d, b).collect()
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in rows}
    assert {x[:2] for x in got} == {x[:2] for x in want} and got == want
    assert len(rows) == len(want) + sum(x[0] == 500 for x in want) and len(want) > 60
    assert {92, 94} <= {x[1] for x in want}


def test_long_items(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(4000)]
    long, same = rnd.choices(words, k=40_000), ["again"] * 36_000
    edited = list(long)
    edited[5000:5100] = ["x"] * 100
    items = [(1, " ".join(long)), (2, " ".join(same)), (3, " ".join(long[:900]))]
    docs = [(1, " ".join(["before"] * 500 + edited + ["behind"] * 300)), (2, " ".join(same[:35_000])), (3, " ".join(long[:30_000])), (4, " ".join(long[:880]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.first_word, r.n_words) for r in benchmark_leaks(d, b).collect()}
    assert got == {(1, 1): (0.995, 500, 40_000), (1, 3): (1.0, 500, 900), (2, 2): (0.972, 0, 35_000), (3, 3): (1.0, 0, 900), (4, 3): (0.978, 0, 880)}


def test_short_items_lose_nothing(spark):
    """Items of 5 to 10 shingles and texts at a similarity of just 0.8 or above: cut at an end, or with one word more or less."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(2000)]
    items = [(i, rnd.choices(words, k=9 + i % 6)) for i in range(120)]
    docs = []
    for i, piece in items:
        for k, cut in enumerate((piece[1:], piece[:-1], piece[:-2], piece)):
            docs.append((4 * i + k, " ".join([*rnd.choices(words, k=rnd.randint(0, 20) * (k % 2)), *cut])))
    items = [(i, " ".join(p)) for i, p in items]
    want = brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in benchmark_leaks(d, b).collect()}
    assert got == want and len(want) > 300 and sum(x[2] == 0.8 for x in want) > 20


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert benchmark_leaks(d.limit(0), b).collect() == []
    assert benchmark_leaks(d, b.limit(0)).collect() == []
