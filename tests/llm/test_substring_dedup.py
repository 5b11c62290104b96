import random
import re

import xxhash

from brickwise.llm.queries import op3_substring_dedup
from brickwise.llm.substring_dedup import substring_dedup


def sentences(text):
    """Lists of words, by a plain walk over the text."""
    out, now, at = [], [], 0
    for m in re.finditer(r"[^\W_]+", text):
        if now and (re.search(r"[.!?]\s|\n", text[at : m.start()]) or xxhash.xxh32_intdigest(now[-1]) % 8 == 0):
            out.append(now)
            now = []
        now.append(m[0].lower())
        at = m.end()
    return out + [now] if now else out


def plain_spans(split, run, least):
    """Every run that can't lose its last sentence, and the run at the end that can't lose its first one."""
    n = len(split)
    good = lambda i, j: j - i >= run and sum(map(len, split[i:j])) >= least
    found = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if good(i, j) and not good(i, j - 1)}
    return sorted(found | {(i, n) for i in range(n) if good(i, n) and not good(i + 1, n)})


def brute(rows, run=3, least=16):
    split = [sentences(t or "") for _, t in rows]
    seen, gone = {}, [set() for _ in rows]
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        for i, j in plain_spans(split[k], run, least):
            words = tuple(w for s in split[k][i:j] for w in s)
            if words in seen and seen[words] != (k, i):
                gone[k] |= set(range(i, j))
            seen.setdefault(words, (k, i))
    left = [[w for i, s in enumerate(split[k]) if i not in gone[k] for w in s] for k in range(len(rows))]
    return sorted((rows[k][0], len(split[k]), sorted(gone[k]), left[k]) for k in range(len(rows)) if gone[k])


def test_against_brute_force(spark):
    rnd = random.Random(2)
    sentence = lambda: " ".join("".join(rnd.choices("abcdé", k=rnd.randint(1, 4))) for _ in range(rnd.choice([1, 1, 4, 9, 15]))).capitalize() + rnd.choice(".!?,")
    shared = [[sentence() for _ in range(rnd.randint(2, 8))] for _ in range(12)]
    rows = []
    for d in range(150):
        text = [sentence() for _ in range(rnd.randint(0, 15))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(text))
            text[at:at] = rnd.choice(shared)
        rows.append((d, rnd.choice([" ", "\n", "  "]).join(text)))
    rows += [(900, None), (901, ""), (902, " . ! "), (903, "One two. " * 200), (904, " ".join(shared[0]).upper()), (905, " ".join(shared[0]).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "3 as at").repartition(5)
    for run, least in ((3, 16), (2, 5), (1, 1)):
        got = sorted((r.doc_id, r.n_sentences, r.removed, [w for s in sentences(r.text) for w in s]) for r in substring_dedup(docs, run, least).collect())
        assert got == brute(rows, run, least) and len(got) > 50


def test_repeated_rows_long_texts_and_empty_table(spark):
    text = "This is the first sentence. Here the second one stands. And the third one, which ends it, has a few more words."
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (None, "x")], "doc_id long, text string")
    got = substring_dedup(docs).collect()
    assert [(r.doc_id, r.n_removed == r.n_sentences, r.first_docs, r.text) for r in got] == [(2, True, [1], "")] * 2
    assert substring_dedup(docs.limit(0)).collect() == []
    long = "One two. " * 100_000
    (r,) = substring_dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert r.n_removed == r.n_sentences - 2 and r.text == "One two."  # all but the first span's own place


def test_query_finds_stretches_of_short_sentences(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6))) for _ in range(400)]
    marked, lines = "!! ".join(rnd.sample(words, 120)) + "!!", "\n".join(rnd.sample(words, 80))
    rows = [(1, marked), (2, marked.upper()), (3, lines), (4, "Something else. " + lines), (5, "a\nb\nc"), (6, "a\nb\nc"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.first_docs, r.text) for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {2: (120, [1], ""), 4: (80, [3], "Something else.")}


def test_query_finds_passages_that_begin_and_end_inside_sentences(spark, tmp_path):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(5000)]
    some = lambda k: " ".join(rnd.choices(words, k=k))
    passages = [some(60) for _ in range(200)]
    rows = [(2 * k + side, f"{some(90)} {p} {some(90)}.") for k, p in enumerate(passages) for side in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(i % 2 and got[i].first_docs == [i - 1] for i in got) and len(got) >= 180
