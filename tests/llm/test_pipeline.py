import random

import corpus_pipeline
from brickwise.llm.decontaminate import benchmark_leaks
from brickwise.llm.simhash_dedup import fingerprint
from tests.llm.test_simhash_dedup import brute


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def corpus(spark, folder):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    some = lambda k: rnd.choices(words, k=k)
    items = [(i, " ".join(some(30))) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        text = some(rnd.randint(30, 120))
        toxic = i % 8 == 0
        if toxic:
            text[::3] = rnd.choices(["idiot", "trash", "moron"], k=len(text[::3]))
        labels.append((i, int(toxic), 1))
        rows.append([i, " ".join(text), "en", f"s{i % 7}", 0])
    for i in range(1, 400, 40):  # copies, leaks and secrets, on documents that aren't toxic
        rows.append([1000 + i, rows[i][1], "en", "s1", 0])
        rows.append([2000 + i, " ".join(some(40)) + " " + items[i % 5][1] + " " + " ".join(some(40)), "de", "s2", 0])
        rows.append([3000 + i, " ".join(some(50)) + f' token = "{i:024x}" ' + " ".join(some(50)), "de", "s3", 0])
    rows += [[5000, None, None, None, None], [5001, "", "en", "s1", 0], [None, "no id at all", "en", "s1", 12]]
    for k in range(6):
        rows.append([6000 + k, " ".join(some(50)) + f" token = \"{'ab' * 16}\"", "en", f"s{k}", 0])
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(spark, folder, "documents", rows, schema)
    write(spark, folder, "labels", labels, "doc_id long, toxic int, quality int")
    write(spark, folder, "benchmark", items, "item_id long, text string")


def test_stages_one_by_one(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5

    mild = steps["toxicity"](spark, docs, folder).cache()
    assert mild.columns == docs.columns
    left = {r.doc_id: r for r in mild.collect()}
    assert all(i % 8 for i in left if i is not None and i < 400) and len(left) == docs.count() - 50

    single = steps["near duplicates"](spark, mild, folder).cache()
    rows = [(r.doc_id, r.text) for r in mild.collect()]
    want = {i for i, _, name in brute([r for r in rows if r[0] is not None]) if i == name} | {None}
    assert {r.doc_id for r in single.collect()} == want and not want & {1000 + i for i in range(1, 400, 40)}
    assert fingerprint(b"") == 0 and 5000 in want and 5001 not in want

    clean = steps["decontamination"](spark, single, folder).cache()
    bad = {r.doc_id for r in benchmark_leaks(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert bad == {2000 + i for i in range(1, 400, 40)}
    assert {r.doc_id for r in clean.collect()} == want - bad

    safe = steps["secrets"](spark, clean, folder).cache()
    assert safe.columns == docs.columns
    before, after = ({r.doc_id: r for r in df.collect()} for df in (clean, safe))
    assert before.keys() == after.keys()
    for i, r in after.items():
        if i is not None and 3000 <= i < 4000:
            secret = f'token = "{i - 3000:024x}'
            assert r.text == before[i].text.replace(secret, "[secret]") and r.n_chars == len(r.text)
        else:
            assert r == before[i]
    assert any("abab" in r.text for i, r in after.items() if i is not None and i >= 6000)

    last = {r.doc_id: r for r in steps["sentencepiece"](spark, safe, folder).collect()}
    assert last.keys() == after.keys() and all(r.lossless for r in last.values())
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == last


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.collect() == []


def test_extra_columns_with_clashing_names(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["toxic", "mark", "gone_id", "gone_mark", "whole", "found", "row", "spans", "fp", "Score", "a.b", "repository", "owner", "k1"]
    wide = plain.selectExpr("*", *[f"doc_id + {k} as `{n}`" for k, n in enumerate(names)])
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, wide, folder)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r["doc_id"] is None or r[n] == r["doc_id"] + k for r in rows for k, n in enumerate(names)), name
        assert sorted(map(str, step(spark, plain, folder).collect())) == sorted(str(type(r)(**{c: r[c] for c in plain.columns})) for r in rows)


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    folder = str(tmp_path)
    rnd = random.Random(5)
    some = lambda k: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(k))
    item, a, b = some(30), some(60), some(60)
    rows = [(3, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (7, f"{some(20)} {item} {some(20)}", "en", "s", 0), (7, some(50), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(spark, folder, "documents", rows, schema)
    write(spark, folder, "benchmark", [(1, item)], "item_id long, text string")
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    left = sorted(r.text for r in steps["near duplicates"](spark, docs, folder).collect())
    assert left == sorted(r[1] for k, r in enumerate(rows) if k != 1)
    left = sorted(r.text for r in steps["decontamination"](spark, docs, folder).collect())
    assert left == sorted(r[1] for k, r in enumerate(rows) if k != 3)
