import re
from itertools import permutations

from brickwise.llm.filter_audit import FIRST, ORDERS, failures, filter_audit_sql, filter_interactions
from tests.llm.sql import same_as_sql

LONG = " ".join(f"word{i}" for i in range(220))
DULL = "same old thing " * 90
TEXTS = [LONG, LONG, LONG + " #", LONG.upper(), DULL, DULL + "&", DULL.upper(), "", None, " \t\x0b\n", "Short", "ÀÉ short\x85one ", "x" * 300_000, LONG, "é" * 40 + "AB", "é" * 40 + "ABC", " ".join(["a", "b"] * 101), "a|b"]
DOCS = [(i, t, ("en", "de", None, "")[i % 4], "x") for i, t in enumerate(TEXTS)]
DOCS += [(1, LONG, "en", "x"), (1, LONG, "en", "x"), (0, LONG, "de", "x"), (None, LONG, "en", "x"), (None, None, None, None), (None, LONG, "en", "x"), (-5, "a|b", "fr", None), (-5, "a|b", "fr", None)]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, 1, 1), (3, None, None), (4, 0, 1), (None, 1, 1), (99, 1, 1), (13, 1, 1), (-5, 1, 0)]


def plain(docs, labels):
    """One pass over the documents for each order."""
    whitespace = re.compile(r"[^\x20\x09-\x0D]+")
    seen, said = {}, {}
    for i, t, *_ in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    for i, q, t in labels:
        if i is not None:
            good, bad = said.get(i, (False, False))
            said[i] = good or q == 1, bad or t == 1
    rows = {}
    for part in {lang or "" for _, _, lang, _ in docs}:
        fails = []
        for i, t, lang, _ in docs:
            if (lang or "") == part:
                t = t or ""
                words = whitespace.findall(t)
                bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in seen and i > seen[t]}
                fails.append((bad, *said.get(i, (False, False))))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = fails
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                rows[part, "".join(order), step] = [len(left), len(gone), sum(d[0][f] for d in fails) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in fails), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in rows.items())


def tables(spark, docs=DOCS, labels=LABELS):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, bits string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_one_pass_for_each_order(spark):
    got = sorted(map(tuple, filter_interactions(*tables(spark)).collect()))
    assert got == plain(DOCS, LABELS)
    assert len(got) == 4 * 600


def test_equals_sql(spark):
    docs, labels = tables(spark)
    same_as_sql(filter_interactions(docs, labels), filter_audit_sql(), documents=docs, labels=labels)


def test_lookup_table():
    assert FIRST.shape == (32, 120) and len(set(ORDERS)) == 120
    assert FIRST[0].tolist() == [5] * 120
    assert FIRST[0b10010, ORDERS.index("ACEDB")] == 2


def test_limits_of_the_filters():
    words = [f"w{i}" for i in range(200)]
    assert failures(" ".join(words).encode()) == 0 and failures(" ".join(words[:199]).encode()) & 1
    half = " ".join((words[:100]) * 2).encode()
    assert not failures(half) & 2 and failures(half + b" w1") & 2
    assert not failures(("AAA" + "é" * 97).encode()) & 4 and failures(("AAA" + "é" * 96).encode()) & 4


def test_no_rows_no_labels(spark):
    docs, labels = tables(spark, [], [])
    assert filter_interactions(docs, labels).collect() == []
    some, _ = tables(spark)
    assert {(r.good_lost, r.toxic_lost) for r in filter_interactions(some, labels).collect()} == {(0, 0)}
