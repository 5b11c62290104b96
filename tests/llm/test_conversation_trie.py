import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brickwise.llm.conversation_trie import conversation_trie, conversation_trie_sql, prefix_trie, quicksorted
from tests.llm.sql import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string, ids string, n long"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def plain(sequences, points):
    """Every prefix of every sequence in a dictionary, and sums over all nodes that begin with it."""
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    rows = []
    for node, convs in members.items():
        inside = [x for x in members if x[: len(node)] == node]
        children = sum(len(x) == len(node) + 1 for x in inside)
        leaves = sum(not any(y != x and y[: len(x)] == x for y in inside) for x in inside)
        saved = sum((len(members[x]) - 1) * points(x[-1]) for x in inside if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def made(seed, convs=60, words=3, longest=8):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), *range(100, 100 + convs // 2), *range(205, 215), -3, 10**12 + 1]:
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["a", "bé", "日本 語", None, ""][:words]), "x", 1))
    return rows


ODD = [(0, None, "user", "first", "x", 1), (0, 0, "user", "second", "x", 1), (0, 0, None, "second", "x", 1), (0, 0, "user", "second", "x", 1), (None, 0, "user", "no conversation", "x", 1), (7, 5, None, None, None, None), (8, 5, "", "", None, None), (5, 1, "ab", "c", "x", 1), (6, 1, "a", "bc", "x", 1), (11, 0, "user", "y" * 100_000, "x", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("rows", "local"), [(made(1), 4), (made(2, words=5), 1), (made(3), 128), (ODD, 1), (made(4, 20) + [(c, t, "user", "same", "x", 1) for c in range(300, 380) for t in range(12)], 3)])
def test_equals_all_prefixes(spark, rows, local):
    got = sorted(map(tuple, conversation_trie(frame(spark, rows), local).collect()), key=str)
    assert got == plain(rebuilt(rows), lambda turn: len(turn[1]))


@pytest.mark.parametrize("rows", [made(5, words=4), ODD])
def test_equals_sql(spark, rows):
    conversations = frame(spark, rows)
    same_as_sql(conversation_trie(conversations, 5), conversation_trie_sql(), conversations=conversations)


def sequences(spark, given):
    return spark.createDataFrame([(c, list(s), [x % 7 for x in s]) for c, s in given.items()], "conv_id long, ids array<long>, points array<int>")


@pytest.mark.parametrize("local", [1, 2, 50])
def test_long_shared_stretches_take_one_round(spark, local):
    stem = list(range(30))
    given = {1: stem, 2: [*stem, 5, 6], 3: [*stem, 5, 7], 9: [*stem, 5, 7], 4: [*stem, 8], 5: [], 6: [], 7: [100], 8: stem[:10], 10: [3, *stem]}
    got = sorted(map(tuple, prefix_trie(sequences(spark, given), local).collect()), key=str)
    assert got == plain(given, lambda turn: turn % 7)


def test_only_conversations_without_turns(spark):
    assert [tuple(r)[:7] for r in prefix_trie(sequences(spark, {3: [], 4: []})).collect()] == [(3, 0, None, 2, 0, 1, 0)]


def test_no_rows(spark):
    assert conversation_trie(frame(spark, [])).collect() == []


def test_many_conversations_of_one_sequence(spark):
    rows = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    got = {r.depth: r for r in conversation_trie(rows).collect() if r.conv_id == 0}
    ends = [str(c) for c in range(20_000)]
    assert got[1].n_convs == len(ends) == 20_000
    assert got[1].ends_sha256 == hashlib.sha256(",".join(ends).encode()).hexdigest()


def test_deep_buckets_need_no_recursion():
    rows = [(list(range(50_000)), [1] * 50_000, 1, 1, "e"), (list(range(40_000)), [1] * 40_000, 2, 3, "f")]
    nodes = quicksorted(rows, 0, 0)
    assert len(nodes) == 50_000 and nodes[39_999][3:7] == (4, 1, 1, 3) and nodes[0][8]
