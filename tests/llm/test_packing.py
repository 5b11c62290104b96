import json
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brickwise.llm.bin_completion import best_fit, completions, least_sequences, solve
from brickwise.llm.packing import Encoder, blocks, packed, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    FILE = f.read()
ODD = ["", " ", "\n", "  ", " \n", "\n ", "\n\n", "a  b", "a \n b", "a\n\nb", "a\n\n", "a \n", "a\n\n\nb", "   a", "\n\n\n", "a   b c", "<|endoftext|>", "a <|endoftext|>  b", "\0 a\0", "\t x\ty", "a\xa0 b \xa0c", "e　 f  g", "\x85 h\x1c i", "it's we'll IT'S", "élan ünd 日本 語", "x" * 5000, " a" * 3000, "​ ﻿᠎", "a\r\nb\r\n", "12 34５"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def same(encoder, texts):
    got, at = encoder(pa.array(texts, pa.string()))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids(t) for t in texts]


@pytest.mark.parametrize("cache", [250_000, 2])
def test_ids_equal_the_library(cache):
    encoder = Encoder(FILE, cache)
    same(encoder, ODD)
    same(encoder, ODD[::-1])
    same(encoder, [])
    same(encoder, [" ".join(ODD), "plain words only", "\n".join(ODD)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\t'sé\xa0 <|endoftext>1_日\0", max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    same(Encoder(FILE, 10), texts)


def test_files_of_another_kind():
    spec = json.loads(FILE) | {"normalizer": {"type": "Lowercase"}}
    encoder, library = Encoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    got, at = encoder(pa.array(["ONE Two", "", "three"]))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in ("ONE Two", "", "three")]


def test_blocks_hold_all_texts():
    texts = pa.array(["a" * n for n in (3, 0, 50, 1, 1, 1, 9, 9)])
    assert list(blocks(texts, 10)) == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]


DOCS = [(i, t, "x") for i, t in enumerate([None, *ODD, "word " * 900, "word " * 5000, "long one " * 2048])] + [(None, "no id", "x"), (1, "repeated", "x"), (1, "repeated", "x")]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_sequences(spark, capacity):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, sequence_id string").repartition(3)
    got = packed(docs, PATH, capacity).collect()
    want = []
    for i, t, _ in DOCS:
        whole = [*ids(t), 0]
        first = (len(whole) - 1) % capacity + 1
        cuts = [0, *range(first, len(whole) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in held.values():
        inside.sort()
        assert [o for o, _ in inside] == np.cumsum([0, *(n for _, n in inside)])[:-1].tolist()
        assert sum(n for _, n in inside) <= capacity
    counts = np.bincount([r.length for r in got], minlength=capacity + 1)
    assert least_sequences(counts, capacity) <= len(held) <= sum(t for _, t in best_fit(counts, capacity))


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, ids string")
    rows = sequences(packed(docs, PATH, 256, with_ids=True)).collect()
    assert sum(len(r.ids) for r in rows) == sum(len(ids(t)) + 1 for _, t, _ in DOCS)
    assert all(len(r.ids) <= 256 and r.ids.count(0) <= len(r.starts) for r in rows)


def test_no_rows(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def fewest(lengths, capacity):
    """By trying every assignment."""
    for bins in range(1, len(lengths) + 1):
        for where in product(range(bins), repeat=len(lengths)):
            sums = [0] * bins
            for n, b in zip(lengths, where, strict=True):
                sums[b] += n
            if max(sums) <= capacity:
                return bins
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_as_few_as_brute_force(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=21)
    plan = solve(counts, 20)
    assert plan.n_sequences == fewest(lengths, 20)
    assert least_sequences(counts, 20) <= plan.n_sequences


def test_search_beats_best_fit():
    # Best fit puts both 4s together; each needs two of the 3s.
    counts = np.bincount([9, 8, 4, 4, 3, 3, 3, 3], minlength=11)
    assert sum(t for _, t in best_fit(counts, 10)) == 5 and solve(counts, 10).n_sequences == 4


def test_many_equal_sequences_and_their_places():
    rng = np.random.default_rng(3)
    counts = np.zeros(2049, np.int64)
    counts[rng.integers(1, 2049, 400)] = rng.integers(1, 10**9, 400)
    plan = solve(counts, 2048)
    assert all(plan.held.get(n, 0) == counts[n] for n in range(1, 2049))
    assert least_sequences(counts, 2048) <= plan.n_sequences <= sum(t for _, t in best_fit(counts, 2048))
    some = np.flatnonzero(counts)[:50].repeat(20)
    rank = (rng.random(len(some)) * counts[some]).astype(np.int64)
    sequence, offset = plan.places(some, rank)
    assert ((0 <= sequence) & (sequence < plan.n_sequences) & (offset + some <= 2048)).all()


def test_dominated_fillings_are_left_out():
    counts = [0, 1, 1, 1, 1, 1, 0, 0]
    following = [1, 1, 2, 3, 4, 5, 0, 0, 0]
    got = completions(5, 5, counts, [1, 2, 3, 4, 5], following)
    assert got == [(0, [5])]
