import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brickwise.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a<|endoftext|> b  <|endoftext|><|endoftext|>", " \n\n  x", "  a\xa0b　\t\r\n", "é" * 5000, "it's we'LL 123４５ !!!\x00 \x1c \x85 ​", "日本語 русский " * 50, "it's we'LL 123４５ !!!"]


@pytest.mark.parametrize("cache", [400_000, 2])
def test_counts_equal_the_library(spark, cache):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "token " * 2000, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, cache=cache).collect()
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}])
def test_files_of_another_kind(spark, tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    rows = [(i, t) for i, t in enumerate([*TEXTS, "ONE Two three FOUR"])]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
