"""Token counts with a two-tier lookup of pre-token lengths (operator 7)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import text_or_empty

LIMIT = 1024
#: Pre-tokens that a worker remembers beside the broadcast table; beyond it the memory starts anew.
CACHE = 400_000
#: The pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern engines class differently as white space; texts that hold one take the library's own path.
UNSURE = r"[\x1c-\x1f\x85᠎​﻿]"


def is_byte_level(tokenizer_json: str) -> bool:
    """Whether the file is what the lookup assumes: byte-level BPE that splits by PATTERN, without a normalizer, a blank
    put before the text, dropout, or added tokens that match in other ways than as plain strings."""
    spec = json.loads(tokenizer_json)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens") or [])
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    return split and plain and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")


class Lengths(dict):
    """Lengths in tokens by pre-token: the broadcast tier, and what this worker has met since."""

    def __init__(self, frequent: dict[str, int], encode, room: int):
        super().__init__(frequent)
        self.frequent, self.encode, self.room = frequent, encode, room + len(frequent)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.room:
            self.clear()
            self.update(self.frequent)
        found = self[piece] = len(self.encode(piece, add_special_tokens=False).ids)
        return found


class Counter:
    """Counts tokens as the tokenizer in the given JSON does."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int], cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = is_byte_level(tokenizer_json)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.pieces, self.unsure = regex.compile(PATTERN).findall, regex.compile(UNSURE).search
        self.lengths = Lengths(frequent, self.tokenizer.encode, cache)

    def __call__(self, text: str) -> int:
        if not self.plain or self.unsure(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        get = self.lengths.__getitem__
        if self.special and any(mark in text for mark in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(get, self.pieces(part))) for part in parts)
        return sum(map(get, self.pieces(text)))


def frequent_lengths(tokenizer_json: str) -> dict[str, int]:
    """The first tier: every vocabulary entry that is one whole pre-token, with its length in tokens. A BPE
    vocabulary is the list of the pieces most frequent where it was trained, and its size bounds the table."""
    from tokenizers import Tokenizer

    if not is_byte_level(tokenizer_json):
        return {}
    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    whole = regex.compile(PATTERN).fullmatch
    texts = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)
    texts = [t for t in dict.fromkeys(texts) if t and "�" not in t and t not in special and whole(t)]
    return {t: len(e.ids) for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, cache: int = CACHE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text), in one pass without a shuffle.

    A null text counts as empty: no bytes, no tokens. Special strings inside a text count as the
    library has them by default. Repeated rows and null ids keep a row each; other columns are
    ignored; an empty table gives an empty result. A file of another kind than is_byte_level tells has no first tier
    and every text is one call of the library. The tokenizer file is read on the driver and
    sent, with the table, as a broadcast of its own fixed size."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer_json, frequent_lengths(tokenizer_json)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent, cache)
        for batch in batches:
            found = [counter(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_made: dict[int, Counter] = {}


def _counter(sent, cache: int) -> Counter:
    """One counter for each worker process and broadcast, kept from task to task."""
    key = sent._jbroadcast_id if hasattr(sent, "_jbroadcast_id") else hash(sent.value[0])
    if key not in _made:
        _made.clear()
        _made[key] = Counter(*sent.value, cache)
    return _made[key]
