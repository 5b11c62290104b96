"""Best-fit packing of tokenised documents into sequences, by bin completion (operator 12)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm.bin_completion import Plan, solve
from brickwise.llm.common import stage, text_or_empty
from brickwise.llm.token_counts import PATTERN, UNSURE, is_byte_level

CAPACITY, END_ID = 2048, 0
#: Bytes of text that a worker encodes at once; a longer text is one such block.
BLOCK = 8 << 20
#: Words whose ids a worker remembers; twice as many at most, as the ones before the last change are kept too.
CACHE = 250_000
#: Marks that are no part of a letter's stretch and, alone behind one, no stretch with others.
MARKS = frozenset(".,;:!?")
#: Words that are encoded as lines of one text.
LINES = 64
#: Texts with a stretch of white space whose parts aren't each of their own, with white space other than blanks and line ends, or
#: with characters that engines class differently. All others may be cut before every blank and around every line end.
ENTWINED = "[ \n]{3}|[ \n]{2}\\z|[\\x00\\t\\x0b-\\x0d\\x1c-\\x1f\u0085\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


class Encoder:
    """Token ids of many texts at once, as the library gives them: texts are cut at places where the tokenizer always cuts,
    the distinct parts of a block are looked up, and only parts never met go to the library."""

    def __init__(self, tokenizer_json: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = is_byte_level(tokenizer_json)
        self.entwined = "|".join([ENTWINED, *map(regex.escape, special)])
        self.pieces, self.unsure = regex.compile(PATTERN).findall, regex.compile(UNSURE).search
        self.special = regex.compile(f"({'|'.join(map(regex.escape, special))})") if special else None
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if self.plain and len(line_end) == 1 and self._stands_alone(line_end[0]) else None
        self.room, self.young, self.old = cache, {}, {}

    def _stands_alone(self, token: int) -> bool:
        """Whether a token is one byte and nothing else, so that only a line end can give it."""
        return len(self.tokenizer.id_to_token(token)) == 1

    def _whole(self, text: str) -> list[str] | None:
        """The parts of a text by the tokenizer's own pattern; None if only the library can tell them."""
        if not self.plain or self.unsure(text):
            return None
        if self.special is None:
            return self.pieces(text)
        parts = self.special.split(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces(part))]

    def _encode(self, parts: list[str]) -> None:
        """Remember the ids, as little-endian 32-bit numbers, of parts never met. Parts without a line end, which the tokenizer
        parts from all around it and which is always one token, are encoded as the lines of a text."""
        young, old = self.young, self.old
        # A mark behind letters is a token of its own: with any mark, a word is encoded once.
        marked = [p for p in parts if p[-1:] in MARKS and p[:-1].lstrip(" ").isalpha()] if self.plain else []
        if marked:
            own = set(marked)
            stems = {*(p[:-1] for p in marked), *(p[-1] for p in marked)}
            parts = [*(p for p in parts if p not in own), *(s for s in stems.difference(parts) if s not in young)]
            for s in parts[-len(stems) :]:
                if s in old:
                    young[s] = old[s]
            parts = [p for p in parts if p not in young]
        lines = [p for p in parts if not p.isspace() and p and "\n" not in p] if self.line_end is not None else []
        if lines:
            texts = ["\n".join(lines[k : k + LINES]) + "\n" for k in range(0, len(lines), LINES)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.line_end) * 4
            raw, at = ids.tobytes(), 0
            for p, end in zip(lines, ends.tolist(), strict=True):
                young[p] = raw[at:end]
                at = end + 4
        rest = [p for p in parts if p not in young]
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            young[p] = np.array(e.ids, "<u4").tobytes()
        for p in marked:
            young[p] = young[p[:-1]] + young[p[-1]]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts, each of them distinct."""
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        lacking = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in lacking:
            x = old.get(parts[k])
            if x is None:
                new.append(parts[k])
            else:
                young[parts[k]] = x
        if new:
            self._encode(new)
        for k in lacking:
            found[k] = young[parts[k]]
        if len(young) >= self.room:
            self.young, self.old = {}, young
        return found

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins in them, the end included."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.entwined).to_numpy(zero_copy_only=False) if self.plain else np.ones(n, bool)
        some = bool(odd.any())
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)) if some else texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        odd_texts = texts.filter(pa.array(odd)).to_pylist() if some else []
        lists = [self._whole(t) for t in odd_texts]
        alone = [t for x, t in zip(lists, odd_texts, strict=True) if x is None]
        counts = np.empty(n, np.int64)
        counts[~odd] = pc.list_value_length(split).to_numpy()
        counts[odd] = [1 if x is None else len(x) for x in lists]
        coded = pa.concat_arrays([split.flatten(), pa.array([p for x in lists if x is not None for p in x], pa.string())]).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        ids += [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in alone]
        which = coded.indices.to_numpy()
        if some:
            # The parts of odd texts, and the texts that are looked up whole, go to their places between the others.
            of_text = np.repeat(np.arange(n), counts)
            whole = np.zeros(n, bool)
            whole[np.flatnonzero(odd)] = [x is None for x in lists]
            of_odd, single = odd[of_text], whole[of_text]
            looked, n_even = which, int((~of_odd).sum())
            which = np.empty(counts.sum(), np.int64)
            which[~of_odd] = looked[:n_even]
            which[of_odd & ~single] = looked[n_even:]
            which[single] = len(coded.dictionary) + np.arange(len(alone))
        by_part = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))] // 4, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        out = by_part.take(pa.array(which))
        ends = out.offsets.to_numpy()
        return out.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0])[np.r_[0, counts.cumsum()]].astype(np.int64)


def blocks(texts: pa.StringArray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes, one text at least."""
    lengths = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(lengths[at:].cumsum(), size, "right")))
        yield at, end
        at = end


_made: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder for each worker process and broadcast, kept from task to task."""
    key = sent._jbroadcast_id if hasattr(sent, "_jbroadcast_id") else hash(sent.value)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(sent.value)
    return _made[key]


#: Columns of the pieces before they have a place. task and nth: the task that cut a piece, and how many of this length it cut before.
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' ids, end_id behind each document, cut into pieces: (doc_id, piece, start, length, ids_crc32, task,
    nth) and, if asked for, ids. Only documents of more than capacity tokens are cut, so that every piece but the first is full."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(sent), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                ids, at = encoder(batch.column(1).slice(a, b - a))
                n = np.diff(at) + 1
                last = -(-n // capacity) - 1
                doc = np.repeat(np.arange(b - a), last + 1)
                piece = np.arange(len(doc)) - np.repeat((last + 1).cumsum() - last - 1, last + 1)
                end = n[doc] - (last[doc] - piece) * capacity
                start = np.maximum(end - capacity, 0)
                length = end - start
                order = np.argsort(length, kind="stable")
                groups = length[order]
                first = np.searchsorted(groups, groups)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - first + met[groups]
                met += np.bincount(length, minlength=capacity + 1)
                closing = np.array([end_id], "<u4").tobytes()
                held = [ids[at[d] + s : min(at[d] + e, at[d + 1])].tobytes() + closing * int(p == z) for d, s, e, p, z in zip(doc, start, end, piece, last[doc], strict=True)]
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length, pa.int32()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in held], pa.int64()), "task": pa.array(np.full(len(doc), task), pa.int32()), "nth": pa.array(nth),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in held], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def placed(cut: DataFrame, plan: Plan) -> DataFrame:
    """The pieces with sequence_id and offset. A piece's rank among those of its length is what its task cut before,
    behind what earlier tasks cut; the plan says which sequence holds that rank. No group is gathered or sorted for it."""
    spark = cut.sparkSession
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "task", "nth")
    sent = spark.sparkContext.broadcast(plan)
    names = ranked.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = {c: batch.column(c) for c in names if c != "rank"}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(put, ", ".join(f"{c} {kinds[c]}" for c in names if c != "rank") + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs(doc_id, text), and with with_ids its ids.

    Texts are encoded once, by task; pieces, without their ids unless these are asked for, are written to the shared folder.
    How many pieces there are of each length, capacity numbers at most, is all that comes to the driver; from these
    bin completion makes a plan of fillings, each with the number of sequences that have it.
    A null text is empty: one piece of the end token. Null and repeated doc_ids keep their rows, a document each; extra columns
    are ignored; an empty table gives no rows; a text of any length is one document."""
    cut = stage(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    return placed(cut, solve(counts, capacity)).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the sequences themselves, from packed(..., with_ids=True). A group holds capacity tokens at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
