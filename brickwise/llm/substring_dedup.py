"""Substring deduplication by sliding sentence spans (operator 3)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import stage, text_or_empty

#: A span is the shortest run of consecutive sentences from a place on that has so many of them and so many words.
RUN = 3
LEAST_WORDS = 16
#: A sentence ends behind its mark, where white space follows, or with the line; and behind every word whose hash is a
#: multiple of CUT. Such cuts depend on nothing but the word, so they are the same in every copy of a passage, also in
#: one that begins and ends inside sentences, or has no marks at all.
BREAK = re.compile(r"[.!?]\s|\n").search
CUT = 8
WORDS = re.compile(r"([^\W_]+)").split
#: Words that a worker remembers.
ROOM = 500_000


class Words(dict):
    """By word: its lower case, and whether it cuts."""

    def __missing__(self, word: str) -> tuple[str, bool]:
        if len(self) >= ROOM:
            self.clear()
        low = word.lower()
        found = self[word] = (low, xxhash.xxh32_intdigest(low) % CUT == 0)
        return found


class Gaps(dict):
    """By what stands between two words: whether a sentence ends there."""

    def __missing__(self, gap: str) -> bool:
        if len(self) >= ROOM:
            self.clear()
        found = self[gap] = BREAK(gap) is not None
        return found


class Cutter:
    def __init__(self):
        self.words, self.gaps = Words(), Gaps()

    def parts(self, text: str) -> tuple[list[str], list[str], np.ndarray]:
        """The gaps and words of a text in turn, its words in lower case, and the number of words up to the end of each
        sentence."""
        parts = WORDS(text)
        known = [self.words[w] for w in parts[1::2]]
        ends = [i for i, (w, gap) in enumerate(zip(known, parts[2::2], strict=True), 1) if w[1] or (gap != " " and self.gaps[gap])]
        if known and (not ends or ends[-1] != len(known)):
            ends.append(len(known))
        return parts, [w[0] for w in known], np.array(ends, dtype=np.int64)


def spans(ends: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every span: from each sentence on, as far as is needed; and one that ends with the
    text, so that its last sentences are in a span too."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(n)
    starts = np.r_[0, ends[:-1]]
    last = np.maximum(np.searchsorted(ends, starts + least_words), first + run - 1)
    first, last = first[last < n], last[last < n]
    back = min(np.searchsorted(starts, ends[-1] - least_words, side="right") - 1, n - run)
    if back >= 0 and (not len(first) or first[-1] != back or last[-1] != n - 1):
        first, last = np.r_[first, back], np.r_[last, n - 1]
    return first, last


def _lists(edges: list[int], flat) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum(edges), pa.int32()), pa.array(flat))


def _measure(run: int, least_words: int):
    """(row, doc_id, text) -> row, doc_id, the packed text, its spans (at, size, h1, h2), the first of equal ones only, and
    the rest of those with the place of the first (again_at, again_size, again_of)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            packed, once, again, digests, n_once, n_again = [], [], [], [], [0], [0]
            for text in batch.column("text").to_pylist():
                packed.append(zlib.compress(text.encode(), 1))
                _, low, ends = cutter.parts(text)
                first, last = spans(ends, run, least_words)
                joined = " ".join(low)
                at = np.r_[0, np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)]
                begin = at[np.r_[0, ends][first]].tolist() if len(ends) else []
                stop = (at[ends[last]] - 1).tolist() if len(ends) else []
                seen: dict[bytes, int] = {}
                before = len(again)
                for k, size, a, b in zip(first.tolist(), (last - first + 1).tolist(), begin, stop, strict=True):
                    digest = xxhash.xxh3_128_digest(joined[a:b].encode())
                    if digest in seen:
                        again.append((k, size, seen[digest]))
                    else:
                        seen[digest] = k
                        once.append((k, size))
                digests += seen
                n_once.append(len(seen))
                n_again.append(len(again) - before)
            pairs = np.array(once, dtype=np.int32).reshape(-1, 2)
            rest = np.array(again, dtype=np.int32).reshape(-1, 3)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            lists = [_lists(n_once, x.copy()) for x in (pairs[:, 0], pairs[:, 1], both[:, 0], both[:, 1])] + [_lists(n_again, rest[:, k].copy()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *lists], names=["row", "doc_id", "packed", "at", "size", "h1", "h2", "again_at", "again_size", "again_of"])

    return work


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the sentences of its repeated spans."""
    cutter = Cutter()
    for batch in batches:
        counts, gone, left, sources = [], [], [], []
        for r in batch.select(["doc_id", "packed", "at", "size", "first_docs", "again_at", "again_size", "again_of"]).to_pylist():
            parts, _, ends = cutter.parts(zlib.decompress(r["packed"]).decode())
            at, size = (np.array((r[k] or []) + r[f"again_{k}"], dtype=np.int64) for k in ("at", "size"))
            edge = np.zeros(len(ends) + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            removed = np.cumsum(edge)[:-1] > 0
            starts = np.r_[0, ends[:-1]]
            kept = [parts[2 * s + (s > 0) : 2 * e + 1] for s, e in zip(starts[~removed].tolist(), ends[~removed].tolist(), strict=True)]
            counts.append(len(ends))
            gone.append(np.flatnonzero(removed).tolist())
            left.append("".join(x for k in kept for x in k).strip())
            own = set(r["again_of"]) - set(r["at"] or [])
            found = {*(r["first_docs"] or []), *([r["doc_id"]] if own else [])}
            sources.append(sorted(found, key=lambda d: (d is not None, d)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array([len(g) for g in gone], pa.int32()), pa.array(gone, pa.list_(pa.int32())), pa.array(sources, pa.list_(pa.int64())), pa.array(left, pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "removed", "first_docs", "text"],
        )


def repeated_spans(measured: DataFrame) -> DataFrame:
    """(row, at, size, first_docs) of every row with a span that another row before it has: the places and sizes of
    those spans, and the documents that hold the first ones. First is the smallest doc_id (null before all), then row.
    The digest has 128 bits. Sums of fixed width are made before the shuffle; a hot digest meets only rows that Spark can
    split between tasks."""
    low = F.lit(-(1 << 63))
    zipped = F.arrays_zip("at", "size", "h1", "h2")
    each = measured.select("row", F.coalesce("doc_id", low).alias("doc"), F.explode(zipped).alias("s")).select("row", "doc", "s.at", "s.size", "s.h1", "s.h2")
    firsts = each.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    shared = stage(each.join(stage(firsts, "repeats"), ["h1", "h2"]), "repeated")
    # Rows of one id: the first of them is told by row, where several hold the digest's first copy.
    ids = measured.groupBy(F.coalesce("doc_id", low).alias("doc")).agg(F.count("*").alias("k")).where("k > 1").select("doc")
    twins = shared.where("doc = first").join(ids, "doc")
    heads = twins.groupBy("h1", "h2").agg(F.min("row").alias("head"))
    more = twins.join(heads, ["h1", "h2"]).where("row != head")
    columns = ["row", "at", "size", "first"]
    later = shared.where("doc != first").select(*columns).union(more.select(*columns))
    found = later.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("s"), F.collect_set("first").alias("first"))
    return found.select("row", F.col("s.at").alias("at"), F.col("s.size").alias("size"), F.transform("first", lambda d: F.when(d != low, d)).alias("first_docs"))


def substring_dedup(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, first_docs, text) for the rows of docs(doc_id, text) that lose a
    sentence; text is what is left. Rows without a repeat aren't returned. Words are runs of letters and digits, in
    either case; what stands between them doesn't count, and stays with the word before it. Long sentences are cut (see
    CUT), so removed may list a part of what a reader takes for one sentence.

    A span goes if the same words stand in a span before it: that of a smaller doc_id, of another row of the same one, or
    further up in the same text. A repeat of fewer than least_words words, or of fewer than run sentences, is no span and stays, and so
    may the last words of a longer one, fewer than least_words, if the text goes on otherwise behind them.
    A null or empty text, or a short one, has no span and stays as it is. Repeated rows are copies like any others. A
    null id sorts first. Other columns are ignored; an empty table gives an empty result."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (("at", "int"), ("size", "int"), ("h1", "long"), ("h2", "long"), ("again_at", "int"), ("again_size", "int"), ("again_of", "int")))
    measured = stage(rows.mapInArrow(_measure(run, least_words), f"row long, doc_id long, packed binary, {lists}"), "spans")
    found = repeated_spans(measured)
    both = measured.drop("at", "size", "h1", "h2").join(found, "row", "left").where(F.col("at").isNotNull() | (F.size("again_at") > 0))
    return both.mapInArrow(_cut_out, "doc_id long, n_sentences int, n_removed int, removed array<int>, first_docs array<long>, text string")
