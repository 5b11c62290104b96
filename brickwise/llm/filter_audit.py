"""Interaction audit of document filters over all their orders (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm.common import text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
#: Every order of the filters, and the step (from 0) at which a document first fails, by the bits of what it fails; 5: it
#: passes them all.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
FIRST = np.array([[next((k for k, f in enumerate(o) if mask >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for mask in range(1 << STEPS)])
#: Labels of a document: bit 0 is good quality, bit 1 is toxic.
LABELS = 4
#: A partial array holds, by order, first failing step and label, the documents, and behind them the documents by bits.
CELLS = len(ORDERS) * (STEPS + 1) * LABELS
#: Parts whose arrays a task holds before it passes them on.
PARTS_HELD = 256
CAPITALS, INNER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails. bytes.split parts words at blanks and x09 to x0D alone."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        + 2 * (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words))
        + 4 * (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS_PERCENT * len(text.translate(None, INNER_BYTES)))
        + 8 * (len(text.translate(None, MARKS)) < len(text))
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, digest, bits, spread): texts end here. spread deals rows without an id over tasks."""
    turn = 0
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2).cast(pa.binary())]
        spread = np.arange(turn, turn + len(texts)) % 4096 * batch.column(0).is_null().to_numpy(zero_copy_only=False)
        turn += len(texts)
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        bits = pa.array([failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, bits, pa.array(spread.astype(np.int32))], names=["doc_id", "part", "digest", "bits", "spread"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, cell, n) from rows (part, bits, label, n): the first failing step of each row under every order is looked up,
    and its documents are added where order, step and label meet."""
    held: dict[str, np.ndarray] = {}
    orders = np.arange(len(ORDERS)) * (STEPS + 1)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for part, cells in held.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["part", "cell", "n"])
        held.clear()

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        bits, label, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
        which = parts.indices.to_numpy()
        for k, part in enumerate(parts.dictionary.to_pylist()):
            own = which == k
            at = (FIRST[bits[own]] + orders) * LABELS + label[own, None]
            removed = np.bincount(at.ravel(), np.repeat(n[own], len(ORDERS)), CELLS)
            found = np.concatenate([removed, np.bincount(bits[own], n[own], 1 << STEPS)]).astype(np.int64)
            held[part] = held[part] + found if part in held else found
        if len(held) >= PARTS_HELD:
            yield from passed_on()
    yield from passed_on()


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, from its summed arrays of cells and counts."""
    filters = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    for batch in batches:
        for part, cells, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            whole = np.zeros(CELLS + (1 << STEPS), np.int64)
            whole[cells] = n
            removed = whole[:CELLS].reshape(len(ORDERS), STEPS + 1, LABELS)
            by_bits = whole[CELLS:]
            masks = np.arange(1 << STEPS)
            fails = np.array([by_bits[masks >> f & 1 == 1].sum() for f in range(STEPS)])
            unique = by_bits[1 << np.arange(STEPS)]
            here = removed[:, :STEPS].sum(2)
            shapley = np.bincount(filters.ravel(), here.ravel(), STEPS).astype(np.int64)
            columns = (
                by_bits.sum() - here.cumsum(1), here, fails[filters] - here, unique[filters],
                removed[:, :STEPS, 1::2].sum(2), removed[:, :STEPS, 2:].sum(2), shapley[filters],
            )
            rows = len(ORDERS) * STEPS
            front = [pa.array([part] * rows, pa.string()), pa.array([o for o in ORDERS for _ in FILTERS], pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*front, *(pa.array(c.ravel()) for c in columns)], names=["part", "filter_order", "step", *NAMES])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at every step of all 120 orders, by part (lang): (part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Texts are read once, down to a digest (SHA-256) and the bits of what they fail. Rows of one text, part and label are
    summed before the smallest doc_id of each text is looked for, so copies never meet in one task.
    A null text is an empty one, a null lang is the part ''. A row without a doc_id counts, fails E never and makes no
    other row fail it, and has no labels; rows of one doc_id and text don't fail E by one another. A document with several rows of
    labels is good if any says so, and toxic likewise; null labels say nothing. An empty table gives no rows; extra columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    read = rows.mapInArrow(_read, "doc_id long, part string, digest binary, bits int, spread int")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), (2 * F.max((F.col("toxic") == 1).cast("int"))).alias("toxic"))
    told = told.select("doc_id", F.lit(0).alias("spread"), (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("label"))
    marked = read.join(told, ["doc_id", "spread"], "left").select("doc_id", "spread", "part", "digest", "bits", F.coalesce("label", F.lit(0)).alias("label"))
    alike = ["digest", "bits", "part", "label"]
    ids = marked.groupBy("doc_id", "spread", *alike).agg(F.count("*").alias("n"))
    sums = ids.groupBy(*alike).agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    first = F.min("least").over(Window.partitionBy("digest"))
    original = F.col("without_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    told_apart = sums.withColumn("original", original).select("part", "label", F.explode(F.array(F.struct("bits", F.col("original").alias("n")), F.struct(F.col("bits").bitwiseOR(COPY).alias("bits"), (F.col("n") - F.col("original")).alias("n")))).alias("e"))
    weighted = told_apart.select("part", "e.bits", "label", "e.n").where("n > 0")
    cells = weighted.mapInArrow(_count, "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).select("part", F.col("cells.cell").alias("cell"), F.col("cells.n").alias("n"))
    return whole.mapInArrow(_shape, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NAMES))


def filter_audit_sql() -> str:
    """The same in DuckDB SQL."""
    apart = " and ".join(f"p{i}.f <> p{j}.f" for i in range(1, 6) for j in range(1, i))
    order = " || ".join(f"p{i}.f" for i in range(1, 6))
    tables = ", ".join(f"filters p{i}" for i in range(1, 6))
    return rf"""
    with words as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
        from documents),
    fails as (
        select doc_id, part, [
            len(ws) < {LEAST_WORDS},
            100 * len(list_distinct(ws)) < {LEAST_DISTINCT_PERCENT} * len(ws),
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(t),
            regexp_matches(t, '[#$%&*|]'),
            coalesce(doc_id > min(doc_id) over (partition by t), false)] as f
        from words),
    told as (
        select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
        from labels where doc_id is not null group by doc_id),
    parts as (
        select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
        from fails left join told using (doc_id) group by part, f),
    filters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
    orders as (select {order} as filter_order from {tables} where {apart}),
    steps as (
        select part, filter_order, f, n, good, toxic,
            coalesce(list_position([f[ascii(c) - 64] for c in string_split(filter_order, '')], true), 6) as first
        from parts, orders),
    shown as (select part, filter_order, unnest([1, 2, 3, 4, 5]) as step from (select distinct part from parts), orders),
    counted as (
        select part, filter_order, step, ascii(filter_order[step]) - 64 as k,
            sum(n) filter (first > step) as kept, sum(n) filter (first = step) as removed,
            sum(n) filter (f[ascii(filter_order[step]) - 64] and first < step) as redundant,
            sum(n) filter (f[ascii(filter_order[step]) - 64] and len(list_filter(f, lambda b: b)) = 1) as unique_fails,
            sum(good) filter (first = step) as good_lost, sum(toxic) filter (first = step) as toxic_lost
        from shown join steps using (part, filter_order) group by part, filter_order, step)
    select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
        coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
        coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
        coalesce(sum(removed) over (partition by part, k), 0)::bigint as shapley
    from counted"""
