"""SimHash near-duplicate detection with bit-sliced distance counting (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import Forest, connected_components, stage, text_or_empty

WORDS_PER_SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bits of a fingerprint are cut into radius + paired blocks, so that paired of them agree in every link; so few that
#: random fingerprints fill buckets by FILL at most on average.
FILL = 64
#: A bucket of more fingerprints than this is compared in tiles of about this size by several tasks.
TILE = 1024
#: Lanes whose distances are counted together, in words of 64 lanes.
LANE_WORDS = 4096


def fingerprint(raw: bytes, words: int = WORDS_PER_SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text: bit b is set if over half of the shingles' XXH64 have it.
    Bytes split on 0x20 and 0x09-0x0D only; fewer words than a shingle make one shingle, none give 0."""
    parts = raw.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(line, seed)]
    else:
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).to_pylist()
        found = np.array([fingerprint(x) for x in raw], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def _lanes(flags: np.ndarray) -> np.ndarray:
    """Booleans packed into words of 64 lanes, with one empty word behind."""
    packed = np.packbits(flags, bitorder="little")
    out = np.zeros((len(flags) + 63) // 64 * 8 + 8, dtype=np.uint8)
    out[: len(packed)] = packed
    return out.view("<u8")


def _shifted(plane: np.ndarray, lanes: int, words: int) -> np.ndarray:
    """The plane moved down by so many lanes, its first words."""
    whole, bits = divmod(lanes, 64)
    low = plane[whole : whole + words]
    if not bits:
        return low
    return (low >> np.uint64(bits)) | (plane[whole + 1 : whole + 1 + words] << np.uint64(64 - bits))


def bit_sliced_links(run: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of the same run whose fingerprints differ in radius bits at most.

    run is sorted. Fingerprints lie vertically, a plane for each bit; lane i is held against lane i + s
    for s = 1, 2, ... Distances of all lanes of a block are counted at once by carry-save adders into
    a few counter planes that start so high that the carry out of the last one means: over the radius.
    A block all of whose lanes are over it is abandoned."""
    bounds = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[bounds, len(run)])
    size_of = np.repeat(sizes, sizes)
    counters = max(1, int(radius).bit_length())
    start = (1 << counters) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    s, rebuilt = 1, 0
    while True:
        if s >= 2 * rebuilt:
            live = np.flatnonzero(size_of > s)
            if not len(live):
                return
            runs, values = run[live], prints[live]
            flat = np.arange(64, dtype=np.uint64)
            spare = np.zeros(s + 64, dtype=np.uint64)
            planes = [np.r_[_lanes(((values >> b) & np.uint64(1)).astype(bool)), spare] for b in flat]
            rebuilt = s
        n = len(live) - s
        if n <= 0:
            return
        same = runs[:-s] == runs[s:]
        if not same.any():
            return
        mask = _lanes(same)[: (n + 63) // 64]
        for w in range(0, len(mask), LANE_WORDS):
            wanted = mask[w : w + LANE_WORDS]
            k = len(wanted)
            count = [np.full(k, ones if start >> c & 1 else 0, dtype=np.uint64) for c in range(counters)]
            over = ~wanted
            for b in range(0, 64, 2):
                one, two = (planes[x][w : w + k] ^ _shifted(planes[x][w:], s, k) for x in (b, b + 1))
                half = one ^ two
                carry = (one & two) | (half & count[0])
                count[0] = half ^ count[0]
                for c in range(1, counters):
                    count[c], carry = count[c] ^ carry, count[c] & carry
                over |= carry
                if b % 8 == 6 and (over == ones).all():
                    break
            else:
                hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) + 64 * w
                if len(hit):
                    yield live[hit], live[hit + s]
        s += 1


def _forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (unit, fp) rows the spanning forest of the links found in each unit."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(unit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        forest = Forest(len(unit))
        for i, j in bit_sliced_links(unit, fp.view(np.uint64)):
            forest.join(i, j)
        top = forest.roots()
        child = np.flatnonzero(top != np.arange(len(top)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[top[child]])], schema=schema)

    held_unit, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        held_unit = np.r_[held_unit, batch.column(0).to_numpy()]
        held_fp = np.r_[held_fp, batch.column(1).to_numpy()]
        if len(held_unit) < 1 << 17:
            continue
        last = int(np.searchsorted(held_unit, held_unit[-1]))  # the last unit may go on in the next batch
        if last:
            yield edges(held_unit[:last], held_fp[:last])
            held_unit, held_fp = held_unit[last:], held_fp[last:]
    yield edges(held_unit, held_fp)


def paired_blocks(n: int, radius: int = RADIUS) -> int:
    """How many of the blocks make a key for n fingerprints: at least two, more where buckets would grow with n."""
    paired = 2
    while n > FILL << (64 * paired // (radius + paired)) and paired < 6:
        paired += 1
    return paired


def block_keys(fp: str, radius: int = RADIUS, paired: int = 2):
    """An array of bucket keys: for each choice of `paired` of radius + paired blocks, their bits. Two
    fingerprints within the radius differ in radius blocks at most, so they share one key at least."""
    count = radius + paired
    edges = [64 * k // count for k in range(count + 1)]
    block = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(k), *[block[x] for x in chosen]) for k, chosen in enumerate(combinations(range(count), paired))])


def simhash_components(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text), and the columns in keep, whose names
    must differ from those.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any
    other. Repeated rows keep a row each. A null doc_id keeps its row and is never a component's
    name unless no other id is there (then null). Other columns are ignored; an empty table gives
    an empty result. Links are exact: no bucket is capped, large ones are compared in tiles."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw"), *keep)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    prints = stage(raw.mapInArrow(_fingerprints, f"doc_id long, fp long{kept}"), "simhash")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "simhash-distinct")

    keyed = distinct.select("fp", F.explode(block_keys("fp", radius, paired_blocks(distinct.count(), radius))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("tiles")).cast("int")
    pairs = F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("own")))
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("own", own)
        .select("fp", "key", "own", F.explode(pairs).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp")
        .repartition("unit")
        .sortWithinPartitions("unit")
    )
    roots = connected_components(dealt.mapInArrow(_forest_edges, "a long, b long"))

    linked = stage(roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least_doc"), "simhash-linked")
    named = linked.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    moved = linked.join(named, "root").select("fp", "component_id")
    # Staged, so that the last join's both sides are plain exchanges and a fingerprint of very many rows can be split.
    ids = stage(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least_doc").alias("component_id")), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)
