"""Benchmark decontamination by SimHash windows and a multi-index search (operator 1). Native: columns only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm.common import stage, text_or_empty

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints within so many bits are verified. Windows of similarity 0.8 differ in 10 bits on average, 19 is
#: over three standard deviations more; random ones differ in 32.
RADIUS = 19
#: Items of up to so many shingles are too short for a fingerprint to tell: every window that shares a shingle is verified.
SHORT = 12
#: Blocks of a fingerprint; one of them differs in RADIUS // BLOCKS bits at most if the whole is within the radius.
BLOCKS = 5
#: A lane is a long that counts two bits, 32 of its own bits for each: room for more hashes than an array has.
LANES = 32
LANE_MASK = 0x0000000100000001
#: Windows whose fingerprints are made by one slide: as many as the window is long, but between these.
SLIDE = (64, 2048)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gram_at(words: Column, i: Column, size: int = WORDS_PER_SHINGLE) -> Column:
    """The hash of so many words by place; slices would copy the whole array each time."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def grams(words: Column, size: int = WORDS_PER_SHINGLE) -> Column:
    """Hashes of all runs of so many words, repeats included; fewer words have none. words must be a name or bound."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: gram_at(words, i, size))).otherwise(F.array().cast("array<bigint>"))


def _spread(h: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANE_MASK)) for k in range(LANES)])


def _counts(hashes: Column) -> Column:
    """How many of the hashes have each bit, in lanes."""
    zero = F.array(*[F.lit(0).cast("long")] * LANES)
    return F.aggregate(hashes, zero, lambda acc, x: F.zip_with(acc, _spread(x), lambda a, b: a + b))


def _majority(counts: Column, n: Column) -> Column:
    """The fingerprint: a bit is set if over half of n hashes have it. counts must be a name or bound."""
    out = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftrightunsigned(F.get(counts, F.lit(b % LANES)), 32 * (b // LANES)).bitwiseAND(F.lit(0xFFFFFFFF))
        out = out.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


def simhash(hashes: Column) -> Column:
    """The 64-bit fingerprint of an array of hashes."""
    return bound(hashes, lambda h: bound(_counts(h), lambda c: _majority(c, F.size(h))))


def sliding_simhash(hashes: Column, size: Column, lo: Column, hi: Column) -> Column:
    """The fingerprints of the windows of so many hashes that start at lo, lo + 1 .. hi: the first is counted, each next
    one drops a hash and takes one, so a window costs the same whatever its size."""
    first = F.array(_counts(F.slice(hashes, lo + 1, size)))

    def step(done: Column, s: Column) -> Column:
        wider = F.zip_with(F.element_at(done, -1), _spread(F.get(hashes, s + size - 1)), lambda a, b: a + b)
        return F.concat(done, F.array(F.zip_with(wider, _spread(F.get(hashes, s - 1)), lambda a, b: a - b)))

    rest = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.aggregate(rest, first, step), lambda c: _majority(c, size))


def needed_stride(sizes: list[int], similarity: float) -> int:
    """How far apart a document's shingles may be looked up without missing a window. In a window of n shingles
    that is similar to an item of m, at most b of them are foreign to the item; what is left forms a run
    of consecutive known ones of at least (n - b) / (b + 1), and a run meets every grid that fine."""
    least = max(sizes, default=1)
    for m in set(sizes):
        for n in range(max(1, int(similarity * m)), m + 1):
            shared = similarity * (m + n) / (1 + similarity)
            if shared <= n + 1e-9:
                b = int(n - shared + 1e-9)
                least = min(least, -(-(n - b) // (b + 1)))
    return max(1, least)


def _blocks(fp: Column) -> Column:
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return F.array(*[F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)])


def _probes(radius: int) -> list[int]:
    """What to flip in a block so that BLOCKS blocks find all fingerprints within the radius."""
    width, flips = -(-64 // BLOCKS), radius // BLOCKS
    return [sum(1 << b for b in some) for k in range(flips + 1) for some in combinations(range(width), k)]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, g, hashes, m): the shingles of every item with a word; one of fewer words than a shingle is a
    single shingle of its g words."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_or_empty()).alias("words"))
    g = F.least(F.size("words"), F.lit(WORDS_PER_SHINGLE))
    short = F.array(F.xxhash64(F.col("words")))
    for size in range(1, WORDS_PER_SHINGLE):
        short = F.when(g == size, F.array(gram_at(F.col("words"), F.lit(0), size))).otherwise(short)
    hashes = bound(F.col("words"), lambda w: F.when(F.size(w) >= WORDS_PER_SHINGLE, grams(w)))
    found = words.where(F.size("words") > 0).select("item_id", g.alias("g"), F.coalesce(hashes, short).alias("hashes"))
    return stage(found.select(F.monotonically_increasing_id().alias("item"), "item_id", "g", "hashes", F.size("hashes").alias("m")), "items")


def _met(docs: DataFrame, items: DataFrame, similarity: float, keep: tuple[str, ...]) -> tuple[DataFrame, list[int]]:
    """The rows of docs that hold a known shingle: row, doc_id, keep, hashes (arrays by shingle size), and jobs: which
    windows, of which size, could be similar to some item; for short items also to which."""
    sizes = [(r["g"], r["m"]) for r in items.select("g", "m").distinct().collect()]
    present = sorted({g for g, _ in sizes})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *keep)
    docs = docs.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    split = docs.select("k1", "k2", words_of(F.col("text")).alias("words"))

    def looked(words: Column, g: int) -> Column:
        stride = needed_stride([m for k, m in sizes if k == g], similarity) if g == WORDS_PER_SHINGLE else 1
        at = F.sequence(F.lit(0), F.size(words) - g, F.lit(stride))
        found = F.transform(at, lambda p: F.struct(F.lit(g).alias("g"), p.alias("p"), gram_at(words, p, g).alias("h"), (F.size(words) - g + 1).alias("n")))
        return F.when(F.size(words) >= g, found).otherwise(F.array().cast("array<struct<g:int,p:int,h:bigint,n:int>>"))

    none = F.array().cast("array<struct<g:int,p:int,h:bigint,n:int>>")
    seen = bound(F.col("words"), lambda w: F.concat(none, *[looked(w, g) for g in present]))
    places = split.select("k1", "k2", F.explode(seen).alias("x")).select("k1", "k2", "x.*")
    known = items.select("item", "g", "m", F.explode(F.array_distinct("hashes")).alias("h"))
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    width = F.least(F.greatest(F.col("m"), F.lit(SLIDE[0])), F.lit(SLIDE[1]))
    spans = places.join(known, ["g", "h"]).select(
        "k1", "k2", "g", "m", "item", width.alias("width"), F.least(F.greatest(F.col("p") - F.col("m") + 1, F.lit(0)), last).alias("lo"), F.least(F.col("p"), last).alias("hi")
    )
    part = F.explode(F.sequence((F.col("lo") / F.col("width")).cast("int"), (F.col("hi") / F.col("width")).cast("int")))
    spans = spans.select("*", part.alias("part"))
    lo, hi = F.greatest("lo", F.col("part") * F.col("width")), F.least(F.col("hi"), (F.col("part") + 1) * F.col("width") - 1)
    jobs = spans.groupBy("k1", "k2", "g", "m", "part").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.collect_set(F.when(F.col("m") <= SHORT, F.col("item"))).alias("items"))
    jobs = stage(jobs.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "m", "lo", "hi", "items")).alias("jobs")), "places")
    met = docs.join(jobs, ["k1", "k2"]).select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, "jobs", words_of(F.col("text")).alias("words"))
    empty = F.array().cast("array<bigint>")
    by_size = bound(F.col("words"), lambda w: F.array(*[grams(w, g) if g in present else empty for g in range(1, WORDS_PER_SHINGLE + 1)]))
    return stage(met.select("row", "doc_id", *keep, "jobs", by_size.alias("hashes")), "leaks"), present


def _candidates(met: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(row, item, s, bits): the windows whose fingerprints are within the radius of that of an item of their size, by an
    index of all values of a block that are near enough. Known shingles only tell which windows are made, not which item
    they meet; short items get every window that shares a shingle with them."""

    def made(j: Column) -> Column:
        return bound(F.get("hashes", j["g"] - 1), lambda h: sliding_simhash(h, F.least(j["m"], F.size(h)), j["lo"], j["hi"]))

    slides = met.select("row", F.explode(F.transform("jobs", lambda j: F.struct(j["g"].alias("g"), j["m"].alias("m"), j["lo"].alias("lo"), j["items"].alias("items"), made(j).alias("fps")))).alias("j"))
    windows = slides.select("row", "j.g", "j.m", "j.lo", "j.items", F.posexplode("j.fps").alias("k", "fp")).select("row", "g", "m", (F.col("lo") + F.col("k")).alias("s"), "fp", "items")
    windows = stage(windows, "fingerprints")
    prints = items.select("item", "g", "m", simhash(F.col("hashes")).alias("item_fp"))
    probes = F.array(*map(F.lit, _probes(radius)))
    index = prints.select("item", "g", "m", "item_fp", F.posexplode(_blocks(F.col("item_fp"))).alias("block", "own"), probes.alias("probes"))
    index = index.select("item", "g", "m", "item_fp", "block", F.explode(F.transform("probes", lambda f: F.col("own").bitwiseXOR(f.cast("long")))).alias("value"))
    keyed = windows.where(F.col("m") > SHORT).select("row", "g", "m", "s", "fp", F.posexplode(_blocks(F.col("fp"))).alias("block", "value"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("bits")
    near = keyed.join(index, ["g", "m", "block", "value"]).select("row", "item", "s", bits).where(F.col("bits") <= radius)
    short = windows.where(F.col("m") <= SHORT).select("row", "s", "fp", F.explode("items").alias("item")).join(prints, "item").select("row", "item", "s", bits)
    return near.unionByName(short).groupBy("row", "item", "s").agg(F.min("bits").alias("bits"))


def _rated(met: DataFrame, items: DataFrame, cand: DataFrame) -> DataFrame:
    """(row, item, m, size, s, bits, both): what each candidate window shares with its item, by one sweep over the
    document. The i-th place p of a shingle that the item has c times counts in the windows that start behind the place
    c before it and within m of p; the number of such spans over a start is what its window shares."""
    pairs = cand.select("row", "item").distinct()
    counts = items.select("item", "g", "m", F.explode("hashes").alias("h")).groupBy("item", "g", "m", "h").agg(F.count("*").alias("c"))
    each = F.explode(F.transform("hashes", lambda h, k: F.struct((k + 1).alias("g"), F.size(h).alias("n"), h.alias("h")))).alias("x")
    own = met.select("row", each).select("row", "x.g", "x.n", F.posexplode("x.h").alias("p", "h"))
    places = own.join(counts, ["g", "h"]).join(pairs, ["row", "item"])
    lists = places.groupBy("row", "item", "h").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.first("c").cast("int").alias("c"), F.first("m").alias("m"))
    span = F.transform("ps", lambda p, i: F.struct(F.greatest(p - F.col("m") + 1, F.coalesce(F.get("ps", i - F.col("c")), F.lit(-1)) + 1, F.lit(0)).alias("lo"), p.alias("hi")))
    ends = lists.select("row", "item", F.explode(span).alias("x")).select("row", "item", F.explode(F.array(F.struct(F.col("x.lo").alias("s"), F.lit(1).alias("d")), F.struct((F.col("x.hi") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("row", "item", F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d")).withColumn("bits", F.lit(None).cast("int"))
    every = steps.unionByName(cand.select("row", "item", "s", F.lit(0).cast("long").alias("d"), F.col("bits").cast("int").alias("bits")))
    both = F.sum("d").over(Window.partitionBy("row", "item").orderBy("s"))
    found = every.withColumn("both", both).where("bits is not null")
    sizes = met.select("row", *[F.size(F.get("hashes", F.lit(g))).alias(f"n{g + 1}") for g in range(WORDS_PER_SHINGLE)])
    n = F.get(F.array(*[F.col(f"n{g + 1}") for g in range(WORDS_PER_SHINGLE)]), F.col("g") - 1)
    joined = found.join(items.select("item", "item_id", "g", "m"), "item").join(sizes, "row")
    return joined.select("row", "item", "item_id", "g", "m", F.least("m", n).alias("size"), "s", "bits", "both")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, similarity, differing_bits, first_word, n_words): a row for each row of docs(doc_id,
    text) and row of benchmark(item_id, text) of which the document has a passage: the item-sized
    window of words that is most similar, the first of equals, if its similarity is enough.

    Words are runs of letters and digits in lower case. Similarity is that of the multisets of five-word
    shingles: the sum of smaller counts by the sum of larger ones. Windows at every word that could
    reach it are fingerprinted; a fingerprint within the radius of the item's is surely found and
    then verified, and so is every window for an item of up to SHORT shingles. A document shorter than the item is one window. An item of fewer than five words is one
    shingle of all its words and is found where they stand; items without words, and documents of fewer words than the
    item's shingle, never match. Null texts count as empty; repeated rows have a result each;
    a null id is carried, and so are the columns in keep. Other columns are ignored; an empty table gives an empty
    result. The documents are read twice, whatever the benchmark's size."""
    items = _items(benchmark)
    met, _ = _met(docs, items, similarity, keep)
    rated = _rated(met, items, stage(_candidates(met, items, radius), "windows"))
    value = F.col("both") / (F.col("m") + F.col("size") - F.col("both"))
    best = rated.groupBy("row", "item", "item_id", "g", "size").agg(F.max(F.struct(value.alias("similarity"), (-F.col("s")).alias("back"), "bits")).alias("best"))
    best = best.where(F.col("best.similarity") >= similarity - 1e-12)
    return best.join(met.select("row", "doc_id", *keep), "row").select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        F.col("best.bits").cast("int").alias("differing_bits"),
        (-F.col("best.back")).cast("long").alias("first_word"),
        (F.col("size") + F.col("g") - 1).cast("long").alias("n_words"),
        *keep,
    )
