import numpy as np
import xxhash
from pyspark.sql import functions as F

from brickwise.llm.simhash_dedup import bit_sliced_links, fingerprint, simhash_components


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    for text in ["", " \t", "One", "a B c", "a b c d", "a b c d e É é\x0bz a b c d e", "x " * 300, "ÀB\xa0c d e f g"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_bit_sliced_links_against_popcounts():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64).repeat(rng.integers(1, 90, 40))
    for bit in rng.integers(0, 64, (6, len(prints))):
        prints = np.where(rng.random(len(prints)) < 0.6, prints ^ (np.uint64(1) << bit.astype(np.uint64)), prints)
    run = np.sort(rng.integers(0, 12, len(prints)))
    for radius in (0, 1, 3, 4, 7):
        got = {p for i, j in bit_sliced_links(run, prints, radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
        near = (np.bitwise_count(prints[:, None] ^ prints) <= radius) & (run[:, None] == run)
        assert got == {(i, j) for i, j in zip(*(x.tolist() for x in np.where(near)), strict=True) if i < j}


def brute(rows):
    ids = [r[0] for r in rows]
    prints = np.array([plain_fingerprint(r[1] or "") for r in rows], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= 4
    reach = list(range(len(rows)))
    changed = True
    while changed:
        new = [min(reach[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        changed, reach = new != reach, new
    names = [min(ids[j] for j in range(len(rows)) if reach[j] == reach[i]) for i in range(len(rows))]
    return sorted(zip(ids, (f"{int(p):016x}" for p in prints), names, strict=True))


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        words = rng.integers(0, 50, 300).astype(str).tolist()
        for c in range(int(rng.integers(1, 9))):
            some = list(words)
            for at in rng.integers(0, 300, int(rng.integers(0, 6))):
                some[at] = "new"
            rows.append((1000 + 10 * k + c, " ".join(some)))
    rows += [(5, None), (7, ""), (9, " \n"), (9, "same row"), (9, "same row"), (11, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("x")).repartition(5)
    for tile in (1024, 3):
        got = sorted(tuple(r) for r in simhash_components(docs, tile=tile).collect())
        assert got == brute(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
