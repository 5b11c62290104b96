"""Near-duplicate vectors by small-world graphs, one for each shard (operator 8)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from brickwise.llm.common import Forest, connected_components, stage
from brickwise.llm.hnsw import Graph

COSINE = 0.9
#: Shards and slices of the queries at least, and what the vectors of a shard may take on average, in bytes: a task
#: holds one shard's graph.
SHARDS, SLICES, SHARD_BYTES = 8, 4, 1 << 26
#: The first beam of a search, and the widest; queries with more links than that are compared exactly.
BEAM, WIDEST = 64, 1024
#: Queries of each slice that are audited against all vectors of the shard, and the share of their links that must
#: have been found.
AUDITS, RECALL = 64, 0.995
#: Queries and members that are multiplied together.
BLOCK = 2048
#: A stored graph goes in rows of so many bytes; partitions of the search at most.
PART_BYTES, PARTITIONS = 1 << 20, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Shard:
    """The vectors of a shard with their graph: float32 unit vectors to search with, double ones to verify with."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, cosine: float = COSINE, graph: Graph | None = None):
        self.nodes, self.sizes, self.vectors, self.cosine, self.beam = nodes, sizes, vectors, cosine, BEAM
        self.exact = _unit(vectors)
        self.graph = graph or Graph(self.exact.astype(np.float32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        layers = {f"{name}{k}": a for k, layer in enumerate(self.graph.layers) for name, a in zip(("members", "near"), layer, strict=True)}
        np.savez(out, nodes=self.nodes, sizes=self.sizes, vectors=self.vectors, **layers)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes, cosine: float) -> Shard:
        kept = np.load(io.BytesIO(raw))
        layers = [(kept[f"members{k}"], kept[f"near{k}"]) for k in range(sum(n.startswith("near") for n in kept.files))]
        return Shard(kept["nodes"], kept["sizes"], kept["vectors"], cosine, Graph.of(_unit(kept["vectors"]).astype(np.float32), layers))

    def audit(self, queries: np.ndarray, nodes: np.ndarray) -> None:
        """Double the beam until these queries find enough of their links, by the mean of their shares without
        themselves; a beam that fails at its widest means exact products from then on."""
        exact = _unit(queries)
        near = exact @ self.exact.T >= self.cosine
        near &= self.nodes[None, :] != nodes[:, None]
        total = near.sum(axis=1)
        while self.beam <= WIDEST:
            hits = np.zeros(len(queries), dtype=np.int64)
            for q, m in self.links(queries):
                np.add.at(hits, q, near[q, m])
            if not total.any() or (hits[total > 0] / total[total > 0]).mean() >= RECALL:
                return
            self.beam *= 2

    def links(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) places of the links found, in blocks of bounded size. Beams are doubled for queries whose
        beams are full of links."""
        exact = _unit(queries)
        todo, beam = np.arange(len(exact)), self.beam
        while len(todo) and beam <= WIDEST:
            ids, sims = self.graph.search(exact[todo], beam)
            close = (sims >= self.cosine - 1e-4) & (ids >= 0)
            full = close.all(axis=1) & (beam < len(self.nodes))
            rows, cols = np.nonzero(close & ~full[:, None])
            q, m = todo[rows], ids[rows, cols]
            for at in range(0, len(q), 1 << 16):
                a, b = q[at : at + (1 << 16)], m[at : at + (1 << 16)]
                true = np.einsum("pd,pd->p", exact[a], self.exact[b]) >= self.cosine
                yield a[true], b[true]
            todo, beam = todo[full], 2 * beam
        for at in range(0, len(self.nodes) if len(todo) else 0, BLOCK):
            q, m = np.nonzero(exact[todo] @ self.exact[at : at + BLOCK].T >= self.cosine)
            yield todo[q], m + at


def _links(shard: Shard, nodes: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """For each query its number of links, copies of members counted; and a spanning forest of the links."""
    counts = np.zeros(len(nodes), dtype=np.int64)
    forest = Forest(len(shard.nodes) + len(nodes))
    for q, m in shard.links(vectors):
        other = shard.nodes[m] != nodes[q]
        q, m = q[other], m[other]
        counts += np.bincount(q, shard.sizes[m], len(nodes)).astype(np.int64)
        forest.join(m, q + len(shard.nodes))
    top = forest.roots()
    name = np.concatenate([shard.nodes, nodes])
    child = np.flatnonzero(top != np.arange(len(top)))
    some = np.flatnonzero(counts)
    columns = [np.concatenate([nodes[some], name[child]]), name[top[child]], counts[some]]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0]), pa.array([None] * len(some) + columns[1].tolist(), pa.int64()), pa.array(columns[2].tolist() + [None] * len(child), pa.int64())],
        names=["a", "b", "n"],
    )


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
    yield from zip(edges, [*edges[1:], len(keys)], strict=True)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, size, v), sorted by shard -> every shard with its graph, in parts."""
    held: list[tuple] = []

    def done(shard: int) -> Iterator[pa.RecordBatch]:
        nodes, sizes, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        raw = Shard(nodes, sizes, vectors).dump()
        for k, at in enumerate(range(0, len(raw), PART_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([k], pa.int32()), pa.array([raw[at : at + PART_BYTES]], pa.binary())], names=["shard", "part", "raw"])

    now = None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        for lo, hi in _runs(shards):
            if held and shards[lo] != now:
                yield from done(now)
            now = int(shards[lo])
            some = batch.slice(lo, hi - lo)
            held.append((some.column(1).to_numpy(), some.column(2).to_numpy(), _vectors(some.column(3))))
    if held:
        yield from done(now)


def _search(cosine: float):
    """Rows (unit, part, raw, node, v), sorted by unit and part: a unit's shard comes in parts, then its queries with the
    part null, which are streamed past it in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, raw, held = None, None, [], []

        def ask(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if not held or (not rest and sum(len(h[0]) for h in held) < BLOCK):
                return
            nodes, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if shard is None:
                shard = Shard.load(b"".join(raw), cosine)
                raw.clear()
                shard.audit(vectors[:AUDITS], nodes[:AUDITS])
            for at in range(0, len(nodes), BLOCK):
                yield _links(shard, nodes[at : at + BLOCK], vectors[at : at + BLOCK])

        for batch in batches:
            units = batch.column(0).to_numpy()
            stored = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi in _runs(units * 2 + stored):
                if units[lo] != now:
                    yield from ask(True)
                    now, shard = units[lo], None
                    raw.clear()
                some = batch.slice(lo, hi - lo)
                if stored[lo]:
                    raw.extend(some.column(2).to_pylist())
                elif raw or shard is not None:
                    held.append((some.column(3).to_numpy(), _vectors(some.column(4))))
                    yield from ask(False)
        yield from ask(True)

    return run


def _landing(spark: SparkSession, count: int) -> list[int]:
    """For each of so many partitions a key that Spark's hash deals to it."""
    some = spark.range(32 * count + 64).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("p"))
    keys = {r["p"]: r["id"] for r in some.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [keys.get(p, p) for p in range(count)]


def _dealt(df: DataFrame, by: str, count: int):
    """df in count partitions, the rows of by = k in the partition k modulo count."""
    keys = _landing(df.sparkSession, count)
    key = F.get(F.array(*map(F.lit, keys)), F.pmod(F.col(by), F.lit(count)).cast("int")).cast("long")
    return df.withColumn("lands", key).repartition(count, "lands").drop("lands")


def embedding_components(vectors: DataFrame, cosine: float = COSINE, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Equal vectors are one point of the graphs and all linked with one another. A vector that is null,
    empty, zero or has a null or non-finite component links with nothing; so do vectors of different
    lengths. Rows with one vec_id are one vertex of the components, also if their vectors differ; n_links counts other
    rows. A null vec_id keeps its row with no links and a null component. Other columns are ignored; an empty table
    gives an empty result. Cosines are of the doubles that the components are. Every vector asks every shard, in slices
    that tasks share; the graphs may miss links, which audits hold to RECALL."""
    spark = vectors.sparkSession
    value = F.col("embedding").cast("array<double>")
    wide = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType)
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>" if wide else "array<float>").alias("v"),
        (F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).alias("sound"),
    )
    rows = stage(rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.hash("v")), "vectors")
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = stage(classes.select("*", F.monotonically_increasing_id().alias("node")), "vector-classes")

    # Vectors of different lengths are never in one shard.
    lengths = [(r["n"], r["k"]) for r in classes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy("n").collect()]
    plan, first_shard, first_unit = [], 0, 0
    for n, k in lengths:
        most = max(BLOCK, shard_bytes // (8 * n))
        count, slices = max(shards, -(-k // most)), max(SLICES, -(-k // most))
        plan.append((n, count, slices, first_shard, first_unit))
        first_shard, first_unit = first_shard + count, first_unit + count * slices
    by_length = spark.createDataFrame(plan, "n int, shards int, slices int, shard0 long, unit0 long")
    known = classes.withColumn("n", F.size("v")).join(F.broadcast(by_length), "n")
    shard = F.col("shard0") + F.pmod(F.xxhash64("node"), F.col("shards"))
    own = known.select(shard.alias("shard"), "node", "size", "v")
    graphs = _dealt(own, "shard", max(1, min(first_shard, PARTITIONS))).sortWithinPartitions("shard", "node").mapInArrow(_build, "shard long, part int, raw binary")
    graphs = stage(graphs, "vector-graphs")

    kind = rows.schema["v"].dataType.simpleString()
    spread = spark.createDataFrame([(s0 + k, u0 + k * slices + j) for _, count, slices, s0, u0 in plan for k in range(count) for j in range(slices)], "shard long, unit long")
    stored = graphs.join(F.broadcast(spread), "shard").select("unit", "part", "raw", F.lit(None).cast("long").alias("node"), F.lit(None).cast(kind).alias("v"))
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices"))
    units = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda k: F.col("unit0") + k * F.col("slices") + at)
    asked = known.select(F.explode(units).alias("unit"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("raw"), "node", "v")
    dealt = _dealt(stored.unionByName(asked), "unit", max(1, min(first_unit, PARTITIONS))).sortWithinPartitions("unit", F.col("part").asc_nulls_last())
    found = stage(dealt.mapInArrow(_search(cosine), "a long, b long, n long"), "vector-links")

    # Classes that hold rows of one vec_id are one vertex.
    holds = rows.where("sound").select("vec_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("vec_id", "node")
    several = holds.groupBy("vec_id").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1").select("vec_id", "b")
    same = holds.join(several, "vec_id").select(F.col("node").alias("a"), "b")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b").union(same))
    linked = stage(classes.select("k1", "k2", "node", "id", "size").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "vector-roots")
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    named = stage(linked.join(least, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "component"), "vector-names")
    joined = rows.select("vec_id", "sound", "k1", "k2").join(named, ["k1", "k2"], "left")
    alone = ~F.col("sound") | F.col("component").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
