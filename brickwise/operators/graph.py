"""Staging in the folder that driver and executors share, and connected components of large edge tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task joins, where the caller allows it: 16 MB of them.
FEW_EDGES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only on a single machine whose setting is
    absent (tests) is a folder of our own made, once for a session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("brickwise.stage.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="brickwise-")
        spark.conf.set("brickwise.stage.dir", found)
    return found.rstrip("/")


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, a lost executor costs
    nothing that was staged, and what is read twice is computed once. Columns stay prunable."""
    return _staged(df, name)[0]


def _drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def dense_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of 0..n-1 the smallest number reachable over the undirected edges, by hooking and pointer jumping."""
    up = np.arange(n)
    while len(i):
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the undirected edges, root the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[dense_roots(len(nodes), at[: len(a)], at[len(a) :])]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternating large and small stars: every round links each node's neighbours to the smallest one
    seen, first the larger neighbours, then the smaller; the edge set shrinks to one star for each
    component in a number of rounds that grows with the logarithm of its size. All work is grouped
    minima, summed before their shuffles, and equi-joins of staged tables, so that Spark can split the rows of
    a hub between tasks; lineage stays short, and what a round read is deleted behind it. Stars make staged files so small that Spark would take
    tables of many rows for ones to broadcast; these joins, and those with the result, are merges. With few, a measured
    number of distinct edges up to that is joined by one task instead. An empty input gives an empty result."""
    spark = edges.sparkSession
    old: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        found, path = _staged(df, "cc")
        old.append(path)
        return found

    now = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    seen = signature(now)
    if seen[0] <= few and {f.dataType.simpleString() for f in now.schema} == {"bigint"}:
        return now.coalesce(1).mapInArrow(_join_all, "node long, root long").hint("merge")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low.hint("merge"), "u").select(F.explode(pair).alias("e")).select("e.*")
        done = old[:]
        old.clear()
        now = kept(small.where("u != v").distinct())
        _drop(spark, done)
        fresh = signature(now)
        if fresh == seen:
            break
        seen = fresh
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).hint("merge")
