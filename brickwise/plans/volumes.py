"""Volumes that the queries run over, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.generate import Phantom, box_phantom
from brickwise.operators.volume import voxelise

SIDE = 64
BOX = ((0, 0, 0), (SIDE, SIDE, SIDE))
SMALL = Phantom(size=32, pitch=0.375)
FLAGSHIP = Phantom()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a sparse volume of 64^3 voxels: quantities summed by part, supplier and order."""
    rows = table(spark, sf_dir, "lineitem")
    return voxelise(rows, F.col("l_partkey") % SIDE, F.col("l_suppkey") % SIDE, F.col("l_orderkey") % SIDE, F.col("l_quantity"))


PARTS = f"vox AS (SELECT (l_partkey % {SIDE})::INT AS x, (l_suppkey % {SIDE})::INT AS y, (l_orderkey % {SIDE})::INT AS z, sum(l_quantity::INT)::INT AS grey FROM lineitem GROUP BY ALL)"


def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a volume of 32^3 voxels, full from 100,000 rows on: the last digits of the quantities that meet in a voxel, so that values
    spread over 0 to 999 whatever the size of the table."""
    rows = table(spark, sf_dir, "lineitem")
    half = lambda c: F.floor(F.col(c) % SIDE / 2).cast("int")
    summed = voxelise(rows, half("l_partkey"), half("l_suppkey"), half("l_orderkey"), F.col("l_quantity"))
    return summed.select("x", "y", "z", (F.col("grey") * 17 % 1000).cast("int").alias("grey"))


TEXTURE = f"vox AS (SELECT (l_partkey % {SIDE} // 2)::INT AS x, (l_suppkey % {SIDE} // 2)::INT AS y, (l_orderkey % {SIDE} // 2)::INT AS z, (sum(l_quantity::INT) * 17 % 1000)::INT AS grey FROM lineitem GROUP BY ALL)"
HALF = SIDE // 2


def small_phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_phantom(spark, SMALL)


def phantom_sql(p: Phantom, name: str = "vox") -> str:
    n, half = p.size, p.outer / 2
    inner = half - p.wall
    box = lambda h: f"(sqrt(greatest(abs(px)-{h},0.0)*greatest(abs(px)-{h},0.0)+greatest(abs(py)-{h},0.0)*greatest(abs(py)-{h},0.0)+greatest(abs(pz)-{h},0.0)*greatest(abs(pz)-{h},0.0))+least(greatest(abs(px)-{h},abs(py)-{h},abs(pz)-{h}),0.0))"
    holes = ", ".join(f"{r}-sqrt((px-({a}))*(px-({a}))+(py-({b}))*(py-({b}))+(pz-({c}))*(pz-({c})))" for a, b, c, r in p.pores)
    return f"""{name} AS (
  SELECT x, y, z, floor({p.air} + least(greatest(0.5 - greatest({box(half)}, -{box(inner)}, {holes}) / {p.pitch}::DOUBLE, 0.0), 1.0) * {p.material - p.air} + 0.5)::INT AS grey
  FROM (SELECT x, y, z, ((x + 0.5 - {n / 2}) * {p.pitch})::DOUBLE AS px, ((y + 0.5 - {n / 2}) * {p.pitch})::DOUBLE AS py, ((z + 0.5 - {n / 2}) * {p.pitch})::DOUBLE AS pz
    FROM (SELECT (i % {n})::INT AS x, (i // {n} % {n})::INT AS y, (i // {n * n})::INT AS z FROM range({n ** 3}) r(i))))"""
