"""Stored volumes: packed bricks of every level in Morton order, and their metadata. What a box or a level doesn't need is
left unread by Spark's own Parquet scan, from the folders of levels and the ranges of brick keys in each row group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions.keys import morton
from brickwise.operators import bricks
from brickwise.operators.blocks import pyramid_level
from brickwise.operators.bricks import KEYS, SCHEMA, SIDE
from brickwise.operators.graph import stage
from brickwise.sources.metadata import Volume, read_volume, write_volume

#: Bricks in a row group, neighbours in Morton order, so that a small box reads few others.
ROW_GROUP = 16
Place = tuple[int, int, int]


def write(voxels: DataFrame, volume: Volume, folder: str, levels: int = 0) -> None:
    """Store voxels (x, y, z, grey) and that many coarser levels of them. Bricks are dealt by ranges of their Morton key and sorted in them;
    a level is made from the finer one as it was stored. A volume without voxels has a file and no bricks."""
    spark = voxels.sparkSession
    now = stage(voxels.select("x", "y", "z", "grey"), "volume")
    for level in range(levels + 1):
        if level:
            now = stage(pyramid_level(now).select("x", "y", "z", F.col("grey").cast("int").alias("grey")), "volume-level")
        keyed = bricks.pack(now).withColumn("code", morton(*KEYS))
        keyed.repartitionByRange("code").sortWithinPartitions("code").drop("code").write.option("parquet.block.row.count.limit", ROW_GROUP).mode("overwrite").parquet(f"{folder}/bricks/level={level}")
    write_volume(spark, volume, folder)


@dataclass
class Stored:
    """A stored volume that is open: its metadata, and readers that say what they need before anything is read."""

    spark: SparkSession
    folder: str
    volume: Volume

    def bricks(self, level: int = 0, low: Place | None = None, high: Place | None = None) -> DataFrame:
        """The bricks of a level, those that meet the box from low to before high, in voxels of the level, if one is given.
        The conditions are plain comparisons of stored columns, so the scan skips row groups by them."""
        found = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/bricks/level={level}")
        for key, a, b in zip(KEYS, low or (None,) * 3, high or (None,) * 3, strict=True):
            if a is not None:
                found = found.where((F.col(key) >= a // SIDE) & (F.col(key) <= (b - 1) // SIDE))
        return found

    def voxels(self, level: int = 0, low: Place | None = None, high: Place | None = None) -> DataFrame:
        """(x, y, z, grey) of a level or of a box of it. An empty box has no voxels."""
        if low is not None and any(a >= b for a, b in zip(low, high, strict=True)):
            return self.spark.createDataFrame([], "x int, y int, z int, grey int")
        found = bricks.unpack(self.bricks(level, low, high))
        for c, a, b in zip("xyz", low or (None,) * 3, high or (None,) * 3, strict=True):
            if a is not None:
                found = found.where((F.col(c) >= a) & (F.col(c) < b))
        return found

    def levels(self) -> int:
        """How many levels there are besides the finest, by the folders."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bricks")
        return len(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)) - 1

    def preview(self, most: int) -> tuple[int, DataFrame]:
        """(level, (x, y, z, shade)): the finest level no side of which is over `most`, the coarsest if none is, its values from
        their 0.5th to 99.5th percentile as 0 to 255."""
        last = self.levels()
        level = next((k for k in range(last + 1) if max(-(-n // 2**k) for n in self.volume.size) <= most), last)
        found = self.voxels(level)
        low, high = found.agg(F.percentile("grey", F.lit(0.005)), F.percentile("grey", F.lit(0.995))).first()
        shade = F.round(255 * (F.col("grey") - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1e-9)))
        return level, found.select("x", "y", "z", F.least(F.greatest(shade, F.lit(0)), F.lit(255)).cast("int").alias("shade"))


def holds_volume(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bricks")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def open_volume(spark: SparkSession, folder: str) -> Stored:
    """A stored volume; only its metadata is read."""
    return Stored(spark, folder, read_volume(spark, folder))
