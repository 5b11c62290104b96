"""Volumes as voxel tables (x, y, z, grey): voxelising, reading regions, slices and planes, joining and interpolating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import offsets

Box = tuple[tuple[int, int, int], tuple[int, int, int]]


def voxelise(rows: DataFrame, x: Column, y: Column, z: Column, value: Column) -> DataFrame:
    """A sparse volume from any table: rows that fall in a voxel are summed; voxels without rows are inactive."""
    return rows.groupBy(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z")).agg(F.sum(value.cast("int")).cast("int").alias("grey"))


def lattice(spark: SparkSession, box: Box) -> DataFrame:
    """All voxels of a half-open box, generated by the executors."""
    (x0, y0, z0), (x1, y1, z1) = box
    nx, ny, nz = x1 - x0, y1 - y0, z1 - z0
    i = F.col("id")
    return spark.range(nx * ny * nz).select(
        (i % nx + x0).cast("int").alias("x"), (F.floor(i / nx) % ny + y0).cast("int").alias("y"), (F.floor(i / (nx * ny)) + z0).cast("int").alias("z")
    )


def inside(box: Box) -> Column:
    """Predicate of a half-open box; it is pushed to the scan."""
    lo, hi = box
    out = F.lit(True)
    for c, a, b in zip("xyz", lo, hi, strict=True):
        out = out & (F.col(c) >= a) & (F.col(c) < b)
    return out


def read_region(voxels: DataFrame, box: Box, fill: int) -> DataFrame:
    """Every voxel of a box, with the fill value where it is inactive."""
    grid = lattice(voxels.sparkSession, box)
    return grid.join(voxels.where(inside(box)), ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("grey", F.lit(fill)).alias("grey"))


def point_sample(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """The points with the grey value at them, null where the volume is inactive."""
    return points.join(voxels, ["x", "y", "z"], "left")


def oblique_nearest(voxels: DataFrame, width: int, height: int, origin, du, dv, fill: int) -> DataFrame:
    """Pixels (i, j) of a plane origin + i du + j dv, each with the value of the nearest voxel."""
    pix = voxels.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("i"), F.floor(F.col("id") / width).cast("int").alias("j"))
    at = [F.floor(F.lit(float(o)) + F.col("i") * float(a) + F.col("j") * float(b) + 0.5).cast("int").alias(c) for c, o, a, b in zip("xyz", origin, du, dv, strict=True)]
    return pix.select("i", "j", *at).join(voxels, ["x", "y", "z"], "left").select("i", "j", F.coalesce("grey", F.lit(fill)).alias("grey"))


def oblique_trilinear(voxels: DataFrame, width: int, height: int, origin, du, dv, air: float) -> DataFrame:
    """The same by trilinear interpolation: inactive corners count as air, pixels with no active corner are left out."""
    pix = voxels.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("i"), F.floor(F.col("id") / width).cast("int").alias("j"))
    at = [(F.lit(float(o)) + F.col("i") * float(a) + F.col("j") * float(b)).alias(f"c{c}") for c, o, a, b in zip("xyz", origin, du, dv, strict=True)]
    pix = pix.select("i", "j", *at)
    corners = F.array(*[F.struct(*[F.lit(k >> n & 1).alias(c) for n, c in enumerate("xyz")]) for k in range(8)])
    each = pix.select("*", F.explode(corners).alias("d"))
    cell = {c: F.floor(F.col(f"c{c}")) for c in "xyz"}
    share = F.lit(1.0)
    for c in "xyz":
        f = F.col(f"c{c}") - cell[c]
        share = share * F.when(F.col(f"d.{c}") == 1, f).otherwise(1 - f)
    each = each.select("i", "j", share.alias("w"), *[(cell[c] + F.col(f"d.{c}")).cast("int").alias(c) for c in "xyz"])
    got = each.join(voxels, ["x", "y", "z"], "left").groupBy("i", "j").agg(F.sum(F.col("w") * F.coalesce(F.col("grey").cast("double"), F.lit(float(air)))).alias("value"), F.count("grey").alias("n"))
    return got.where("n > 0").select("i", "j", "value")


def interpolate_slices(voxels: DataFrame, factor: int) -> DataFrame:
    """(nz - 1) * factor + 1 slices: between two neighbouring slices linear values, rounded half up."""
    w = Window.partitionBy("x", "y").orderBy("z")
    nxt = F.when(F.lead("z").over(w) == F.col("z") + 1, F.lead("grey").over(w))
    both = voxels.select("x", "y", "z", "grey", nxt.alias("high"))
    steps = F.when(F.col("high").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    each = both.select("x", "y", "z", "grey", "high", F.explode(steps).alias("k"))
    value = F.when(F.col("k") == 0, F.col("grey")).otherwise(F.floor((F.col("grey") * (factor - F.col("k")) + F.col("high") * F.col("k")) / factor + 0.5).cast("int"))
    return each.select("x", "y", (F.col("z") * factor + F.col("k")).alias("z"), value.alias("grey"))


def concatenate(first: DataFrame, second: DataFrame, axis: str, length: int) -> DataFrame:
    """Two volumes one behind the other along an axis; length is the first one's."""
    return first.unionByName(second.withColumn(axis, (F.col(axis) + length).cast("int")))


def crop(voxels: DataFrame, planes: list[tuple[tuple[float, float, float], float]]) -> DataFrame:
    """Cut planes: each removes the side that its normal points to, n . p > d."""
    for n, d in planes:
        voxels = voxels.where(F.col("x") * n[0] + F.col("y") * n[1] + F.col("z") * n[2] <= d)
    return voxels


def occupied_bricks(voxels: DataFrame, size: int) -> DataFrame:
    return voxels.select(*[F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "xyz"]).distinct()


def window_to_bytes(voxels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Grey values mapped to 0..255 between two exact percentiles (discrete, of the active voxels)."""
    ends = voxels.agg(F.expr(f"percentile_disc({low}) within group (order by grey)").alias("lo"), F.expr(f"percentile_disc({high}) within group (order by grey)").alias("hi"))
    scaled = (F.col("grey") - F.col("lo")) * 255.0 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return voxels.join(F.broadcast(ends)).select("x", "y", "z", F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int").alias("byte"))


def neighbours(voxels: DataFrame, count: int, value: str = "grey") -> DataFrame:
    """Each voxel's active neighbours: (x, y, z, dx, dy, dz, other). The offsets are a literal; the join is on the
    shifted voxel key, so both sides are dealt by it once."""
    shifts = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for d, c in zip(o, "xyz", strict=True)]) for o in offsets(count)])
    each = voxels.select("x", "y", "z", F.explode(shifts).alias("d")).select("x", "y", "z", "d.*", *[(F.col(c) + F.col(f"d.d{c}")).alias(f"n{c}") for c in "xyz"])
    other = voxels.select(*[F.col(c).alias(f"n{c}") for c in "xyz"], F.col(value).alias("other"))
    return each.join(other, ["nx", "ny", "nz"]).drop("nx", "ny", "nz")


def box_filter(voxels: DataFrame, radius: int, box: Box, fill: int) -> DataFrame:
    """Sums over cubes of 2 radius + 1 voxels of a full lattice, clipped at its border: one window along each axis."""
    full = read_region(voxels, box, fill)
    for axis in "xyz":
        rest = [c for c in "xyz" if c != axis]
        w = Window.partitionBy(*rest).orderBy(axis).rowsBetween(-radius, radius)
        full = full.select("x", "y", "z", F.sum("grey").over(w).alias("grey"))
    return full


def map_values(voxels: DataFrame, offset: float, scale: float) -> DataFrame:
    return voxels.withColumn("value", F.lit(offset) + F.lit(scale) * F.col("grey"))


def float_to_grey(values: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Floats mapped linearly to 16 bits, with a flag for values that were clipped."""
    v = F.col(column)
    scaled = F.least(F.greatest((v - low) * 65535.0 / (high - low), F.lit(0.0)), F.lit(65535.0))
    return values.withColumn("grey", F.floor(scaled + 0.5).cast("int")).withColumn("clipped", (v < low) | (v > high))


def to_integer(values: DataFrame, column: str) -> DataFrame:
    """Float values that are whole numbers as integers; any other raises."""
    whole = F.col(column) == F.floor(column)
    return values.withColumn(column, F.when(F.assert_true(whole, F.lit("a value is not a whole number")).isNull(), F.col(column).cast("int")))


def mip(voxels: DataFrame, axis: str, value: Column) -> DataFrame:
    """Values summed along an axis."""
    rest = [c for c in "xyz" if c != axis]
    return voxels.groupBy(*rest).agg(F.sum(value).alias("value"))
