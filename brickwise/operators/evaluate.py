"""Evaluation: acceptance of zones, porosity keys, requirements, ratings and the newest artifacts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The symbols of porosity keys, longest first.
SYMBOLS = ("PROI", "Daq", "Psi", "Gap", "PG", "PV", "Vp", "Dp", "da", "C", "Z")


def acceptance(zones: DataFrame, pores: DataFrame, disregarded: Column) -> DataFrame:
    """Each zone (x0, x1, y0, y1, limits) with its pores counted and rated: considered and disregarded pores by centre,
    the largest with its id, and whether size and count are within the limits (an empty zone passes). The zone
    table comes from an order and is small; Spark broadcasts it by its size."""
    tagged = pores.withColumn("skip", disregarded)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    hit = zones.join(tagged, inside, "left")
    counts = F.col("id").isNotNull() & ~F.col("skip")
    m = hit.groupBy("zone", "max_size", "max_count").agg(
        F.count(F.when(counts, F.lit(1))).alias("pores"),
        F.count(F.when(F.col("id").isNotNull() & F.col("skip"), F.lit(1))).alias("disregarded"),
        F.coalesce(F.max(F.when(counts, F.col("size"))), F.lit(0.0)).alias("largest"),
        F.max(F.when(counts, F.struct("size", -F.col("id")))).alias("top"),
    )
    worst = F.when(F.col("largest") > 0, -F.col("top")["col2"])
    return m.select("zone", "pores", "disregarded", "largest", worst.alias("worst"), (~(F.col("largest") > F.col("max_size"))).alias("size_ok"), (~(F.col("pores") > F.col("max_count"))).alias("count_ok"))


def parse_keys(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, symbol, disregard, value) for each parameter of porosity keys: tokens between slashes, a leading U marks
    what is disregarded, numbers have a comma or a point."""
    form = rf"^(U?) *({'|'.join(SYMBOLS)}) *([0-9.,]+)$"
    token = rows.select(name, F.explode(F.split(key, "/")).alias("t")).select(name, F.trim("t").alias("t")).where("t != ''")
    part = lambda k: F.regexp_extract("t", form, k)
    return token.select(name, part(2).alias("symbol"), (part(1) == "U").alias("disregard"), F.replace(part(3), F.lit(","), F.lit(".")).cast("double").alias("value"))


def disregards(limits: dict[str, float]) -> Column:
    """A pore is disregarded if any given limit holds: diameters and volume at most, sphericity and compactness at least."""
    out = F.lit(False)
    for c, limit in limits.items():
        out = out | (F.col(c) >= limit if c in ("sphericity", "compactness") else F.col(c) <= limit)
    return out


def match_families(need: DataFrame, found: DataFrame) -> DataFrame:
    """(need, id, angle): for each required direction the closest measured one by axial angle. Both tables have a row
    for each family of an order or a result, a handful."""
    d = F.abs(found["a"] - need["a"])
    angle = F.least(d, math.pi - d)
    pair = need.join(found).select("need", "id", angle.alias("angle"))
    return pair.groupBy("need").agg(F.min_by("id", F.struct(F.round("angle", 9), "id")).alias("id"), F.min("angle").alias("angle"))


def rate(rows: DataFrame) -> DataFrame:
    """rows with deviation and rating: pass, fail, not measured, or unrated without a tolerance."""
    d = F.col("measured") - F.col("nominal")
    rating = F.when(F.col("measured").isNull(), "not measured").when(F.col("tolerance").isNull(), "unrated").when(F.abs(d) > F.col("tolerance"), "fail").otherwise("pass")
    return rows.withColumns({"deviation": d, "rating": rating})


def latest(rows: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    """The value of the newest row of each group; a maximum, not a sort, so it is summed before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(value, order).alias("value"))
