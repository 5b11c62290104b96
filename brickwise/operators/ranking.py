"""Ranks of the rows of a whole table without a task that reads them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.operators.graph import stage


#: Columns of our own, beside whatever names the rows have.
PART, AT, SIZE, FIRST, BEFORE = (f"__rank_{n}" for n in ("part", "at", "size", "first", "before"))


def ranks(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their rank from 1 by an order: they are dealt by ranges of it, sorted and numbered inside a part, and the
    sizes of the parts before, one row each, are added. Rows that are equal in the order get ranks in no certain order; no rows, no ranks."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = stage(dealt.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()), "ranked")
    sizes = part.groupBy(PART).agg(F.count("*").alias(SIZE), F.min(AT).alias(FIRST))
    before = sizes.withColumn(BEFORE, F.sum(SIZE).over(Window.orderBy(PART)) - F.col(SIZE))
    return part.join(F.broadcast(before), PART).withColumn(name, F.col(BEFORE) + F.col(AT) - F.col(FIRST) + 1).drop(PART, AT, SIZE, FIRST, BEFORE)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums by an order, each up to its row: inside of ranges of the order, which tasks share, plus the sums of the ranges before,
    one row each. A count is the running sum of 1."""
    part = stage(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranges")
    each = part.groupBy(PART).agg(*[F.sum(v).alias(f"{SIZE}_{n}") for n, v in sums.items()])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(PART, *[F.coalesce(F.sum(f"{SIZE}_{n}").over(earlier), F.lit(0)).alias(f"{BEFORE}_{n}") for n in sums])
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = part.join(F.broadcast(before), PART).withColumns({n: F.sum(v).over(inside) + F.col(f"{BEFORE}_{n}") for n, v in sums.items()})
    return found.drop(PART, *[f"{BEFORE}_{n}" for n in sums])
