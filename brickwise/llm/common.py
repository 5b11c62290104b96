"""What several operators share: table reading, union-find, and staging and components of the library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.graph import connected_components, shared_dir, stage

__all__ = ["Forest", "columns_of", "connected_components", "fresh", "shared_dir", "stage", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            higher = up[up]
            if (higher == up).all():
                self.up = up
                return up
            up = higher

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        top = self.roots()
        a, b = top[i], top[j]
        apart = a != b
        up = self.up
        for x, y in np.unique(np.c_[a[apart], b[apart]], axis=0).tolist():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
