"""Keys of voxels, blocks and bricks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 8
BITS = 21


def voxel_key(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """One long that sorts like (z, y, x), x fastest, for coordinates of up to 21 bits."""
    part = lambda c, k: F.shiftleft(F.col(c).cast("long"), BITS * k)
    return part(z, 2) + part(y, 1) + part(x, 0)


def unkey(key: str = "key") -> list[Column]:
    """x, y and z of a voxel key."""
    return [F.shiftright(F.col(key), BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(c) for k, c in enumerate("xyz")]


def block_of(c: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def morton(x: str = "x", y: str = "y", z: str = "z", bits: int = BITS) -> Column:
    """Bits of x, y and z interleaved, x lowest: neighbours in space are near in this order."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate((x, y, z)):
            bit = F.shiftright(F.col(c).cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * b + k))
    return out


def offsets(neighbours: int) -> list[tuple[int, int, int]]:
    """The 6, 18 or 26 offsets of face, edge and corner neighbours."""
    reach = {6: 1, 18: 2, 26: 3}[neighbours]
    every = [(i, j, k) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    return [o for o in every if 0 < sum(map(abs, o)) <= reach]


def natural_key(name: Column, digits: int = 12) -> Column:
    """Sorts slice2 before slice10: runs of digits are padded to one width."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, digits, "0")).otherwise(p)), "")
