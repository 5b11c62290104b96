"""Inspection regions: unions of solids minus unions of solids, as predicates over coordinates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float, float]


def _numbers(p: Point) -> str:
    return "(" + ", ".join(f"{v:g}" for v in p) + ")"


@dataclass
class Block:
    """A box, its lower corner inside and its upper one outside."""

    low: Point
    high: Point

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        out = F.lit(True)
        for c, a, b in zip((x, y, z), self.low, self.high, strict=True):
            out = out & (c >= a) & (c < b)
        return out

    def side(self, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
        """Whether all points of the box from low to high are inside, and whether none is. Both may be false."""
        every, none = F.lit(True), F.lit(False)
        for a, b, p, q in zip(low, high, self.low, self.high, strict=True):
            every, none = every & (a >= p) & (b < q), none | (b < p) | (a >= q)
        return every, none

    def describe(self) -> str:
        return f"box {_numbers(self.low)} to {_numbers(self.high)}"

    def bounds(self) -> tuple[Point, Point]:
        return self.low, self.high


@dataclass
class Ball:
    centre: Point
    radius: float

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        d = [c - p for c, p in zip((x, y, z), self.centre, strict=True)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= self.radius**2

    def side(self, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
        """By the farthest and the nearest place of a box."""
        far, near = F.lit(0.0), F.lit(0.0)
        for a, b, c in zip(low, high, self.centre, strict=True):
            most, least = F.greatest(F.abs(a - c), F.abs(b - c)), F.greatest(a - c, c - b, F.lit(0.0))
            far, near = far + most * most, near + least * least
        return far <= self.radius**2, near > self.radius**2

    def describe(self) -> str:
        return f"sphere at {_numbers(self.centre)} of radius {self.radius:g}"

    def bounds(self) -> tuple[Point, Point]:
        return tuple(c - self.radius for c in self.centre), tuple(c + self.radius for c in self.centre)


@dataclass
class Cylinder:
    """Points whose projection falls between the ends of the axis and that are near enough to it."""

    start: Point
    end: Point
    radius: float

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        axis = [b - a for a, b in zip(self.start, self.end, strict=True)]
        length = sum(v * v for v in axis)
        d = [c - p for c, p in zip((x, y, z), self.start, strict=True)]
        t = (d[0] * axis[0] + d[1] * axis[1] + d[2] * axis[2]) / length
        away = [a - t * v for a, v in zip(d, axis, strict=True)]
        return (t >= 0) & (t <= 1) & (away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= self.radius**2)

    def side(self, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
        """By the box's middle and half its diagonal, which no point of it is farther from the middle."""
        axis = [b - a for a, b in zip(self.start, self.end, strict=True)]
        length = sum(v * v for v in axis) ** 0.5
        half = F.sqrt(sum(((b - a) * (b - a) for a, b in zip(low, high, strict=True)), F.lit(0.0))) / 2 + 1e-9
        d = [(a + b) / 2 - p for a, b, p in zip(low, high, self.start, strict=True)]
        along = sum((x * v / length for x, v in zip(d, axis, strict=True)), F.lit(0.0))
        away = [x - along * v / length for x, v in zip(d, axis, strict=True)]
        radial = F.sqrt(sum((x * x for x in away), F.lit(0.0)))
        every = (radial + half <= self.radius) & (along - half >= 0) & (along + half <= length)
        return every, (radial - half > self.radius) | (along + half < 0) | (along - half > length)

    def describe(self) -> str:
        return f"cylinder from {_numbers(self.start)} to {_numbers(self.end)} of radius {self.radius:g}"

    def bounds(self) -> tuple[Point, Point]:
        lo = tuple(min(a, b) - self.radius for a, b in zip(self.start, self.end, strict=True))
        return lo, tuple(max(a, b) + self.radius for a, b in zip(self.start, self.end, strict=True))


@dataclass
class Region:
    """What is in a solid of the first list and in none of the second; an empty first list includes everything."""

    include: list = field(default_factory=list)
    exclude: list = field(default_factory=list)

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        inside = F.lit(not self.include)
        for s in self.include:
            inside = inside | s.contains(x, y, z)
        for s in self.exclude:
            inside = inside & ~s.contains(x, y, z)
        return inside

    def side(self, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
        """Whether a box from low to high surely lies in the region as a whole, and whether it surely lies outside."""
        every, none = F.lit(not self.include), F.lit(bool(self.include))
        for s in self.include:
            in_, out = s.side(low, high)
            every, none = every | in_, none & out
        for s in self.exclude:
            in_, out = s.side(low, high)
            every, none = every & out, none | in_
        return every, none

    def describe(self) -> str:
        """The region in words."""
        parts = " and ".join(s.describe() for s in self.include) or "the whole part"
        return parts + (" without " + " and ".join(s.describe() for s in self.exclude) if self.exclude else "")

    def bounds(self) -> tuple[Point, Point] | None:
        if not self.include:
            return None
        lows, highs = zip(*(s.bounds() for s in self.include), strict=True)
        return tuple(map(min, zip(*lows, strict=True))), tuple(map(max, zip(*highs, strict=True)))

    @staticmethod
    def parse(order: dict) -> Region:
        """From {"include": [...], "exclude": [...]}; each solid has a type: box, sphere or cylinder."""

        def solid(s: dict):
            kinds = {"box": lambda: Block(tuple(s["min"]), tuple(s["max"])), "sphere": lambda: Ball(tuple(s["center"]), s["radius"]), "cylinder": lambda: Cylinder(tuple(s["start"]), tuple(s["end"]), s["radius"])}
            if s.get("type") not in kinds:
                raise ValueError(f"unknown solid {s.get('type')!r}")
            return kinds[s["type"]]()

        return Region([solid(s) for s in order.get("include", [])], [solid(s) for s in order.get("exclude", [])])

    @staticmethod
    def of_zone(zone: dict) -> Region:
        """The region of an inspection order's zone, in mm: its box_mm, or region: a list of solids, or include and exclude
        lists. A solid is {"box_mm": [low, high]}, {"sphere": {"center_mm", "radius_mm"}} or {"cylinder": {"from_mm", "to_mm", "radius_mm"}}. A
        zone without either is the whole part. Meshes aren't taken."""

        def point(p: object) -> Point:
            if not isinstance(p, list) or len(p) != 3:
                raise ValueError(f"a place is three numbers, not {p!r}")
            return tuple(map(float, p))

        def radius(s: dict) -> float:
            if not isinstance(s.get("radius_mm"), (int, float)) or s["radius_mm"] <= 0:
                raise ValueError("a radius is a number over zero")
            return float(s["radius_mm"])

        def solid(s: object):
            kind = next(iter(s), None) if isinstance(s, dict) and len(s) == 1 else None
            if kind == "box_mm" and isinstance(s[kind], list) and len(s[kind]) == 2:
                low, high = map(point, s[kind])
                if any(a >= b for a, b in zip(low, high, strict=True)):
                    raise ValueError("a box goes from its lower to its upper corner")
                return Block(low, high)
            if kind == "sphere":
                return Ball(point(s[kind].get("center_mm")), radius(s[kind]))
            if kind == "cylinder":
                ends = point(s[kind].get("from_mm")), point(s[kind].get("to_mm"))
                if ends[0] == ends[1]:
                    raise ValueError("a cylinder's ends are two places")
                return Cylinder(*ends, radius(s[kind]))
            raise ValueError(f"a solid is a box_mm, a sphere or a cylinder, not {s!r}")

        given = zone.get("region", [])
        lists = {"include": given} if isinstance(given, list) else given
        box = [{"box_mm": zone["box_mm"]}] if "box_mm" in zone else []
        return Region([solid(s) for s in [*box, *lists.get("include", [])]], [solid(s) for s in lists.get("exclude", [])])

    def overlap(self, x: Column, y: Column, z: Column, size: float) -> Column:
        """The share of a cube at (x, y, z) that is inside, by 4^3 samples at the centres of its parts."""
        total = F.lit(0)
        for k in range(64):
            at = [c + size * ((k >> 2 * n) % 4 + 0.5) / 4 for n, c in enumerate((x, y, z))]
            total = total + self.contains(*at).cast("int")
        return total / 64.0


def region_volumes(voxels: DataFrame, regions: dict[str, Region], material: float, air: float, voxel: Point = (1.0, 1.0, 1.0), size: int = 8, sums: DataFrame | None = None) -> DataFrame:
    """(name, voxels, volume_mm3) of the part in each region: voxel centres, (index + 1/2) times the voxel's sizes, that are inside, each with its share of
    material (grey - air) / (material - air).

    Blocks of size^3 voxels are told by their corners to be inside, outside or mixed. Of those inside only the block's
    sums (bx, by, bz, n, s) count, made here from the voxels unless they are given; voxels are tested one by one in mixed blocks alone. A region that holds nothing has a row of zeros."""
    spark = voxels.sparkSession
    block = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "xyz"]
    keys = ["bx", "by", "bz"]
    grey = F.col("grey").cast("long")
    sums = voxels.groupBy(*block).agg(F.count("*").alias("n"), F.sum(grey).alias("s")) if sums is None else sums.select(*keys, "n", "s")
    low = [(F.col(k) * size + 0.5) * v for k, v in zip(keys, voxel, strict=True)]
    high = [(F.col(k) * size + size - 0.5) * v for k, v in zip(keys, voxel, strict=True)]
    centre = [(F.col(c) + 0.5) * v for c, v in zip("xyz", voxel, strict=True)]
    told = F.array(*[F.struct(F.lit(n).alias("name"), *[x.alias(k) for x, k in zip(r.side(low, high), ("every", "none"), strict=True)]) for n, r in regions.items()])
    marked = sums.select(*keys, "n", "s", F.explode(told).alias("r")).select(*keys, "n", "s", "r.*").where(~F.col("none"))
    tested = F.lit(False)
    for n, r in regions.items():
        tested = tested | ((F.col("name") == n) & r.contains(*centre))
    mixed = voxels.select("x", "y", "z", "grey", *block).join(marked.where(~F.col("every")).select(*keys, "name"), keys).where(tested)
    parts = marked.where("every").select("name", "n", "s").unionByName(mixed.groupBy("name").agg(F.count("*").alias("n"), F.sum(grey).alias("s")))
    found = parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    names = spark.createDataFrame([(n,) for n in regions], "name string")
    n, s = (F.coalesce(c, F.lit(0)) for c in ("n", "s"))
    return names.join(found, "name", "left").select("name", n.alias("voxels"), ((s - air * n) / (material - air) * (voxel[0] * voxel[1] * voxel[2])).alias("volume_mm3"))
