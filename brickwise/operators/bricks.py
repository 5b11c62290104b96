"""The physical form of large volumes: one row for each brick of 64^3 voxels, its values and mask packed, and kernels that
read whole bricks. Neighbours are known by what little of them a kernel needs (block flags, rims of labels); values are
never exchanged. `unpack` gives the voxel view for SQL.

A brick is (bx, by, bz, data, mask): data are 16-bit values, x fastest, mask the packed bits of the active voxels, null
where all voxels inside the volume are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions.keys import offsets
from brickwise.operators.generate import Phantom, gaussian_noise
from brickwise.operators.graph import FEW_EDGES, connected_components, dense_roots, stage

SIDE, BLOCK = 64, 8
CELLS = SIDE // BLOCK
#: Beyond it a sieved brick, with the one voxel around it, would need bricks that aren't its neighbours.
MOST_MARGIN = SIDE - 1
KEYS = ["bx", "by", "bz"]
SCHEMA = "bx int, by int, bz int, data binary, mask binary"
Size = tuple[int, int, int]


def _bricks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray | None, dict]]:
    """((bx, by, bz), values [z, y, x], mask or None, the row's other columns) of each row."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k] for i, n in enumerate(names)}
            key = tuple(row.pop(n).as_py() for n in KEYS)
            data = np.frombuffer(row.pop("data").as_buffer(), dtype="<u2").reshape(SIDE, SIDE, SIDE)
            raw = row.pop("mask").as_buffer()
            mask = None if raw is None else np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little").reshape(SIDE, SIDE, SIDE).astype(bool)
            yield key, data, mask, {n: v.as_py() for n, v in row.items()}


def _row(key: tuple[int, int, int], data: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
    packed = None if mask is None else np.packbits(mask.ravel(), bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([data.astype("<u2").tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=[*KEYS, "data", "mask"])


def _inside(key: tuple[int, int, int], size: Size) -> np.ndarray | None:
    """Which voxels of a brick lie in the volume; None for all."""
    room = [min(SIDE, n - SIDE * k) for k, n in zip(key, size, strict=True)]
    if min(room) == SIDE:
        return None
    out = np.zeros((SIDE, SIDE, SIDE), dtype=bool)
    out[: room[2], : room[1], : room[0]] = True
    return out


def brick_keys(spark: SparkSession, size: Size) -> DataFrame:
    nx, ny, nz = (-(-n // SIDE) for n in size)
    k = F.col("id")
    rows = spark.range(nx * ny * nz, numPartitions=max(1, min(nx * ny * nz, 4 * spark.sparkContext.defaultParallelism)))
    return rows.select((k % nx).cast("int").alias("bx"), (F.floor(k / nx) % ny).cast("int").alias("by"), F.floor(k / (nx * ny)).cast("int").alias("bz"))


def generate(spark: SparkSession, size: Size, values: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Bricks of values(x, y, z), which gets open grids of voxel indices and returns an array indexed [z, y, x]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, y, z = (SIDE * k + np.arange(SIDE) for k in key)
                got = np.clip(np.floor(values(x[None, None, :], y[None, :, None], z[:, None, None]) + 0.5), 0, 65535)
                yield _row(key, np.broadcast_to(got, (SIDE, SIDE, SIDE)), _inside(key, size))

    return brick_keys(spark, size).mapInArrow(run, SCHEMA)


def phantom_bricks(spark: SparkSession, p: Phantom, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """The box phantom of generate.box_phantom, in bricks."""

    def box(at: list[np.ndarray], half: float) -> np.ndarray:
        d = [np.abs(c) - half for c in at]
        away = sum(np.maximum(c, 0.0) ** 2 for c in d)
        return np.sqrt(away) + np.minimum(np.maximum(np.maximum(d[0], d[1]), d[2]), 0.0)

    def values(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        at = [(c + 0.5 - p.size / 2) * p.pitch for c in (x, y, z)]
        d = np.maximum(box(at, p.outer / 2), -box(at, p.outer / 2 - p.wall))
        for cx, cy, cz, r in p.pores:
            near = [np.abs(a - c).min() <= r + 2 * p.pitch for a, c in zip(at, (cx, cy, cz), strict=True)]
            if all(near):
                d = np.maximum(d, r - np.sqrt((at[0] - cx) ** 2 + (at[1] - cy) ** 2 + (at[2] - cz) ** 2))
        got = p.air + np.clip(0.5 - d / p.pitch, 0.0, 1.0) * (p.material - p.air)
        if noise:
            got = np.floor(got + 0.5) + noise * gaussian_noise(seed, x + p.size * (y + p.size * z.astype(np.int64)))
        return got

    return generate(spark, (p.size,) * 3, values)


def pack(voxels: DataFrame) -> DataFrame:
    """Bricks of a voxel table (x, y, z, grey)."""
    keyed = voxels.select(*[F.floor(F.col(c) / SIDE).cast("int").alias(b) for c, b in zip("xyz", KEYS, strict=True)], "x", "y", "z", F.col("grey").cast("int").alias("grey"))

    def run(table: pa.Table) -> pa.Table:
        bx, by, bz, x, y, z, grey = (table.column(k).to_numpy() for k in range(7))
        data, mask = np.zeros((SIDE,) * 3, dtype=np.uint16), np.zeros((SIDE,) * 3, dtype=bool)
        at = (z - SIDE * bz, y - SIDE * by, x - SIDE * bx)
        data[at], mask[at] = grey, True
        return pa.Table.from_batches([_row((bx[0], by[0], bz[0]), data, mask)])

    return keyed.groupBy(*KEYS).applyInArrow(run, SCHEMA)


def unpack(bricks: DataFrame) -> DataFrame:
    """The voxel view (x, y, z, grey) of the active voxels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, mask, _ in _bricks(batches):
            z, y, x = np.nonzero(np.ones(data.shape, dtype=bool) if mask is None else mask)
            yield pa.RecordBatch.from_arrays([pa.array((a + SIDE * k).astype(np.int32)) for a, k in zip((x, y, z), key, strict=True)] + [pa.array(data[z, y, x].astype(np.int32))], names=["x", "y", "z", "grey"])

    return bricks.select(*KEYS, "data", "mask").mapInArrow(run, "x int, y int, z int, grey int")


def histogram(bricks: DataFrame) -> DataFrame:
    """(v, n) of the active voxels; a task sends 65536 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for _, data, mask, _ in _bricks(batches):
            total += np.bincount(data.ravel() if mask is None else data[mask], minlength=65536)
        v = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(total[v])], names=["v", "n"])

    return bricks.select(*KEYS, "data", "mask").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def label(mask: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat places of the set cells, rising, each cell's component, and the place of each component's first cell.
    Runs of cells along x are joined with the runs of neighbouring rows that they touch."""
    nz, ny, nx = mask.shape
    flat = np.pad(mask, ((0, 0), (0, 0), (0, 1))).ravel()
    change = np.flatnonzero(np.diff(np.r_[False, flat].astype(np.int8)))
    start, stop = change[::2], change[1::2]  # in rows of nx + 1 cells, the last of them empty
    row = start // (nx + 1)
    y, z = row % ny, row // ny
    a, b = [], []
    for dz, dy, slack in ((0, 1, 1), (1, 0, 1), (1, 1, 1), (1, -1, 1)):
        if count == 6:
            if dz and dy:
                continue
            slack = 0
        elif count == 18 and dz and dy:
            slack = 0
        ok = np.flatnonzero((y + dy >= 0) & (y + dy < ny) & (z + dz < nz))
        shift = (dz * ny + dy) * (nx + 1)
        base = (row[ok] + dz * ny + dy) * (nx + 1)
        lo = np.searchsorted(stop, np.maximum(start[ok] + shift - slack, base), side="right")
        hi = np.searchsorted(start, np.minimum(stop[ok] + shift + slack, base + nx + 1), side="left")
        n = np.maximum(hi - lo, 0)
        a.append(np.repeat(ok, n))
        b.append(np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
    roots = dense_roots(len(start), np.concatenate(a), np.concatenate(b))
    heads = np.flatnonzero(roots == np.arange(len(roots)))
    group = np.searchsorted(heads, roots)
    return np.flatnonzero(mask), np.repeat(group, stop - start), start[heads] - row[heads]


def _blocks(data: np.ndarray, mask: np.ndarray | None, threshold: float, least: int) -> np.ndarray:
    """Of each block 0 if it has no active voxel, 2 if at least so many are above the threshold, else 1."""
    cells = (CELLS, BLOCK) * 3
    above = data > threshold
    if mask is None:
        return np.where(above.reshape(cells).sum((1, 3, 5)) >= least, 2, 1).astype(np.uint8)
    there = mask.reshape(cells).any((1, 3, 5))
    return np.where(there, np.where((above & mask).reshape(cells).sum((1, 3, 5)) >= least, 2, 1), 0).astype(np.uint8)


def kept_blocks(bricks: DataFrame, size: Size, threshold: float, least: int = 1, open_axes: str = "xyz") -> DataFrame:
    """(bx, by, bz, kept): of each brick a byte for each block, 1 unless it is outside air or empty. Air blocks are
    labelled inside bricks; pairs of labels over brick faces are joined, and a label reaches an open face or not."""
    counts = [-(-n // BLOCK) for n in size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, mask, _ in _bricks(batches):
            flags = _blocks(data, mask, threshold, least)
            at, group, first = label(flags == 1, 6)
            origin = [CELLS * k for k in key]
            z, y, x = (w.astype(np.int64) for w in np.unravel_index(at, flags.shape))
            fz, fy, fx = (w.astype(np.int64) for w in np.unravel_index(first, flags.shape))
            name = ((fx + origin[0]) | (fy + origin[1]) << 21 | (fz + origin[2]) << 42)[group]
            labels = np.full(flags.shape, -1, dtype=np.int64)
            labels[z, y, x] = name
            open_ = np.zeros(len(at), dtype=bool)
            for axis, w, o, n in zip("xyz", (x, y, z), origin, counts, strict=True):
                if axis in open_axes:
                    open_ |= (w + o == 0) | (w + o == n - 1)
            reached = np.unique(name[open_])
            sides = [labels[:, :, 0], labels[:, :, -1], labels[:, 0, :], labels[:, -1, :], labels[0], labels[-1]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k], pa.int32()) for k in key], pa.array([flags.tobytes()], pa.binary()), pa.array([labels.ravel()], pa.list_(pa.int64())), pa.array([reached], pa.list_(pa.int64()))]
                + [pa.array([s.ravel()], pa.list_(pa.int64())) for s in sides],
                names=[*KEYS, "flags", "labels", "reached", "x0", "x1", "y0", "y1", "z0", "z1"],
            )

    kinds = "bx int, by int, bz int, flags binary, labels array<long>, reached array<long>, " + ", ".join(f"{c}{k} array<long>" for c in "xyz" for k in (0, 1))
    found = stage(bricks.select(*KEYS, "data", "mask").mapInArrow(run, kinds), "air-blocks")
    edges = None
    for c, b in zip("xyz", KEYS, strict=True):
        ahead = found.select(*[(F.col(k) + 1).alias(k) if k == b else F.col(k) for k in KEYS], F.col(f"{c}1").alias("before"))
        pairs = found.select(*KEYS, F.col(f"{c}0").alias("behind")).join(ahead, KEYS).select(F.explode(F.arrays_zip("before", "behind")).alias("p"))
        part = pairs.where("p.before >= 0 and p.behind >= 0").select(F.col("p.before").alias("a"), F.col("p.behind").alias("b"))
        edges = part if edges is None else edges.union(part)
    roots = connected_components(edges, FEW_EDGES)
    own = found.select(F.explode("reached").alias("node")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    named = found.select(*KEYS, F.explode(F.array_distinct(F.filter("labels", lambda n: n >= 0))).alias("node")).join(roots, "node", "left")
    outside = named.withColumn("root", F.coalesce("root", "node")).join(own, "root", "left_semi").groupBy(*KEYS).agg(F.collect_set("node").alias("outside"))
    both = found.select(*KEYS, "flags", "labels").join(outside, KEYS, "left")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flags, labels, outside in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                keep = np.frombuffer(flags, dtype=np.uint8) > 0
                out.append((keep & ~np.isin(labels, outside or [])).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=[*KEYS, "kept"])

    return stage(both.mapInArrow(mark, "bx int, by int, bz int, kept binary"), "kept-blocks")


def with_kept_around(bricks: DataFrame, kept: DataFrame) -> DataFrame:
    """Bricks with the kept blocks of all 27 bricks around, by their offsets: 512 bytes from each neighbour."""
    shifts = F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip(o, KEYS, strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    sent = kept.select(*KEYS, "kept", F.explode(shifts).alias("o")).select(*[(F.col(k) + F.col(f"o.{k}")).alias(k) for k in KEYS], F.struct(*[(-F.col(f"o.{k}")).alias(k) for k in KEYS], "kept").alias("near"))
    around = sent.groupBy(*KEYS).agg(F.collect_list("near").alias("near"))
    return bricks.join(around, KEYS).select(*KEYS, "data", "mask", "near")


def _grow(mask: np.ndarray, steps: int, count: int) -> np.ndarray:
    for _ in range(steps):
        wide = np.pad(mask, 1)
        out = mask.copy()
        for dz, dy, dx in offsets(count):
            out |= wide[1 + dz : wide.shape[0] - 1 + dz, 1 + dy : wide.shape[1] - 1 + dy, 1 + dx : wide.shape[2] - 1 + dx]
        mask = out
    return mask


def sieved_mask(key: tuple[int, int, int], near: list[dict], size: Size, margin: int, mask: np.ndarray | None) -> np.ndarray | None:
    """The active voxels of a brick and one voxel around it after the sieve, [z, y, x]; None if there are none. Kept
    blocks are grown by the margin over faces and edges; the neighbours' blocks are enough for margins up to MOST_MARGIN."""
    cells = np.zeros((3 * CELLS,) * 3, dtype=bool)
    for n in near:
        at = tuple(slice((n[k] + 1) * CELLS, (n[k] + 2) * CELLS) for k in reversed(KEYS))
        cells[at] = np.frombuffer(n["kept"], dtype=np.uint8).reshape((CELLS,) * 3) > 0
    wide = margin // BLOCK + 1
    cells = cells[(slice(CELLS - wide, 2 * CELLS + wide),) * 3]
    if not cells.any():
        return None
    if cells.all():
        out = np.ones((SIDE + 2,) * 3, dtype=bool)
    else:
        voxels = cells.repeat(BLOCK, 0).repeat(BLOCK, 1).repeat(BLOCK, 2)
        lo = wide * BLOCK - 1 - margin
        voxels = voxels[(slice(lo, voxels.shape[0] - lo),) * 3]
        out = _grow(voxels, margin, 18)
        out = out[(slice(margin, out.shape[0] - margin),) * 3]
    for axis, (k, n) in enumerate(zip(reversed(key), reversed(size), strict=True)):
        place = SIDE * k - 1 + np.arange(SIDE + 2)
        shape = [1, 1, 1]
        shape[axis] = -1
        out = out & ((place >= 0) & (place < n)).reshape(shape)
    if mask is not None:
        out = out.copy()
        out[1:-1, 1:-1, 1:-1] &= mask
    return out


def sieve(bricks: DataFrame, size: Size, threshold: float, margin: int = 3, least: int = 1, open_axes: str = "xyz") -> DataFrame:
    """The bricks without outside air, values kept; bricks with no active voxel go."""
    if not 0 <= margin <= MOST_MARGIN:
        raise ValueError(f"sieve: a margin of 0 to {MOST_MARGIN}")
    around = with_kept_around(bricks, kept_blocks(bricks, size, threshold, least, open_axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, mask, more in _bricks(batches):
            active = sieved_mask(key, more["near"], size, margin, mask)
            if active is not None and active[1:-1, 1:-1, 1:-1].any():
                yield _row(key, data, active[1:-1, 1:-1, 1:-1])

    return around.mapInArrow(run, SCHEMA)


def find_pores(bricks: DataFrame, size: Size, threshold: float, least: int = 3, margin: int = 3) -> DataFrame:
    """(component, voxels, sx, sy, sz, sg) of the pores of a raw volume: the sums of the places and values of each
    26-connected set of active voxels below the threshold, of so many voxels at least, none of which has an inactive
    neighbour over a face.

    One kernel sieves a brick, finds its candidates and labels them. What leaves it are the sums of each label and the
    rim voxels of candidates; a label with a seed is outside air, so only rims of others look for neighbours."""
    if not 0 <= margin <= MOST_MARGIN:
        raise ValueError(f"find_pores: a margin of 0 to {MOST_MARGIN}")
    around = with_kept_around(bricks, kept_blocks(bricks, size, threshold))
    last = SIDE - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, mask, more in _bricks(batches):
            wide = sieved_mask(key, more["near"], size, margin, mask)
            if wide is None:
                continue
            active = wide[1:-1, 1:-1, 1:-1]
            low = active & (data < threshold)
            if not low.any():
                continue
            shut = wide[:-2, 1:-1, 1:-1] & wide[2:, 1:-1, 1:-1] & wide[1:-1, :-2, 1:-1] & wide[1:-1, 2:, 1:-1] & wide[1:-1, 1:-1, :-2] & wide[1:-1, 1:-1, 2:]
            at, group, first = label(low, 26)
            z, y, x = np.unravel_index(at, low.shape)
            seed = ~shut[z, y, x]
            fz, fy, fx = (w.astype(np.int64) for w in np.unravel_index(first, low.shape))
            labels = (fx + SIDE * key[0]) | (fy + SIDE * key[1]) << 21 | (fz + SIDE * key[2]) << 42
            place = [w + SIDE * k for w, k in zip((x, y, z), key, strict=True)]
            total = lambda w: np.bincount(group, w, len(labels)).astype(np.int64)
            sums = [np.bincount(group, minlength=len(labels)), *[total(w) for w in place], total(data[z, y, x].astype(np.int64))]
            seeded = total(seed) > 0
            rim = (x == 0) | (x == last) | (y == 0) | (y == last) | (z == 0) | (z == last)
            none = lambda n: pa.array([None] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(seeded), *[pa.array(s) for s in sums], *[none(len(labels))] * 3], names=names)
            if rim.any():
                n = int(rim.sum())
                yield pa.RecordBatch.from_arrays([pa.array(labels[group[rim]]), pa.array(seeded[group[rim]]), *[pa.array([None] * n, pa.int64())] * 5, *[pa.array(w[rim].astype(np.int32)) for w in place]], names=names)

    names = ["label", "seeded", "voxels", "sx", "sy", "sz", "sg", "x", "y", "z"]
    kinds = "label long, seeded boolean, voxels long, sx long, sy long, sz long, sg long, x int, y int, z int"
    found = stage(around.mapInArrow(run, kinds), "brick-pores")
    rims = found.where("x is not null")
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in offsets(26)])
    asked = rims.where("not seeded").select(F.col("label").alias("a"), "x", "y", "z", F.explode(shifts).alias("o")).select("a", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
    edges = stage(asked.join(rims.select("x", "y", "z", F.col("label").alias("b"), "seeded"), ["x", "y", "z"]).where("a != b").select("a", "b", "seeded").distinct(), "pore-edges")
    roots = connected_components(edges.select("a", "b"), FEW_EDGES)
    parts = found.where("x is null").select("label", "seeded", "voxels", "sx", "sy", "sz", "sg").join(roots.withColumnRenamed("node", "label"), "label", "left")
    sums = [F.sum(c).alias(c) for c in ("voxels", "sx", "sy", "sz", "sg")]
    whole = parts.groupBy(F.coalesce("root", "label").alias("component")).agg(F.bool_or("seeded").alias("seeded"), *sums)
    return whole.where((~F.col("seeded")) & (F.col("voxels") >= least)).drop("seeded")
