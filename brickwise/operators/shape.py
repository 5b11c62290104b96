"""Non-rigid registration on a grid of B-spline controls, families of directions, and learned models on bricks."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.filters import with_halo


def _basis(t: np.ndarray) -> np.ndarray:
    """The four cubic B-spline weights at places 0..1 of a span."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], -1) / 6


class Warp:
    """Shifts by cubic B-splines over a box: controls (nx, ny, nz, 3) a spacing apart."""

    def __init__(self, low: np.ndarray, spacing: float, counts: tuple[int, int, int], controls: np.ndarray | None = None):
        self.low, self.spacing, self.counts = np.asarray(low, float), float(spacing), tuple(counts)
        self.controls = np.zeros((*self.counts, 3)) if controls is None else controls

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray, spans: int = 8) -> Warp:
        """A grid whose spacing is a share of the largest extent."""
        extent = np.asarray(high, float) - low
        spacing = max(float(extent.max()) / spans, 1e-9)
        return cls(low, spacing, tuple(int(np.ceil(e / spacing - 1e-9)) + 3 for e in np.maximum(extent, spacing)))

    def weights(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat control, weight) of the 64 controls of each point, both (n, 64)."""
        u = (p - self.low) / self.spacing
        top = np.array(self.counts) - 4
        k = np.clip(np.floor(u).astype(int), 0, top)
        b = _basis(np.clip(u - k, 0, 1))
        off = np.arange(4)
        at = ((k[:, 0, None, None, None] + off[:, None, None]) * self.counts[1] + (k[:, 1, None, None, None] + off[None, :, None])) * self.counts[2] + (k[:, 2, None, None, None] + off[None, None, :])
        w = b[:, 0, :, None, None] * b[:, 1, None, :, None] * b[:, 2, None, None, :]
        return at.reshape(len(p), 64), w.reshape(len(p), 64)

    def __call__(self, p: np.ndarray) -> np.ndarray:
        at, w = self.weights(p)
        return p + (w[:, :, None] * self.controls.reshape(-1, 3)[at]).sum(1)


def _laplacian(counts: tuple[int, int, int], v: np.ndarray) -> np.ndarray:
    """Second differences along each axis, applied twice: the normal equations of bending."""
    out = np.zeros_like(v)
    for axis in range(3):
        n = counts[axis]
        if n < 3:
            continue
        m = np.moveaxis(v, axis, 0)
        d = m[2:] - 2 * m[1:-1] + m[:-2]
        back = np.zeros_like(m)
        back[2:] += d
        back[1:-1] -= 2 * d
        back[:-2] += d
        out += np.moveaxis(back, 0, axis)
    return out


def fit_warp(matches: DataFrame, warp: Warp, stiffness: float = 0.1, rounds: int = 60) -> Warp:
    """The warp that brings points (x, y, z) onto their planes (qx, qy, qz, nx, ny, nz) with the least squares and little
    bending. Executors sum the normal equations of the controls, a number of them that depends on the grid only; the
    conjugate gradients run on the driver."""
    size = int(np.prod(warp.counts))
    schema = "i int, j int, a double, b double"

    def run(batches):
        rows, cols, values, right = [], [], [], []
        for pdf in batches:
            p, q, n = (pdf[[*c]].to_numpy(float) for c in (("x", "y", "z"), ("qx", "qy", "qz"), ("nx", "ny", "nz")))
            r = ((q - p) * n).sum(1)
            for lo in range(0, len(p), 512):
                at, w = warp.weights(p[lo : lo + 512])
                j = (w[:, :, None] * n[lo : lo + 512, None, :]).reshape(len(at), 192)
                k = (3 * at[:, :, None] + np.arange(3)).reshape(len(at), 192)
                near = np.unique(k)
                local = np.searchsorted(near, k)
                dense = np.zeros((len(at), len(near)))
                np.put_along_axis(dense, local, j, 1)
                m = dense.T @ dense
                a, b = np.nonzero(np.triu(m))
                rows.append(near[a]), cols.append(near[b]), values.append(m[a, b]), right.append((near, dense.T @ r[lo : lo + 512]))
        if rows:
            key = np.concatenate(rows).astype(np.int64) * 3 * size + np.concatenate(cols)
            some, back = np.unique(key, return_inverse=True)
            total = np.bincount(back, np.concatenate(values))
            yield pd.DataFrame({"i": (some // (3 * size)).astype(np.int32), "j": (some % (3 * size)).astype(np.int32), "a": total, "b": None})
            rhs = np.zeros(3 * size)
            for near, v in right:
                rhs[near] += v
            i = np.flatnonzero(rhs)
            yield pd.DataFrame({"i": i.astype(np.int32), "j": np.full(len(i), -1, np.int32), "a": None, "b": rhs[i]})

    sums = matches.select("x", "y", "z", "qx", "qy", "qz", "nx", "ny", "nz").mapInPandas(run, schema).groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    plane = sums[sums.j >= 0]
    i, j, a = plane.i.to_numpy(), plane.j.to_numpy(), plane.a.to_numpy(float)
    rhs = np.zeros(3 * size)
    some = sums[sums.j < 0]
    rhs[some.i.to_numpy()] = some.b.to_numpy(float)
    scale = max(a[i == j].sum() / max(3 * size, 1), 1e-12) * stiffness if len(a) else stiffness

    def apply(v: np.ndarray) -> np.ndarray:
        out = np.bincount(i, a * v[j], 3 * size) if len(a) else np.zeros(3 * size)
        off = i != j
        out = out + (np.bincount(j[off], a[off] * v[i[off]], 3 * size) if off.any() else 0)
        grid = v.reshape(*warp.counts, 3)
        return out + scale * _laplacian(warp.counts, grid).ravel() + 1e-6 * scale * v

    x, r = np.zeros(3 * size), rhs.copy()
    d, rr = r.copy(), float(r @ r)
    for _ in range(rounds * 10):
        if rr <= 1e-18 * max(float(rhs @ rhs), 1e-300):
            break
        ad = apply(d)
        step = rr / float(d @ ad)
        x, r = x + step * d, r - step * ad
        fresh = float(r @ r)
        d, rr = r + fresh / rr * d, fresh
    return Warp(warp.low, warp.spacing, warp.counts, x.reshape(*warp.counts, 3))


def warped(points: DataFrame, warp: Warp) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(warp)

    def run(batches):
        for pdf in batches:
            pdf[["x", "y", "z"]] = sent.value(pdf[["x", "y", "z"]].to_numpy(float))
            yield pdf

    return points.mapInPandas(run, points.schema)


def register(points: DataFrame, mesh, spans: int = 8, stiffness: float = 0.1, rounds: int = 3) -> Warp:
    """The warp that brings points onto a mesh: closest places are found on the executors, the controls fitted to their
    planes, a few times."""
    from brickwise.operators.compare import mesh_distance

    ends = points.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first()
    warp = Warp.over(np.array([ends[f"lo{c}"] for c in "xyz"]), np.array([ends[f"hi{c}"] for c in "xyz"]), spans)
    for _ in range(rounds):
        moved = warped(points.select("x", "y", "z"), warp)
        hit = mesh_distance(moved, mesh)
        q = [(F.col(c) - F.col("distance") * F.col(f"n{c}")).alias(f"q{c}") for c in "xyz"]
        step = fit_warp(hit.select("x", "y", "z", *q, "nx", "ny", "nz"), Warp(warp.low, warp.spacing, warp.counts), stiffness)
        warp = Warp(warp.low, warp.spacing, warp.counts, warp.controls + step.controls)
    return warp


def direction_families(blocks: DataFrame, families: int, rounds: int = 50) -> DataFrame:
    """blocks (bx, by, bz, n, direction, ...) with family, 0 for the largest share. Axial means: a centre is the main axis
    of its members' weighted tensor, the first that of all, each next the direction least like those before. The blocks
    are summed on the executors; centres, a few numbers, are what the driver holds."""
    p = [F.get("direction", F.lit(k)) for k in range(3)]

    def tensors(df: DataFrame, by: list[str]) -> list:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p[a] * p[b]).alias(f"t{a}{b}") for a in range(3) for b in range(a, 3)]).collect()

    def axis(r) -> np.ndarray:
        t = np.array([[r[f"t{min(a, b)}{max(a, b)}"] for b in range(3)] for a in range(3)])
        return np.linalg.eigh(t)[1][:, -1]

    def cosine(c: np.ndarray):
        return F.abs(p[0] * float(c[0]) + p[1] * float(c[1]) + p[2] * float(c[2]))

    whole = tensors(blocks, [])
    if not whole or whole[0]["n"] is None:
        return blocks.withColumn("family", F.lit(0))
    centres = [axis(whole[0])]
    while len(centres) < families:
        near = F.greatest(*[cosine(c) for c in centres]) if len(centres) > 1 else cosine(centres[0])
        far = blocks.agg(F.min_by("direction", F.struct(near, "bx", "by", "bz")).alias("d")).first()["d"]
        centres.append(np.array(far))

    def assigned(df: DataFrame) -> DataFrame:
        best = F.array_max(F.array(*[F.struct(cosine(c).alias("c"), F.lit(-k).alias("k")) for k, c in enumerate(centres)]))
        return df.withColumn("family", -best["k"])

    before = None
    for _ in range(rounds):
        rows = tensors(assigned(blocks), ["family"])
        for r in rows:
            centres[r["family"]] = axis(r)
        now = [c.round(12).tolist() for c in centres]
        if now == before:
            break
        before = now
    share = {r["family"]: r["n"] for r in tensors(assigned(blocks), ["family"])}
    order = sorted(range(len(centres)), key=lambda k: (-share.get(k, 0), k))
    centres = [centres[k] for k in order]
    return assigned(blocks)


#: The magic and version of a stored model.
MAGIC, VERSION = b"BWMODEL\0", 1


def write_model(layers: list[dict]) -> bytes:
    """A model file: magic, version, a JSON header of the layers, and their float32 weights one behind the other."""
    arrays, head = [], []
    for layer in layers:
        shapes = {}
        for name, value in layer.items():
            if isinstance(value, np.ndarray):
                shapes[name] = list(value.shape)
                arrays.append(value.astype("<f4").ravel())
        head.append({k: v for k, v in layer.items() if not isinstance(v, np.ndarray)} | {"arrays": shapes})
    text = json.dumps(head).encode()
    return MAGIC + struct.pack("<II", VERSION, len(text)) + text + (np.concatenate(arrays).tobytes() if arrays else b"")


def read_model(data: bytes) -> list[dict]:
    if data[:8] != MAGIC:
        raise ValueError("not a model file")
    version, length = struct.unpack("<II", data[8:16])
    if version != VERSION:
        raise ValueError(f"model version {version} is unknown")
    head, at, out = json.loads(data[16 : 16 + length]), 16 + length, []
    for layer in head:
        shapes = layer.pop("arrays")
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            if at + 4 * n > len(data):
                raise ValueError("the model file is cut off")
            layer[name] = np.frombuffer(data, "<f4", n, at).reshape(shape)
            at += 4 * n
        out.append(layer)
    return out


def _conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """x (channels, x, y, z) with weight (out, in, k, k, k), the border repeated."""
    k = weight.shape[2] // 2
    wide = np.pad(x, ((0, 0), (k, k), (k, k), (k, k)), mode="edge")
    out = np.zeros((weight.shape[0], *x.shape[1:]), dtype=np.float32) + bias[:, None, None, None]
    for i in range(weight.shape[2]):
        for j in range(weight.shape[3]):
            for m in range(weight.shape[4]):
                part = wide[:, i : i + x.shape[1], j : j + x.shape[2], m : m + x.shape[3]]
                out += np.tensordot(weight[:, :, i, j, m], part, 1)
    return out


def infer(layers: list[dict], x: np.ndarray) -> np.ndarray:
    """The output of a model on (channels, x, y, z): conv (with relu), maxpool and upsample by two, and concat with the
    output of an earlier layer. Sides are multiples of two to the number of pools."""
    kept = []
    for layer in layers:
        kind = layer["type"]
        if kind == "conv":
            x = _conv(x, layer["weight"], layer["bias"])
            x = np.maximum(x, 0) if layer.get("relu") else x
        elif kind == "maxpool":
            c, a, b, d = x.shape
            x = x.reshape(c, a // 2, 2, b // 2, 2, d // 2, 2).max((2, 4, 6))
        elif kind == "upsample":
            x = x.repeat(2, 1).repeat(2, 2).repeat(2, 3)
        elif kind == "concat":
            x = np.concatenate([x, kept[layer["with"]]])
        else:
            raise ValueError(f"unknown layer {kind!r}")
        kept.append(x)
    return x


def apply_model(voxels: DataFrame, layers: list[dict], offset: float = 0.0, scale: float = 1.0, classify: bool = True, brick: int = 32, halo: int = 8, fill: float = 0.0) -> DataFrame:
    """(x, y, z, material) of the class with the largest output, or (x, y, z, value) of a denoising model, for the active
    voxels: bricks with a halo are tiles, the weights are broadcast. brick + 2 halo is a multiple of two to the number of
    pools."""
    pools = sum(layer["type"] == "maxpool" for layer in layers)
    n = brick + 2 * halo
    if n % 2**pools:
        raise ValueError(f"tiles of {n} voxels don't fit {pools} pools")
    sent = voxels.sparkSession.sparkContext.broadcast(layers)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = [k * brick - halo for k in key]
        grey = np.full((n, n, n), fill, dtype=np.float32)
        at = tuple(pdf[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))
        grey[at] = pdf["grey"]
        out = infer(sent.value, ((grey - offset) / scale)[None].astype(np.float32))
        inner = np.ones(len(pdf), dtype=bool)
        for a in at:
            inner &= (a >= halo) & (a < brick + halo)
        here = tuple(a[inner] for a in at)
        rows = pdf[inner][["x", "y", "z"]]
        if classify:
            return rows.assign(material=out.argmax(0)[here].astype(np.int32))
        return rows.assign(value=out[0][here].astype(float) * scale + offset)

    kind = "material int" if classify else "value double"
    return with_halo(voxels.select("x", "y", "z", "grey"), brick, halo).groupBy("tx", "ty", "tz").applyInPandas(run, f"x int, y int, z int, {kind}")
