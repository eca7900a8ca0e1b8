"""Voxel operators on blocks: the form for large volumes.

A block is one row ``(bx, by, bz, nx, ny, nz, data)`` with its voxels as bytes of
little-endian int64 in x, y, z order; all blocks but the last of an axis have the
same edges, and block (bx, by, bz) begins at voxel (bx * size_x, ...). Kernels run
on one block at a time, with a halo that neighbours send as cropped slabs: a
block's rows meet on the receiving block, at most 27 of them where the halo is no
wider than a block.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import voxels as V

KEY = ["bx", "by", "bz"]
SCHEMA = "bx long, by long, bz long, nx int, ny int, nz int, data binary"
AXES = "xyz"
#: Blocks whose slabs a task holds at a time, however many rows come to it at once.
AT_ONCE = 64


def to_blocks(voxels: DataFrame, label: str, size: tuple[int, int, int], shape: tuple[int, int, int], missing: int = 0, flags: list[str] | None = None) -> DataFrame:
    """All dense blocks of a volume of ``shape`` from a voxel table; voxels that are missing are ``missing``, so are whole blocks.

    ``flags`` are more columns of 0 and 1, each a binary column of one byte a voxel.
    """
    flags = flags or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = [int(pdf[k].iloc[0]) for k in KEY]
        n = [min(s, m - s * i) for s, m, i in zip(size, shape, b)]
        a = np.full(n, np.iinfo("<i8").min, "<i8")
        real = pdf[pdf["real"]]
        at = tuple((real[c] - s * i).to_numpy(int) for c, s, i in zip(AXES, size, b))
        np.maximum.at(a, at, real["label"].to_numpy("<i8"))
        a[a == np.iinfo("<i8").min] = missing
        more = []
        for f in flags:
            m = np.zeros(n, np.uint8)
            m[at] = real[f].to_numpy(np.uint8)
            more.append(m.tobytes())
        return pd.DataFrame([(*b, *n, a.tobytes(), *more)], columns=[*KEY, "nx", "ny", "nz", "data", *flags])

    spans = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-m // s) - 1).cast("long"))).alias(k) for m, s, k in zip(shape, size, KEY)]
    grid = voxels.sparkSession.range(1).select(spans[0]).select("*", spans[1]).select("*", spans[2])
    inside = voxels
    for c, m in zip(AXES, shape):
        inside = inside.where((F.col(c) >= 0) & (F.col(c) < m))
    more = [F.col(f).cast("int").alias(f) for f in flags]
    keyed = inside.select(*[F.floor(F.col(c) / s).cast("long").alias(k) for c, s, k in zip(AXES, size, KEY)], *[F.col(c).cast("long").alias(c) for c in AXES], F.col(label).cast("long").alias("label"), *more, F.lit(True).alias("real"))
    corner = grid.select(*KEY, *[(F.col(k) * s).alias(c) for c, s, k in zip(AXES, size, KEY)], F.lit(0).cast("long").alias("label"), *[F.lit(0).alias(f) for f in flags], F.lit(False).alias("real"))
    keyed = keyed.unionByName(corner)
    return keyed.groupBy(*KEY).applyInPandas(run, SCHEMA + "".join(f", {f} binary" for f in flags))


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, "<i8").reshape(row.nx, row.ny, row.nz)


def _slabs_of(frame: pd.DataFrame, halo: int, size: tuple[int, int, int], reach: list[int], extra: list[str]) -> list[tuple]:
    """What the blocks of a frame send to the blocks round them, a row each: whose it is, its place and its voxels."""
    rows = []
    for r in frame.itertuples():
        a = array_of(r)
        for d in itertools.product(*(range(-r, r + 1) for r in reach)):
            # what the block at offset d from this one needs of it
            cutout = tuple(slice(max(0, k * m - halo), min(n, k * m + m + halo)) for k, m, n in zip(d, size, a.shape))
            part = a[cutout] if all(c.start < c.stop for c in cutout) else a[:0]
            if part.size:
                own = d == (0, 0, 0)
                at = [s * b + c.start for s, b, c in zip(size, (r.bx, r.by, r.bz), cutout)]
                rows.append((r.bx + d[0], r.by + d[1], r.bz + d[2], own, *at, *part.shape, part.tobytes(), *[getattr(r, e) if own else None for e in extra]))
    return rows


def with_halo(blocks: DataFrame, halo: int, size: tuple[int, int, int], schema: str, fn: Callable, fill: int = 0) -> DataFrame:
    """Rows that ``fn(array, own)`` makes of each block, ``halo`` voxels of its neighbours round it (``fill`` where there are none).

    Neighbours send cropped slabs. ``own`` is the block's row; columns beyond the block's own go
    along with it, not with the slabs.
    """
    reach = [-(-halo // s) for s in size]
    extra = [f for f in blocks.schema if f.name not in (*KEY, "nx", "ny", "nz", "data")]
    named = [*KEY, "own", "x0", "y0", "z0", "nx", "ny", "nz", "data", *[f.name for f in extra]]

    def slabs(frames):
        for f in frames:
            for a in range(0, len(f), AT_ONCE):
                yield pd.DataFrame(_slabs_of(f.iloc[a : a + AT_ONCE], halo, size, reach, [e.name for e in extra]), columns=named)

    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]
        if not len(own):
            return pd.DataFrame({c: [] for c in columns})
        o = next(own.itertuples())
        a = np.full([k + 2 * halo for k in (o.nx, o.ny, o.nz)], fill, "<i8")
        for r in pdf.itertuples():
            at = [p - q + halo for p, q in zip((r.x0, r.y0, r.z0), (o.x0, o.y0, o.z0))]
            a[tuple(slice(p, p + k) for p, k in zip(at, (r.nx, r.ny, r.nz)))] = array_of(r)
        return fn(a, o)

    if halo == 0:  # nothing to send
        alone = lambda frames: (fn(array_of(r), r) for f in frames for r in f.itertuples())
        return blocks.mapInPandas(alone, schema)
    more = "".join(f", {e.name} {e.dataType.simpleString()}" for e in extra)
    sent = blocks.select(*KEY, "nx", "ny", "nz", "data", *[e.name for e in extra]).mapInPandas(slabs, "bx long, by long, bz long, own boolean, x0 long, y0 long, z0 long, nx int, ny int, nz int, data binary" + more)
    return sent.groupBy(*KEY).applyInPandas(run, schema)


def block_rows(blocks: DataFrame, fn: Callable, halo: int, size: tuple[int, int, int], schema: str, fill: int = 0) -> DataFrame:
    """Rows of ``fn(array, low, own)`` over each block with a halo; ``low`` is the block's first voxel in the volume, ``own`` its row."""

    def run(a: np.ndarray, own) -> pd.DataFrame:
        return fn(a, tuple(s * b for s, b in zip(size, (own.bx, own.by, own.bz))), own)

    return with_halo(blocks, halo, size, schema, run, fill)


def map_blocks(blocks: DataFrame, fn: Callable[..., np.ndarray], halo: int, size: tuple[int, int, int], keep: tuple[int, int] | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``fn`` over each block with ``halo`` voxels of its neighbours round it (0 where there are none).

    ``fn`` gets and gives an array of the same shape; the block keeps the inner
    part, or with ``keep = (before, after)`` that much of the halo too. With
    ``shape``, the volume's, it also gets which voxels lie inside the volume.
    """
    before, after = keep or (0, 0)

    def run(a: np.ndarray, o) -> pd.DataFrame:
        if shape is None:
            out = np.asarray(fn(a))
        else:
            ranges = [np.arange(k) + s * b - halo for k, s, b in zip(a.shape, size, (o.bx, o.by, o.bz))]
            gx, gy, gz = ((r >= 0) & (r < m) for r, m in zip(ranges, shape))
            out = np.asarray(fn(a, gx[:, None, None] & gy[None, :, None] & gz[None, None, :]))
        inner = out[tuple(slice(halo - before, halo + k + after) for k in (o.nx, o.ny, o.nz))].astype("<i8")
        return pd.DataFrame([(o.bx, o.by, o.bz, *inner.shape, inner.tobytes())], columns=[*KEY, "nx", "ny", "nz", "data"])

    return with_halo(blocks.select(*KEY, "nx", "ny", "nz", "data"), halo, size, SCHEMA, run)


def to_voxels(blocks: DataFrame, size: tuple[int, int, int], name: str = "label", offset: int = 0) -> DataFrame:
    """``(bx, by, bz, x, y, z, label)`` of the voxels that are not 0; ``offset`` is the halo that the blocks keep before them."""

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                a = array_of(r)
                at = np.nonzero(a)
                yield pd.DataFrame(
                    {"bx": r.bx, "by": r.by, "bz": r.bz, **{c: p + s * b - offset for c, p, s, b in zip(AXES, at, size, (r.bx, r.by, r.bz))}, name: a[at]}
                )

    return blocks.mapInPandas(run, f"bx long, by long, bz long, x long, y long, z long, {name} long")


def shifted(a: np.ndarray, d: tuple[int, int, int]) -> np.ndarray:
    """The array moved by ``d``; what comes in is 0."""
    out = np.zeros_like(a)
    dst = tuple(slice(max(0, k), n + min(0, k)) for k, n in zip(d, a.shape))
    src = tuple(slice(max(0, -k), n + min(0, -k)) for k, n in zip(d, a.shape))
    out[dst] = a[src]
    return out


def dilate(a: np.ndarray, times: int = 1, kernel=V.SIX) -> np.ndarray:
    a = a.astype(bool)
    for _ in range(times):
        a = np.logical_or.reduce([a, *[shifted(a, d) for d in kernel]])
    return a


def erode(a: np.ndarray, times: int = 1, kernel=V.SIX) -> np.ndarray:
    a = a.astype(bool)
    for _ in range(times):
        a = np.logical_and.reduce([a, *[shifted(a, d) for d in kernel]])
    return a


OPERATIONS = {"dilation": (dilate,), "erosion": (erode,), "opening": (erode, dilate), "closing": (dilate, erode)}


def morphology(blocks: DataFrame, chain: list[tuple[str, int]], size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """A chain of binary operations, repeats merged; the halo is as wide as the chain reaches. Outside the volume is 0."""
    steps = [(f, n) for name, n in chain for f in OPERATIONS[name]]
    halo = sum(n for _, n in steps)

    def fn(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        a = a != 0
        for f, n in steps:
            for _ in range(n):
                a = f(a) & inside
        return a.astype("<i8")

    return map_blocks(blocks, fn, halo, size, shape=shape)


def label_components(mask: np.ndarray) -> np.ndarray:
    """Six-connected components, numbered from 1 in scan order."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = label.copy()
        for d in V.SIX:
            s = shifted(label, d)
            low = np.where(mask & (s > 0), np.minimum(low, s), low)
        if (low == label).all():
            break
        label = low
    ids = np.unique(label[label > 0])
    return np.where(label > 0, np.searchsorted(ids, label) + 1, 0)


def _mirrored(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The array with what lies outside the volume replaced by the volume mirrored at its faces."""
    for axis in range(3):
        on = np.nonzero(inside.any(axis=tuple(k for k in range(3) if k != axis)))[0]
        lo, hi = int(on[0]), int(on[-1]) + 1
        at = np.arange(a.shape[axis])
        while ((at < lo) | (at >= hi)).any():
            at = np.where(at < lo, 2 * lo - 1 - at, np.where(at >= hi, 2 * hi - 1 - at, at))
        a = np.take(a, at, axis=axis)
    return a


def gaussian(blocks: DataFrame, sigma: tuple[float, float, float], size: tuple[int, int, int], shape: tuple[int, int, int], truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of whole numbers (a probability map in fixed point), rounded once at the end.

    Separable, cut off at ``truncate`` sigmas; the volume is mirrored at its faces.
    A block needs as much of its neighbours as the widest kernel reaches.
    """
    reach = [int(truncate * s + 0.5) for s in sigma]

    def fn(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = _mirrored(a, inside).astype(float)
        for axis, (s, r) in enumerate(zip(sigma, reach)):
            if r:
                k = np.arange(-r, r + 1)
                w = np.exp(-0.5 * (k / s) ** 2)
                padded = np.pad(out, [(r, r) if j == axis else (0, 0) for j in range(3)])
                out = sum(v * np.take(padded, np.arange(out.shape[axis]) + r + d, axis=axis) for d, v in zip(k, w / w.sum()))
        return np.rint(out)

    return map_blocks(blocks, fn, max(reach), size, shape=shape)


def squared_distances(on: np.ndarray, background: np.ndarray, scale: tuple[int, int, int], most: int) -> np.ndarray:
    """Squared distance of each voxel that is ``on`` to the nearest of the background, ``most`` squared where none is nearer; 0 elsewhere."""
    d = np.where(background, 0, most * most).astype("<i8")
    for axis, s in enumerate(scale):
        best = d.copy()
        for k in range(1, min(-(-most // s), d.shape[axis] - 1) + 1):
            for there in (-k, k):
                best = np.minimum(best, _moved(d, axis, there, most * most) + (k * s) ** 2)
        d = best
    return np.where(on, np.minimum(d, most * most), 0)


def _moved(a: np.ndarray, axis: int, by: int, fill: int) -> np.ndarray:
    out = np.full_like(a, fill)
    n = a.shape[axis]
    dst, src = [slice(None)] * 3, [slice(None)] * 3
    dst[axis], src[axis] = slice(max(0, by), n + min(0, by)), slice(max(0, -by), n + min(0, -by))
    out[tuple(dst)] = a[tuple(src)]
    return out


def distance_transform(blocks: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int], most: int, scale: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Exact squared distance of the voxels that are not 0 to the nearest 0 of the volume, in whole units of ``scale``, up to ``most``.

    What lies outside the volume is no background.
    """

    def fn(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return squared_distances(a != 0, (a == 0) & inside, scale, most)

    return map_blocks(blocks, fn, max(-(-most // s) for s in scale), size, shape=shape)


def fused_partials(cells: DataFrame, organelles: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """V4, block form: partial rows ``(kind, id, id2, size, box, first voxel)`` of each block, merged by one aggregation.

    ``organelles`` has the same blocks of one organelle label.
    """
    both = cells.join(organelles.select(*KEY, F.col("data").alias("sub")), KEY)

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                shape, base = (r.nx, r.ny, r.nz), [s * b for s, b in zip(size, (r.bx, r.by, r.bz))]
                cell, sub = np.frombuffer(r.data, "<i8"), np.frombuffer(r.sub, "<i8")
                place = np.stack(np.unravel_index(np.arange(cell.size), shape), 1) + base
                for kind, ids, second in (("cell", cell, None), ("sub", sub, None), ("sub:overlap", sub, cell)):
                    on = ids != 0 if second is None else (ids != 0) & (second != 0)
                    if not on.any():
                        continue
                    key = np.stack([ids[on], np.zeros(on.sum(), "<i8") if second is None else second[on]], 1)
                    names, first, back = np.unique(key, axis=0, return_index=True, return_inverse=True)
                    at, back = place[on], back.ravel()
                    low, high = np.full((len(names), 3), np.iinfo("i8").max), np.full((len(names), 3), -1)
                    np.minimum.at(low, back, at), np.maximum.at(high, back, at + 1)
                    out = {"kind": kind, "id": names[:, 0], "id2": names[:, 1], "size": np.bincount(back, minlength=len(names))}
                    for i, c in enumerate(AXES):
                        out |= {f"min_{c}": low[:, i], f"max_{c}": high[:, i], f"rep_{c}": at[first, i]}
                    yield pd.DataFrame(out)

    cols = ", ".join(f"{e}_{c} long" for e in ("min", "max", "rep") for c in AXES)
    names = ["kind", "id", "id2", "size", *[f"{e}_{c}" for e in ("min", "max", "rep") for c in AXES]]
    parts = both.mapInPandas(lambda frames: (f[names] for f in run(frames)), f"kind string, id long, id2 long, size long, {cols}")
    return V.merge_partials(parts, "kind", "id", "id2")
