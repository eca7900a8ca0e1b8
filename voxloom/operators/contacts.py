"""Contacts between segments on blocks: kernels with a halo that emit partial rows.

Labels: 0 is background, OUTSIDE marks voxels that are not part of the volume. A
contact is a pair of labels packed in one whole number, the smaller id above;
ids are below 2**31.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks as B
from voxloom.operators import voxels as V

OUTSIDE = -1
#: Stencil entries that are held at a time.
HELD = 1 << 21


def boundary(a: np.ndarray) -> np.ndarray:
    """Voxels of an object beside another label, background too; what lies outside does not count."""
    edge = np.zeros(a.shape, bool)
    for axis in range(3):
        one, two = np.moveaxis(a, axis, 0)[:-1], np.moveaxis(a, axis, 0)[1:]
        differs = (one != two) & (one != OUTSIDE) & (two != OUTSIDE)
        view = np.moveaxis(edge, axis, 0)
        view[:-1] |= differs
        view[1:] |= differs
    return edge & (a > 0)


def most_frequent(rows: np.ndarray) -> np.ndarray:
    """The most frequent entry above 0 of each row, ties to the smallest; 0 where there is none."""
    rows = np.sort(rows, axis=1)
    n, k = rows.shape
    starts = np.ones((n, k), bool)
    starts[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at = np.nonzero(starts.ravel())[0]
    count, value, row = np.diff(np.append(at, n * k)), rows.ravel()[at], at // k
    real = value > 0
    count, value, row = count[real], value[real], row[real]
    order = np.lexsort((value, -count, row))
    row, first = np.unique(row[order], return_index=True)
    out = np.zeros(n, rows.dtype)
    out[row] = value[order][first]
    return out


def contact_labels(a: np.ndarray, stencil: tuple[int, int, int]) -> np.ndarray:
    """At boundary voxels the most frequent other label of the stencil round them, packed with their own; else 0."""
    reach = [s // 2 for s in stencil]
    padded = np.pad(a, [(r, r) for r in reach], constant_values=OUTSIDE)
    at = np.argwhere(boundary(a))
    out = np.zeros(a.shape, "<i8")
    flat, strides = padded.ravel(), [padded.shape[1] * padded.shape[2], padded.shape[2], 1]
    offsets = np.array([sum(d * s for d, s in zip(o, strides)) for o in V.stencil(*stencil)])
    centre = (at + reach) @ np.array(strides)
    step = max(1, HELD // max(1, len(offsets)))
    for s in range(0, len(at), step):
        own = flat[centre[s : s + step]]
        near = flat[centre[s : s + step, None] + offsets]
        near[near == own[:, None]] = 0
        other = most_frequent(near)
        pair = np.minimum(own, other) << 32 | np.maximum(own, other)
        out[tuple(at[s : s + step].T)] = np.where(other > 0, pair, 0)
    return out


def label_boxes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels above 0 in ascending order with the corners of their boxes (half-open)."""
    at = np.argwhere(a > 0)
    value = a[tuple(at.T)]
    order = np.argsort(value, kind="stable")
    names, first = np.unique(value[order], return_index=True)
    if not len(names):
        return names, np.empty((0, 3), int), np.empty((0, 3), int)
    return names, np.minimum.reduceat(at[order], first), np.maximum.reduceat(at[order], first) + 1


def fill_contacts(a: np.ndarray, closing: int, dilation: int) -> np.ndarray:
    """Each label, in ascending order, is closed and then dilated into background only; each within its own box."""
    out = a.copy()
    grow = closing + dilation
    for label, low, high in zip(*label_boxes(a)):
        # one layer more than the label can reach, so that no face of the crop is eroded
        pad = [(max(0, grow + 1 - lo), max(0, hi + grow + 1 - n)) for lo, hi, n in zip(low, high, a.shape)]
        crop = tuple(slice(max(0, lo - grow - 1), hi + grow + 1) for lo, hi in zip(low, high))
        own = np.pad(a[crop] == label, pad)
        grown = B.dilate(B.erode(B.dilate(own, closing), closing), dilation)
        grown = grown[tuple(slice(p, n - q) for (p, q), n in zip(pad, grown.shape))]
        view = out[crop]
        view[grown & (view == 0)] = label
    return out


def _xyz(at: np.ndarray, low: tuple[int, int, int]) -> dict[str, np.ndarray]:
    return {c: at[:, i] + o for i, (c, o) in enumerate(zip("xyz", low))}


def boundary_voxels(blocks: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """V14 on blocks: ``(x, y, z, label)``."""

    def fn(a: np.ndarray, low, own) -> pd.DataFrame:
        at = np.argwhere(boundary(a)[1:-1, 1:-1, 1:-1])
        return pd.DataFrame({**_xyz(at, low), "label": a[tuple((at + 1).T)]})

    return B.block_rows(blocks, fn, 1, size, "x long, y long, z long, label long", fill=OUTSIDE)


def _halo(stencil: tuple[int, int, int]) -> int:
    return max(1, *[s // 2 for s in stencil])


def contact_voxels(blocks: DataFrame, size: tuple[int, int, int], stencil: tuple[int, int, int] = (3, 3, 3)) -> DataFrame:
    """V15, V16 on blocks: ``(x, y, z, id_lo, id_hi)``."""
    h = _halo(stencil)

    def fn(a: np.ndarray, low, own) -> pd.DataFrame:
        made = contact_labels(a, stencil)[h:-h, h:-h, h:-h]
        at = np.argwhere(made)
        pair = made[tuple(at.T)]
        return pd.DataFrame({**_xyz(at, low), "id_lo": pair >> 32, "id_hi": pair & 0xFFFFFFFF})

    return B.block_rows(blocks, fn, h, size, "x long, y long, z long, id_lo long, id_hi long", fill=OUTSIDE)


def contact_sizes(blocks: DataFrame, size: tuple[int, int, int], stencil: tuple[int, int, int] = (3, 3, 3)) -> DataFrame:
    """``(id_lo, id_hi, n)``: voxels of every contact; a block sends one row a pair."""
    h = _halo(stencil)

    def fn(a: np.ndarray, low, own) -> pd.DataFrame:
        made = contact_labels(a, stencil)[h:-h, h:-h, h:-h]
        pair, n = np.unique(made[made > 0], return_counts=True)
        return pd.DataFrame({"id_lo": pair >> 32, "id_hi": pair & 0xFFFFFFFF, "n": n})

    rows = B.block_rows(blocks, fn, h, size, "id_lo long, id_hi long, n long", fill=OUTSIDE)
    return rows.groupBy("id_lo", "id_hi").agg(F.sum("n").alias("n"))


def filled_sizes(blocks: DataFrame, size: tuple[int, int, int], stencil: tuple[int, int, int] = (3, 3, 3), closing: int = 1, dilation: int = 1) -> DataFrame:
    """``(id_lo, id_hi, n)`` of the contacts closed and grown into all that is no contact; a block sends one row a pair."""
    h = _halo(stencil) + 2 * closing + dilation

    def fn(a: np.ndarray, low, own) -> pd.DataFrame:
        made = fill_contacts(contact_labels(a, stencil), closing, dilation)[h:-h, h:-h, h:-h]
        pair, n = np.unique(made[made > 0], return_counts=True)
        return pd.DataFrame({"id_lo": pair >> 32, "id_hi": pair & 0xFFFFFFFF, "n": n})

    rows = B.block_rows(blocks, fn, h, size, "id_lo long, id_hi long, n long", fill=OUTSIDE)
    return rows.groupBy("id_lo", "id_hi").agg(F.sum("n").alias("n"))


PARTS = ["cs_size", "syn_size", "n_sym", "n_asym"]
CORNERS = [f"{k}_{e}_{c}" for k in ("cs", "syn") for e in ("min", "max") for c in "xyz"]


def contact_sites(
    blocks: DataFrame, masks: list[str], size: tuple[int, int, int], stencil: tuple[int, int, int] = (3, 3, 3), closing: int = 0, dilation: int = 0, least: int = 1
) -> DataFrame:
    """Contacts and the synapse fragments in them, in one pass over blocks.

    ``blocks`` has the labels in ``data`` and three more binary columns, ``masks``: junctions, symmetric and
    asymmetric type, one byte a voxel. Every block labels its contacts (V15), closes and grows them
    (V17), measures them against the masks (V18) and sends one row a pair; these are merged
    (V5) and small contacts go (V12). Synapse corners are null without a junction voxel. No voxel leaves its block but for
    the halo; voxels outside the volume belong to no contact.
    """
    h = _halo(stencil) + 2 * closing + dilation

    def fn(a: np.ndarray, low, own) -> pd.DataFrame:
        made = fill_contacts(contact_labels(a, stencil), closing, dilation)
        inner = tuple(slice(h, n - h) for n in a.shape)
        made = np.where(a[inner] == OUTSIDE, 0, made[inner])
        on, sym, asym = (np.frombuffer(getattr(own, m), np.uint8).reshape(made.shape) > 0 for m in masks)
        at = np.argwhere(made)
        pair, back = np.unique(made[tuple(at.T)], return_inverse=True)
        syn = on[tuple(at.T)]
        count = lambda m: np.bincount(back[m], minlength=len(pair))
        out = {"id_lo": pair >> 32, "id_hi": pair & 0xFFFFFFFF, "cs_size": np.bincount(back, minlength=len(pair)), "syn_size": count(syn)}
        out |= {"n_sym": count(syn & sym[tuple(at.T)]), "n_asym": count(syn & asym[tuple(at.T)])}
        for kind, some in (("cs", np.ones(len(at), bool)), ("syn", syn)):
            for c, i, o in zip("xyz", range(3), low):
                least_at, most_at = np.full(len(pair), np.iinfo("i8").max), np.full(len(pair), -1)
                np.minimum.at(least_at, back[some], at[some, i] + o), np.maximum.at(most_at, back[some], at[some, i] + o + 1)
                out |= {f"{kind}_min_{c}": least_at, f"{kind}_max_{c}": most_at}
        return pd.DataFrame(out)[["id_lo", "id_hi", *PARTS, *CORNERS]]

    rows = B.block_rows(blocks, fn, h, size, ", ".join(f"{c} long" for c in ["id_lo", "id_hi", *PARTS, *CORNERS]), fill=OUTSIDE)
    box = lambda c: F.max(c) if "_max_" in c else F.min(c)
    merged = rows.groupBy("id_lo", "id_hi").agg(*[F.sum(c).alias(c) for c in PARTS], *[box(c).alias(c) for c in CORNERS]).where(F.col("cs_size") >= least)
    known = lambda c: F.when(F.col("syn_size") > 0, F.col(c)).alias(c) if c.startswith("syn") else F.col(c)
    return merged.select("id_lo", "id_hi", *PARTS, *map(known, CORNERS))
