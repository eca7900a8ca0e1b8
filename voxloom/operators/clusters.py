"""Components of places that lie near each other, block by block.

Space is cut into blocks; a block takes the places beyond its upper faces that its own
may reach, finds the components of what it holds, and says which places it shares. Pairs of
places are never rows: what is shuffled is each place once or a few times, and each place
that several blocks hold once more, with its part in each of them. Parts, not places, are then joined over the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from voxloom.operators.components import graph_components, least_members
from voxloom.session import cut

XYZ = ("x", "y", "z")
#: Width of a block in reaches of a place.
WIDTH = 9
#: Distances that a task holds at a time.
PAIRS = 2_000_000
REACH = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0)]


def _joined(part: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return least_members(len(part), part[u], part[v])[part]


def join_near(part: np.ndarray, at: np.ndarray, group: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """``part`` (the least member that each place is joined to) with places of one group joined that are within ``gap``.

    Places fall into cells whose diagonal is the gap, so that all in a cell are joined. Two cells are joined by their
    corners or their first places if these tell; only of cells that are not yet joined all places are compared.
    """
    near = (lambda d2: np.sqrt(d2) < gap) if strict else (lambda d2: np.sqrt(d2) <= gap)
    cell = np.floor(at / (gap / 3**0.5 * (1 - 1e-9))).astype(np.int64)
    cell -= cell.min(0) - 2
    span = cell.max(0) + 3
    code = ((group * span[0] + cell[:, 0]) * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(code, kind="stable")
    codes, first, count = np.unique(code[order], return_index=True, return_counts=True)
    head, place = order[first], at[order]
    low, high = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
    part = _joined(part, order, np.repeat(head, count))

    found = []
    for o in REACH:
        other = codes + (o[0] * span[1] + o[1]) * span[2] + o[2]
        where = np.minimum(np.searchsorted(codes, other), len(codes) - 1)
        hit = np.flatnonzero(codes[where] == other)
        found.append((hit, where[hit]))
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    apart = (np.maximum(np.maximum(low[b] - high[a], low[a] - high[b]), 0.0) ** 2).sum(1)
    a, b = a[near(apart)], b[near(apart)]
    across = (np.maximum(high[b] - low[a], high[a] - low[b]) ** 2).sum(1)
    sure = near(across) | near(((at[head[a]] - at[head[b]]) ** 2).sum(1))
    part = _joined(part, head[a[sure]], head[b[sure]])

    a, b = a[~sure], b[~sure]
    while True:
        still = part[head[a]] != part[head[b]]
        a, b = a[still], b[still]
        if not len(a):
            return part
        # the cheapest pairs of cells first, as many as fit; of a pair that does not fit alone, a part of its rows at a time
        by = np.argsort(count[a] * count[b], kind="stable")
        a, b = a[by], b[by]
        m = max(1, int(np.searchsorted(np.cumsum(count[a] * count[b]), PAIRS, side="right")))
        rows = np.repeat(np.arange(m), count[a[:m]])
        p = _runs(first[a[:m]], count[a[:m]])
        step = max(1, PAIRS // int(count[b[:m]].max())) if m == 1 else len(rows)
        for k in range(0, len(rows), step):
            r, q = rows[k : k + step], p[k : k + step]
            n = count[b[r]]
            close = near(((place[np.repeat(q, n)] - place[_runs(first[b[r]], n)]) ** 2).sum(1))
            which = np.unique(np.repeat(r, n)[close])
            if len(which):
                part = _joined(part, head[a[which]], head[b[which]])
                if m == 1:
                    break
        a, b = a[m:], b[m:]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start``, ``start + 1`` and so on, ``length`` numbers for each start."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def clusters(points: DataFrame, gap: float, key: list[str], scale=(1.0, 1.0, 1.0), strict: bool = True, within: tuple[list[str], float] | None = None) -> DataFrame:
    """``points`` (id, x, y, z, key, more) with ``component``, the smallest id that is reached over steps of less than ``gap`` (at most, if not strict).

    ``within = (columns, r)`` also joins places at most ``r`` apart (not scaled) that agree on more columns. A place
    without a coordinate or key is alone. A group of the key in one block is a task's.
    """
    cols, r = within or ([], 0.0)
    width = [max(gap / float(s), r) for s in scale]
    known = " and ".join([f"{c} is not null and not isnan({c})" for c in XYZ] + [f"{k} is not null" for k in key])
    points = cut(points)  # it is read twice, what makes it runs once
    held = points.where(known)
    low = {c: F.floor((F.col(c) - w * (1 + 1e-6)) / (w * WIDTH)).cast("long") for c, w in zip(XYZ, width)}
    own = {c: F.floor(F.col(c) / (w * WIDTH)).cast("long") for c, w in zip(XYZ, width)}
    held = held.withColumn("shared_place", sum((low[c] < own[c]).cast("int") for c in XYZ) > 0)
    for c in XYZ:
        held = held.withColumn(f"block_{c}", F.explode(F.sequence(low[c], own[c])))
    held = held.withColumn("own_place", (F.col("block_x") == own["x"]) & (F.col("block_y") == own["y"]) & (F.col("block_z") == own["z"]))
    kind = StructType([*held.drop("block_x", "block_y", "block_z").schema, StructField("least_here", points.schema["id"].dataType)])
    names, by = kind.names[:-1], np.array(scale, dtype=float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        at, part = pdf[list(XYZ)].to_numpy(float), np.arange(len(pdf))
        part = join_near(part, at * by, np.zeros(len(pdf), np.int64), gap, strict)
        if cols:
            full = np.flatnonzero(pdf[cols].notna().all(axis=1).to_numpy())
            if len(full):
                group = pdf.iloc[full].groupby(cols).ngroup().to_numpy().astype(np.int64)
                inner = join_near(np.arange(len(full)), at[full], group, r, False)
                part = _joined(part, full, full[inner])
        return pdf[names].assign(least_here=pdf["id"].to_numpy()[part])

    made = cut(held.groupBy(*key, "block_x", "block_y", "block_z").applyInPandas(run, kind))
    mine = made.where("own_place").drop("own_place", "shared_place")
    # a place that several blocks hold tells that its parts there are one; parts that share no place with another are whole
    part = F.min("least_here").over(Window.partitionBy("id"))
    links = made.where("shared_place").select("least_here", part.alias("src")).where("src <> least_here").distinct()
    comp = graph_components(links, "src", "least_here").withColumnRenamed("node", "least_here")
    named = mine.join(comp, "least_here", "left").select(*points.columns, F.coalesce("component", "least_here").alias("component"))
    return named.unionByName(points.where(f"not coalesce({known}, false)").withColumn("component", F.col("id")))
