"""Instances on blocks: components and seeded watershed of volumes of any size.

Blocks are binary rows and stay where they are; what they exchange are faces and what
follows from them. A voxel's number is its place in scan order, from 1; an object is
named by its first voxel.

Blocks of few labels are small in files and large in memory, so joins of blocks are hinted: none goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks as B
from voxloom.operators.components import graph_components, least_members
from voxloom.operators.forest import spanning_forest
from voxloom.session import cut, cut_in_buckets

KEY = B.KEY
FACE = "fx long, fy long, fz long, axis int, upper boolean, bx long, by long, bz long, n1 int, n2 int"


def numbers(row, size: tuple[int, int, int], shape: tuple[int, int, int]) -> np.ndarray:
    """The voxel numbers of a block."""
    x, y, z = (np.arange(n) + s * b for n, s, b in zip((row.nx, row.ny, row.nz), size, (row.bx, row.by, row.bz)))
    return (x[:, None, None] * shape[1] + y[None, :, None]) * shape[2] + z[None, None, :] + 1


def block_of(number, size: tuple[int, int, int], shape: tuple[int, int, int]) -> list:
    """The columns bx, by, bz of a voxel number."""
    at = number - 1
    places = (F.floor(at / (shape[1] * shape[2])), F.floor(at / shape[2]) % shape[1], at % shape[2])
    return [F.floor(p / s).cast("long").alias(k) for p, s, k in zip(places, size, KEY)]


def voxel_edges(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the six-connected pairs of voxels that are on."""
    place, ends = np.arange(on.size).reshape(on.shape), []
    for axis in range(3):
        a, b = np.moveaxis(place, axis, 0)[:-1], np.moveaxis(place, axis, 0)[1:]
        both = np.moveaxis(on, axis, 0)[:-1] & np.moveaxis(on, axis, 0)[1:]
        ends.append((a[both], b[both]))
    return np.concatenate([u for u, _ in ends]), np.concatenate([v for _, v in ends])


def settled(p: np.ndarray) -> np.ndarray:
    """Pointers followed to their ends."""
    while (p[p] != p).any():
        p = p[p]
    return p


def contract(n: int, u: np.ndarray, v: np.ndarray, rooted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning forest of edges in ascending order: the part of each node, and which edges are in the forest.

    With ``rooted`` nodes no two of them come into one part: the others go to the one that
    is reached over the lowest edges.
    """
    part, chosen = np.arange(n), np.zeros(len(u), bool)
    has_root = np.zeros(n, bool) if rooted is None else rooted.copy()
    live = np.arange(len(u))
    while True:
        a, b = part[u[live]], part[v[live]]
        apart = (a != b) & ~(has_root[a] & has_root[b])
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            return part, chosen
        best = np.full(n, len(u))
        np.minimum.at(best, a, live), np.minimum.at(best, b, live)
        best[has_root] = len(u)
        picks = np.nonzero(best < len(u))[0]
        edge = best[picks]
        chosen[edge] = True
        ends = part[u[edge]] + part[v[edge]] - picks
        p = np.arange(n)
        p[picks] = ends
        mutual = p[p] == np.arange(n)
        p = np.where(mutual & (np.arange(n) < p), np.arange(n), p)
        p = settled(p)
        roots = np.zeros(n, bool)
        roots[p[has_root]] = True
        part, has_root = p[part], roots


def pointwise(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``fn`` over each block's array; nothing is exchanged."""

    def run(frames):
        for f in frames:
            yield f[[*KEY, "nx", "ny", "nz"]].assign(data=[np.ascontiguousarray(fn(B.array_of(r)), "<i8").tobytes() for r in f.itertuples()])

    return blocks.select(*KEY, "nx", "ny", "nz", "data").mapInPandas(run, B.SCHEMA)


def faces(blocks: DataFrame, arrays: Callable[..., list[np.ndarray]], count: int, meet: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``meet(lower arrays, upper arrays)`` for each two blocks that share a face.

    ``arrays(row)`` gives ``count`` arrays of a block; of each the layers at the faces travel, nothing else.
    """
    names = [f"a{i}" for i in range(count)]

    def layers(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                at, made = (r.bx, r.by, r.bz), arrays(r)
                for axis in range(3):
                    for upper, index in ((True, 0), (False, -1)):  # the first layer meets what lies before, the last what lies behind
                        cuts = [np.take(a, index, axis=axis).astype("<i8") for a in made]
                        meets = [k + (i == axis and not upper) for i, k in enumerate(at)]
                        rows.append((*meets, axis, upper, *at, *cuts[0].shape, *[c.tobytes() for c in cuts]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACE.split(", ")] + names)

    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({c: [] for c in columns})
        low, high = ([np.frombuffer(r[n], "<i8").reshape(r["n1"], r["n2"]) for n in names] for r in (pdf[~pdf["upper"]].iloc[0], pdf[pdf["upper"]].iloc[0]))
        return meet(low, high)

    sent = blocks.mapInPandas(layers, FACE + "".join(f", {n} binary" for n in names))
    return sent.groupBy("fx", "fy", "fz", "axis").applyInPandas(run, schema)


def local_labels(blocks: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Six-connected components of each block by itself, named by their first voxel and so unique in the volume."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                on = B.array_of(r) != 0
                first = least_members(on.size, *voxel_edges(on)).reshape(on.shape)
                out.append(np.where(on, numbers(r, size, shape).ravel()[first], 0).astype("<i8").tobytes())
            yield f[[*KEY, "nx", "ny", "nz"]].assign(data=out)

    return blocks.select(*KEY, "nx", "ny", "nz", "data").mapInPandas(run, B.SCHEMA)


def stitch_list(labels: DataFrame) -> DataFrame:
    """``(src, dst)`` of labels that face each other across two blocks, each once a face."""

    def meet(low, high) -> pd.DataFrame:
        a, b = low[0].ravel(), high[0].ravel()
        both = np.unique(np.stack([a, b], 1)[(a != 0) & (b != 0)], axis=0)
        return pd.DataFrame({"src": both[:, 0], "dst": both[:, 1]})

    return faces(labels, lambda r: [B.array_of(r)], 1, meet, "src long, dst long")


def relabel_blocks(blocks: DataFrame, mapping: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """``mapping(old, new)`` applied to blocks of voxel numbers; a block gets the pairs that name voxels of its own.

    Only labels that touch a face are in a merge list, so a block's pairs are fewer than the voxels on its faces.
    """
    pairs = mapping.select(*block_of(F.col("old"), size, shape), F.struct("old", "new").alias("pair")).groupBy(*KEY).agg(F.collect_list("pair").alias("pairs"))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                a = B.array_of(r)
                if r.pairs is not None and len(r.pairs):
                    old, new = (np.array([p[k] for p in r.pairs], "<i8") for k in ("old", "new"))
                    order = np.argsort(old)
                    at = np.minimum(np.searchsorted(old[order], a), len(old) - 1)
                    a = np.where(old[order][at] == a, new[order][at], a)
                out.append(np.ascontiguousarray(a, "<i8").tobytes())
            yield f[[*KEY, "nx", "ny", "nz"]].assign(data=out)

    return blocks.join(pairs.hint("merge"), KEY, "left").mapInPandas(run, B.SCHEMA)


def instance_segmentation(blocks: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Components of a binary volume: blocks of labels, and the merge list ``(node, component)``.

    Blocks label themselves, faces tell which labels are one object, and every block applies its part of the
    merge list. The labelled blocks lie in buckets by block, so that last join does not move them.
    """
    labels = cut_in_buckets(local_labels(blocks, size, shape), KEY)
    merge = cut(graph_components(stitch_list(labels)))
    return relabel_blocks(labels, merge.where("node <> component").selectExpr("node AS old", "component AS new"), size, shape), merge


def label_sizes(blocks: DataFrame) -> DataFrame:
    """``(label, n)``: voxels of every label above 0; a block sends one row a label."""

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                a = np.frombuffer(r.data, "<i8")
                label, n = np.unique(a[a > 0], return_counts=True)
                yield pd.DataFrame({"label": label, "n": n})

    return blocks.select("data").mapInPandas(run, "label long, n long").groupBy("label").agg(F.sum("n").alias("n"))


def drop_small(blocks: DataFrame, least: int, size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Labels of fewer than ``least`` voxels become 0.

    Blocks say which labels they hold, since a small object's name may lie in another block.
    """

    def held(frames):
        for f in frames:
            for r in f.itertuples():
                a = np.frombuffer(r.data, "<i8")
                label, n = np.unique(a[a > 0], return_counts=True)
                yield pd.DataFrame({**{k: getattr(r, k) for k in KEY}, "label": label, "n": n})

    blocks = cut_in_buckets(blocks, KEY)
    parts = cut(blocks.select(*KEY, "data").mapInPandas(held, "bx long, by long, bz long, label long, n long"))
    small = parts.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") < least).select("label")
    gone = parts.join(small, "label").groupBy(*KEY).agg(F.collect_list("label").alias("gone"))

    def run(frames):
        for f in frames:
            out = [d if g is None else np.where(np.isin(a := np.frombuffer(d, "<i8"), g), 0, a).tobytes() for d, g in zip(f["data"], f["gone"])]
            yield f[[*KEY, "nx", "ny", "nz"]].assign(data=out)

    return blocks.join(gone.hint("merge"), KEY, "left").mapInPandas(run, B.SCHEMA)


ORDER = ["w1", "w2", "w3", "w4"]


def _ordered(number_u, height_u, number_v, height_v) -> list[np.ndarray]:
    """How an edge compares: the later of its voxels by (height downwards, number), then the earlier one."""
    swap = (height_u > height_v) | ((height_u == height_v) & (number_u < number_v))  # u comes first
    pick = lambda a, b: np.where(swap, b, a)
    return [-pick(height_u, height_v), pick(number_u, number_v), -pick(height_v, height_u), pick(number_v, number_u)]


def _basins(row, size, shape):
    """Of a block: seeds, what is flooded, the basin of each voxel among its terminals, each terminal's node, and the edges between basins."""
    dims = (row.nx, row.ny, row.nz)
    seed, height = np.frombuffer(row.seed, "<i8"), np.frombuffer(row.data, "<i8")
    on = (height > 0) | (seed > 0)
    number = numbers(row, size, shape).ravel()
    face = np.ones(dims, bool)
    face[1:-1, 1:-1, 1:-1] = False
    terminal = on & (face.ravel() | (seed > 0))
    u, v = voxel_edges(on.reshape(dims))
    order = _ordered(number[u], height[u], number[v], height[v])
    rank = np.lexsort(order[::-1])
    u, v, order = u[rank], v[rank], [o[rank] for o in order]
    part, _ = contract(on.size, u, v, terminal)
    node = np.zeros(on.size, "<i8")  # of a part: its terminal, a seed's label below 0 or the voxel's number
    node[part[terminal]] = np.where(seed > 0, -seed, number)[terminal]
    return seed, on, node[part], terminal, number, u, v, order


def watershed(seeds: DataFrame, heights: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Touching objects parted by seeds: the flood from all seeds over the voxels with a height above 0, as in one whole volume.

    A voxel comes before another if it is higher, or as high and earlier in scan order; an edge before another if its later
    voxel is, then its earlier one. The flood always takes the first edge that leaves it. As no two edges are alike, what a seed floods is its
    part of the minimum spanning forest that hangs on the seeds, whatever is looked at first:

    1. every block finds the basins of its seeds and of its face voxels, and sends the least forest between them;
    2. faces add the edges across; one spanning forest over all tells which seed a face voxel belongs to;
    3. every block floods itself again and gives each basin its seed.

    Objects may reach over any number of blocks. Voxels that no seed reaches become 0. Seeds are labels above 0.
    """
    both = cut_in_buckets(heights.select(*KEY, "nx", "ny", "nz", "data").join(seeds.select(*KEY, F.col("data").alias("seed")).hint("merge"), KEY), KEY)
    schema = "src long, dst long, " + ", ".join(f"{w} long" for w in ORDER)

    def inner(frames):
        for f in frames:
            for r in f.itertuples():
                _, _, node, _, _, u, v, order = _basins(r, size, shape)
                a, b = node[u], node[v]
                cross = (a != b) & (a != 0) & (b != 0)
                names, ends = np.unique(np.concatenate([a[cross], b[cross]]), return_inverse=True)
                n = int(cross.sum())
                _, kept = contract(len(names), ends[:n], ends[n:])
                yield pd.DataFrame({"src": a[cross][kept], "dst": b[cross][kept], **{w: o[cross][kept] for w, o in zip(ORDER, order)}})

    def on_faces(r) -> list[np.ndarray]:
        dims = (r.nx, r.ny, r.nz)
        seed, height, number = np.frombuffer(r.seed, "<i8").reshape(dims), np.frombuffer(r.data, "<i8").reshape(dims), numbers(r, size, shape)
        node = np.where(seed > 0, -seed, np.where(height > 0, number, 0))
        return [node, number, height]

    def meet(low, high) -> pd.DataFrame:
        (a, na, ha), (b, nb, hb) = ([x.ravel() for x in side] for side in (low, high))
        on = (a != 0) & (b != 0)
        return pd.DataFrame({"src": a[on], "dst": b[on], **dict(zip(ORDER, (o[on] for o in _ordered(na, ha, nb, hb))))})

    edges = cut(both.mapInPandas(inner, schema).unionByName(faces(both, on_faces, 3, meet, schema)))
    # all seeds are one node while the forest is sought; its edges then fall apart into one tree a seed
    hung = edges.select(F.lit(0).alias("all"), F.greatest("src", F.lit(0)).alias("src"), F.greatest("dst", F.lit(0)).alias("dst"), *ORDER, F.col("src").alias("w5"), F.col("dst").alias("w6"))
    forest = spanning_forest(hung, "all", [*ORDER, "w5", "w6"])
    trees = graph_components(forest, "w5", "w6")
    known = trees.where("node > 0 and component < 0").select(*block_of(F.col("node"), size, shape), F.struct(F.col("node").alias("old"), (-F.col("component")).alias("new")).alias("pair"))
    per = known.groupBy(*KEY).agg(F.collect_list("pair").alias("pairs"))

    def outer(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                seed, on, node, *_ = _basins(r, size, shape)
                label = np.where(node < 0, -node, 0)
                if r.pairs is not None and len(r.pairs):
                    old, new = (np.array([p[k] for p in r.pairs], "<i8") for k in ("old", "new"))
                    order = np.argsort(old)
                    at = np.minimum(np.searchsorted(old[order], node), len(old) - 1)
                    label = np.where(old[order][at] == node, new[order][at], label)
                out.append(np.where(seed > 0, seed, np.where(on, label, 0)).astype("<i8").tobytes())
            yield f[[*KEY, "nx", "ny", "nz"]].assign(data=out)

    return both.join(per.hint("merge"), KEY, "left").mapInPandas(outer, B.SCHEMA)
