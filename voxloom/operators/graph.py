"""Region graphs: components, sizes, pruning, splits.

Graphs are edge tables ``(src, dst)``; a singleton is a self-loop. Spanning trees,
walks and stitching are for components of any size: small ones are groups of
``applyInPandas``, large ones go by rounds of joins.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.components import graph_components
from voxloom.operators.forest import Sets, spanning_forest
from voxloom.operators.spatial import pairs_within
from voxloom.session import cut

XYZ = ("x", "y", "z")
BOX = [f"{e}_{c}" for e in ("min", "max") for c in XYZ]


def with_singletons(edges: DataFrame, ids: DataFrame, node: str = "sv_id") -> DataFrame:
    """Edges without background (0), and a self-loop for each id that no edge has."""
    kept = edges.where("src <> 0 and dst <> 0").select("src", "dst")
    seen = kept.select(F.col("src").alias(node)).union(kept.select("dst"))
    alone = ids.select(node).where(F.col(node) != 0).distinct().join(seen, node, "left_anti")
    return kept.unionByName(alone.select(F.col(node).alias("src"), F.col(node).alias("dst")))


def component_extent(components: DataFrame, boxes: DataFrame, scale: tuple[float, float, float], node: str = "sv_id") -> DataFrame:
    """``(component, n, n_boxes, extent)``: diagonal of the union of the members' boxes in nm; null without any box."""
    joined = components.join(boxes.select(F.col(node).alias("node"), *BOX), "node", "left")
    side = [((F.max(f"max_{c}") - F.min(f"min_{c}")) * float(s)) ** 2 for c, s in zip(XYZ, scale)]
    return joined.groupBy("component").agg(F.count("*").alias("n"), F.count("min_x").alias("n_boxes"), F.sqrt(side[0] + side[1] + side[2]).alias("extent"))


def prune_components(components: DataFrame, extents: DataFrame, least: float, inclusive: bool) -> DataFrame:
    """Members of components whose extent passes; ``>=`` or ``>`` by ``inclusive``."""
    keep = F.col("extent") >= least if inclusive else F.col("extent") > least
    return components.join(extents.where(keep).select("component"), "component", "left_semi").select("node", "component")


def lookup(ids: DataFrame, mapping: DataFrame, missing_zero: bool) -> DataFrame:
    """Cell of each supervoxel; absent ids are left out, or get 0."""
    if not missing_zero:
        return ids.join(mapping, "sv_id")
    return ids.join(mapping, "sv_id", "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(0)))


def members(mapping: DataFrame) -> DataFrame:
    """Sorted supervoxels of each cell."""
    return mapping.groupBy("cell_id").agg(F.sort_array(F.collect_set("sv_id")).alias("sv_ids"))


def cell_rollup(sv: DataFrame, mapping: DataFrame) -> DataFrame:
    """Size, box and representative coordinate (of the smallest supervoxel) of each cell."""
    first = F.min(F.struct("sv_id", *[f"min_{c}" for c in XYZ]))
    box = [F.min(f"min_{c}").alias(f"min_{c}") for c in XYZ] + [F.max(f"max_{c}").alias(f"max_{c}") for c in XYZ]
    got = sv.join(mapping, "sv_id").groupBy("cell_id").agg(F.count("*").alias("n_sv"), F.sum("size").alias("size"), *box, first.alias("r"))
    return got.select("cell_id", "n_sv", "size", *BOX, *[F.col(f"r.min_{c}").alias(f"rep_{c}") for c in XYZ])


def volume_mm3(sv: DataFrame, scale: tuple[float, float, float], ids: DataFrame | None = None) -> DataFrame:
    """Summed volume in cubic millimetres, of all supervoxels or of a set."""
    kept = sv if ids is None else sv.join(ids.select("sv_id"), "sv_id", "left_semi")
    return kept.agg((F.coalesce(F.sum("size"), F.lit(0)) * float(np.prod(scale)) / 1e18).alias("volume_mm3"))


def astrocyte_call(votes: DataFrame, t: float, key: str = "sv_id") -> DataFrame:
    """Mean probability above ``t`` and more than int(0.7 n) votes above it."""
    return votes.groupBy(key).agg(
        F.avg("p").alias("mean_p"), ((F.avg("p") > t) & (F.count_if(F.col("p") > t) > F.floor(F.lit(0.7) * F.count("*")))).alias("astrocyte")
    )


def induced(edges: DataFrame, nodes: DataFrame, keep: bool = True) -> DataFrame:
    """The subgraph on ``nodes(node)``, or on all others."""
    how = "left_semi" if keep else "left_anti"
    return edges.join(nodes.select(F.col("node").alias("src")), "src", how).join(nodes.select(F.col("node").alias("dst")), "dst", how).select("src", "dst")


def _sized(edges: DataFrame, nodes: DataFrame, boxes: DataFrame, scale) -> DataFrame:
    """``(node, component, extent)`` of the subgraph on ``nodes``, isolated ones included."""
    sub = induced(edges, nodes).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    comp = graph_components(sub)
    return comp.join(component_extent(comp, boxes, scale).select("component", "extent"), "component").select("node", "component", "extent")


def split_astrocytes(edges: DataFrame, glia: DataFrame, boxes: DataFrame, least: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """``(node, kind)``, kind ``neuron`` or ``astrocyte``.

    Small astrocyte fragments join the neurons; of the neuron components that
    result, small ones go over to the astrocytes. Components without any
    astrocyte node, and those that have nothing but them, stay as they are.
    """
    whole = graph_components(edges)
    flagged = whole.join(glia.select("node", F.lit(True).alias("g")).distinct(), "node", "left").withColumn("g", F.coalesce("g", F.lit(False)))
    mixed = flagged.groupBy("component").agg(F.count_if("g").alias("n_glia"), F.count("*").alias("n"))
    flagged = flagged.join(mixed, "component")
    decided = flagged.where("n_glia = 0 or n_glia = n").select("node", F.when(F.col("n_glia") == 0, "neuron").otherwise("astrocyte").alias("kind"))
    open_ = flagged.where("n_glia > 0 and n_glia < n")
    fragments = _sized(edges, open_.where("g").select("node"), boxes, scale)
    large = fragments.where(F.coalesce(F.col("extent") >= least, F.lit(False))).select("node")
    neurons = _sized(edges, open_.select("node").join(large, "node", "left_anti"), boxes, scale)
    kept = neurons.where(F.coalesce(F.col("extent") >= least, F.lit(False))).select("node")
    rest = open_.select("node").join(kept, "node", "left_anti")
    return decided.unionByName(kept.withColumn("kind", F.lit("neuron"))).unionByName(rest.withColumn("kind", F.lit("astrocyte")))


def sv_sets(all_sv: DataFrame, neuron: DataFrame, astrocyte: DataFrame) -> DataFrame:
    """Each supervoxel's set: neuron, astrocyte, or pruned where neither has it."""
    marked = all_sv.select("sv_id").join(neuron.select("sv_id", F.lit(1).alias("n")).distinct(), "sv_id", "left").join(astrocyte.select("sv_id", F.lit(1).alias("a")).distinct(), "sv_id", "left")
    return marked.select("sv_id", F.when(F.col("a") == 1, "astrocyte").when(F.col("n") == 1, "neuron").otherwise("pruned").alias("kind"))


def sized_graph(edges: DataFrame, nodes: DataFrame, boxes: DataFrame, least: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Edges of the subgraph on ``nodes`` whose component's extent is not below ``least``; singletons as loops."""
    comp = _sized(edges, nodes, boxes, scale).where(F.col("extent") >= least).select("node")
    inside = induced(edges, comp)
    touched = inside.select(F.col("src").alias("node")).union(inside.select("dst"))
    alone = comp.join(touched, "node", "left_anti")
    return inside.unionByName(alone.select(F.col("node").alias("src"), F.col("node").alias("dst")))


def merge_nodes(edges: DataFrame, nodes: DataFrame, new: int) -> DataFrame:
    """All of ``nodes`` become ``new``; self-loops that arise go, edges stay distinct and undirected."""
    m = nodes.select(F.col("node"), F.lit(new).cast("long").alias("new")).distinct()
    a = edges.join(m.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("new", "src").alias("src"), "dst")
    b = a.join(m.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("new", "dst").alias("dst"))
    return b.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _adjacency(pdf: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, set] = {}
    for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return {k: sorted(v - {k}) for k, v in out.items()}


def bfs_order(adj: dict[int, list[int]], start: int, most: int) -> list[int]:
    """Breadth-first nodes from ``start``, neighbours by ascending id, the first ``most``."""
    seen, queue, i = {start}, [start], 0
    while i < len(queue) and len(queue) < most:
        for n in adj[queue[i]]:
            if n not in seen:
                seen.add(n)
                queue.append(n)
                if len(queue) == most:
                    break
        i += 1
    return queue


def spanning_tree(edges: DataFrame, key: str = "cell_id") -> DataFrame:
    """Minimum spanning forest of each group by weight, ties by (src, dst); groups may be of any size."""
    return spanning_forest(edges, key, ["weight", "src", "dst"]).select(key, "src", "dst", "weight")


#: Nodes of a group that one task stitches.
GROUP_NODES = 20_000


def stitch(nodes: DataFrame, edges: DataFrame, key: str = "cell_id") -> DataFrame:
    """Edges with those added that join a group's components, always the shortest link from the largest component.

    Of equal links the one with the smaller ends goes first, so the links are the minimum spanning tree of the
    components, whichever of them one begins with. Groups of up to GROUP_NODES nodes are one task's each;
    the others are joined by :func:`stitch_by_rounds`.
    """
    large = nodes.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > GROUP_NODES).select(key)
    if not large.take(1):
        return _stitch_by_task(nodes, edges, key)
    large = cut(large)
    part = lambda df, how: df.join(large, key, how)
    rounds = stitch_by_rounds(part(nodes, "left_semi"), part(edges, "left_semi"), key)
    return rounds.unionByName(_stitch_by_task(part(nodes, "left_anti"), part(edges, "left_anti"), key))


def stitch_by_rounds(nodes: DataFrame, edges: DataFrame, key: str = "cell_id", start: float | None = None) -> DataFrame:
    """:func:`stitch` for groups of any size.

    In a round every component finds its shortest link to another one, by distance joins of growing radius (from ``start``, or
    the mean length of an edge) over the components that have found none yet; the links join them, which halves
    their number at least. No group is in one task.
    """
    points = cut(nodes.select(F.col(key).alias("g"), "node_id", *[F.col(c).cast("double").alias(c) for c in XYZ]).dropDuplicates(["g", "node_id"]))
    points = cut(points.withColumn("nid", F.monotonically_increasing_id()))
    end = lambda c, n: points.select("g", F.col("node_id").alias(c), F.col("nid").alias(n), *[F.col(x).alias(f"{n}{x}") for x in XYZ])
    known = cut(edges.select(F.col(key).alias("g"), "src", "dst").join(end("src", "a"), ["g", "src"]).join(end("dst", "b"), ["g", "dst"]))
    if start is None:
        start = known.agg(F.avg(F.sqrt(sum((F.col(f"a{x}") - F.col(f"b{x}")) ** 2 for x in XYZ)))).first()[0] or 1.0
    loops = points.select(F.col("nid").alias("a"), F.col("nid").alias("b"))
    comp = graph_components(known.select("a", "b").unionByName(loops), "a", "b")
    held, links = cut(points.join(comp.withColumnRenamed("node", "nid"), "nid")), []
    while True:
        several = held.groupBy("g").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("g")
        held = cut(held.join(several, "g", "left_semi"))
        if not held.take(1):
            break
        places = held.select("g", F.struct("component", "node_id").alias("id"), *XYZ)
        left, radius, found = held.select("component").distinct(), start, []
        while left.take(1):
            asking = places.join(left, F.col("id.component") == F.col("component"), "left_semi")
            near = pairs_within(asking, places, radius, on=["g"]).where("id_a.component <> id_b.component")
            link = F.struct("dist", F.least("id_a.node_id", "id_b.node_id").alias("lo"), F.greatest("id_a.node_id", "id_b.node_id").alias("hi"), F.col("id_b.component").alias("other"))
            best = cut(near.groupBy("g", F.col("id_a.component").alias("component")).agg(F.min(link).alias("l")))
            found.append(best)
            left = cut(left.join(best.select("component"), "component", "left_anti"))
            radius *= 2
        best = found[0]
        for f in found[1:]:
            best = best.unionByName(f)
        links.append(best.select("g", F.col("l.lo").alias("src"), F.col("l.hi").alias("dst")).distinct())
        joined = graph_components(best.select(F.col("component").alias("a"), F.col("l.other").alias("b")), "a", "b")
        held = cut(held.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), "component").drop("component").withColumnRenamed("c", "component"))
    out = edges.select(key, "src", "dst", F.lit(False).alias("added"))
    for f in links:
        out = out.unionByName(f.select(F.col("g").alias(key), "src", "dst", F.lit(True).alias("added")))
    return out


def _stitch_by_task(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n if len(n) else pd.DataFrame({c: [] for c in (key, "node_id", *XYZ)})  # a side without rows comes without columns
        e = e if len(e) else pd.DataFrame({c: [] for c in (key, "src", "dst")})
        at = {i: np.array(p, float) for i, p in zip(n["node_id"].tolist(), n[list(XYZ)].to_numpy().tolist())}
        sets = Sets()
        for i in at:
            sets.root(i)
        for a, b in zip(e["src"].tolist(), e["dst"].tolist()):
            if a in at and b in at:
                sets.join(a, b)
        groups: dict = {}
        for i in sorted(at):
            groups.setdefault(sets.root(i), []).append(i)
        comps, added = sorted(groups.values(), key=lambda c: (-len(c), c[0])), []
        names = np.array([i for c in comps for i in c])
        places = np.stack([at[i] for i in names.tolist()]) if len(names) else np.empty((0, 3))
        part = np.repeat(np.arange(len(comps)), [len(c) for c in comps])
        out, dist, link = part > 0, np.full(len(names), np.inf), np.zeros(len(names), int)
        joined = np.nonzero(part == 0)[0]  # the largest; what it takes in is met by every other node once
        while out.any():
            left = np.nonzero(out)[0]
            for s in range(0, len(joined), 512):
                some = joined[s : s + 512][np.argsort(names[joined[s : s + 512]])]
                d = np.sqrt(((places[left][:, None] - places[some][None]) ** 2).sum(2))
                k = d.argmin(axis=1)
                near, who = d[np.arange(len(left)), k], names[some][k]
                nearer = (near < dist[left]) | ((near == dist[left]) & (who < link[left]))
                dist[left[nearer]], link[left[nearer]] = near[nearer], who[nearer]
            best = left[np.lexsort((np.maximum(names[left], link[left]), np.minimum(names[left], link[left]), dist[left]))[0]]
            added.append((int(link[best]), int(names[best])))
            joined = np.nonzero(part == part[best])[0]
            out[joined] = False
        cell = (n if len(n) else e)[key].iloc[0]
        rows = [(cell, int(a), int(b), False) for a, b in zip(e["src"].tolist(), e["dst"].tolist())] + [(cell, int(a), int(b), True) for a, b in added]
        return pd.DataFrame(rows, columns=[key, "src", "dst", "added"])

    left, right = nodes.select(key, "node_id", *XYZ).groupBy(key), edges.select(key, "src", "dst").groupBy(key)
    return left.cogroup(right).applyInPandas(run, f"{key} long, src long, dst long, added boolean")


def smooth_labels(nodes: DataFrame, edges: DataFrame, votes: int, key: str = "cell_id") -> DataFrame:
    """Each node's majority label over its first ``votes`` breadth-first nodes, ties to the smallest label."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({key: [], "node_id": [], "label": []})
        adj = {i: [] for i in n["node_id"].tolist()} | (_adjacency(e) if len(e) else {})
        label = dict(zip(n["node_id"].tolist(), n["label"].tolist()))
        rows = []
        for i in sorted(label):
            seen = [label[m] for m in bfs_order(adj, i, votes) if m in label]
            rows.append((n[key].iloc[0], i, min(set(seen), key=lambda v: (-seen.count(v), v))))
        return pd.DataFrame(rows, columns=[key, "node_id", "label"])

    left, right = nodes.select(key, "node_id", "label").groupBy(key), edges.select(key, "src", "dst").groupBy(key)
    return left.cogroup(right).applyInPandas(run, f"{key} long, node_id long, label long")


def split_cell(mapping: DataFrame, cell: int, sv: list[int]) -> DataFrame:
    """The mapping with the given supervoxels of a cell moved to the lowest free cell id.

    Raises ValueError if they are no proper part of the cell.
    """
    own = mapping.where(F.col("cell_id") == cell)
    total, inside = own.agg(F.count("*"), F.count_if(F.col("sv_id").isin(sv))).first()
    if inside != len(set(sv)) or inside == total or not inside:
        raise ValueError("the supervoxels must be a proper part of the cell")
    used = mapping.select("cell_id").distinct()
    free = used.select((F.col("cell_id") + 1).alias("cell_id")).where("cell_id > 0").join(used, "cell_id", "left_anti").agg(F.min("cell_id").alias("free"))
    moved = (F.col("cell_id") == cell) & F.col("sv_id").isin(sv)
    return mapping.crossJoin(F.broadcast(free)).select("sv_id", F.when(moved, F.col("free")).otherwise(F.col("cell_id")).alias("cell_id"))


def dijkstra(adj: dict[int, list[tuple[int, float]]], sources: list[int], limit: float = np.inf) -> dict[int, float]:
    """Shortest distances from a set of nodes, up to ``limit``."""
    dist = dict.fromkeys(sources, 0.0)
    heap = [(0.0, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, a = heapq.heappop(heap)
        if d > dist.get(a, np.inf):
            continue
        for b, w in adj.get(a, ()):
            e = d + w
            if e <= limit and e < dist.get(b, np.inf):
                dist[b] = e
                heapq.heappush(heap, (e, b))
    return dist
