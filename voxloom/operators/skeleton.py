"""Skeleton operators: ``nodes(cell_id, node_id, x, y, z, ...)``, ``edges(cell_id, src, dst)``.

Path walks (windows along paths, shortest paths, pruning) work on one cell's
skeleton as a group; a skeleton is bounded by its cell.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.modes import mode_nearest, mode_smallest
from voxloom.operators.clusters import clusters
from voxloom.operators.components import graph_components, least_members
from voxloom.operators.graph import _adjacency, dijkstra
from voxloom.operators.spatial import DISTANCES, GROUP_POINTS, distance, k_nearest, nearest_in_group, pairs_within
from voxloom.session import cut, running_total

XYZ = ("x", "y", "z")


def weighted_edges(nodes: DataFrame, edges: DataFrame, scale=(1.0, 1.0, 1.0), attrs: tuple[str, ...] = ()) -> DataFrame:
    """K1: edges with their length, and the ends' attributes as ``<attr>_a`` and ``<attr>_b``."""
    end = lambda s, n: nodes.select("cell_id", F.col("node_id").alias(n), *[F.col(c).alias(f"{c}_{s}") for c in (*XYZ, *attrs)])
    both = edges.join(end("a", "src"), ["cell_id", "src"]).join(end("b", "dst"), ["cell_id", "dst"])
    return both.select("cell_id", "src", "dst", distance(scale=scale).alias("length"), *[f"{c}_{s}" for c in attrs for s in "ab"])


def path_lengths(weighted: DataFrame, comps: list[int] | None = None, attr: str = "axoness") -> DataFrame:
    """K2: total edge length per cell; only edges with both ends in ``comps``, if given."""
    length = F.col("length")
    if comps is not None:
        length = F.when(F.col(f"{attr}_a").isin(comps) & F.col(f"{attr}_b").isin(comps), length).otherwise(0.0)
    return weighted.groupBy("cell_id").agg(F.sum(length).alias("length"))


def long_cells(lengths: DataFrame, micrometres: float) -> DataFrame:
    """K3: cells whose path (in nm) reaches a length in µm."""
    return lengths.where(F.col("length") / 1000 >= micrometres).select("cell_id")


def path_density(objects: DataFrame, lengths: DataFrame, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """K4: µm³ of objects per µm of path; 0 without a path."""
    volume = objects.groupBy("cell_id").agg((F.sum("size") * float(np.prod(scale)) / 1e9).alias("volume"))
    joined = lengths.join(volume, "cell_id", "left")
    return joined.select("cell_id", F.when(F.col("length") > 0, F.coalesce("volume", F.lit(0.0)) / (F.col("length") / 1000)).otherwise(0.0).alias("density"))


def _weights(e: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for a, b, w in zip(e["src"].tolist(), e["dst"].tolist(), e["length"].tolist()):
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, []).append((a, w))
    return out


def _mode(values: list):
    """The most frequent value, ties to the smallest; in proportion to the values."""
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v))


#: Nodes of a skeleton whose distances to each other are held as one matrix.
TREE_NODES = 2_000


def _tree_distances(names: np.ndarray, e: pd.DataFrame) -> np.ndarray | None:
    """Path lengths between all nodes of a forest; None if it is none."""
    n, adj = len(names), [[] for _ in names]
    u, v = np.searchsorted(names, e["src"].to_numpy()).tolist(), np.searchsorted(names, e["dst"].to_numpy()).tolist()
    for a, b, w in zip(u, v, e["length"].tolist()):
        adj[a].append((b, w)), adj[b].append((a, w))
    dist, seen = np.full((n, n), np.inf), np.zeros(n, bool)
    trees = 0
    for root in range(n):
        if seen[root]:
            continue
        trees += 1
        seen[root], dist[root, root], walk = True, 0.0, [root]
        for a in walk:
            for b, w in adj[a]:
                if not seen[b]:
                    seen[b] = True
                    dist[b] = dist[:, b] = dist[a] + w
                    dist[b, b] = 0.0
                    walk.append(b)
    return dist if len(u) == n - trees else None


def _votes_on_tree(n: pd.DataFrame, e: pd.DataFrame, attr: str, reach: float) -> np.ndarray | None:
    """Each node's most frequent value within ``reach``, ties to the smallest; None where one matrix of distances does not do."""
    ids = n["node_id"].to_numpy()
    names = np.unique(np.concatenate([ids, e["src"].to_numpy(), e["dst"].to_numpy()])) if len(e) else np.unique(ids)
    if len(names) > TREE_NODES or len(np.unique(ids)) < len(ids) or n[attr].isna().any() or (len(e) and not (e["length"].to_numpy() >= 0).all()):
        return None
    dist = _tree_distances(names, e if len(e) else pd.DataFrame({"src": [], "dst": [], "length": []}, dtype=float))
    if dist is None:
        return None
    at = np.searchsorted(names, ids)
    values, code = np.unique(n[attr].to_numpy(), return_inverse=True)
    votes = (dist[np.ix_(at, at)] <= reach).astype(float) @ np.eye(len(values))[code]
    return values[votes.argmax(1)]


def synapse_distance(pairs: DataFrame, synapses: DataFrame, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Straight-line distance of each pair ``(syn_a, syn_b)`` of synapses, in the unit of ``scale``."""
    end = lambda s: synapses.select(F.col("syn_id").alias(f"syn_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in XYZ])
    return pairs.join(end("a"), "syn_a").join(end("b"), "syn_b").select("syn_a", "syn_b", distance(scale=scale).alias("dist"))


def _window_votes(attr: str, reach: float, mode: str):
    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"cell_id": [], "node_id": [], attr: []})
        if mode != "bfs_budget" and (voted := _votes_on_tree(n, e, attr, reach)) is not None:
            return pd.DataFrame({"cell_id": n["cell_id"], "node_id": n["node_id"], attr: voted})
        adj = _weights(e) if len(e) else {}
        value = dict(zip(n["node_id"].tolist(), n[attr].tolist()))
        rows = []
        for i in n["node_id"].tolist():
            if mode == "bfs_budget":
                if value[i] == 2:
                    rows.append((n["cell_id"].iloc[0], i, 2))
                    continue
                seen, queue, left = [i], [i], reach
                for a in queue:
                    for b, w in sorted(adj.get(a, ())):
                        if b not in seen and left >= w:
                            left -= w
                            seen.append(b)
                            queue.append(b)
                inside = seen
            else:
                inside = dijkstra(adj, [i], reach)
            rows.append((n["cell_id"].iloc[0], i, _mode([value[j] for j in inside if j in value])))
        return pd.DataFrame(rows, columns=["cell_id", "node_id", attr])

    return run


def window_majority(nodes: DataFrame, weighted: DataFrame, attr: str, reach: float, mode: str = "path") -> DataFrame:
    """Each node's most frequent value among nodes within path distance ``reach``, ties to the smallest.

    ``mode='bfs_budget'`` (K12): the window is breadth-first and ``reach`` is
    shared by all edges walked; soma nodes (2) keep their value.
    """
    left = nodes.select("cell_id", "node_id", F.col(attr).cast("long").alias(attr))
    right = weighted.select(F.col("cell_id").alias("cell"), "src", "dst", "length")
    return left.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(_window_votes(attr, reach, mode), f"cell_id long, node_id long, {attr} long")


def component_compartments(nodes: DataFrame, edges: DataFrame, share: float = 0.66, attr: str = "axoness") -> DataFrame:
    """K6: soma-free components become axon where their share of axon nodes reaches ``share``, else dendrite; soma stays."""
    kept = nodes.where(F.col(attr) != 2).select("cell_id", "node_id", attr)
    key = lambda c: F.struct("cell_id", F.col(c).alias("node_id"))
    inside = edges.join(kept.select("cell_id", F.col("node_id").alias("src")), ["cell_id", "src"], "left_semi").join(
        kept.select("cell_id", F.col("node_id").alias("dst")), ["cell_id", "dst"], "left_semi"
    )
    pairs = inside.select(key("src").alias("src"), key("dst").alias("dst")).unionByName(kept.select(key("node_id").alias("src"), key("node_id").alias("dst")))
    comp = graph_components(pairs).select("node.cell_id", "node.node_id", "component")
    shares = kept.join(comp, ["cell_id", "node_id"]).groupBy("component").agg((F.count_if(F.col(attr) == 1) / F.count("*")).alias("s"))
    called = comp.join(shares, "component").select("cell_id", "node_id", F.when(F.col("s") >= share, 1).otherwise(0).alias(attr))
    return called.unionByName(nodes.where(F.col(attr) == 2).select("cell_id", "node_id", F.lit(2).alias(attr)))


def smooth_compartments(nodes: DataFrame, weighted: DataFrame, edges: DataFrame, reach: float, share: float = 0.66) -> DataFrame:
    """K7: window majority on folded labels, then the component rule; nodes that were boutons (3, 4) and end as axon keep their code.

    The window makes a cell one task's, which follows the other steps there as well: nodes and edges are moved once.
    """
    vote = _window_votes("axoness", reach, "path")

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"cell_id": [], "node_id": [], "axoness": []})
        folded = n[["cell_id", "node_id"]].assign(axoness=n["axoness"].where(~n["axoness"].isin([3, 4]), 1))
        smooth = vote(folded, e).set_index("node_id")["axoness"].reindex(n["node_id"]).to_numpy()
        soma, names = smooth == 2, np.unique(n["node_id"].to_numpy())
        part = np.arange(len(names))
        if len(e):
            out = np.isin(names, n["node_id"].to_numpy()[soma])
            u, v = np.searchsorted(names, e["src"].to_numpy()), np.searchsorted(names, e["dst"].to_numpy())
            inside = ~(out[u] | out[v])
            part = least_members(len(names), u[inside], v[inside])
        of = part[np.searchsorted(names, n["node_id"].to_numpy())]
        axon, all_of = (np.bincount(of[~soma], w[~soma], len(names)) for w in ((smooth == 1).astype(float), np.ones(len(n))))
        ruled = np.where(soma, 2, np.where(axon[of] / np.maximum(all_of[of], 1) >= share, 1, 0))
        raw = n["axoness"].to_numpy()
        return pd.DataFrame({"cell_id": n["cell_id"], "node_id": n["node_id"], "axoness": np.where((ruled == 1) & np.isin(raw, (3, 4)), raw, ruled)})

    kind = nodes.schema["axoness"].dataType.simpleString()
    own = nodes.select("cell_id", "node_id", "axoness").where("axoness is not null")
    right = weighted.select(F.col("cell_id").alias("cell"), "src", "dst", "length")
    return own.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(run, f"cell_id long, node_id long, axoness {kind}")


def attribute_at(coords: DataFrame, nodes: DataFrame, attr: str, radius: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """K8: the nearest node's value; with a radius the majority within it, the nearest as fallback; -1 for cells without skeleton.

    The columns ``keep`` of the coordinates come along. A cell with up to GROUP_POINTS nodes is one task's: coordinates and nodes are
    moved once, what lies within the radius is never a row.
    """
    large = cut(nodes.groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_POINTS).select("cell_id"))
    if not large.take(1):
        return _attribute_by_task(coords, nodes, attr, radius, keep)
    by_task = _attribute_by_task(coords.join(large, "cell_id", "left_anti"), nodes.join(large, "cell_id", "left_anti"), attr, radius, keep)
    return by_task.unionByName(_attribute_by_blocks(coords.join(large, "cell_id", "left_semi"), nodes.join(large, "cell_id", "left_semi"), attr, radius, keep))


def _attribute_by_task(coords: DataFrame, nodes: DataFrame, attr: str, radius: float, keep: tuple[str, ...]) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in coords.schema}
    names = ["cell_id", "query_id", *keep]
    value = nodes.schema[attr].dataType.simpleString()
    out = ", ".join(f"{c} {kind[c]}" for c in names) + f", near {value}, vote {value}"

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return q[names].assign(near=None, vote=None) if len(q) else pd.DataFrame({c: [] for c in [*names, "near", "vote"]})
        p = p.sort_values("id", kind="stable")
        at, asked = p[["px", "py", "pz"]].to_numpy(float), q[list(XYZ)].to_numpy(float)
        held = p["pv"].to_numpy()
        place, _ = k_nearest(at, asked, 1)
        frame = q[names].assign(near=held[place[:, 0]], vote=None)
        if radius > 0:
            codes, values = pd.factorize(p["pv"], sort=True)
            each = (codes[:, None] == np.arange(-1, len(values))[None]).astype(np.int64)  # the first column counts nodes without a value
            most = np.zeros(len(q), np.int64)
            for i in range(0, len(q), step := max(1, DISTANCES // len(p))):
                d = asked[i : i + step, None, :] - at[None]
                n = (np.sqrt((d * d).sum(2)) <= radius).astype(np.int64) @ each
                most[i : i + step] = np.where(n.max(1) > 0, n.argmax(1), 0)
            frame["vote"] = np.append(np.array([None], object), np.asarray(values, object))[most]
        return frame

    own = nodes.where("cell_id is not null").select(F.col("cell_id").alias("pk"), F.col("node_id").alias("id"), *[F.col(c).alias(f"p{c}") for c in XYZ], F.col(attr).alias("pv"))
    tasks = int(coords.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = coords.select(*names, *XYZ).repartition(tasks, "cell_id")
    got = asked.groupBy("cell_id").cogroup(own.repartition(tasks, "pk").groupBy("pk")).applyInPandas(run, out)
    return got.select(*names, F.coalesce("vote", "near", F.lit(-1)).alias(attr))


def _attribute_by_blocks(coords: DataFrame, nodes: DataFrame, attr: str, radius: float, keep: tuple[str, ...]) -> DataFrame:
    nearest = nearest_in_group(coords, nodes.withColumnRenamed("node_id", "id"), "cell_id", 1, attr).select("cell_id", "query_id", F.col("value").alias("near"))
    out = coords.select("cell_id", "query_id", *keep).join(nearest, ["cell_id", "query_id"], "left")
    if radius <= 0:
        return out.select("cell_id", "query_id", *keep, F.coalesce("near", F.lit(-1)).alias(attr))
    inside = pairs_within(coords.withColumnRenamed("query_id", "id"), nodes.withColumnRenamed("node_id", "id"), radius, on=["cell_id"])
    values = inside.select("cell_id", F.col("id_a").alias("query_id"), F.col("id_b").alias("node_id")).join(nodes.select("cell_id", "node_id", attr), ["cell_id", "node_id"])
    voted = mode_smallest(values, ["cell_id", "query_id"], attr, "vote").drop("vote_count")
    return out.join(voted, ["cell_id", "query_id"], "left").select("cell_id", "query_id", *keep, F.coalesce("vote", "near", F.lit(-1)).alias(attr))


def transfer_labels(queries: DataFrame, points: DataFrame, k: int, key: str = "obj_id", ignore: tuple[int, ...] = (), stride: int = 1) -> DataFrame:
    """K9: majority label of the ``k`` nearest labelled points, ties to the one met first by distance; K10 is k = 1."""
    kept = points.where(~F.col("label").isin(list(ignore))) if ignore else points
    kept = kept.where(F.col("id") % stride == 0) if stride > 1 else kept
    near = nearest_in_group(queries, kept, key, k, "label")
    return mode_nearest(near, [key, "query_id"], "value", "rank", "label")


def soma_distance(coords: DataFrame, nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    """Path length from each coordinate's nearest node to the soma; infinite without soma nodes or path."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"cell_id": [], "id": [], "soma_dist": []})
        dist = dijkstra(_weights(e) if len(e) else {}, n.loc[n["axoness"] == 2, "node_id"].tolist())
        return pd.DataFrame({"cell_id": n["cell_id"], "id": n["node_id"], "soma_dist": [dist.get(i, float("inf")) for i in n["node_id"].tolist()]})

    left, right = nodes.select("cell_id", "node_id", "axoness"), weighted.select(F.col("cell_id").alias("cell"), "src", "dst", "length")
    per_node = left.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(run, "cell_id long, id long, soma_dist double")
    near = nearest_in_group(coords, nodes.withColumnRenamed("node_id", "id"), "cell_id", 1).select("cell_id", "query_id", "id")
    return near.join(per_node, ["cell_id", "id"]).select("cell_id", "query_id", "soma_dist")


def path_between(pairs: DataFrame, nodes: DataFrame, weighted: DataFrame, match: float, cutoff: float) -> DataFrame:
    """Path length between two points of a cell's skeleton; -5 where a point is farther than ``match`` from it or the path longer than ``cutoff``."""

    def run(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        cols = ["cell_id", "pair_id", "dist"]
        if not len(p):
            return pd.DataFrame({c: [] for c in cols})
        adj, rows = _weights(e) if len(e) else {}, []
        for pair, a, b, ok in zip(p["pair_id"].tolist(), p["a"].tolist(), p["b"].tolist(), p["ok"].tolist()):
            d = dijkstra(adj, [int(a)], cutoff).get(int(b)) if ok else None
            rows.append((p["cell_id"].iloc[0], pair, -5.0 if d is None else d))
        return pd.DataFrame(rows, columns=cols)

    near = None
    for s in "ab":
        q = pairs.select("cell_id", F.col("pair_id").alias("query_id"), *[F.col(f"{c}_{s}").alias(c) for c in XYZ])
        got = nearest_in_group(q, nodes.withColumnRenamed("node_id", "id"), "cell_id", 1).select("cell_id", F.col("query_id").alias("pair_id"), F.col("id").alias(s), F.col("dist").alias(f"d_{s}"))
        near = got if near is None else near.join(got, ["cell_id", "pair_id"])
    ready = near.withColumn("ok", (F.col("d_a") <= match) & (F.col("d_b") <= match))
    right = weighted.select(F.col("cell_id").alias("cell"), "src", "dst", "length")
    return ready.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(run, "cell_id long, pair_id long, dist double")


def surface_path(vertices: DataFrame, near: float, k: int, free: float = 0.0001) -> DataFrame:
    """Length of the way along the surfaces of a path's parts, counted inside some parts alone (astrocyte fragments).

    ``vertices`` has path_id, part (in the order of the path), vid, x, y, z and counted.
    A vertex is linked to the ``k`` nearest of its part within ``near`` and to the nearest
    of the part before within ``near``; a link costs its length in a counted part, else
    nothing, or ``free`` where it leads to an uncounted part. From the first vertex of the first part to
    the last of the last; infinite if there is no way. ``(path_id, length)``.

    Links are found by all tasks (:func:`nearest_in_group`); the way over a path's links is one task's.
    """

    v = vertices.select("path_id", "part", "vid", *XYZ, "counted")
    pieces = cut(v.select("path_id", "part").distinct().withColumn("piece", F.monotonically_increasing_id()))
    one_before = lambda c: F.lag(c).over(Window.partitionBy("path_id").orderBy("part"))
    parts = cut(pieces.select("*", one_before("part").alias("before"), one_before("piece").alias("piece_before")))
    v = cut(v.join(pieces, ["path_id", "part"]))
    points = v.select("piece", F.col("vid").alias("id"), *XYZ)
    asked = v.select("piece", F.col("vid").alias("query_id"), *XYZ)
    own = nearest_in_group(asked, points, "piece", k + 1).where((F.col("query_id") != F.col("id")) & (F.col("dist") <= near))
    back = asked.join(parts.where("before is not null").select("piece", "piece_before"), "piece").select(F.col("piece_before").alias("piece"), "query_id", *XYZ)
    back = nearest_in_group(back, points, "piece", 1).where(F.col("dist") <= near)
    ends = lambda to: [F.col("path_id").alias("path"), F.col("part").alias("part_u"), F.col("query_id").alias("u"), F.col(to).alias("part_v"), F.col("id").alias("v"), "dist"]
    links = own.join(parts, "piece").select(ends("part")).unionByName(back.join(parts.drop("piece").withColumnRenamed("piece_before", "piece"), "piece").select(ends("before")))

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"path_id": [], "length": []})
        n = n.sort_values(["part", "vid"])
        length = 0.0 if len(n) == 1 else float("inf")
        if len(e) and len(n) > 1:
            (p, of), (vid, at) = (np.unique(n[c].to_numpy(), return_inverse=True) for c in ("part", "vid"))
            code = of * len(vid) + at  # ascending as the rows are
            place = lambda s: np.searchsorted(code, np.searchsorted(p, e[f"part_{s}"].to_numpy()) * len(vid) + np.searchsorted(vid, e[s].to_numpy()))
            u, v, d = place("u"), place("v"), e["dist"].to_numpy()
            cost = np.where(n["counted"].to_numpy(bool)[u], d, np.where(e["part_u"].to_numpy() == e["part_v"].to_numpy(), 0.0, free))
            length = _way(len(n), u, v, cost)
        return pd.DataFrame({"path_id": [n["path_id"].iloc[0]], "length": [length]})

    return v.select("path_id", "part", "vid", "counted").groupBy("path_id").cogroup(links.groupBy("path")).applyInPandas(run, "path_id long, length double")


def _way(n: int, u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> float:
    """Shortest way from the first to the last of ``n`` nodes over links of both directions."""
    a, b, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([cost, cost])
    order = np.argsort(a, kind="stable")
    to, w, start = b[order], w[order], np.searchsorted(a[order], np.arange(n + 1))
    dist, done, heap = np.full(n, np.inf), np.zeros(n, bool), [(0.0, 0)]
    dist[0] = 0.0
    while heap:
        d, i = heapq.heappop(heap)
        if i == n - 1:
            return d
        if done[i]:
            continue
        done[i] = True
        near, e = to[start[i] : start[i + 1]], d + w[start[i] : start[i + 1]]
        for j in np.flatnonzero(e < dist[near]).tolist():
            if e[j] < dist[near[j]]:
                dist[near[j]] = e[j]
                heapq.heappush(heap, (float(e[j]), int(near[j])))
    return float("inf")


def _branches(adj: dict[int, list[int]]) -> list[list[int]]:
    """End branches: from each leaf up to, not including, the first branching node."""
    out = []
    for leaf in sorted(n for n in adj if len(adj[n]) == 1):
        walk, before, at = [leaf], None, leaf
        while True:
            on = [m for m in adj[at] if m != before]
            if len(on) != 1 or len(adj[on[0]]) > 2:
                out.append(walk + on[:1] if on else walk + [None])
                break
            before, at = at, on[0]
            walk.append(at)
            if len(adj[at]) == 1:
                out.append(walk + [None])
                break
    return out


def prune_branches(nodes: DataFrame, edges: DataFrame, shorter: float, by_path: bool = False) -> DataFrame:
    """K17 (straight line), K18 (path): end branches below a length go, again until none is left; remaining ``(cell_id, node_id)``."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"cell_id": [], "node_id": []})
        at = dict(zip(n["node_id"].tolist(), n[list(XYZ)].to_numpy(float)))
        adj = {i: [] for i in at} | (_adjacency(e) if len(e) else {})
        while True:
            gone: set[int] = set()
            for b in _branches(adj):
                end = b[-1]
                if end is None or len(adj[end]) <= 2:
                    continue
                pts = [at[i] for i in b]
                d = sum(float(np.linalg.norm(p - q)) for p, q in zip(pts, pts[1:])) if by_path else float(np.linalg.norm(pts[0] - pts[-1]))
                if d < shorter and len([m for m in adj[end] if m not in gone]) > 2:
                    gone.update(b[:-1])
            if not gone:
                break
            adj = {i: [m for m in v if m not in gone] for i, v in adj.items() if i not in gone}
        return pd.DataFrame({"cell_id": n["cell_id"].iloc[0], "node_id": sorted(adj)})

    left, right = nodes.select("cell_id", "node_id", *XYZ), edges.select(F.col("cell_id").alias("cell"), "src", "dst")
    return left.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(run, "cell_id long, node_id long")


def thin(nodes: DataFrame, edges: DataFrame, near: float, far: float, straight: float) -> DataFrame:
    """Nodes of degree 2 go, in order of id, where their neighbours are closer than ``near``, or straight enough and closer than ``far``.

    Straightness is the direct distance of the neighbours over the way through the node. Gives the new edges.
    """

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n) or not len(e):
            return pd.DataFrame({"cell_id": [], "src": [], "dst": []})
        at = dict(zip(n["node_id"].tolist(), n[list(XYZ)].to_numpy(float)))
        adj = {k: set(v) for k, v in _adjacency(e).items()}
        for i in sorted(adj):
            if len(adj[i]) != 2:
                continue
            a, b = sorted(adj[i])
            if b in adj[a]:
                continue
            direct = float(np.linalg.norm(at[a] - at[b]))
            way = float(np.linalg.norm(at[a] - at[i]) + np.linalg.norm(at[i] - at[b]))
            if direct < near or (direct < far and (way == 0 or direct / way >= straight)):
                adj[a].remove(i), adj[b].remove(i)
                adj[a].add(b), adj[b].add(a)
                del adj[i]
        rows = sorted({(min(a, b), max(a, b)) for a in adj for b in adj[a]})
        return pd.DataFrame({"cell_id": n["cell_id"].iloc[0], "src": [r[0] for r in rows], "dst": [r[1] for r in rows]})

    left, right = nodes.select("cell_id", "node_id", *XYZ), edges.select(F.col("cell_id").alias("cell"), "src", "dst")
    return left.groupBy("cell_id").cogroup(right.groupBy("cell")).applyInPandas(run, "cell_id long, src long, dst long")


def weld(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of equal coordinates of one cell become one (the smallest id), edges follow; loops and repeats go."""
    to = nodes.groupBy("cell_id", *XYZ).agg(F.min("node_id").alias("new"))
    m = nodes.join(to, ["cell_id", *XYZ]).select("cell_id", "node_id", "new")
    a = edges.join(m.toDF("cell_id", "src", "a"), ["cell_id", "src"]).join(m.toDF("cell_id", "dst", "b"), ["cell_id", "dst"])
    kept = a.where("a <> b").select("cell_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return to.select("cell_id", F.col("new").alias("node_id"), *XYZ), kept


def grid_means(points: DataFrame, key: str, step: float) -> DataFrame:
    """Mean point of each grid cell."""
    cell = [F.floor(F.col(c) / step).alias(f"g{c}") for c in XYZ]
    return points.groupBy(key, *cell).agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("n"))


def density_samples(points: DataFrame, key: str, bins: float, most: int, radius: float) -> DataFrame:
    """The ``most`` fullest bins per key (ties in bin order), each as the mean of the points within ``radius`` of the bin's point nearest its centre."""
    binned = points.select(key, "id", *XYZ, *[F.floor(F.col(c) / bins).alias(f"g{c}") for c in XYZ])
    g = ["gx", "gy", "gz"]
    centre = sum((F.col(c) - (F.col(f"g{c}") + 0.5) * bins) ** 2 for c in XYZ)
    counts = binned.groupBy(key, *g).agg(F.count("*").alias("n"), F.min(F.struct(centre.alias("d"), "id", *XYZ)).alias("p"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), *g)
    top = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    seeds = top.select(key, F.col("rn").alias("id"), *[F.col(f"p.{c}").alias(c) for c in XYZ])
    near = pairs_within(seeds, points, radius, on=[key])
    return near.groupBy(key, F.col("id_a").alias("rank")).agg(*[F.avg(f"{c}_b").alias(c) for c in XYZ], F.count("*").alias("n"))


def node_diameters(nodes: DataFrame, vertices: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """Twice the median of the ``k`` nearest vertex distances, over 10, times ``factor``."""
    near = nearest_in_group(nodes.withColumnRenamed("node_id", "query_id"), vertices, "cell_id", k)
    return near.groupBy("cell_id", F.col("query_id").alias("node_id")).agg((F.percentile("dist", 0.5) * 2 / 10 * factor).alias("diameter"))


def label_components(points: DataFrame, radius: float, key: str, least: int) -> DataFrame:
    """Per key and label, components of points within ``radius``; small ones go; mean position and size of the rest."""
    joined = clusters(points.select(key, "label", "id", *XYZ), radius, [key, "label"], strict=False)
    return joined.groupBy(key, "label", "component").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in XYZ]).where(F.col("n") >= least)


def complete_cells(nodes: DataFrame) -> DataFrame:
    """Cells with dendrite, axon and soma nodes, and the mean soma position."""
    soma = F.col("axoness") == 2
    return (
        nodes.groupBy("cell_id")
        .agg(*[F.max((F.col("axoness") == k).cast("int")).alias(f"has{k}") for k in range(3)], *[F.avg(F.when(soma, F.col(c))).alias(f"soma_{c}") for c in XYZ])
        .where("has0 = 1 and has1 = 1 and has2 = 1")
        .drop("has0", "has1", "has2")
    )


def corners(faces: DataFrame, vertices: DataFrame, attrs: tuple[str, ...] = XYZ, key: str = "obj_id") -> DataFrame:
    """Faces with the attributes of their three vertices as ``<attr>_a``, ``_b``, ``_c``."""
    out = faces
    for s in "abc":
        out = out.join(vertices.select(key, F.col("vid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in attrs]), [key, s])
    return out


def cross() -> list[Column]:
    """Cross product of the face's two edges at its first vertex."""
    d = lambda c, s: F.col(f"{c}_{s}") - F.col(f"{c}_a")
    return [d("y", "b") * d("z", "c") - d("z", "b") * d("y", "c"), d("z", "b") * d("x", "c") - d("x", "b") * d("z", "c"), d("x", "b") * d("y", "c") - d("y", "b") * d("x", "c")]


def mesh_area(faces: DataFrame, vertices: DataFrame, key: str = "obj_id") -> DataFrame:
    """Surface in µm² of meshes given in nm."""
    a, b, c = cross()
    return corners(faces, vertices, key=key).groupBy(key).agg((F.sum(F.sqrt(a * a + b * b + c * c) / 2) / 1e6).alias("area"))


def merged_faces(faces: DataFrame, vertices: DataFrame, key: str = "obj_id") -> DataFrame:
    """Faces of one mesh made of all: vertex numbers within each mesh, shifted by the vertices of the meshes before it."""
    shift = running_total(vertices.groupBy(key).agg(F.count("*").alias("n")), [key], F.col("n"), "shift").drop("n")
    place = vertices.select(key, "vid", (F.row_number().over(Window.partitionBy(key).orderBy("vid")) - 1).alias("p"))
    out = faces
    for s in "abc":
        out = out.join(place.toDF(key, s, f"p{s}"), [key, s])
    return out.join(shift, key).select(key, "fid", *[(F.col(f"p{s}") + F.col("shift")).alias(s) for s in "abc"])


def mesh_box(vertices: DataFrame, key: str = "obj_id") -> DataFrame:
    """Box of a mesh and its diagonal."""
    box = vertices.groupBy(key).agg(*[F.min(c).alias(f"min_{c}") for c in XYZ], *[F.max(c).alias(f"max_{c}") for c in XYZ])
    return box.withColumn("diagonal", F.sqrt(sum((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in XYZ)))


def face_labels(faces: DataFrame, vertices: DataFrame, key: str = "obj_id") -> DataFrame:
    """A face's label is what two of its vertices have, -1 if all differ."""
    a, b, c = (F.col(f"label_{s}") for s in "abc")
    return corners(faces, vertices, ("label",), key).select(key, "fid", F.when((a == b) | (a == c), a).when(b == c, b).otherwise(-1).alias("label"))


def vertex_normals(faces: DataFrame, vertices: DataFrame, key: str = "obj_id") -> DataFrame:
    """Negated sum of the unit normals of the faces at each vertex."""
    n = cross()
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [F.when(size > 0, v / size).otherwise(0.0).alias(f"n{c}") for v, c in zip(n, XYZ)]
    each = corners(faces, vertices, key=key).select(key, F.explode(F.array("a", "b", "c")).alias("vid"), *unit)
    return each.groupBy(key, "vid").agg(*[(-F.sum(f"n{c}")).alias(f"n{c}") for c in XYZ])


def empty_spaces(coords: DataFrame, vertices: DataFrame, edge: float) -> DataFrame:
    """Coordinates without a vertex in a box of ``edge`` round them.

    Vertices fall into cells of half the box. A coordinate is met by the cells' corners alone, a row a cell: a
    cell whose vertices all lie in the box settles it. Only where no such cell is, single vertices are looked at.
    """
    half = edge / 2
    cell = lambda c: F.floor(c / half).cast("long")
    grid = [f"g{c}" for c in XYZ]
    reach = coords.select("id", *[F.col(c).alias(f"{c}_a") for c in XYZ])
    for c in XYZ:
        reach = reach.select("*", F.explode(F.sequence(cell(F.col(f"{c}_a") - half), cell(F.col(f"{c}_a") + half))).alias(f"g{c}"))
    vox = vertices.select(*[F.col(c).alias(f"{c}_b") for c in XYZ], *[cell(F.col(c)).alias(f"g{c}") for c in XYZ])
    ends = [f(f"{c}_b").alias(f"{n}_{c}") for c in XYZ for n, f in (("low", F.min), ("high", F.max))]
    # a coordinate is many rows here, which no estimate of Spark's knows of: neither side may go through the driver
    met = reach.join(vox.groupBy(*grid).agg(*ends).hint("merge"), grid)
    for c in XYZ:
        met = met.where((F.col(f"high_{c}") >= F.col(f"{c}_a") - half) & (F.col(f"low_{c}") < F.col(f"{c}_a") + half))
    inside = [(F.col(f"low_{c}") >= F.col(f"{c}_a") - half) & (F.col(f"high_{c}") < F.col(f"{c}_a") + half) for c in XYZ]
    met = cut(met.select("id", *[f"{c}_a" for c in XYZ], *grid, (inside[0] & inside[1] & inside[2]).alias("sure")))
    full = met.where("sure").select("id").distinct()
    hit = met.join(full.hint("merge"), "id", "left_anti").join(vox.hint("merge"), grid)
    for c in XYZ:
        hit = hit.where((F.col(f"{c}_b") >= F.col(f"{c}_a") - half) & (F.col(f"{c}_b") < F.col(f"{c}_a") + half))
    return coords.join(full.unionByName(hit.select("id").distinct()).hint("merge"), "id", "left_anti")
