"""Connected components by randomised contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut, drop_cut


#: Edges that are left to one task at most.
TASK_EDGES = 200_000


def least_members(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` nodes."""
    p = np.arange(n)
    while True:
        a, b = p[u], p[v]
        live = a != b
        if not live.any():
            return p
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while (p[p] != p).any():
            p = p[p]


def _by_task(sym: DataFrame) -> DataFrame:
    """``(u, rep)`` of a bounded number of edges."""

    def run(frames):
        held = list(frames)
        if held:
            pdf = pd.concat(held)
            names, ends = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
            yield pd.DataFrame({"u": names, "rep": names[least_members(len(names), ends[: len(pdf)], ends[len(pdf) :])]})

    kind = sym.schema["u"].dataType.simpleString()
    return sym.repartition(1).mapInPandas(run, f"u {kind}, rep {kind}")


def graph_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """:func:`connected_components` that leaves the last TASK_EDGES edges to one task."""
    return connected_components(edges, src, dst, task_edges=TASK_EDGES)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = 0) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest member.

    Each round every node picks the neighbour (or itself) that is smallest under a
    round-specific hash order, and the graph is contracted onto the picks. The
    number of nodes with edges falls by a constant factor a round whatever the
    shape (chain, star, clique), so the rounds grow with the logarithm of the
    graph. All steps are aggregations with map-side combine and equi-joins; a hub
    is one row after the aggregation, and its edges can be split by the skew join.

    Tables of nodes are small files of many rows; they are joined by shuffles, so that none is sent through the driver.

    With ``task_edges`` the rounds end when no more edges are left; whole numbers are
    then joined by one task.

    Self-loops make singletons. Nulls at either end are ignored. An empty edge
    table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    task_edges = task_edges if pairs.schema["u"].dataType.simpleString() in ("int", "bigint") else 0
    nodes = None
    live = cut(pairs.distinct())
    maps: list[DataFrame] = []
    first = live
    for k in range(max_rounds):
        sym = live.where("u <> v")
        if not (left := sym.limit(task_edges + 1).count()):
            break
        if left <= task_edges:
            maps.append(cut(_by_task(sym)))
            break
        both = sym.unionByName(sym.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
        pick = cut(
            both.groupBy("u")
            .agg(F.min(order("v")).alias("best"))
            .select("u", F.least(F.col("best"), order("u"))["id"].alias("rep"))
        )
        a, b = pick.withColumnsRenamed({"rep": "ru"}), pick.withColumnsRenamed({"u": "v", "rep": "rv"})
        nxt = cut(
            sym.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u <> v").distinct()
        )
        maps.append(pick)
        if live is not first:
            drop_cut(live)
        live = nxt
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        nodes = first.select("u").union(first.select("v")).distinct()
        return nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    label = maps[0].withColumnsRenamed({"u": "node", "rep": "at"})
    for step in maps[1:]:
        label = label.join(step.withColumnRenamed("u", "at").hint("merge"), "at", "left").select("node", F.coalesce("rep", "at").alias("at"))
    smallest = label.groupBy("at").agg(F.min("node").alias("component"))
    linked = label.join(smallest.hint("merge"), "at").select("node", "component")
    loops = first.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(linked.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)
