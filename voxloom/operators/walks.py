"""Breadth-first neighbourhoods and depth-first chunks of graphs of any size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.forest import TASK_EDGES, spanning_forest
from voxloom.session import cut, drop_cut, running_total


def neighbour_lists(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``(component, a, b)``: both directions of every edge once, loops left out; of each node the ``most`` smallest neighbours."""
    named = edges.select("component", F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null and a <> b")
    both = named.unionByName(named.select("component", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    if most is None:
        return both
    place = F.row_number().over(Window.partitionBy("component", "a").orderBy("b"))
    return both.withColumn("k", place).where(F.col("k") <= most).drop("k")


def bfs_neighbourhoods(edges: DataFrame, most: int, starts: DataFrame | None = None) -> DataFrame:
    """``(component, node, place, member)``: the first ``most`` nodes of a breadth-first walk from each node, itself at place 0.

    ``edges`` has component, src, dst; neighbours are met by ascending id. ``starts(component, node)`` limits where walks begin.

    All walks go on at once, ring by ring: the ring's nodes meet their neighbours, each new node goes to the
    first that met it, and a walk that is full stops. Of a node's neighbours the first ``most`` are enough, since a walk of
    fewer than ``most`` nodes knows fewer of them; so a hub costs a walk no more than that. A task holds the rings of its walks.
    """
    lists = cut(neighbour_lists(edges, most))
    nodes = lists.select("component", F.col("a").alias("node")).distinct() if starts is None else starts.select("component", "node").distinct()
    ring = cut(nodes.select("component", "node", F.lit(0).alias("place"), F.col("node").alias("member")))
    rings = [ring]
    met = ring
    while True:
        meets = ring.join(lists.withColumnRenamed("a", "member"), ["component", "member"]).groupBy("component", "node", F.col("b").alias("member")).agg(F.min("place").alias("by"))
        new = meets.join(met.select("component", "node", "member"), ["component", "node", "member"], "left_anti")
        known = met.groupBy("component", "node").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("component", "node").orderBy("by", "member"))
        placed = new.withColumn("k", place).join(known, ["component", "node"]).select("component", "node", (F.col("n") + F.col("k") - 1).cast("int").alias("place"), "member")
        ring = cut(placed.where(F.col("place") < most))
        if not ring.take(1):
            break
        rings.append(ring)
        met = met.unionByName(ring)
    return met


def _tour_by_task(arcs: DataFrame) -> DataFrame:
    """Preorder of small trees: ``(component, node, place)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists: dict = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            lists.setdefault(a, []).append(b)
        root = min(lists)
        stack, order = [(root, root)], []
        while stack:
            n, parent = stack.pop()
            order.append(n)
            stack += [(m, n) for m in sorted(lists[n], key=lambda m: (m < parent, m), reverse=True) if m != parent]  # noqa: B023
        return pd.DataFrame({"component": pdf["component"].iloc[0], "node": order, "place": range(len(order))})

    return arcs.groupBy("component").applyInPandas(run, "component long, node long, place long")


def _tour_by_doubling(arcs: DataFrame) -> DataFrame:
    """The same for large trees: the arcs of a tour round the tree are ranked by pointer doubling.

    After arc (a, b) comes (b, c) with c the next neighbour of b behind a, and the smallest one behind the largest;
    the tour begins at the smallest node and ends with the arc that would repeat its first one.
    """
    w = Window.partitionBy("component", "a").orderBy("b")
    lists = cut(arcs.select("component", "a", "b", F.lead("b").over(w).alias("next"), F.min("b").over(w).alias("first")))
    start = lists.groupBy("component").agg(F.min(F.struct("a", "b")).alias("s"))
    follow = lists.select("component", F.col("a").alias("b"), F.col("b").alias("a"), F.coalesce("next", "first").alias("c"), F.col("next").isNull().alias("wraps"))
    joined = follow.join(start, "component")  # arc (a, b) goes on to (b, c)
    last = F.col("wraps") & (F.col("b") == F.col("s.a"))
    arc = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ptr = cut(joined.select("component", arc("a", "b").alias("arc"), F.when(~last, arc("b", "c")).alias("to"), F.when(~last, 1).otherwise(0).cast("long").alias("left")))
    while ptr.where("to is not null").limit(1).count():  # left: arcs from here to the end, as far as followed
        ahead = ptr.select("component", F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        moving = ptr.where("to is not null").join(ahead, ["component", "to"]).select("component", "arc", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"))
        nxt = cut(moving.unionByName(ptr.where("to is null")))
        drop_cut(ptr)
        ptr = nxt
    back = ptr.select("component", F.struct(F.col("arc.b").alias("a"), F.col("arc.a").alias("b")).alias("arc"), F.col("left").alias("left_back"))
    down = ptr.join(back, ["component", "arc"]).where(F.col("left") > F.col("left_back"))  # an arc away from the root comes before its return
    met = down.select("component", F.col("arc.b").alias("node"), (-F.col("left")).alias("at"))
    roots = start.select("component", F.col("s.a").alias("node"), F.lit(-(1 << 62)).alias("at"))
    numbered = running_total(met.unionByName(roots), ["component", "at"], F.lit(1), "nr")
    first = numbered.groupBy("component").agg(F.min("nr").alias("low"))
    return numbered.join(first, "component").select("component", "node", (F.col("nr") - F.col("low")).alias("place"))


def depth_first(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(component, node, place)``: depth-first order of each component's spanning tree from its smallest node.

    Children come by ascending id, those above their grandparent's first: the order of a tour round the tree that turns to
    the next larger neighbour at every node. The tree is the minimum spanning tree by (src, dst); a component that is a tree is walked as it is.
    Depth-first order of a graph with cycles is inherently one step after the other, that of a tree is not. Small trees
    are walked by a task each, large ones by ranking the arcs of a tour; both give the same order.
    """
    ends = edges.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    arcs = cut(neighbour_lists(spanning_forest(ends, "component", ["src", "dst"], task_edges)))
    large = cut(arcs.groupBy("component").agg(F.count("*").alias("n"))).where(F.col("n") > 2 * task_edges).select("component")
    if not large.take(1):
        return _tour_by_task(arcs)
    return _tour_by_task(arcs.join(large, "component", "left_anti")).unionByName(_tour_by_doubling(arcs.join(large, "component", "left_semi")))


def dfs_chunks(edges: DataFrame, size: int, context: int = 0, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(component, chunk, node, core)``: chunks of ``size`` nodes in depth-first order, see :func:`depth_first`, with context.

    The context of a chunk are the first ``context`` nodes that a breadth-first walk meets after each of its nodes.
    """
    core = depth_first(edges, task_edges).select("component", F.floor(F.col("place") / size).cast("int").alias("chunk"), "node")
    core = cut(core)
    out = core.withColumn("core", F.lit(True))
    if context:
        near = bfs_neighbourhoods(edges, context + 1).where("place > 0").join(core, ["component", "node"]).select("component", "chunk", F.col("member").alias("node")).distinct()
        out = out.unionByName(near.join(core, ["component", "chunk", "node"], "left_anti").withColumn("core", F.lit(False)))
    return out
