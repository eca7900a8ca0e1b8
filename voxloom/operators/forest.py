"""Minimum spanning forests of graphs of any size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut, drop_cut

#: Edges of a group that one task sorts; larger groups are contracted first.
TASK_EDGES = 200_000


class Sets:
    """Union by smallest member."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, a):
        self.parent.setdefault(a, a)
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _by_task(live: DataFrame, order: list[str]) -> DataFrame:
    """Kruskal on each group; ``u`` and ``v`` are what the ends were contracted to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sets = Sets()
        keep = [sets.join(a, b) for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist())]
        return pdf[keep][["grp", *order]]

    kinds = {f.name: f.dataType.simpleString() for f in live.schema}
    return live.select("grp", "u", "v", *order).groupBy("grp").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ["grp", *order]))


def _roots(picks: DataFrame) -> DataFrame:
    """``(grp, u, rep)`` from each node's pick ``p``: the smaller of two that pick each other, found by doubling of the pointers."""
    back = picks.select("grp", F.col("u").alias("p"), F.col("p").alias("pp"))
    ptr = cut(picks.join(back.hint("merge"), ["grp", "p"]).select("grp", "u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p")))
    while True:
        step = ptr.select("grp", F.col("u").alias("p"), F.col("p").alias("pp"))
        nxt = cut(ptr.join(step.hint("merge"), ["grp", "p"]).select("grp", "u", "pp", (F.col("p") != F.col("pp")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        drop_cut(ptr)
        ptr = nxt.select("grp", "u", F.col("pp").alias("p"))
        if not moved:
            return ptr.withColumnRenamed("p", "rep")


def spanning_forest(edges: DataFrame, key: str, order: list[str], task_edges: int = TASK_EDGES) -> DataFrame:
    """The edges ``(key, *order)`` of the minimum spanning forest of each group.

    ``edges`` has the group, ``src``, ``dst`` and the columns of ``order``, by which edges compare: all of them
    together tell the edges of a group apart, so the forest is one and the same however it is found.
    Of equal rows one counts.

    A group of at most ``task_edges`` edges is one task's. In a larger one each node picks its least edge; those are in the
    forest, and the graph is contracted onto what they join (picks point along falling edges, and pointer
    doubling finds where they lead). Tables of nodes are joined by shuffles and never sent through the driver. Nodes fall to half at least in a round, and parallel edges
    to one, until the group fits. No task holds more of a group than that. Self-loops and nulls at an end are left out.
    """
    named = edges.select(F.col(key).alias("grp"), F.col("src").alias("u"), F.col("dst").alias("v"), *[F.col(c).alias(f"o_{c}") for c in order])
    order_cols = [f"o_{c}" for c in order]
    live = cut(named.where("u is not null and v is not null and u <> v").distinct())
    done: list[DataFrame] = []
    while True:
        sizes = cut(live.groupBy("grp").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > task_edges)
        if not large.take(1):
            done.append(_by_task(live, order_cols))
            break
        small = live.join(large.select("grp"), "grp", "left_anti")
        done.append(cut(_by_task(small, order_cols)))
        live = live.join(large.select("grp"), "grp", "left_semi")
        rank = F.struct(*order_cols)
        both = live.select("grp", "u", "v", *order_cols).unionByName(live.select("grp", F.col("v").alias("u"), F.col("u").alias("v"), *order_cols))
        best = cut(both.groupBy("grp", "u").agg(F.min(F.struct(rank.alias("r"), F.col("v"))).alias("b")))
        done.append(best.select("grp", *[F.col(f"b.r.{c}").alias(c) for c in order_cols]).distinct())
        reps = _roots(best.select("grp", "u", F.col("b.v").alias("p")))
        a, b = reps.withColumnRenamed("rep", "ru"), reps.withColumnsRenamed({"u": "v", "rep": "rv"})
        merged = live.join(a.hint("merge"), ["grp", "u"]).join(b.hint("merge"), ["grp", "v"]).where("ru <> rv")
        pairs = merged.groupBy("grp", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min(rank).alias("r"))
        live = cut(pairs.select("grp", "u", "v", "r.*"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("grp").alias(key), *[F.col(f"o_{c}").alias(c) for c in order])
