"""Shortest links between components by rounds and by task against a plain search."""

import numpy as np
import pytest

from voxloom.operators import graph as G


def skeletons(seed):
    """Groups of scattered chains in the plane and in space, some on a grid where links tie."""
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for g, n_chains, spread, whole in ((1, 9, 60, False), (2, 2, 10, False), (3, 12, 8, True), (4, 1, 5, False), (5, 5, 900, False)):
        k = 0
        for _ in range(n_chains):
            at = rng.uniform(0, spread, 3) * (1, 1, g % 2)
            for i in range(int(rng.integers(1, 7))):
                at = at + rng.normal(0, 1, 3)
                nodes.append((g, k, *map(float, np.round(at) if whole else at)))
                if i:
                    edges.append((g, k - 1, k))
                k += 1
    return nodes, edges


def plain(nodes, edges):
    out = set()
    for g in {n[0] for n in nodes}:
        at = {n[1]: np.array(n[2:]) for n in nodes if n[0] == g}
        sets = G.Sets()
        for i in at:
            sets.root(i)
        for h, a, b in edges:
            if h == g:
                sets.join(a, b)
        for _, a, b in sorted((float(np.sqrt(((at[a] - at[b]) ** 2).sum())), a, b) for a in at for b in at if a < b):
            if sets.join(a, b):
                out.add((g, a, b))
    return out


@pytest.mark.parametrize("start", [None])
def test_links_are_the_shortest(spark, start):
    nodes, edges = skeletons(3)
    n = spark.createDataFrame(nodes, "cell_id long, node_id long, x double, y double, z double").repartition(3)
    e = spark.createDataFrame(edges, "cell_id long, src long, dst long")
    pick = lambda df: {(r.cell_id, min(r.src, r.dst), max(r.src, r.dst)) for r in df.where("added").collect()}
    rounds = G.stitch_by_rounds(n, e, start=start)
    assert pick(rounds) == plain(nodes, edges) and rounds.where("not added").count() == len(edges)
    if start is None:
        assert pick(G.stitch(n, e)) == plain(nodes, edges)


def test_large_groups_go_by_rounds(spark, monkeypatch):
    nodes, edges = skeletons(4)
    n = spark.createDataFrame(nodes, "cell_id long, node_id long, x double, y double, z double")
    e = spark.createDataFrame(edges, "cell_id long, src long, dst long")
    monkeypatch.setattr(G, "GROUP_NODES", 12)
    got = {(r.cell_id, min(r.src, r.dst), max(r.src, r.dst)) for r in G.stitch(n, e).where("added").collect()}
    assert got == plain(nodes, edges)
    assert G.stitch_by_rounds(n.limit(0), e.limit(0)).count() == 0
