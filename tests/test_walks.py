"""Walks on graphs of any size against plain ones."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import walks


def adjacency(rows):
    out = collections.defaultdict(set)
    for g, a, b in rows:
        if a != b:
            out[g, a].add(b)
            out[g, b].add(a)
    return {k: sorted(v) for k, v in out.items()}


def plain_bfs(adj, g, start, most):
    queue, i = [start], 0
    while i < len(queue) and len(queue) < most:
        queue += [n for n in adj[g, queue[i]] if n not in queue]
        i += 1
    return queue[:most]


def random_tree(rng, g, n):
    name = rng.permutation(n).tolist()
    return [(g, name[k], name[int(rng.integers(max(0, k - 6), k))]) for k in range(1, n)]


def graphs(seed):
    rng = np.random.default_rng(seed)
    rows = random_tree(rng, 1, 40) + random_tree(rng, 2, 2) + random_tree(rng, 3, 90)
    rows += [(4, k, k + 1) for k in range(30)] + [(5, 0, k) for k in range(1, 50)]  # a chain and a hub
    rows += random_tree(rng, 6, 50) + [(6, *map(int, p)) for p in rng.integers(0, 50, (40, 2))]  # with cycles, loops and repeated edges
    return rows + rows[:5]


@pytest.mark.parametrize("most", [1, 2, 7, 60])
def test_breadth_first_walks(spark, most):
    rows = graphs(1)
    adj = adjacency(rows)
    got = collections.defaultdict(dict)
    for r in walks.bfs_neighbourhoods(spark.createDataFrame(rows, "component long, src long, dst long").repartition(3), most).collect():
        assert r.place not in got[r.component, r.node]
        got[r.component, r.node][r.place] = r.member
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {(g, n): plain_bfs(adj, g, n, most) for g, n in adj}


def test_walks_from_given_nodes(spark):
    df = spark.createDataFrame(graphs(2), "component long, src long, dst long")
    starts = df.where("component = 4 and src in (3, 9)").select("component", F.col("src").alias("node"))
    got = walks.bfs_neighbourhoods(df, 4, starts).groupBy("node").agg(F.sort_array(F.collect_list("member")).alias("m")).collect()
    assert {r.node: r.m for r in got} == {3: [1, 2, 3, 4], 9: [7, 8, 9, 10]}
    assert walks.bfs_neighbourhoods(df.limit(0), 4).count() == 0


def plain_dfs(rows, g):
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    kids = collections.defaultdict(list)
    for a, b in sorted({(min(a, b), max(a, b)) for k, a, b in rows if k == g and a != b}):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            kids[a].append(b)
            kids[b].append(a)
    order = []

    def visit(n, before):
        order.append(n)
        children = sorted(set(kids[n]) - {before})
        for m in [c for c in children if c > before] + [c for c in children if c < before]:
            visit(m, n)

    visit(min(kids), min(kids))
    return order


@pytest.mark.parametrize("task_edges", [200_000, 60, 1])
def test_depth_first_order_by_task_and_by_doubling(spark, task_edges):
    rows = graphs(3)
    got = collections.defaultdict(dict)
    for r in walks.depth_first(spark.createDataFrame(rows, "component long, src long, dst long").repartition(3), task_edges).collect():
        got[r.component][r.place] = r.node
    assert {g: [v[i] for i in range(len(v))] for g, v in got.items()} == {g: plain_dfs(rows, g) for g in range(1, 7)}


def test_chunks_and_their_context(spark):
    rows = graphs(4)
    adj = adjacency(rows)
    got = collections.defaultdict(set)
    for r in walks.dfs_chunks(spark.createDataFrame(rows, "component long, src long, dst long"), 10, 3).collect():
        got[r.component, r.chunk].add((r.node, r.core))
    want = {}
    for g in range(1, 7):
        order = plain_dfs(rows, g)
        for k in range(0, len(order), 10):
            core = set(order[k : k + 10])
            context = {m for n in core for m in plain_bfs(adj, g, n, 4)} - core
            want[g, k // 10] = {(n, True) for n in core} | {(n, False) for n in context}
    assert got == want
