"""Skeletons and surfaces of larger cells: what is shuffled, and results against the plain forms."""

import numpy as np
from growth import shuffled_rows
from pyspark.sql import functions as F

from voxloom.operators import skeleton as K


def chains(spark, cells, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, i, *map(float, np.round(rng.uniform(0, 9, 3), 1)), int(rng.integers(0, 5))) for c in range(cells) for i in range(n)]
    nodes = spark.createDataFrame(rows, "cell_id long, node_id long, x double, y double, z double, axoness int").repartition(2).cache()
    edges = spark.createDataFrame([(c, int(rng.integers(0, i)), i) for c in range(cells) for i in range(1, n) if i % 17], "cell_id long, src long, dst long").cache()
    nodes.count(), edges.count()
    return nodes, edges


def test_attributes_move_no_pairs(spark, monkeypatch):
    """400 coordinates, nearly all of 300 nodes in reach of each."""
    nodes, _ = chains(spark, 2, 150)
    coords = nodes.select((F.col("cell_id") % 3).alias("cell_id"), (F.col("node_id") + 1000 * F.col("cell_id")).alias("query_id"), (F.col("x") + 0.3).alias("x"), "y", "z", F.lit(5).alias("more"))
    coords = coords.unionByName(coords.limit(3).withColumn("cell_id", F.lit(77).cast("long"))).cache()
    coords.count()
    got, rows = [], lambda df: sorted((r.cell_id, r.query_id, r.axoness) for r in df.collect())
    assert shuffled_rows(spark, lambda: got.extend(rows(K.attribute_at(coords, nodes, "axoness", 6.0)))) < 10 * 300
    assert got == rows(K._attribute_by_blocks(coords, nodes, "axoness", 6.0, ()))
    assert {r.more for r in K.attribute_at(coords, nodes, "axoness", keep=("more",)).collect()} == {5}
    monkeypatch.setattr(K, "GROUP_POINTS", 10)
    assert rows(K.attribute_at(coords, nodes, "axoness", 6.0)) == got


def test_compartments_move_a_cell_once(spark):
    """the rules of K5 and K6 in one pass, over branching trees in several parts."""
    nodes, edges = chains(spark, 3, 120)
    w = K.weighted_edges(nodes, edges).cache()
    w.count()
    folded = nodes.withColumn("axoness", F.when(F.col("axoness").isin(3, 4), 1).otherwise(F.col("axoness")))
    got = []
    assert shuffled_rows(spark, lambda: got.extend(K.smooth_compartments(nodes, w, edges, 6.0, 0.6).collect())) < 3 * 360
    ruled = {(r.cell_id, r.node_id): r.axoness for r in K.component_compartments(K.window_majority(folded, w, "axoness", 6.0), edges, 0.6).collect()}
    raw = {(r.cell_id, r.node_id): r.axoness for r in nodes.collect()}
    assert {(r.cell_id, r.node_id): r.axoness for r in got} == {k: raw[k] if v == 1 and raw[k] in (3, 4) else v for k, v in ruled.items()}
    assert len(set(ruled.values())) == 3


def test_votes_by_one_matrix_are_those_of_walks(spark, monkeypatch):
    nodes, edges = chains(spark, 2, 90, 4)
    w = K.weighted_edges(nodes, edges)
    rows = lambda: {(r.cell_id, r.node_id): r.axoness for r in K.window_majority(nodes, w, "axoness", 7.0).collect()}
    fast = rows()
    monkeypatch.setattr(K, "_votes_on_tree", lambda *a: None)
    assert fast == rows()


def test_links_of_surfaces_are_found_by_all_tasks(spark, monkeypatch):
    """links come from the search of nearest points, which deals groups of any size."""
    calls, real = [], K.nearest_in_group
    monkeypatch.setattr(K, "nearest_in_group", lambda *a: calls.append(a[3]) or real(*a))
    v = spark.range(40).selectExpr("0L AS path_id", "id div 20 AS part", "id AS vid", "id % 20 + 0.0D AS x", "0.0D AS y", "id div 20 + 0.0D AS z", "id >= 20 AS counted")
    # free along the first part, one step up is free, then the rest of the second at its length
    assert K.surface_path(v, 1.5, 2).first().length == 1.0 and calls == [3, 1]
