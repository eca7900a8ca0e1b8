"""Clusters of voxels by cells against all pairs; the last edges of a graph in one task."""

import numpy as np
import pytest

from voxloom.operators.components import connected_components, graph_components
from voxloom.operators.forest import Sets
from voxloom.operators.synapses import cluster_voxels

KINDS = "id long, x double, y double, z double, pair long, fragment long"


def voxels(seed, n=150, spread=40):
    rng = np.random.default_rng(seed)
    middle = rng.uniform(0, spread, (12, 3))
    at = np.unique(np.round(middle[rng.integers(0, 12, n)] + rng.normal(0, 2.5, (n, 3))), axis=0)
    return [(i + 5, *map(float, p), int(p[0] > spread / 2), int(p[1] // 6)) for i, p in enumerate(at)]


def plain(rows, gap, scale=(1, 1, 1), r=None, gate=None):
    d = lambda a, b, s=scale: float(np.sqrt((((np.array(a[1:4]) - b[1:4]) * s) ** 2).sum()))
    parts = Sets()
    for a in rows:
        parts.root(a[0])
        for b in rows:
            if r is not None and a[4:] == b[4:] and d(a, b, (1, 1, 1)) <= r:
                parts.join(a[0], b[0])
    part = {a[0]: parts.root(a[0]) for a in rows}
    at = {a[0]: a for a in rows}
    for a in rows:
        for b in rows:
            if a[4] == b[4] and d(a, b) < gap and (gate is None or d(at[part[a[0]]], at[part[b[0]]]) <= gate):
                parts.join(a[0], b[0])
    return {a[0]: parts.root(a[0]) for a in rows}


@pytest.mark.parametrize(("gap", "scale", "r", "gate"), [(2.0, (1, 1, 1), None, None), (6.0, (1, 1, 1), 2.0, None), (12.0, (1, 1, 3), 1.0, None), (9.0, (1, 1, 1), 2.0, 14.0), (30.0, (2, 1, 1), 1.5, 8.0)])
def test_clusters_equal_all_pairs(spark, gap, scale, r, gate):
    rows = voxels(int(gap))
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    got = cluster_voxels(df, gap, ["pair"], scale, (["fragment"], r) if r else None, gate)
    assert {x.id: x.component for x in got.collect()} == plain(rows, gap, scale, r, gate)
    assert set(df.columns) | {"component"} == set(got.columns)


def test_the_gate_changes_what_is_joined():
    rows = voxels(9)
    assert plain(rows, 6.0, r=1.0, gate=4.0) != plain(rows, 6.0, r=1.0)


def test_links_are_few_where_voxels_are_many(spark):
    """3,375 voxels within one gap of each other: no row a pair."""
    grid = [(int(i), *map(float, p), 0, 0) for i, p in enumerate(np.ndindex(15, 15, 15))]
    got = cluster_voxels(spark.createDataFrame(grid, KINDS), 40.0, ["pair"])
    assert {r.component for r in got.select("component").distinct().collect()} == {0}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_by_task_are_those_by_rounds(spark, kind):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    df = spark.createDataFrame(edges, "src long, dst long").selectExpr(f"cast(src as {kind}) as src", f"cast(dst as {kind}) as dst")
    rows = lambda c: {(r.node, r.component) for r in c.collect()}
    assert rows(graph_components(df)) == rows(connected_components(df)) == rows(connected_components(df, task_edges=40))
    assert graph_components(df.limit(0)).count() == 0


def test_places_become_parts_before_they_are_joined(spark):
    """what makes the places runs once, and no place is an edge of the graph over blocks."""
    from growth import shuffled_rows

    grid = spark.range(60 * 20 * 8).selectExpr("id", "double(id div 160) AS x", "double(id div 8 % 20) AS y", "double(id % 8) AS z", "id div 1600 % 2 AS pair", "0L AS fragment")
    made = grid.repartition(4, "id")  # a shuffle of 9,600 rows whenever it runs
    got = []
    # the places, their copies in blocks, what the blocks share
    assert shuffled_rows(spark, lambda: got.extend(cluster_voxels(made, 2.0, ["pair"], within=(["fragment"], 2.0)).collect())) < 5 * 9600
    # slabs of ten places of either pair by turns; within a slab all is joined
    assert {r.id: r.component for r in got} == {i: i - i % 1600 for i in range(9600)}


def test_rows_of_synapses_equal_plain_ones(spark):
    """sizes, boxes and shares in one pass, fragments over several components and components of several fragments."""
    from voxloom.operators.synapses import synapse_rows

    rng = np.random.default_rng(5)
    rows = [(int(c % 2), 9, int(c), int(f), float(f % 5) / 5, float(f % 3) / 3, *map(float, p)) for c, f, p in zip(rng.integers(0, 30, 200), rng.integers(0, 12, 200), rng.integers(0, 50, (200, 3)))]
    df = spark.createDataFrame(rows, "cell_lo long, cell_hi long, component long, syn_id long, sym_share double, asym_share double, x double, y double, z double")
    got = {r.component: r for r in synapse_rows(df, 5).collect()}
    own = {c: [r for r in rows if r[2] == c] for c in {r[2] for r in rows}}
    assert set(got) == {c for c, rs in own.items() if len(rs) >= 5} and len(got) < len(own)
    for c, g in got.items():
        at = np.array([r[6:] for r in own[c]])
        assert (g.size, g.n_fragments) == (len(at), len({r[3] for r in own[c]}))
        assert [g.min_x, g.min_y, g.min_z] == at.min(0).tolist() and [g.max_incl_x, g.max_incl_y, g.max_incl_z] == at.max(0).tolist()
        assert np.allclose([g.sym, g.asym], np.mean([r[4:6] for r in own[c]], axis=0))
