"""Clusters by blocks of space: results against all pairs, and rows that grow with the places alone."""

import numpy as np
import pytest
from growth import shuffled_rows

from voxloom.operators.clusters import clusters, join_near
from voxloom.operators.forest import Sets
from voxloom.operators.skeleton import label_components
from voxloom.operators.synapses import cluster_voxels

KINDS = "id long, x double, y double, z double, obj long, label long"


def places(seed, n, spread, whole=False):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-spread, spread, (n, 3))
    at = np.round(at) if whole else at
    return [(int(i), *map(float, p), int(i % 2), int(i % 3)) for i, p in zip(rng.permutation(n) + 3, at)]


def plain(rows, gap, strict, key, scale=(1, 1, 1), r=None):
    sets, at = Sets(), np.array([x[1:4] for x in rows])
    for i, a in enumerate(rows):
        sets.root(a[0])
        d, e = np.sqrt((((at - at[i]) * scale) ** 2).sum(1)), np.sqrt(((at - at[i]) ** 2).sum(1))
        for b, u, v in zip(rows, d, e):
            if key(a) == key(b) and ((u < gap if strict else u <= gap) or (r and a[5] == b[5] and v <= r)):
                sets.join(a[0], b[0])
    return {a[0]: sets.root(a[0]) for a in rows}


@pytest.mark.parametrize(("gap", "scale", "r", "strict", "whole"), [(3.0, (1, 1, 1), None, False, True), (3.0, (1, 1, 1), None, True, True), (2.5, (1, 1, 2), 3.0, True, False), (60.0, (1, 1, 1), None, True, False)])
def test_clusters_across_blocks(spark, gap, scale, r, strict, whole):
    rows = places(int(gap), 500, 22, whole)
    got = clusters(spark.createDataFrame(rows, KINDS), gap, ["obj"], scale, strict, (["label"], r) if r else None)
    assert {x.id: x.component for x in got.collect()} == plain(rows, gap, strict, lambda a: a[4], scale, r)


def test_dense_cells_far_apart_are_compared_in_parts(monkeypatch):
    from voxloom.operators import clusters as module

    monkeypatch.setattr(module, "PAIRS", 50)
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.uniform(0, 0.5, (40, 3)), rng.uniform(0, 0.5, (40, 3)) + [1.0, 0, 0], [[1.9, 0.2, 0.2]], [[9.0, 9, 9]]])
    part = join_near(np.arange(82), at, np.zeros(82, np.int64), 0.75, True)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) < 0.75
    want = np.arange(82)
    for _ in range(82):
        want = np.array([want[d[i]].min() for i in range(82)])
    assert (part == want).all()


def test_places_without_coordinate_or_key_are_alone(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0, 0), (2, None, 0.0, 0.0, 0, 0), (3, None, 0.0, 0.0, 0, 0), (4, 0.0, 0.0, 1.0, 0, 0), (5, 0.0, 0.0, 0.0, None, 0)]
    got = clusters(spark.createDataFrame(rows, KINDS), 2.0, ["obj"])
    assert {x.id: x.component for x in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_label_components_and_clusters_shuffle_no_pairs(spark):
    """1,200 places that are nearly all within reach of each other."""
    df = spark.createDataFrame(places(5, 1200, 5), KINDS).cache()
    df.count()
    assert shuffled_rows(spark, lambda: label_components(df, 9.5, "obj", 3).collect()) < 20 * 1200
    grid = [(int(i), *map(float, p), 0, 0) for i, p in enumerate(np.ndindex(12, 12, 12))]
    vox = spark.createDataFrame(grid, KINDS).cache()
    vox.count()
    assert shuffled_rows(spark, lambda: cluster_voxels(vox, 2.0, ["obj"]).collect()) < 20 * 1728
