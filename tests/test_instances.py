"""Components and watershed over blocks against the whole volume."""

import heapq

import numpy as np
import pytest

from voxloom.operators import blocks as B
from voxloom.operators import instances as I
from voxloom.operators import voxels as V
from voxloom.session import cut_in_buckets


def blocks_of(spark, a, size):
    rows = []
    for b in np.ndindex(*[-(-n // s) for n, s in zip(a.shape, size)]):
        part = a[tuple(slice(k * s, k * s + s) for k, s in zip(b, size))]
        rows.append((*map(int, b), *part.shape, bytearray(np.ascontiguousarray(part, "<i8").tobytes())))
    return spark.createDataFrame(rows, B.SCHEMA)


def whole(blocks, shape, size):
    out = np.zeros(shape, "<i8")
    for r in blocks.collect():
        at = tuple(slice(k * s, k * s + n) for k, s, n in zip((r.bx, r.by, r.bz), size, (r.nx, r.ny, r.nz)))
        out[at] = B.array_of(r)
    return out


def flooded_components(on):
    out = np.zeros(on.shape, "<i8")
    for p in map(tuple, np.argwhere(on)):
        if not out[p]:
            name, todo = int(np.ravel_multi_index(p, on.shape)) + 1, [p]
            while todo:
                q = todo.pop()
                if all(0 <= i < n for i, n in zip(q, on.shape)) and on[q] and not out[q]:
                    out[q] = name
                    todo += [tuple(i + j for i, j in zip(q, d)) for d in V.SIX]
    return out


def flood(seeds, height):
    """One voxel at a time over the first edge that leaves what is flooded."""
    out, heap = seeds.copy(), []
    level = lambda p: (-int(height[p]), int(np.ravel_multi_index(p, out.shape)))

    def leave(p):
        for d in V.SIX:
            q = tuple(i + j for i, j in zip(p, d))
            if all(0 <= i < n for i, n in zip(q, out.shape)) and not out[q] and height[q] > 0:
                heapq.heappush(heap, (sorted((level(p), level(q)), reverse=True), p, q))

    for p in map(tuple, np.argwhere(seeds)):
        leave(p)
    while heap:
        _, p, q = heapq.heappop(heap)
        if not out[q]:
            out[q] = out[p]
            leave(q)
    return out


@pytest.mark.parametrize(("seed", "size", "share"), [(1, (4, 4, 4), 0.6), (2, (3, 5, 2), 0.35), (3, (1, 9, 4), 0.75)])
def test_components_equal_one_volume(spark, seed, size, share):
    on = np.random.default_rng(seed).random((11, 9, 7)) < share
    labels, merge = I.instance_segmentation(blocks_of(spark, on, size), size, on.shape)
    assert (whole(labels, on.shape, size) == flooded_components(on)).all()
    assert merge.where("component > node").count() == 0
    sizes = {r.label: r.n for r in I.label_sizes(labels).collect()}
    names, n = np.unique(flooded_components(on)[on], return_counts=True)
    assert sizes == dict(zip(names.tolist(), n.tolist()))
    kept = whole(I.drop_small(labels, 4, size, on.shape), on.shape, size)
    large = flooded_components(on)
    large[~np.isin(large, names[n >= 4])] = 0
    assert (kept == large).all()


def test_empty_volume_and_one_block(spark):
    none = np.zeros((5, 4, 3), int)
    labels, merge = I.instance_segmentation(blocks_of(spark, none, (2, 2, 2)), (2, 2, 2), none.shape)
    assert not whole(labels, none.shape, (2, 2, 2)).any() and merge.count() == 0
    one = np.ones((3, 3, 3), int)
    labels, _ = I.instance_segmentation(blocks_of(spark, one, (4, 4, 4)), (4, 4, 4), one.shape)
    assert (whole(labels, one.shape, (4, 4, 4)) == 1).all()


def test_contract_keeps_rooted_parts_apart():
    u, v = np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 5])  # a chain whose edges come in this order
    part, chosen = I.contract(6, u, v, np.array([True, False, False, False, False, True]))
    assert (part[:5] == part[0]).all() and part[5] != part[0] and chosen.tolist() == [True, True, True, True, False]
    part, chosen = I.contract(6, u, v)
    assert len(set(part.tolist())) == 1 and chosen.all()


@pytest.mark.parametrize(("seed", "size", "levels"), [(1, (4, 4, 4), 50), (2, (3, 5, 2), 3), (3, (5, 3, 7), 1), (4, (2, 2, 2), 10)])
def test_watershed_equals_the_whole_flood(spark, seed, size, levels):
    rng = np.random.default_rng(seed)
    shape = (11, 9, 7)
    height = np.where(rng.random(shape) < 0.75, rng.integers(1, levels + 1, shape), 0)
    seeds = np.zeros(shape, int)
    for k, p in enumerate(rng.integers(0, shape, (9, 3))):
        seeds[tuple(p)] = 1 + k % 7  # two labels have two places
    seeds[5, 4, 3] = 3
    height[5, 4, 3] = 0  # a seed floods from where it stands
    got = whole(I.watershed(blocks_of(spark, seeds, size), blocks_of(spark, height, size), size, shape), shape, size)
    assert (got == flood(seeds, height)).all()
    assert len(set(got.ravel().tolist())) > 5


def test_an_object_over_many_blocks(spark):
    """Two seeds at the ends of a tube of 60 voxels that winds through blocks of five; the pass between them is not in the middle."""
    shape, size = (60, 5, 5), (5, 5, 5)
    height = np.zeros(shape, int)
    height[:, 2, 2] = 10 + np.abs(np.arange(60) - 41)
    height[::7, 1:4, 1:4] = np.maximum(height[::7, 1:4, 1:4], 5)
    seeds = np.zeros(shape, int)
    seeds[0, 2, 2], seeds[59, 2, 2] = 8, 9
    got = whole(I.watershed(blocks_of(spark, seeds, size), blocks_of(spark, height, size), size, shape), shape, size)
    assert (got == flood(seeds, height)).all()
    assert (got[:41, 2, 2] == 8).all() and (got[42:, 2, 2] == 9).all()


def test_no_seed_and_no_height(spark):
    none = np.zeros((4, 4, 4), int)
    some = none.copy()
    some[1, 1, 1] = 6
    for seeds, height in ((none, none + 1), (some, none), (none, none)):
        got = whole(I.watershed(blocks_of(spark, seeds, (2, 4, 4)), blocks_of(spark, height, (2, 4, 4)), (2, 4, 4), none.shape), none.shape, (2, 4, 4))
        assert (got == seeds).all()


def test_blocks_stay_where_they_are(spark):
    """Blocks in buckets are not shuffled when their part of the merge list comes to them."""
    a = np.ones((8, 4, 4), int)
    size = (4, 4, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = cut_in_buckets(blocks_of(spark, a, size), B.KEY)
        mapping = spark.createDataFrame([(65, 1)], "old long, new long")
        plan = I.relabel_blocks(blocks, mapping, size, a.shape)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("FileScan parquet")
    join = plan.index("SortMergeJoin")
    between = plan[join:scan]
    assert "Bucketed: true" in plan[scan:] and "Exchange" not in between


def test_blocks_and_nodes_are_not_sent_through_the_driver(spark, monkeypatch):
    """F32: joins of blocks, of the forest over them and of its parts; a graph that takes more than one round."""
    from growth import joins_by_broadcast

    from voxloom.operators import components, forest

    monkeypatch.setattr(components, "TASK_EDGES", 20)
    monkeypatch.setattr(I, "spanning_forest", lambda e, key, order: forest.spanning_forest(e, key, order, 60))
    rng = np.random.default_rng(6)
    shape, size = (12, 6, 6), (4, 3, 3)
    height = np.where(rng.random(shape) < 0.8, rng.integers(1, 9, shape), 0)
    mask, got = np.where(height > 5, 1, 0), []

    def run():
        seeds, _ = I.instance_segmentation(blocks_of(spark, mask, size), size, shape)
        got.append(whole(I.watershed(seeds, blocks_of(spark, height, size), size, shape), shape, size))

    # what is still sent is the list of groups of more than 60 edges, which filters them
    assert joins_by_broadcast(spark, run) <= {"LeftSemi", "LeftAnti"}
    assert (got[0] == flood(flooded_components(mask != 0), height)).all()
