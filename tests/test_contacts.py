"""Contacts on blocks against the row form and plain sets."""

import collections
import itertools

import numpy as np
import pytest

from voxloom.operators import blocks as B
from voxloom.operators import contacts as K
from voxloom.operators import voxels as V


def table(spark, a, **flags):
    """A voxel table of all places of ``a`` that are not OUTSIDE."""
    rows = [(*map(int, p), int(a[tuple(p)]), *(int(f[tuple(p)]) for f in flags.values())) for p in np.argwhere(a != K.OUTSIDE)]
    return spark.createDataFrame(rows, "x long, y long, z long, label long" + "".join(f", {k} int" for k in flags))


def patchy(seed, shape=(13, 9, 7), labels=6, outside=0.1):
    """Random patches of a few voxels, some background and some places outside the volume."""
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, labels, [n // 2 + 1 for n in shape])
    a = np.repeat(np.repeat(np.repeat(coarse, 2, 0), 2, 1), 2, 2)[tuple(slice(0, n) for n in shape)].copy()
    a[rng.random(shape) < outside] = K.OUTSIDE
    return a


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("seed", "size", "stencil"), [(1, (4, 4, 4), (3, 3, 3)), (2, (5, 3, 7), (5, 5, 3)), (3, (2, 2, 2), (3, 5, 7)), (4, (20, 20, 20), (3, 3, 3))])
def test_blocks_equal_the_row_form(spark, seed, size, stencil):
    a = patchy(seed)
    vox = table(spark, a)
    blocks = B.to_blocks(vox, "label", size, a.shape, K.OUTSIDE)
    assert rows_of(K.boundary_voxels(blocks, size), "x", "y", "z", "label") == rows_of(V.boundary_voxels(vox, "label"), "x", "y", "z", "label")
    want = rows_of(V.contact_voxels(vox, "label", stencil), "x", "y", "z", "id_lo", "id_hi")
    assert want and rows_of(K.contact_voxels(blocks, size, stencil), "x", "y", "z", "id_lo", "id_hi") == want
    sizes = collections.Counter(r[3:] for r in want)
    assert rows_of(K.contact_sizes(blocks, size, stencil), "id_lo", "id_hi", "n") == sorted((*k, n) for k, n in sizes.items())


def test_all_distinct_and_all_empty():
    a = np.arange(1, 28).reshape(3, 3, 3)
    assert K.boundary(a).all() and not K.boundary(np.zeros((3, 3, 3), int)).any()
    assert not K.contact_labels(np.full((4, 4, 4), 7), (3, 3, 3)).any()
    big = np.array([[[2**31 - 1, 2**31 - 2]]])
    assert set(K.contact_labels(big, (3, 3, 3)).ravel().tolist()) == {(2**31 - 2) << 32 | 2**31 - 1}


def test_most_frequent_and_its_ties():
    rows = np.array([[5, 3, 5, 3, 0], [0, 0, -1, 0, -1], [9, 2, 2, 0, 0], [7, -1, -1, -1, 0]])
    assert K.most_frequent(rows).tolist() == [3, 0, 2, 7]


def test_two_cubes_at_a_distance():
    a = np.zeros((24, 9, 9), int)
    a[2:7, 2:7, 2:7], a[9:14, 2:7, 2:7] = 4, 5  # three voxels from face to face
    wide, narrow = K.contact_labels(a, (7, 7, 7)), K.contact_labels(a, (5, 5, 5))
    assert not narrow.any()
    assert set(np.argwhere(wide)[:, 0].tolist()) == {6, 9} and set(wide[wide > 0].tolist()) == {4 << 32 | 5}


def plain_fill(a, closing, dilation):
    grow = lambda s: s | {tuple(i + j for i, j in zip(p, d)) for p in s for d in V.SIX}
    shrink = lambda s: {p for p in s if all(tuple(i + j for i, j in zip(p, d)) in s for d in V.SIX)}
    out = a.copy()
    for label in sorted(set(a[a > 0].tolist())):
        s = set(map(tuple, np.argwhere(a == label)))
        for step, n in ((grow, closing), (shrink, closing), (grow, dilation)):
            for _ in range(n):
                s = step(s)
        for p in s:
            if all(0 <= i < n for i, n in zip(p, a.shape)) and out[p] == 0:
                out[p] = label
    return out


@pytest.mark.parametrize(("closing", "dilation"), [(1, 1), (2, 0), (0, 2), (3, 1)])
def test_filling_by_boxes_equals_plain_sets(closing, dilation):
    rng = np.random.default_rng(5)
    for _ in range(5):
        a = np.where(rng.random((9, 8, 7)) < 0.12, rng.integers(1, 5, (9, 8, 7)), 0)
        assert (K.fill_contacts(a, closing, dilation) == plain_fill(a, closing, dilation)).all()


@pytest.mark.parametrize("size", [(4, 4, 4), (3, 9, 2)])
def test_contact_sites_equal_one_whole_volume(spark, size):
    a = patchy(6, labels=8)
    rng = np.random.default_rng(7)
    flags = {k: rng.integers(0, 2, a.shape) for k in ("sj", "sym", "asym")}
    flags["sj"][3:] = 0
    blocks = B.to_blocks(table(spark, a, **flags), "label", size, a.shape, K.OUTSIDE, list(flags))
    made = np.where(a == K.OUTSIDE, 0, plain_fill(K.contact_labels(a, (3, 3, 3)), 1, 1))
    want = []
    for pair in np.unique(made[made > 0]).tolist():
        at = np.argwhere(made == pair)
        syn = [p for p in map(tuple, at) if flags["sj"][p]]
        box = lambda ps: [f(p[i] for p in ps) + k for f, k in ((min, 0), (max, 1)) for i in range(3)] if len(ps) else [None] * 6
        counts = [len(at), len(syn), sum(flags["sym"][p] for p in syn), sum(flags["asym"][p] for p in syn)]
        if len(at) >= 4:
            want.append((pair >> 32, pair & 0xFFFFFFFF, *map(int, counts), *box(list(map(tuple, at))), *box(syn)))
    got = [tuple(r) for r in K.contact_sites(blocks, list(flags), size, closing=1, dilation=1, least=4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(None in w for w in want)


def test_no_voxel_row_is_shuffled(spark):
    """After the blocks are made, exchanges carry slabs and pairs; nothing is exploded."""
    size = (4, 4, 4)
    data = np.zeros(size, "<i8")
    rows = [(*b, *size, bytearray(data.tobytes()), *[bytearray(64)] * 3) for b in itertools.product(range(2), repeat=3)]
    blocks = spark.createDataFrame(rows, B.SCHEMA + ", sj binary, sym binary, asym binary")
    plan = K.contact_sites(blocks, ["sj", "sym", "asym"], size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Generate" not in plan
    assert K.contact_sites(blocks, ["sj", "sym", "asym"], size).count() == 0
