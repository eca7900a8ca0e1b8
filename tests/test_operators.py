"""Hand-made cases: value tests, ties, invariants, the two forms of one operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.modes import mode_nearest, mode_smallest
from voxloom.operators import blocks as B
from voxloom.operators import contacts
from voxloom.operators import instances as I
from voxloom.operators import features as N
from voxloom.operators import graph as G
from voxloom.operators import prediction as P
from voxloom.operators import skeleton as K
from voxloom.operators import synapses as C
from voxloom.operators import voxels as V
from voxloom.operators import wiring as W
from voxloom.operators.components import connected_components
from voxloom.operators.spatial import k_nearest_anywhere, nearest_anywhere, pairs_within
from voxloom.session import cut, located, running_total, scratch


def cube(spark, a, name="label"):
    rows = [(int(x), int(y), int(z), int(a[x, y, z])) for x, y, z in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"x long, y long, z long, {name} long")


def test_object_properties_equal_numpy(spark):
    """A slanted rod, a lone voxel, a frame round a hole and background, in a box of three different edges."""
    a = np.zeros((4, 6, 3), int)
    a[[0, 1, 2, 3], [1, 2, 3, 4], [0, 0, 1, 1]] = 70
    a[3, 0, 2] = 8
    a[:3, 3:6, 2] = 41
    a[1, 4, 2] = 0
    got = {r.label: r for r in V.object_properties(cube(spark, a), "label").collect()}
    assert {k: r["size"] for k, r in got.items()} == {70: 4, 8: 1, 41: 8}
    for k, r in got.items():
        at = np.argwhere(a == k)
        assert (r.min_x, r.min_y, r.min_z) == tuple(at.min(0)) and (r.max_x, r.max_y, r.max_z) == tuple(at.max(0) + 1)
        assert (r.rep_x, r.rep_y, r.rep_z) == tuple(at[0])


def test_boundary_voxels_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    a = np.kron(rng.integers(0, 4, (2, 3, 2)), np.ones((3, 2, 3), int))
    want = set()
    for p in np.ndindex(a.shape):
        for q in V.SIX:
            n = tuple(i + j for i, j in zip(p, q))
            if a[p] and all(0 <= i < m for i, m in zip(n, a.shape)) and a[n] != a[p]:
                want.add(p)
    assert {(r.x, r.y, r.z) for r in V.boundary_voxels(cube(spark, a), "label").collect()} == want
    assert V.boundary_voxels(cube(spark, np.full((2, 2, 4), 9)), "label").count() == 0


def test_contact_between_two_cubes(spark):
    a = np.zeros((8, 4, 4), int)
    a[0:3, :3, :3], a[4:7, :3, :3] = 4, 5
    near = V.contact_voxels(cube(spark, a), "label", (5, 3, 3)).collect()
    assert {(r.id_lo, r.id_hi) for r in near} == {(4, 5)}
    assert {r.x for r in near} == {2, 4}


def test_pair_properties_equal_packed_ones(spark):
    rng = np.random.default_rng(23)
    rows = [(*map(int, rng.integers(0, 30, 3)), int(lo), int(lo + d)) for lo, d in zip(rng.integers(1, 4, 80), rng.integers(1, 3, 80))]
    vox = spark.createDataFrame(sorted(set(rows)), "x long, y long, z long, lo long, hi long")
    two = V.object_properties(vox, "lo", "hi").select("lo", "hi", "size", "rep_x", "rep_y", "rep_z").collect()
    one = V.object_properties(vox.withColumn("packed", C.encode_pair(F.col("lo"), F.col("hi"))), "packed")
    lo, hi = C.decode_pair(F.col("packed"))
    assert len(two) == 6 and sorted(two) == sorted(one.select(lo.alias("lo"), hi.alias("hi"), "size", "rep_x", "rep_y", "rep_z").collect())


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 30)],
        [(i, (i + 1) % 12) for i in range(12)],
        [(7, 7), (3, 3), (1, 2), (2, 1), (1, 2), (None, 4)],
    ],
)
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    sets = G.Sets()
    for a, b in edges:
        if a is not None and b is not None:
            sets.join(a, b)
    assert got == {n: sets.root(n) for n in list(sets.parent)}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    sets = G.Sets()
    for a, b in edges:
        sets.join(a, b)
    assert got == {n: sets.root(n) for n in list(sets.parent)}


def test_modes_and_their_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 3, 2), (1, 5, 3), (1, 3, 4), (2, 9, 1)], "k int, v int, r int")
    assert sorted(mode_smallest(df, ["k"], "v").select("k", "mode").collect()) == [(1, 3), (2, 9)]
    assert sorted(mode_nearest(df, ["k"], "v", "r").collect()) == [(1, 5), (2, 9)]


def test_blocks_equal_voxels(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (9, 7, 5))
    b = B.to_blocks(cube(spark, a), "label", (4, 4, 4), a.shape)
    back = np.zeros_like(a)
    for r in B.to_voxels(b, (4, 4, 4)).collect():
        back[r.x, r.y, r.z] = r.label
    assert (back == a).all()
    summed = B.map_blocks(b, lambda v: v + sum(B.shifted(v, d) for d in V.SIX), 1, (4, 4, 4))
    want = a + sum(B.shifted(a, d) for d in V.SIX)
    got = np.zeros_like(a)
    for r in B.to_voxels(summed, (4, 4, 4)).collect():
        got[r.x, r.y, r.z] = r.label
    assert (got == want).all()


def test_contact_filling_keeps_other_labels(spark):
    a = np.zeros((7, 7, 3), int)
    a[2, 2:5, 1], a[4, 2:5, 1] = 1, 2
    out = contacts.fill_contacts(a, 1, 1)
    assert (out[a > 0] == a[a > 0]).all() and (out == 1).sum() > 3


def test_instances_across_blocks(spark):
    a = np.zeros((12, 6, 4), int)
    a[1:11, 2, 2], a[0, 5, 0] = 1, 1
    labels, _ = I.instance_segmentation(B.to_blocks(cube(spark, a), "label", (4, 4, 4), a.shape), (4, 4, 4), a.shape)
    sizes = sorted(r.n for r in I.label_sizes(labels).collect())
    assert sizes == [1, 10]


def test_pairs_within_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-5, 5, (60, 3))
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.id_a, r.id_b) for r in pairs_within(df, df, 2.0).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert got == {(i, j) for i, j in np.argwhere(d <= 2.0).tolist()}
    near = {r.query_id: r.id for r in nearest_anywhere(df.where("id < 10").withColumnRenamed("id", "query_id"), df.where("id >= 10"), 0.1).collect()}
    assert near == {i: 10 + int(d[i, 10:].argmin()) for i in range(10)}


def chain(spark, n, key=1):
    nodes = spark.createDataFrame([(key, i, float(i), 0.0, 0.0, 0) for i in range(n)], "cell_id long, node_id long, x double, y double, z double, axoness int")
    edges = spark.createDataFrame([(key, i, i + 1) for i in range(n - 1)], "cell_id long, src long, dst long")
    return nodes, edges


def test_pruning_a_y_shape(spark):
    nodes, edges = chain(spark, 10)
    nodes = nodes.union(spark.createDataFrame([(1, 20, 5.0, 0.5, 0.0, 0)], nodes.schema))
    edges = edges.union(spark.createDataFrame([(1, 5, 20)], edges.schema))
    assert {r.node_id for r in K.prune_branches(nodes, edges, 1.0).collect()} == set(range(10))
    assert {r.node_id for r in K.prune_branches(nodes, edges, 0.1).collect()} == {*range(10), 20}


def test_stitching_equals_a_plain_search(spark):
    rng = np.random.default_rng(40)
    p = np.round(rng.uniform(0, 30, (60, 3)), 1)
    links = [(i, i + 1) for i in range(59) if i % 7 < 5]
    nodes = spark.createDataFrame([(1, i, *map(float, q)) for i, q in enumerate(p)], "cell_id long, node_id long, x double, y double, z double")
    got = {(r.src, r.dst) for r in G.stitch(nodes, spark.createDataFrame([(1, a, b) for a, b in links], "cell_id long, src long, dst long")).where("added").collect()}
    sets, want = G.Sets(), set()
    for i in range(60):
        sets.root(i)
    for a, b in links:
        sets.join(a, b)
    groups = {}
    for i in range(60):
        groups.setdefault(sets.root(i), set()).add(i)
    main = max(groups.values(), key=lambda g: (len(g), -min(g)))
    while len(main) < 60:
        _, a, b = min((float(np.sqrt(((p[a] - p[b]) ** 2).sum())), a, b) for a in main for b in range(60) if b not in main)
        want.add((a, b))
        main = main | next(g for g in groups.values() if b in g)
    assert got == want


def test_scratch_tables_go(spark):
    import os

    with scratch(spark):
        made = cut(spark.range(5))
        folder = os.path.dirname(made.inputFiles()[0]).removeprefix("file:").replace("///", "/")
        assert made.count() == 5 and os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_stitching_links_the_nearest_ends(spark):
    nodes, edges = chain(spark, 6)
    got = G.stitch(nodes, edges.where("src <> 2")).where("added").collect()
    assert [(r.src, r.dst) for r in got] in ([(2, 3)], [(3, 2)])


def test_lone_soma_at_node_0_counts(spark):
    nodes, edges = chain(spark, 4)
    nodes = nodes.withColumn("axoness", F.when(F.col("node_id") == 0, 2).otherwise(0))
    q = spark.createDataFrame([(1, 7, 3.0, 0.0, 0.0)], "cell_id long, query_id long, x double, y double, z double")
    assert K.soma_distance(q, nodes, K.weighted_edges(nodes, edges)).first().soma_dist == 3.0


def test_fragments_at_200_and_300(spark):
    rows = [(1, 0.0, 0), (2, 200.0, 0), (3, 500.0, 0)]
    vox = spark.createDataFrame([(i, x, 0.0, 0.0, p) for i, x, p in rows], "id long, x double, y double, z double, pair long")
    got = {r.id: r.component for r in C.cluster_voxels(vox, 250.0, ["pair"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_axodendritic_codes(spark):
    rows = [(a * 10 + b, 1, 2, 1.0, 1.0, 1, a, b, 0, 0) for a in range(-1, 5) for b in range(-1, 5)]
    syn = spark.createDataFrame(rows, "syn_id int, cell_1 int, cell_2 int, syn_prob double, mesh_area double, syn_sign int, ax_1 int, ax_2 int, ct_1 int, ct_2 int")
    kept = {(r.syn_id // 10 if r.syn_id >= 0 else -1, r.ax_1 + r.ax_2) for r in W.filtered_synapses(syn, 0.5, True).collect()}
    assert {s for _, s in kept} == {1}
    syn = syn.withColumns({"sp_1": F.lit(1), "sp_2": F.lit(1), "size": F.lit(1.0), "latent_id": F.lit(1)})
    kept, why = N.orient(syn)
    assert kept.count() == 12 and {r.reason: r.n for r in why.collect()} == {"unknown_compartment": 11, "not_axodendritic": 13}


def test_certainty_of_uniform_and_one_hot(spark):
    df = spark.createDataFrame([(1, [0.25] * 4), (2, [1.0, 0.0, 0.0, 0.0])], "cell_id int, logits array<double>")
    got = {r.cell_id: r.certainty for r in P.certainty(df, 4, is_logit=False).collect()}
    assert abs(got[1]) < 1e-12 and abs(got[2] - 1) < 1e-12


def test_split_needs_a_proper_part(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "sv_id long, cell_id long")
    assert sorted(G.split_cell(m, 1, [2]).collect()) == [(1, 1), (2, 3), (3, 2)]
    for bad in ([1, 2], [3], []):
        with pytest.raises(ValueError):
            G.split_cell(m, 1, bad)


def test_subsets_are_padded(spark):
    df = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (2, 1)], "cell_id int, sample_id long")
    sub = P.fixed_subsets(df, 4, 0)
    assert {(r.cell_id, r.subset): r["count"] for r in sub.groupBy("cell_id", "subset").count().collect()} == {(1, 0): 4, (1, 1): 4, (2, 0): 4}


def dense(spark, blocks, shape, size, name="label"):
    out = np.zeros(shape, int)
    for r in B.to_voxels(blocks, size, name).collect():
        out[r.x, r.y, r.z] = r[name]
    return out


def test_smoothing_over_blocks_equals_the_whole_volume(spark):
    rng = np.random.default_rng(31)
    a, sigma = rng.integers(0, 10**6, (11, 7, 3)), (1.2, 0.7, 1.0)
    got = dense(spark, B.gaussian(B.to_blocks(cube(spark, a), "label", (4, 3, 2), a.shape), sigma, (4, 3, 2), a.shape), a.shape, (4, 3, 2))
    want = a.astype(float)
    for axis, s in enumerate(sigma):  # one line at a time, mirrored index by index
        r, n = int(4 * s + 0.5), a.shape[axis]
        w = [np.exp(-0.5 * (k / s) ** 2) for k in range(-r, r + 1)]

        def line(v):
            mirror = lambda i: (i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)  # noqa: B023
            return [sum(x * v[mirror(i + k)] for k, x in zip(range(-r, r + 1), w)) / sum(w) for i in range(n)]  # noqa: B023

        want = np.apply_along_axis(line, axis, want)
    assert (np.abs(got - want) <= 0.5 + 1e-6).all()


def test_distances_over_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(32)
    a = (rng.random((10, 9, 6)) < 0.93).astype(int)
    got = dense(spark, B.distance_transform(B.to_blocks(cube(spark, a), "label", (4, 4, 3), a.shape), (4, 4, 3), a.shape, 4, (1, 1, 2)), a.shape, (4, 4, 3))
    zero = np.argwhere(a == 0) * (1, 1, 2)
    for p in np.ndindex(a.shape):
        assert got[p] == (min(16, int(((np.array(p) * (1, 1, 2) - zero) ** 2).sum(1).min())) if a[p] else 0)
    full = np.ones((3, 3, 3), int)
    assert (dense(spark, B.distance_transform(B.to_blocks(cube(spark, full), "label", (2, 2, 2), full.shape), (2, 2, 2), full.shape, 3), full.shape, (2, 2, 2)) == 9).all()


def test_watershed_parts_touching_balls(spark):
    shape, size = (16, 9, 9), (5, 4, 9)
    at = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
    mask = (((at - (4, 4, 4)) ** 2).sum(-1) <= 12) | (((at - (10, 4, 4)) ** 2).sum(-1) <= 12)
    height = B.squared_distances(mask, ~mask, (1, 1, 1), 9)
    seeds = np.zeros(shape, int)
    seeds[4, 4, 4], seeds[10, 4, 4] = 3, 8
    to = lambda v: B.to_blocks(cube(spark, v), "label", size, shape)
    got = dense(spark, I.watershed(to(seeds), to(height), size, shape), shape, size)
    assert ((got > 0) == mask).all()
    assert (got[:7][mask[:7]] == 3).all() and (got[8:][mask[8:]] == 8).all()


def test_contact_filling_over_blocks_equals_plain_sets(spark):
    rng = np.random.default_rng(33)
    a = np.zeros((9, 8, 6), int)
    for x, y, z in rng.integers(0, (9, 8, 6), (14, 3)):
        a[x, y, z] = int(rng.integers(1, 5))
    got = dense(spark, B.map_blocks(B.to_blocks(cube(spark, a), "label", (4, 4, 4), a.shape), lambda v: contacts.fill_contacts(v, 1, 1), 3, (4, 4, 4)), a.shape, (4, 4, 4))
    grow = lambda s: s | {tuple(i + j for i, j in zip(p, d)) for p in s for d in V.SIX}
    shrink = lambda s: {p for p in s if all(tuple(i + j for i, j in zip(p, d)) in s for d in V.SIX)}
    want = a.copy()
    for label in sorted(set(a[a > 0].tolist())):
        for p in sorted(grow(shrink(grow({tuple(map(int, q)) for q in np.argwhere(a == label)})))):
            if all(0 <= i < n for i, n in zip(p, a.shape)) and not want[p]:
                want[p] = label
    assert (got == want).all()


def test_budget_windows_equal_a_plain_walk(spark):
    rng = np.random.default_rng(34)
    parent = [None, *[int(rng.integers(0, i)) for i in range(1, 40)]]
    codes = [int(c) for c in rng.integers(0, 4, 40)]
    nodes = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, c) for i, c in enumerate(codes)], "cell_id long, node_id long, x double, y double, z double, axoness int")
    length = {(p, i): float(rng.integers(1, 9)) for i, p in enumerate(parent) if p is not None}
    weighted = spark.createDataFrame([(1, a, b, w) for (a, b), w in length.items()], "cell_id long, src long, dst long, length double")
    got = {r.node_id: r.axoness for r in K.window_majority(nodes, weighted, "axoness", 15.0, "bfs_budget").collect()}
    for i in range(40):
        if codes[i] == 2:
            assert got[i] == 2
            continue
        seen, left, at = [i], 15.0, 0
        while at < len(seen):
            a = seen[at]
            for b in sorted({q for p, q in length if p == a} | {p for p, q in length if q == a}):
                w = length.get((a, b), length.get((b, a)))
                if b not in seen and w <= left:
                    left -= w
                    seen.append(b)
            at += 1
        votes = [codes[j] for j in seen]
        assert got[i] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_whitened_components_equal_a_decomposition(spark):
    rng = np.random.default_rng(35)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 0.5, 0.2]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 4
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r.pca for r in sorted(P.whitened_pca(df, 3).collect(), key=lambda r: r.id)])
    centred = x - x.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = u[:, :3] * np.sqrt(len(x) - 1)
    want = want * np.sign(vt[:3][range(3), np.abs(vt[:3]).argmax(1)])
    assert np.allclose(got, want, atol=1e-6) and np.allclose(np.cov(got.T), np.eye(3), atol=1e-6)


def test_k_nearest_at_any_distance(spark):
    rng = np.random.default_rng(36)
    p = np.round(rng.uniform(0, 9, (40, 3)), 1)
    p[-1] = 5000
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    far = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, -900.0, 3.0, 0.0)], "query_id long, x double, y double, z double")
    got = sorted((r.query_id, r.rank, r.id) for r in k_nearest_anywhere(far, df, 6, 0.5).collect())
    d = lambda q: np.sqrt(((p - np.array(q)) ** 2).sum(1))
    want = [(i, r + 1, int(j)) for i, q in ((0, (1, 1, 1)), (1, (-900, 3, 0))) for r, j in enumerate(np.lexsort((np.arange(40), d(q)))[:6])]
    assert got == want
    assert k_nearest_anywhere(far, df.limit(2), 6, 0.5).count() == 4


def test_running_totals_by_ranges(spark):
    rng = np.random.default_rng(37)
    rows = [(int(k), int(v)) for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    got = {r.k: r.before for r in running_total(spark.createDataFrame(rows, "k long, v long").repartition(7), ["k"], F.col("v"), "before").collect()}
    by = dict(rows)
    assert got == {k: sum(by[j] for j in range(k)) for k in range(500)}


def test_rows_are_located_alike_in_every_scan(spark, tmp_path):
    spark.range(300).repartition(5).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("id", "file_of_row")
    first, names = located(spark.read.parquet(str(tmp_path / "t")))
    assert names == ["file_of_row", "place_of_row"] and first.select(*names).distinct().count() == 300
    derived, names = located(table.where("file_of_row % 2 = 0"))
    assert names == ["_file_of_row", "place_of_row"] and derived.select(*names).distinct().count() == 150
    twice = spark.read.parquet(str(tmp_path / "t")).crossJoin(spark.range(2).toDF("copy"))
    assert located(twice)[0].select("file_of_row", "place_of_row").distinct().count() == 600
    assert located(spark.range(4))[0].select("file_of_row", "place_of_row").distinct().count() == 4


def test_synapse_distance_is_scaled(spark):
    syn = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 2), (3, 0, 4, 0)], "syn_id long, x long, y long, z long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "syn_a long, syn_b long")
    assert sorted(map(tuple, K.synapse_distance(pairs, syn, (10.0, 10.0, 20.0)).collect())) == [(1, 2, 50.0), (1, 3, 40.0), (3, 3, 0.0)]


def test_forest_probabilities_of_held_out_rows(spark):
    rng = np.random.default_rng(38)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(k)) for i, (r, k) in enumerate(zip(x, y))], "syn_id long, a double, b double, c double, label double")
    held = C.cross_validate(df, ["a", "b", "c"], 10, 20).collect()
    assert sorted(r.syn_id for r in held) == list(range(600)) and all(0 <= r.syn_prob <= 1 for r in held)
    assert np.mean([(r.syn_prob > 0.5) == (r.label == 1) for r in held]) > 0.9


def test_surface_paths_equal_a_closure(spark):
    rng = np.random.default_rng(42)
    rows = [(g, int(part), i, *map(float, rng.uniform(0, 12, 3) + (9 * part, 0, 0)), bool(part % 2)) for g in range(4) for i, part in enumerate(sorted(rng.integers(0, 3, 30)))]
    rows += [(9, 0, 0, 0.0, 0.0, 0.0, True), (9, 1, 1, 900.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "path_id long, part long, vid long, x double, y double, z double, counted boolean")
    got = {r.path_id: r.length for r in K.surface_path(df, 8.0, 3).collect()}
    assert got.pop(9) == float("inf")
    for g, length in got.items():
        v = sorted((r[1], r[2], r[3:6], r[6]) for r in rows if r[0] == g)
        n = len(v)
        far = lambda a, b: float(np.linalg.norm(np.array(v[a][2]) - v[b][2]))  # noqa: B023, E731
        best = np.full((n, n), np.inf)
        for i in range(n):
            own = sorted((j for j in range(n) if v[j][0] == v[i][0] and j != i), key=lambda j: (far(i, j), j))[:3]  # noqa: B023
            for j in own:
                if far(i, j) <= 8:
                    best[i, j] = best[j, i] = min(best[i, j], far(i, j) if v[i][3] else 0.0)
            parts = sorted({x[0] for x in v if x[0] < v[i][0]})
            if parts:
                j = min((j for j in range(n) if v[j][0] == parts[-1]), key=lambda j: (far(i, j), j))  # noqa: B023
                if far(i, j) <= 8:
                    best[i, j] = best[j, i] = min(best[i, j], far(i, j) if v[i][3] else 0.0001)
        for k in range(n):
            best = np.minimum(best, best[:, k, None] + best[None, k])
        want = 0.0 if n == 1 else best[0, n - 1]
        assert (length == want) or abs(length - want) < 1e-9
