"""What a task holds or writes does not grow with the table."""

from pathlib import Path

import numpy as np

from voxloom.operators import blocks as B
from voxloom.operators import prediction as P
from voxloom.plans import tables


def test_slabs_are_handed_on_in_parts(spark, monkeypatch):
    """300 blocks that come to a task at once."""
    size, shape = (4, 4, 4), (300 * 4, 4, 4)
    rng = np.random.default_rng(1)
    at = {(int(x), int(y), int(z)) for x, y, z in zip(rng.integers(0, 1200, 5000), rng.integers(0, 4, 5000), rng.integers(0, 4, 5000))}
    blocks = B.to_blocks(spark.createDataFrame([(*p, 1) for p in at], "x int, y int, z int, on int"), "on", size, shape).cache()
    made, real = [], type(blocks).mapInPandas
    monkeypatch.setattr(type(blocks), "mapInPandas", lambda self, f, kind: made.append(f) or real(self, f, kind))
    out = B.map_blocks(blocks, lambda a: a, 1, size)
    sent = [len(f) for f in made[0](iter([blocks.toPandas()]))]
    assert max(sent) <= 27 * B.AT_ONCE and sum(sent) == 27 * 300
    assert {(r.x, r.y, r.z) for r in B.to_voxels(out, size).collect()} == at


def test_a_block_is_a_file(spark, monkeypatch, tmp_path):
    """blocks written as folders are one file each, however many tasks hold their voxels."""
    monkeypatch.setattr(tables, "_path", lambda spark: f"{tmp_path}/blocks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tables.s1_read_subvolume(spark, "/root/testdata/sf0.01").count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list(Path(tmp_path).rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) > 4


def test_neighbours_of_tied_vectors(spark):
    """equal distances, copies, fewer training rows than asked for: exact sums, ties to the smaller id."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(0, 2, (120, 6)).astype(float) * 0.1 + 1e6, rng.normal(0, 1, (80, 6))])
    rows = [(i, int(i % 3), p.tolist()) for i, p in enumerate(v)]
    train = spark.createDataFrame([r for r in rows if r[0] % 2], "id long, label int, v array<double>")
    asked = spark.createDataFrame([(r[0], r[2]) for r in rows if not r[0] % 2], "query_id long, v array<double>")

    def label(q, k):
        d = lambda t: sum((a - b) ** 2 for a, b in zip(q[2], t[2]))
        near = [t[1] for t in sorted((t for t in rows if t[0] % 2), key=lambda t: (d(t), t[0]))[:k]]
        return min(set(near), key=lambda c: (-near.count(c), c))

    for k in (1, 5, 1000):
        assert {r.query_id: r.label for r in P.knn_classify(asked, train, k, 6).collect()} == {q[0]: label(q, k) for q in rows if not q[0] % 2}
