"""Spanning forests by contraction against Kruskal, and sets of places against points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators.forest import Sets, spanning_forest
from voxloom.operators.graph import spanning_tree
from voxloom.operators.spatial import nearest_of_set


def kruskal(rows):
    """rows: (group, weight, src, dst)."""
    sets, out = Sets(), set()
    for g, w, a, b in sorted(set(rows)):
        if a != b and sets.join((g, a), (g, b)):
            out.add((g, w, a, b))
    return out


@pytest.mark.parametrize("task_edges", [200_000, 40, 1])
def test_random_graphs_with_ties(spark, task_edges):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(rng.integers(0, 6)), int(a), int(b)) for g, n, m in ((1, 30, 90), (2, 5, 4), (3, 60, 55), (4, 1, 2)) for a, b in rng.integers(0, n, (m, 2)) for g in [g]]
    rows += [(5, float(k), k, k + 1) for k in range(50)]  # every pick points down a chain
    rows += [(6, 1.0, 0, k) for k in range(1, 40)] + rows[:20]  # a star of ties; repeated rows
    df = spark.createDataFrame(rows, "cell_id long, weight double, src long, dst long").repartition(4)
    got = [(r.cell_id, r.weight, r.src, r.dst) for r in spanning_forest(df, "cell_id", ["weight", "src", "dst"], task_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == kruskal(rows)
    assert spanning_forest(df.limit(0), "cell_id", ["weight", "src", "dst"], task_edges).count() == 0


def test_a_large_component_in_bounded_tasks(spark, monkeypatch):
    from voxloom.operators import forest

    most = []
    plain = forest._by_task

    def watched(live, order):
        most.append(live.groupBy("grp").count().agg(F.max("count")).first()[0] or 0)
        return plain(live, order)

    monkeypatch.setattr(forest, "_by_task", watched)
    n = 120_000
    chain = spark.range(1, n).select(F.lit(1).cast("long").alias("cell_id"), F.col("id").alias("src"), (F.col("id") - 1 - F.col("id") % 3 * (F.col("id") > 2).cast("long")).alias("dst"), (F.xxhash64("id") % 1000).cast("double").alias("weight"))
    extra = spark.range(n // 3).select(F.lit(1).cast("long").alias("cell_id"), (F.xxhash64("id") % n).alias("src"), (F.xxhash64("id", F.lit(1)) % n).alias("dst"), F.lit(5000.0).alias("weight")).where("src >= 0 and dst >= 0")
    got = forest.spanning_forest(chain.unionByName(extra), "cell_id", ["weight", "src", "dst"], 20_000)
    assert got.count() == n - 1 and got.where("weight = 5000").count() == 0  # the tree is spanning, extra edges close cycles
    assert max(most) <= 20_000


def test_nulls_and_loops(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0), (1, None, 2, 0.0), (1, 2, 3, 1.0), (None, 4, 5, 1.0)], "cell_id long, src long, dst long, weight double")
    assert sorted(map(tuple, spanning_tree(df.where("cell_id is not null")).collect())) == [(1, 2, 3, 1.0)]


@pytest.mark.parametrize("fine", [1, 3])
def test_nearest_of_set_equals_all_pairs(spark, fine):
    rng = np.random.default_rng(9)
    places = [(int(s), *map(float, p)) for s in range(6) for p in rng.integers(-20, 20, (25, 3))]
    points = [(i, int(rng.integers(0, 2)), *map(float, rng.uniform(-25, 25, 3))) for i in range(120)]
    members = [(s, k) for s in range(5) for k in (0, 1) if s or k]
    got = nearest_of_set(
        spark.createDataFrame(places, "set_id long, x double, y double, z double"), spark.createDataFrame(points, "id long, k long, x double, y double, z double"), 6.5, fine,
        members=spark.createDataFrame(members, "set_id long, k long"), on=["k"], unless=F.col("id") == 7,
    )
    want = {}
    for s, k in members:
        for i, kp, *p in points:
            d = min(float(np.sqrt(((np.array(p) - q[1:]) ** 2).sum())) for q in places if q[0] == s)
            if kp == k and d < 6.5 and i != 7:
                want[s, k, i] = round(d, 9)
    assert want and {(r.set_id, r.k, r.id): round(r.dist, 9) for r in got.collect()} == want
