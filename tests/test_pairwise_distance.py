"""Feature distances of all pairs by blocks of cells, against a plain version."""

import math

import numpy as np
import pytest
from growth import joins_by_broadcast, shuffled_rows

from voxloom.functions.modes import r6_plain
from voxloom.operators import features as N
from voxloom.operators import wiring as W
from voxloom.plans import registry


def plain(rows, parts):
    want = []
    for p in rows:
        for q in rows:
            if p["cell"] is None or q["cell"] is None or not p["cell"] < q["cell"]:
                continue
            d = [math.sqrt(sum((x - y) * (x - y) for x, y in zip(p[c], q[c]))) for c in parts if any(p[c]) and any(q[c])]
            d = [x for x in d if x > 0]
            want.append((p["cell"], q["cell"], sum(d) / len(d) if d else 1000.0))
    return sorted(want)


def cells_of(spark, n):
    """Cells with parts of zeros, equal ones, a cell twice and one without a name."""
    rng = np.random.default_rng(4)
    rows = [{"cell": i, "one": [float(v) for v in rng.integers(0, 2, 3)], "two": [float(v) for v in rng.integers(0, 3, 1)]} for i in range(n)]
    rows += [dict(rows[3]), {"cell": None, "one": [1.0, 2.0, 3.0], "two": [1.0]}]
    return rows, spark.createDataFrame([(r["cell"], r["one"], r["two"]) for r in rows], "cell long, one array<double>, two array<double>")


def test_pairs_by_blocks_equal_all_pairs(spark):
    """in as many tasks as the session has partitions, however few the rows are, and through no driver."""
    rows, df = cells_of(spark, 150)
    got = []

    def run():
        pairs = N.pairwise_distance(df, ["one", "two"])
        assert pairs.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
        got.extend(pairs.collect())

    assert not joins_by_broadcast(spark, run)
    assert sorted((r.a, r.b, r.dist) for r in got) == plain(rows, ["one", "two"])


def test_blocks_grow_slower_than_cells():
    assert [N.pair_blocks(n, 4000, 64) for n in (0, 1, 1000, 60_000, 360_000)] == [1, 1, 16, 45, 90]


def test_combined_distance_moves_no_pairs(spark, monkeypatch):
    """150 cells and 11,324 pairs, of which those with common partners alone are moved; a part unknown in a cell, parts of unlike length."""
    monkeypatch.setattr(W, "PAIR_BLOCK", 40)
    monkeypatch.setattr(W, "STRIPE", 100)
    rows, _ = cells_of(spark, 150)
    rows[5]["one"], rows[6]["two"], rows[7]["one"] = None, [1.0, 2.0], [1.0, None, 2.0]
    rng = np.random.default_rng(6)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 140, 300), rng.integers(20, 400, 300))}
    matrix = spark.createDataFrame(sorted(edges), "pre long, post long").cache()
    df = spark.createDataFrame([(r["cell"], r["one"], r["two"]) for r in rows], "cell long, one array<double>, two array<double>").cache()
    matrix.count(), df.count()
    got = []
    assert shuffled_rows(spark, lambda: got.extend(N.combined_distance(df, ["one", "two"], matrix).collect())) < 8000
    near = {(r.a, r.b): r.dist for r in N.pairwise_distance(df, ["one", "two"]).collect()}
    wired = {(r.a, r.b): r.dist for r in W.wiring_distance(matrix, df.select("cell")).collect()}
    assert len(got) == 150 * 149 // 2 + 149  # one cell has two rows
    assert all(r.dist == near[r.a, r.b] + wired[r.a, r.b] for r in got)
    assert min(wired.values()) < 2 == max(wired.values())


def test_rounding_without_decimals(spark):
    """as SQL's round of a double, halves up."""
    import duckdb

    values = [0.0, 2.0, 0.3284375, 1.3284375, 1.0000005, 1.9999995, 0.1234565, 1 - 1 / 3, 1e-7, 5e-7, 123456.7890125]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(r6_plain("v").alias("v")).collect()]
    assert got == [duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["j2_pairs_within", "g18_radius_graph", "x18_wiring_distance", "x18_wiring_distance_compat"])
def test_pairs_without_number_are_rounded_by_arithmetic(spark, name):
    """no decimal is made for a pair."""
    registry.load()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "round(" not in plan and "floor(" in plan
