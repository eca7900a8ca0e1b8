"""Searches of places whose rows Spark takes for few: no side of a join goes through the driver."""

import numpy as np
from growth import joins_by_broadcast

from voxloom.operators import skeleton as K
from voxloom.operators.spatial import nearest_anywhere


def crowded(spark, seed=7):
    """3,000 points on some 900 places."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 10, (3000, 3)).astype(float) * [1.0, 0.5, 2.0]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    return df, at


def test_nearest_anywhere_joins_by_shuffles(spark):
    """queries and points that share places, ties to the smaller id."""
    df, at = crowded(spark)
    shift = [0.3, 0.0, 0.5]
    q = df.where("id % 3 = 0").selectExpr("id AS query_id", *[f"{c} + {s} AS {c}" for c, s in zip("xyz", shift)])
    got = []
    assert not joins_by_broadcast(spark, lambda: got.extend(nearest_anywhere(q, df.where("id % 3 <> 0"), 2.0).collect()))
    rest = np.array([i for i in range(3000) if i % 3])
    want = {}
    for i in range(0, 3000, 3):
        d = np.sqrt(((at[i] + shift - at[rest]) ** 2).sum(1))
        want[i] = (int(rest[d.argmin()]), round(float(d.min()), 9))
    assert len(got) == 1000 and {r.query_id: (r.id, round(r.dist, 9)) for r in got} == want


def test_empty_spaces_join_by_shuffles(spark):
    """F4."""
    df, at = crowded(spark, 8)
    q = df.where("id < 500").selectExpr("id", "x + 3 AS x", "y + 1.25 AS y", "z + 2 AS z")
    got = []
    assert not joins_by_broadcast(spark, lambda: got.extend(K.empty_spaces(q, df, 1.5).collect()))
    held = at[:500] + [3.0, 1.25, 2.0]
    want = {i for i, c in enumerate(held) if not ((at >= c - 0.75) & (at < c + 0.75)).all(1).any()}
    assert {r.id for r in got} == want and 0 < len(want) < 500
