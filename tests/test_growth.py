"""What queries shuffle grows with their rows; results against plain versions."""

import numpy as np
from growth import shuffled_rows
from pyspark.sql import functions as F

from voxloom.operators import skeleton as K
from voxloom.operators import synapses as C
from voxloom.operators.spatial import nearest_anywhere, nearest_by_window


def cloud(spark, n, spread, seed=0):
    rng = np.random.default_rng(seed)
    at = np.round(rng.uniform(0, spread, (n, 3)), 3)
    df = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(at)], "id long, g int, x double, y double, z double").cache()
    df.count()
    return df, at


def test_nearest_by_window_looks_near_alone(spark):
    """a group of 1,000 queries and 1,000 points."""
    df, at = cloud(spark, 2000, 60)
    q, p, got = df.where("id < 1000").withColumnRenamed("id", "query_id"), df.where("id >= 1000"), []
    assert shuffled_rows(spark, lambda: got.extend(nearest_by_window(q, p, "g", 3).collect())) < 300 * 2000
    d = np.sqrt(((at[:1000, None] - at[None, 1000:]) ** 2).sum(2))
    want = np.argsort(d, axis=1, kind="stable")[:, :3] + 1000
    assert {(r.query_id, r.rank): r.id for r in got} == {(i, k + 1): int(want[i, k]) for i in range(1000) for k in range(3)}


def test_nearest_anywhere_starts_with_what_is_near(spark, monkeypatch):
    """the first radius follows the density."""
    from voxloom.operators import spatial

    df, at = cloud(spark, 1500, 6)
    radii, real = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda a, b, r, **k: radii.append(r) or real(a, b, r, **k))
    got = nearest_anywhere(df.where("id < 300").withColumnRenamed("id", "query_id"), df.where("id >= 300"), 2.0).collect()
    d = np.sqrt(((at[:300, None] - at[None, 300:]) ** 2).sum(2))
    assert {r.query_id: r.id for r in got} == {i: int(d[i].argmin()) + 300 for i in range(300)}
    assert radii[0] < 0.7


def test_empty_spaces_of_dense_vertices(spark):
    """F8: half-open boxes round 300 places, against all pairs; cells settle nearly all of them."""
    df, at = cloud(spark, 4000, 12, 3)
    q = df.where("id < 300").select("id", *[(F.round(F.col(c) * 1.7 - 3)).alias(c) for c in "xyz"])
    held = {r.id: (r.x, r.y, r.z) for r in q.collect()}
    want = {i for i, c in held.items() if not ((at >= np.array(c) - 1.5) & (at < np.array(c) + 1.5)).all(1).any()}
    assert {r.id for r in K.empty_spaces(q, df, 3.0).collect()} == want and 0 < len(want) < 300


def test_cross_validation_makes_its_rows_once(spark):
    """the rows' own steps do not run again for every fold."""
    rows = spark.range(400).selectExpr("id AS syn_id", "cast(id % 7 as double) AS a", "cast(id % 2 as double) AS label").repartition(4)
    assert shuffled_rows(spark, lambda: C.cross_validate(rows, ["a"], 4, 2).collect()) < 3 * 400


def test_pivot_of_partners_with_one_missing(spark):
    f = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 10, 7)], "syn_id long, cell_id long, n int")
    s = spark.createDataFrame([(1, 10, 11), (2, 10, 12), (3, 1, 1)], "syn_id long, cell_0 long, cell_1 long")
    assert {r.syn_id: (r.n_0, r.n_1) for r in C.pivot_partners(f, s, ["n"]).collect()} == {1: (5, 6), 2: (7, None), 3: (None, None)}


def test_places_of_sets_without_a_near_point_are_not_moved(spark):
    """40 sets of 200 places each and 60 partners a set; one point is near one of them."""
    from voxloom.operators.spatial import nearest_of_set

    rng = np.random.default_rng(2)
    rows = [(s, *map(float, rng.uniform(0, 30, 3) + [100.0 * s, 0, 0])) for s in range(40) for _ in range(200)]
    sets = spark.createDataFrame(rows, "set_id long, x double, y double, z double").repartition("set_id").cache()
    members = spark.range(40).selectExpr("id AS set_id", "explode(sequence(0, 59)) AS cell_id").cache()
    points = spark.createDataFrame([(1, 7, 510.0, 10.0, 10.0), (2, 8, 510.0, 900.0, 0.0)], "id long, cell_id int, x double, y double, z double")
    sets.count(), members.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        # cells of the sets with each partner once, members once
        assert shuffled_rows(spark, lambda: got.extend(nearest_of_set(sets, points, 10.5, 2, members, ["cell_id"]).collect())) < 40 * 60 * 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = min(np.sqrt(((np.array(r[1:]) - [510.0, 10.0, 10.0]) ** 2).sum()) for r in rows if r[0] == 5)
    assert [(r.set_id, r.cell_id, r.id, round(r.dist, 9)) for r in got] == [(5, 7, 1, round(want, 9))]
