"""Wiring distances of all pairs by blocks of cells, against sets."""

import numpy as np
import pytest
from growth import shuffled_rows

from voxloom.operators import wiring as W


@pytest.mark.parametrize("compat", [False, True])
def test_pairs_are_not_shuffled(spark, monkeypatch, compat):
    """300 cells, 44,850 pairs, some cells without inputs, outputs or both, partners outside the set."""
    monkeypatch.setattr(W, "PAIR_BLOCK", 50)
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 290, 900), rng.integers(10, 400, 900))}
    matrix = spark.createDataFrame([(a, b, a % 2) for a, b in edges] + [(1, 20, 7), (1, 20, 8)], "pre long, post long, pre_type long").cache()
    cells = spark.range(300).selectExpr("id AS cell").cache()
    matrix.count(), cells.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        assert shuffled_rows(spark, lambda: got.extend(W.wiring_distance(matrix, cells, compat).collect())) < 44_850
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    into, out = {i: set() for i in range(400)}, {i: set() for i in range(400)}
    for a, b in edges | {(1, 20)}:
        out[a].add(b), into[b].add(a)
    want = {}
    for a in range(300):
        for b in range(a + 1, 300):
            ci, ui, co, uo = len(into[a] & into[b]), len(into[a] | into[b]), len(out[a] & out[b]), len(out[a] | out[b])
            co, uo = (co + ci, uo + ui) if compat else (co, uo)
            want[a, b] = (1 - ci / ui if ui else 1.0) + (1 - co / uo if uo else 1.0)
    assert len(got) == 44_850 and {(r.a, r.b): r.dist for r in got} == want
