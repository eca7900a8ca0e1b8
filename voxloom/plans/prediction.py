"""Queries of the prediction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import argmax, mode_smallest, r6
from voxloom.operators import prediction as P
from voxloom.operators.spatial import nearest_in_group
from voxloom.plans.registry import query
from voxloom.plans.views import view

N = 7
#: The 64 places of an embedding as logits of seven classes: every seventh place belongs to one class.
FOLDED = f"folded AS (SELECT sample_id, cell_id, truth, list_transform(range(1, {N + 1}), lambda c: list_sum(list_transform(range(c, len(logits) + 1, {N}), lambda j: CAST(logits[j] AS DOUBLE)))) AS l FROM samples)"
SOFT = f"""{FOLDED}, soft AS (SELECT sample_id, cell_id, truth, i, exp(l[i] - list_max(l)) AS e FROM (SELECT *, unnest(range(1, {N + 1})) AS i FROM folded) u),
    prob AS (SELECT sample_id, cell_id, truth, i, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM soft)"""
BEST = "best AS (SELECT sample_id, cell_id, truth, arg_min(i, struct_pack(a := -p, b := i)) - 1 AS c FROM prob GROUP BY sample_id, cell_id, truth)"


def _samples(spark, d):
    places = lambda c: F.filter(F.transform("logits", lambda x, i: F.when(i % N == c, x.cast("double"))), lambda x: x.isNotNull())
    total = lambda c: F.aggregate(places(c), F.lit(0.0), lambda a, x: a + x)
    return view(spark, d, "samples").withColumn("logits", F.array(*[total(c) for c in range(N)]))


@query(f"WITH {SOFT}, {BEST}, k AS (SELECT cell_id, c, count(*) AS n FROM best GROUP BY cell_id, c) SELECT cell_id, CAST(c AS INTEGER) AS cell_class FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, c) AS rn FROM k) r WHERE rn = 1")
def p1_cell_class(spark, d):
    return P.cell_class(_samples(spark, d))


@query(f"WITH {FOLDED} SELECT sample_id, round(l[2] + l[7], 6) AS second, CAST(6 AS INTEGER) AS n FROM folded")
def p2_merge_class(spark, d):
    merged = P.merge_class(F.transform("logits", lambda x: x.cast("double")), 6, 1)
    return _samples(spark, d).select("sample_id", r6(merged[1]).alias("second"), F.size(merged).alias("n"))


CERT = f"{SOFT}, mp AS (SELECT cell_id, i, avg(p) AS p FROM prob GROUP BY cell_id, i), cert AS (SELECT cell_id, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln({N}.0) AS certainty FROM mp GROUP BY cell_id)"


@query(f"WITH {CERT} SELECT cell_id, round(certainty, 6) AS certainty FROM cert")
def p3_certainty(spark, d):
    return P.certainty(_samples(spark, d), N).withColumn("certainty", r6("certainty"))


NEAR = """near AS (SELECT q.obj_id, q.vid AS query_id, p.vid AS id, p.x AS px, p.label, row_number() OVER (PARTITION BY q.vid ORDER BY sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)), p.vid) AS rank
    FROM vertices q JOIN vertices p ON q.obj_id = p.obj_id AND q.label < 2 AND p.label >= 2)"""


def _near(spark, d, k, value):
    v = view(spark, d, "vertices")
    q = v.where("label < 2").select("obj_id", F.col("vid").alias("query_id"), "x", "y", "z")
    p = v.where("label >= 2").select("obj_id", F.col("vid").alias("id"), "x", "y", "z", (F.col("x") / 100).alias("px"))
    return nearest_in_group(q, p, "obj_id", k, value)


@query(f"WITH {NEAR} SELECT obj_id, query_id, round(avg(px / 100), 6) AS p FROM near WHERE rank <= 5 GROUP BY obj_id, query_id")
def p4_mean_of_nearest(spark, d):
    return _near(spark, d, 5, "px").groupBy("obj_id", "query_id").agg(r6(F.avg("value")).alias("p"))


@query(f"WITH {NEAR} SELECT obj_id, query_id, id FROM near WHERE rank = 1")
def p5_nearest_embedding(spark, d):
    return _near(spark, d, 1, None).select("obj_id", "query_id", "id")


VOTES = "k AS (SELECT vertex_id, label, count(*) AS n FROM votes {0} GROUP BY vertex_id, label), b AS (SELECT vertex_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY n DESC, label) AS rn FROM k) r WHERE rn = 1)"


def _vertices(spark, d):
    return view(spark, d, "vertices").select((F.col("vid") * 2).alias("vertex_id"))


@query(f"WITH {VOTES.format('')} SELECT v.vid * 2 AS vertex_id, coalesce(b.label, -1) AS label FROM vertices v LEFT JOIN b ON v.vid * 2 = b.vertex_id")
def p6_vertex_votes(spark, d):
    return P.vertex_votes(_vertices(spark, d), view(spark, d, "votes"))


@query("""WITH f AS (SELECT vid, CASE WHEN label % 3 = 1 THEN CASE WHEN z % 3 = 1 THEN 3 WHEN z % 3 = 2 THEN 4 ELSE 1 END WHEN label % 3 = 0 THEN CASE WHEN y % 3 = 1 THEN 5 WHEN y % 3 = 2 THEN 6 ELSE 0 END ELSE 2 END AS fused FROM vertices)
    SELECT vid, fused, CASE WHEN fused IN (5, 6) THEN 0 ELSE fused END AS compartment, CASE fused WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS spine FROM f""")
def p7_fuse_labels(spark, d):
    fused = P.fuse_labels(F.col("label") % 3, F.col("z") % 3, F.col("y") % 3)
    v = view(spark, d, "vertices").select("vid", fused.alias("fused"))
    return v.select("vid", "fused", P.to_compartment(F.col("fused")).alias("compartment"), P.to_spine(F.col("fused")).alias("spine"))


@query(f"WITH {VOTES.format('WHERE label <> 0')} SELECT v.vid * 2 AS vertex_id, coalesce(b.label, 9) AS label FROM vertices v LEFT JOIN b ON v.vid * 2 = b.vertex_id")
def p8_pixel_votes(spark, d):
    return P.pixel_votes(_vertices(spark, d), view(spark, d, "votes"), 0, 9)


@query(f"WITH {VOTES.format('')} SELECT vertex_id, label FROM b")
def p9_majority(spark, d):
    return mode_smallest(view(spark, d, "votes"), ["vertex_id"], "label", "label").drop("label_count")


NAMES = {0: "dendrite", 1: "axon", 2: "soma"}


@query("SELECT vid, CASE label WHEN 0 THEN 'dendrite' WHEN 1 THEN 'axon' WHEN 2 THEN 'soma' END AS name, CASE WHEN label < 3 THEN label ELSE -1 END AS code FROM vertices")
def p10_codes(spark, d):
    return P.encode(P.decode(view(spark, d, "vertices"), "label", NAMES), "name", NAMES).select("vid", "name", "code")


@query("""WITH k AS (SELECT truth AS t, label AS p, count(*) AS n FROM votes GROUP BY truth, label), cl AS (SELECT DISTINCT t AS c FROM k UNION SELECT DISTINCT p FROM k),
    s AS (SELECT c, coalesce((SELECT sum(n) FROM k WHERE t = c), 0) AS support, coalesce((SELECT sum(n) FROM k WHERE p = c), 0) AS called, coalesce((SELECT sum(n) FROM k WHERE p = c AND t = c), 0) AS hits FROM cl),
    r AS (SELECT c, support, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM s)
    SELECT CAST(c AS BIGINT) AS class, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS fscore,
        round((SELECT sum(n) FROM k WHERE t = p) / (SELECT sum(n) FROM k), 6) AS accuracy FROM r""")
def p11_performance(spark, d):
    out = P.performance(view(spark, d, "votes"))
    return out.select(F.col("class").cast("long").alias("class"), "support", *[r6(c).alias(c) for c in ("precision", "recall", "fscore", "accuracy")])


@query("""WITH v AS (SELECT sample_id, truth, list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS v FROM samples),
    n AS (SELECT q.sample_id AS query_id, t.truth AS label, row_number() OVER (PARTITION BY q.sample_id ORDER BY list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), t.sample_id) AS rn FROM v q JOIN v t ON q.sample_id % 3 = 0 AND t.sample_id % 3 <> 0),
    k AS (SELECT query_id, label, count(*) AS c FROM n WHERE rn <= 5 GROUP BY query_id, label)
    SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) AS rn FROM k) r WHERE rn = 1""")
def p12_knn_classify(spark, d):
    v = view(spark, d, "samples").select("sample_id", F.col("truth").alias("label"), F.col("logits").alias("v"))
    return P.knn_classify(v.where("sample_id % 3 = 0").withColumnRenamed("sample_id", "query_id"), v.where("sample_id % 3 <> 0").withColumnRenamed("sample_id", "id"), 5, 64)


@query()
def p13_whitened_pca(spark, d):
    v = view(spark, d, "samples").select("sample_id", F.col("logits").alias("v"))
    return P.whitened_pca(v, 3).select("sample_id", *[r6(F.col("pca")[i]).alias(f"c{i}") for i in range(3)])


@query("SELECT sv_id FROM (SELECT x * 100 + y AS sv_id, avg(round(p, 6)) AS m, sum(CASE WHEN round(p, 6) > 0.45 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM voxels GROUP BY x * 100 + y) v WHERE m > 0.45 AND k > floor(0.7 * n)")
def p14_astrocyte_list(spark, d):
    from voxloom.operators.graph import astrocyte_call

    votes = view(spark, d, "voxels").select((F.col("x") * 100 + F.col("y")).alias("sv_id"), r6("p").alias("p"))
    return astrocyte_call(votes, 0.45).where("astrocyte").select("sv_id")


@query("SELECT v.vid, n.diameter > 25 AS myelin FROM vertices v JOIN skel_nodes n ON n.cell_id = v.obj_id AND n.node_id = v.vid % 40")
def p15_myelin_to_vertices(spark, d):
    nodes = view(spark, d, "skel_nodes").select(F.col("cell_id").alias("obj_id"), "node_id", (F.col("diameter") > 25).alias("myelin"))
    return view(spark, d, "vertices").withColumn("node_id", F.col("vid") % 40).join(nodes, ["obj_id", "node_id"]).select("vid", "myelin")


@query(f"WITH {SOFT}, {BEST} SELECT sample_id, CAST(c AS INTEGER) AS c FROM best")
def p16_argmax(spark, d):
    return _samples(spark, d).select("sample_id", argmax(F.col("logits")).alias("c"))


@query("""WITH n AS (SELECT cell_id, count(*) AS n FROM samples WHERE sample_id % 7 <> 0 OR cell_id % 2 = 0 GROUP BY cell_id)
    SELECT cell_id, CAST(CASE WHEN n < 4 THEN 4 ELSE n - n % 4 END AS BIGINT) AS n_places, CAST(CASE WHEN n < 4 THEN 1 ELSE floor(n / 4) END AS BIGINT) AS n_subsets FROM n""")
def p18_fixed_subsets(spark, d):
    s = view(spark, d, "samples").where("sample_id % 7 <> 0 or cell_id % 2 = 0")
    sub = P.fixed_subsets(s, 4, 0)
    return sub.groupBy("cell_id").agg(F.count("*").alias("n_places"), F.count_distinct("subset").alias("n_subsets"))


@query(f"WITH {CERT}, {BEST}, k AS (SELECT cell_id, c, count(*) AS n FROM best GROUP BY cell_id, c), m AS (SELECT cell_id, c FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, c) AS rn FROM k) r WHERE rn = 1) SELECT cell_id, CASE c WHEN 0 THEN 'dendrite' WHEN 1 THEN 'axon' WHEN 2 THEN 'soma' END AS name, round(certainty, 6) AS certainty FROM m JOIN cert USING (cell_id)")
def x14_cell_type(spark, d):
    s = _samples(spark, d)
    return P.decode(P.cell_class(s), "cell_class", NAMES).join(P.certainty(s, N), "cell_id").select("cell_id", "name", r6("certainty").alias("certainty"))


@query("""WITH z AS (SELECT cell_id, list_sum(list_transform(range(1, 65), lambda j: ((j * 37) % 11 - 5) / 5.0 * CAST(logits[j] AS DOUBLE))) AS z FROM samples)
    SELECT cell_id, count(*) AS n, round(avg(greatest(z, 0)), 6) AS score FROM z GROUP BY cell_id""")
def u2_apply_model(spark, d):
    """A unit with fixed weights over whole vectors, rectified, then the mean of each cell."""

    def load():
        import numpy as np
        import pandas as pd

        weights = ((np.arange(1, 65) * 37) % 11 - 5) / 5.0
        return lambda f: pd.DataFrame({"cell_id": f["cell_id"], "score": np.maximum(np.stack(f["logits"]).astype(float) @ weights, 0) if len(f) else []})

    made = P.apply_model(view(spark, d, "samples"), load, ["cell_id", "logits"], "cell_id long, score double")
    return made.groupBy("cell_id").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("score"))
