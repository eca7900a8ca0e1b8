"""Queries of the connectivity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6, r6_plain
from voxloom.operators import wiring as W
from voxloom.plans.registry import query
from voxloom.plans.views import view

COLS = "syn_id, cell_1, cell_2, round(syn_prob, 6) AS syn_prob, ax_1, ax_2, ct_1, ct_2, sp_1, sp_2, x, y, z"
FOLD = "CASE WHEN {0} IN (3, 4) THEN 1 ELSE {0} END"
FILTERED = f"""f AS (SELECT * FROM (SELECT syn_id, cell_1, cell_2, syn_prob, {FOLD.format('ax_1')} AS ax_1, {FOLD.format('ax_2')} AS ax_2, ct_1, ct_2, mesh_area, mesh_area / 2 AS size, syn_sign
    FROM synapses WHERE round(syn_prob, 6) >= 0.6) q WHERE ax_1 + ax_2 = 1)"""
DIRECTED = f"""{FILTERED}, g AS (SELECT *, CASE WHEN ax_1 = 1 THEN cell_1 ELSE cell_2 END AS pre, CASE WHEN ax_1 = 1 THEN cell_2 ELSE cell_1 END AS post,
    CASE WHEN ax_1 = 1 THEN ct_1 ELSE ct_2 END AS pre_type, CASE WHEN ax_1 = 1 THEN ct_2 ELSE ct_1 END AS post_type FROM f)"""
MATRIX = f"""{DIRECTED}, m AS (SELECT pre, post, pre_type, post_type,
    CASE WHEN sum(CASE WHEN syn_sign < 0 THEN size ELSE 0 END) > sum(CASE WHEN syn_sign > 0 THEN size ELSE 0 END) THEN -sum(size) ELSE sum(size) END AS weight, count(*) AS n
    FROM g GROUP BY pre, post, pre_type, post_type)"""
PARTNERS = """p AS (SELECT syn_id, syn_prob, mesh_area, syn_sign, cell_1 AS cell, ct_1 AS cell_type, ax_1 AS ax, cell_2 AS partner, ax_2 AS partner_ax, ct_2 AS partner_type, 1 AS side FROM synapses
    UNION ALL SELECT syn_id, syn_prob, mesh_area, syn_sign, cell_2, ct_2, ax_2, cell_1, ax_1, ct_1, 2 FROM synapses)"""


def _syn(spark, d):
    return view(spark, d, "synapses").withColumn("syn_prob", r6("syn_prob"))


def _filtered(spark, d):
    return W.filtered_synapses(_syn(spark, d), 0.6, True)


@query(f"SELECT {COLS}, latent_id, round(mesh_area / 2 * syn_sign, 6) AS size FROM synapses WHERE round(syn_prob, 6) > 0.6")
def x1_export_table(spark, d):
    return W.export_table(_syn(spark, d), 0.6).withColumn("size", r6("size"))


@query(f"WITH {FILTERED} SELECT syn_id, cell_1, cell_2, ax_1, ax_2, round(size, 6) AS size FROM f")
def x2_filtered_synapses(spark, d):
    return _filtered(spark, d).select("syn_id", "cell_1", "cell_2", "ax_1", "ax_2", r6("size").alias("size"))


@query(f"WITH {DIRECTED} SELECT DISTINCT pre, post FROM g")
def x3_wiring_graph(spark, d):
    return W.wiring_graph(_filtered(spark, d))


@query(f"WITH {MATRIX} SELECT pre, post, pre_type, post_type, round(weight, 6) AS weight, n FROM m")
def x4_wiring_matrix(spark, d):
    return W.wiring_matrix(_filtered(spark, d)).withColumn("weight", r6("weight"))


@query(f"""WITH {MATRIX} SELECT pre AS cell, pre_type AS cell_type, row_number() OVER (ORDER BY pre_type, pre) - 1 AS place FROM (SELECT DISTINCT pre, pre_type FROM m) u""")
def x4_matrix_places(spark, d):
    return W.matrix_places(W.wiring_matrix(_filtered(spark, d)), "pre").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {MATRIX}, s AS (SELECT pre_type, post_type, CASE WHEN sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) > sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) THEN -sum(abs(weight)) ELSE sum(abs(weight)) END AS total FROM m GROUP BY pre_type, post_type),
    a AS (SELECT pre_type, count(DISTINCT pre) AS n_pre FROM m GROUP BY pre_type), b AS (SELECT post_type, count(DISTINCT post) AS n_post FROM m GROUP BY post_type)
    SELECT pre_type, post_type, round(CASE WHEN abs(total / (n_pre * n_post)) < 0.01 THEN 0 ELSE total / (n_pre * n_post) END, 6) AS density FROM s JOIN a USING (pre_type) JOIN b USING (post_type)""")
def x5_type_blocks(spark, d):
    return W.type_blocks(W.wiring_matrix(_filtered(spark, d)), 0.01).withColumn("density", r6("density"))


SUMS = """w AS (SELECT *, CASE WHEN ax_1 IN (3, 4) THEN 1 WHEN ax_1 IN (5, 6) THEN 0 ELSE ax_1 END AS a1, CASE WHEN ax_2 IN (3, 4) THEN 1 WHEN ax_2 IN (5, 6) THEN 0 ELSE ax_2 END AS a2
    FROM synapses WHERE round(syn_prob, 6) >= 0.6 AND mesh_area BETWEEN 0.5 AND 4),
    h AS (SELECT mesh_area, CASE WHEN a1 = 1 THEN ct_1 ELSE ct_2 END AS pre_type, CASE WHEN a1 = 1 THEN ct_2 ELSE ct_1 END AS post_type FROM w WHERE a1 + a2 = 1),
    s AS (SELECT 'out' AS direction, pre_type AS cell_type, post_type AS partner_type, sum(mesh_area) AS area, count(*) AS n FROM h GROUP BY pre_type, post_type
    UNION ALL SELECT 'in', post_type, pre_type, sum(mesh_area), count(*) FROM h GROUP BY pre_type, post_type)"""


@query(f"WITH {SUMS} SELECT direction, cell_type, partner_type, round(area, 6) AS area, n FROM s")
def x6_type_sums(spark, d):
    return W.type_sums(_syn(spark, d), 0.6, (0.5, 4.0)).withColumn("area", r6("area"))


@query(f"WITH {SUMS} SELECT direction, cell_type, partner_type, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY direction, cell_type ORDER BY n DESC, partner_type) AS INTEGER) AS rank FROM s) r WHERE rank <= 5")
def x7_top_partners(spark, d):
    return W.top_partners(W.type_sums(_syn(spark, d), 0.6, (0.5, 4.0))).select("direction", "cell_type", "partner_type", "n", "rank")


@query(f"WITH {PARTNERS}, c AS (SELECT DISTINCT s_suppkey AS cell FROM supplier UNION SELECT c_custkey + 1000 FROM customer), k AS (SELECT cell, count(*) AS n FROM p WHERE round(syn_prob, 6) >= 0.8 GROUP BY cell) SELECT cell, coalesce(n, 0) AS n FROM c LEFT JOIN k USING (cell)")
def x8_synapses_per_cell(spark, d):
    from voxloom.session import read_table

    cells = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell")).union(read_table(spark, d, "customer").select(F.col("c_custkey") + 1000)).distinct()
    return W.synapses_per_cell(_syn(spark, d), cells, 0.8)


@query(f"""WITH {PARTNERS}, s AS (SELECT cell, sum(CASE WHEN ax IN (1, 3, 4) AND partner_ax IN (0) THEN mesh_area END) AS t, sum(CASE WHEN ax IN (1, 3, 4) AND partner_ax IN (0) AND syn_sign = -1 THEN mesh_area END) AS m FROM p GROUP BY cell)
    SELECT cell, round(CASE WHEN t > 0 THEN coalesce(m, 0) / t ELSE -1 END, 6) AS ratio FROM s""")
def x9_sign_ratio(spark, d):
    return W.sign_ratio(_syn(spark, d), [1, 3, 4], [0], True).withColumn("ratio", r6("ratio"))


@query(f"""WITH {PARTNERS}, q AS (SELECT cell, syn_sign, mesh_area FROM p WHERE ax = 1 AND partner_ax = 0) SELECT cell, round(sum(CASE WHEN syn_sign = -1 THEN 1 ELSE 0 END) / count(*), 6) AS ratio, count(*) AS n FROM q GROUP BY cell""")
def x9_sign_ratio_unweighted(spark, d):
    p = W.partners(_syn(spark, d)).where("ax = 1 and partner_ax = 0")
    return p.groupBy("cell").agg(r6(F.count_if(F.col("syn_sign") == -1) / F.count("*")).alias("ratio"), F.count("*").alias("n"))


@query(f"WITH {PARTNERS} SELECT cell, syn_sign, count(*) AS n, round(sum(mesh_area), 6) AS area FROM p GROUP BY cell, syn_sign")
def x11_by_sign(spark, d):
    return W.by_sign(_syn(spark, d)).withColumn("area", r6("area"))


@query(f"SELECT {COLS} FROM synapses WHERE cell_1 = 7 OR cell_2 = 7")
def x12_of_cell(spark, d):
    return W.of_cell(_syn(spark, d), 7).select("syn_id", "cell_1", "cell_2", "syn_prob", "ax_1", "ax_2", "ct_1", "ct_2", "sp_1", "sp_2", "x", "y", "z")


@query(f"SELECT syn_id, cell_1, cell_2, ct_1, ct_2, {FOLD.format('ax_1')} AS ax_1, {FOLD.format('ax_2')} AS ax_2, round(mesh_area / 2, 6) AS size, syn_sign FROM synapses WHERE round(syn_prob, 6) >= 0.3")
def x13_all_metadata(spark, d):
    return W.filtered_synapses(_syn(spark, d), 0.3, False).select("syn_id", "cell_1", "cell_2", "ct_1", "ct_2", "ax_1", "ax_2", r6("size").alias("size"), "syn_sign")


@query("SELECT obj_id, CASE WHEN size IS NULL THEN '' ELSE CAST(size AS VARCHAR) END AS value FROM (SELECT 17 AS obj_id) k LEFT JOIN objects USING (obj_id)")
def x15_read_attribute(spark, d):
    one = spark.range(17, 18).select(F.col("id").alias("obj_id"))
    found = view(spark, d, "objects").where("obj_id = 17").select("obj_id", F.col("size").cast("string").alias("v"))
    return one.join(found, "obj_id", "left").select(F.col("obj_id").cast("int").alias("obj_id"), F.coalesce("v", F.lit("")).alias("value"))


@query("""SELECT obj_id, CASE WHEN obj_id % 10 = 0 THEN CAST(obj_id * 2 AS BIGINT) ELSE size END AS size, CASE WHEN obj_id % 10 = 0 THEN 'new' END AS note FROM objects
    UNION ALL SELECT 100000000, 5, 'added'""")
def x16_upsert(spark, d):
    objs = view(spark, d, "objects").select("obj_id", "size")
    changes = objs.where("obj_id % 10 = 0").select("obj_id", (F.col("obj_id") * 2).alias("size"), F.lit("new").alias("note"))
    added = spark.range(1).select(F.lit(100000000).cast("long").alias("obj_id"), F.lit(5).cast("long").alias("size"), F.lit("added").alias("note"))
    return W.upsert(objs, changes.unionByName(added), "obj_id")


@query(f"WITH {DIRECTED} SELECT pre, post, round(sum(abs(size)), 6) AS size FROM g WHERE abs(size) > 0.3 GROUP BY pre, post")
def x17_dense_matrix(spark, d):
    syn = _filtered(spark, d)
    cells = syn.select(F.explode(F.array("cell_1", "cell_2")).alias("cell")).distinct()
    return W.dense_matrix(syn, cells, 0.3).withColumn("size", r6("size"))


SHARED = """c AS (SELECT DISTINCT s_suppkey AS cell FROM supplier),
    i AS (SELECT DISTINCT post AS cell, pre AS partner FROM m), o AS (SELECT DISTINCT pre AS cell, post AS partner FROM m),
    pr AS (SELECT a.cell AS a, b.cell AS b FROM c a JOIN c b ON a.cell < b.cell),
    ic AS (SELECT x.cell AS a, y.cell AS b, count(*) AS n FROM i x JOIN i y ON x.partner = y.partner AND x.cell < y.cell GROUP BY x.cell, y.cell),
    oc AS (SELECT x.cell AS a, y.cell AS b, count(*) AS n FROM o x JOIN o y ON x.partner = y.partner AND x.cell < y.cell GROUP BY x.cell, y.cell),
    ni AS (SELECT cell, count(*) AS n FROM i GROUP BY cell), nn AS (SELECT cell, count(*) AS n FROM o GROUP BY cell),
    t AS (SELECT pr.a, pr.b, coalesce(ic.n, 0) AS ci, coalesce(ia.n, 0) + coalesce(ib.n, 0) - coalesce(ic.n, 0) AS ui, coalesce(oc.n, 0) AS co, coalesce(oa.n, 0) + coalesce(ob.n, 0) - coalesce(oc.n, 0) AS uo
        FROM pr LEFT JOIN ic ON pr.a = ic.a AND pr.b = ic.b LEFT JOIN oc ON pr.a = oc.a AND pr.b = oc.b
        LEFT JOIN ni ia ON pr.a = ia.cell LEFT JOIN ni ib ON pr.b = ib.cell LEFT JOIN nn oa ON pr.a = oa.cell LEFT JOIN nn ob ON pr.b = ob.cell)"""


@query(f"WITH {MATRIX}, {SHARED} SELECT a, b, round(CASE WHEN ui > 0 THEN 1 - ci / ui ELSE 1 END + CASE WHEN uo > 0 THEN 1 - co / uo ELSE 1 END, 6) AS dist FROM t")
def x18_wiring_distance(spark, d):
    from voxloom.session import read_table

    cells = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"))
    return W.wiring_distance(W.wiring_matrix(_filtered(spark, d)), cells).withColumn("dist", r6_plain("dist"))


@query(f"WITH {MATRIX}, {SHARED} SELECT a, b, round(CASE WHEN ui > 0 THEN 1 - ci / ui ELSE 1 END + CASE WHEN ui + uo > 0 THEN 1 - (ci + co) / (ui + uo) ELSE 1 END, 6) AS dist FROM t")
def x18_wiring_distance_compat(spark, d):
    from voxloom.session import read_table

    cells = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"))
    return W.wiring_distance(W.wiring_matrix(_filtered(spark, d)), cells, compat=True).withColumn("dist", r6_plain("dist"))


OWN = """q AS (SELECT syn_id, cell_1 AS cell_id, syn_sign, mesh_area, x, y, z FROM synapses),
    a AS (SELECT q.*, n.axoness, row_number() OVER (PARTITION BY syn_id ORDER BY sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2) + pow(q.z - n.z, 2)), n.node_id) AS rn FROM q JOIN skel_nodes n ON q.cell_id = n.cell_id),
    s AS (SELECT cell_id, sum(CASE WHEN axoness IN (1, 3, 4) THEN mesh_area END) AS t, sum(CASE WHEN axoness IN (1, 3, 4) AND syn_sign = -1 THEN mesh_area END) AS m FROM a WHERE rn = 1 GROUP BY cell_id)"""


@query(f"WITH {OWN} SELECT cell_id AS cell, round(CASE WHEN t > 0 THEN coalesce(m, 0) / t ELSE -1 END, 6) AS ratio FROM s")
def x10_sign_ratio_by_skeleton(spark, d):
    """The compartment of a synapse is that of its cell's nearest skeleton node."""
    from voxloom.operators.skeleton import attribute_at

    coords = _syn(spark, d).select(F.col("cell_1").alias("cell_id"), F.col("syn_id").alias("query_id"), "x", "y", "z", "syn_sign", "mesh_area")
    nodes = view(spark, d, "skel_nodes")
    own = attribute_at(coords.join(nodes.select("cell_id").distinct(), "cell_id", "left_semi"), nodes, "axoness", keep=("syn_sign", "mesh_area"))
    return W.sign_ratio_of(own.withColumnsRenamed({"axoness": "own", "cell_id": "cell"}), [1, 3, 4]).withColumn("ratio", r6("ratio"))
