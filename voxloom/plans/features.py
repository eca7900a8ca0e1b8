"""Queries of the neuron features."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import features as N
from voxloom.operators import skeleton as K
from voxloom.operators import wiring as W
from voxloom.operators.spatial import nearest_in_group
from voxloom.plans.registry import query
from voxloom.plans.skeletons import EDGE, SCALE
from voxloom.plans.views import view

FWD = "ax_1 IN (1, 3, 4) AND ax_2 IN (0, 2)"
REV = "ax_2 IN (1, 3, 4) AND ax_1 IN (0, 2)"
MARK = f"""mk AS (SELECT *, mesh_area / 2 * syn_sign AS size, CASE WHEN {FWD} THEN sp_2 ELSE sp_1 END AS post_morph, CASE WHEN {FWD} THEN cell_1 ELSE cell_2 END AS pre, CASE WHEN {FWD} THEN cell_2 ELSE cell_1 END AS post,
        CASE WHEN {FWD} THEN ax_1 ELSE ax_2 END AS pre_morph, CASE WHEN {FWD} THEN ax_2 ELSE ax_1 END AS post_comp FROM synapses),
    why AS (SELECT *, CASE WHEN ax_1 = -1 OR ax_2 = -1 THEN 'unknown_compartment' WHEN NOT ({FWD}) AND NOT ({REV}) THEN 'not_axodendritic' WHEN size = 0 THEN 'size' WHEN post_morph = -1 THEN 'unknown_spine' END AS reason FROM mk),
    o AS (SELECT syn_id, pre, post, pre_morph, post_comp, post_morph, size, latent_id FROM why WHERE reason IS NULL),
    sd AS (SELECT *, pre AS cell, 'axon' AS comp, post AS partner FROM o UNION ALL SELECT *, post, CASE WHEN post_comp = 2 THEN 'soma' ELSE 'dendrite' END, pre FROM o),
    fa AS (SELECT cell, comp, sum(CASE WHEN size > 0 THEN size ELSE 0 END) / sum(abs(size)) AS f FROM sd GROUP BY cell, comp)"""


def _oriented(spark, d):
    syn = view(spark, d, "synapses").withColumn("size", F.col("mesh_area") / 2 * F.col("syn_sign"))
    return N.orient(syn)


@query(f"WITH {MARK} SELECT syn_id, pre, post, pre_morph, post_comp, post_morph, round(size, 6) AS size FROM o")
def n1_oriented(spark, d):
    return _oriented(spark, d)[0].select("syn_id", "pre", "post", "pre_morph", "post_comp", "post_morph", r6("size").alias("size"))


@query(f"WITH {MARK} SELECT reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY reason")
def n2_rejections(spark, d):
    return _oriented(spark, d)[1]


@query(f"WITH {MARK} SELECT cell FROM sd GROUP BY cell HAVING sum(CASE WHEN comp = 'dendrite' THEN 1 ELSE 0 END) > 50 OR sum(CASE WHEN comp = 'axon' THEN 1 ELSE 0 END) >= 50")
def n3_analysis_set(spark, d):
    return N.analysis_set(_oriented(spark, d)[0])


OBJ = """ob AS (SELECT obj_type, obj_id, obj_id % 200 AS cell_id, size, x, y, z FROM objects),
    nn AS (SELECT ob.obj_type, ob.obj_id, ob.cell_id, ob.size, n.axoness, row_number() OVER (PARTITION BY ob.obj_id ORDER BY sqrt(pow(ob.x - n.x, 2) + pow(ob.y - n.y, 2) + pow(ob.z - n.z, 2)), n.node_id) AS rn FROM ob JOIN skel_nodes n ON n.cell_id = ob.cell_id),
    oc AS (SELECT obj_type, obj_id, cell_id, size, CASE WHEN axoness = 0 THEN 'dendrite' WHEN axoness = 2 THEN 'soma' ELSE 'axon' END AS comp FROM nn WHERE rn = 1)"""


def _placed(spark, d):
    objs = view(spark, d, "objects").withColumn("cell_id", F.col("obj_id") % 200)
    near = nearest_in_group(objs.withColumnRenamed("obj_id", "query_id"), view(spark, d, "skel_nodes").withColumnRenamed("node_id", "id"), "cell_id", 1, "axoness")
    comp = F.when(F.col("value") == 0, "dendrite").when(F.col("value") == 2, "soma").otherwise("axon")
    return objs.join(near.select("cell_id", F.col("query_id").alias("obj_id"), comp.alias("comp")), ["cell_id", "obj_id"]).select("obj_type", "obj_id", "cell_id", "size", "comp")


@query(f"WITH {OBJ} SELECT obj_id, cell_id, comp FROM oc")
def n4_organelle_compartments(spark, d):
    return _placed(spark, d).select("obj_id", "cell_id", "comp")


PATH = f"{EDGE}, pa AS (SELECT cell_id, CASE ax_a WHEN 0 THEN 'dendrite' WHEN 1 THEN 'axon' WHEN 2 THEN 'soma' END AS comp, sum(length) AS path FROM w WHERE ax_a IN (0, 1, 2) GROUP BY cell_id, ax_a)"


def _weighted(spark, d):
    return K.weighted_edges(view(spark, d, "skel_nodes"), view(spark, d, "skel_edges"), SCALE, ("axoness",))


@query(f"WITH {PATH} SELECT cell_id, comp, round(path, 4) AS path FROM pa")
def n5_compartment_paths(spark, d):
    return N.compartment_paths(_weighted(spark, d)).withColumn("path", F.round("path", 4))


@query(f"""WITH {PATH}, {OBJ} SELECT cell_id, comp, obj_type, count(*) AS n, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.5), 6) AS median_size,
    round(coalesce(count(*) / max(path), 0), 6) AS n_density, round(coalesce(sum(size) / max(path), 0), 6) AS volume_density FROM oc LEFT JOIN pa USING (cell_id, comp) GROUP BY cell_id, comp, obj_type""")
def n6_compartment_stats(spark, d):
    s = N.compartment_stats(_placed(spark, d), N.compartment_paths(_weighted(spark, d)))
    return s.withColumns({c: r6(c) for c in ("mean_size", "median_size", "n_density", "volume_density")})


@query(f"WITH {MARK} SELECT cell, comp, round(f + 1e-9, 6) AS fraction_asym FROM fa")
def n7_fraction_asymmetric(spark, d):
    return N.fraction_asymmetric(N.sides(_oriented(spark, d)[0]), ["cell", "comp"]).withColumn("fraction_asym", r6(F.col("fraction_asym") + 1e-9))


@query(f"WITH {MARK} SELECT cell, comp, round(sum(CASE WHEN post_morph = 1 THEN abs(size) ELSE 0 END) / sum(abs(size)), 6) AS head_ratio FROM sd GROUP BY cell, comp")
def n8_head_ratio(spark, d):
    return N.head_ratio(N.sides(_oriented(spark, d)[0]), ["cell", "comp"]).withColumn("head_ratio", r6("head_ratio"))


@query(f"WITH {EDGE}, l AS (SELECT cell_id, sum(length) AS length, count(*) AS n FROM w GROUP BY cell_id) SELECT cell_id, round((n - 1) / length * 1000, 6) AS branch_density FROM l")
def n9_branch_density(spark, d):
    w = _weighted(spark, d)
    return N.branch_density(w, K.path_lengths(w)).withColumn("branch_density", r6(F.col("branch_density") * 1000))


@query("SELECT cell_id, round(avg(CASE WHEN diameter < 10 THEN 1.0 ELSE 0 END), 6) AS thin, round(avg(CASE WHEN diameter >= 10 AND diameter < 35 THEN 1.0 ELSE 0 END), 6) AS middle, round(avg(CASE WHEN diameter >= 35 THEN 1.0 ELSE 0 END), 6) AS thick FROM skel_nodes WHERE axoness = 1 GROUP BY cell_id")
def n10_radius_shares(spark, d):
    return N.radius_shares(view(spark, d, "skel_nodes"), 1, 10, 35).withColumns({c: r6(c) for c in ("thin", "middle", "thick")})


@query(f"""WITH {MARK} SELECT s.cell, s.comp, round(avg(coalesce(f.f, 0) * abs(size)), 6) AS partner_mean FROM sd s LEFT JOIN fa f ON f.cell = s.partner AND f.comp = CASE WHEN s.comp = 'axon' THEN 'dendrite' ELSE 'axon' END
    WHERE s.comp IN ('axon', 'dendrite') GROUP BY s.cell, s.comp""")
def n11_partner_means(spark, d):
    return N.partner_means(_oriented(spark, d)[0]).withColumn("partner_mean", r6("partner_mean"))


@query(f"WITH {MARK}, t AS (SELECT pre AS cell, sum(CASE WHEN pre_morph = 4 THEN abs(size) ELSE 0 END) AS a, sum(CASE WHEN pre_morph IN (3, 4) THEN abs(size) ELSE 0 END) AS b FROM o GROUP BY pre) SELECT cell, round(CASE WHEN b > 0 THEN a / b ELSE 0 END + 1e-9, 6) AS terminal_share FROM t")
def n12_terminal_share(spark, d):
    return N.terminal_share(_oriented(spark, d)[0]).withColumn("terminal_share", r6(F.col("terminal_share") + 1e-9))


STATS = "count(*) AS n_syn, avg(abs(size)) AS mean_size, quantile_cont(abs(size), 0.5) AS median_size, stddev_pop(abs(size)) AS std_size, sum(abs(size)) AS sum_size"
AXON = f"""{MARK}, st AS (SELECT cell, {STATS} FROM sd WHERE comp = 'axon' GROUP BY cell),
    te AS (SELECT pre AS cell, CASE WHEN sum(CASE WHEN pre_morph IN (3, 4) THEN abs(size) ELSE 0 END) > 0 THEN sum(CASE WHEN pre_morph = 4 THEN abs(size) ELSE 0 END) / sum(CASE WHEN pre_morph IN (3, 4) THEN abs(size) ELSE 0 END) ELSE 0 END AS t FROM o GROUP BY pre),
    la AS (SELECT cell, avg(CAST(embedding[1] AS DOUBLE)) AS l1, avg(CAST(embedding[10] AS DOUBLE)) AS l10 FROM sd JOIN embeddings ON latent_id = vec_id WHERE comp = 'axon' GROUP BY cell)"""
NAMES = ["n_syn", "mean_size", "median_size", "std_size", "sum_size", "fraction_asym", "terminal_share"]


def _latents(spark, d):
    from voxloom.session import read_table

    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("latent_id"), F.slice("embedding", 1, 10).alias("latent"))


def _vectors(spark, d, comp: str, least: int):
    """Cell, and the array of size figures, asymmetric fraction, terminal share (axons) and mean latents of a compartment."""
    o = _oriented(spark, d)[0]
    own = N.sides(o).where(F.col("comp") == comp)
    latent = N.mean_latent(own, _latents(spark, d), "cell").select("cell", *[F.col("latent")[i].alias(f"l{i}") for i in range(10)])
    parts = [N.fraction_asymmetric(own, ["cell"]), latent]
    names = list(NAMES)
    if comp == "axon":
        parts.append(N.terminal_share(o))
    else:
        names.remove("terminal_share")
    names += [f"l{i}" for i in range(10)]
    return N.feature_vectors(N.size_summary(own, ["cell"]), parts, "cell", "n_syn", least, names), names


@query(f"""WITH {AXON} SELECT st.cell, CASE WHEN n_syn > 15 THEN n_syn ELSE 0 END::DOUBLE AS n_syn, round(CASE WHEN n_syn > 15 THEN median_size ELSE 0 END, 6) AS median_size, round(CASE WHEN n_syn > 15 THEN std_size ELSE 0 END, 6) AS std_size,
    round(CASE WHEN n_syn > 15 THEN coalesce(f, 0) ELSE 0 END, 6) AS fraction_asym, round(CASE WHEN n_syn > 15 THEN t ELSE 0 END, 6) AS terminal_share, round(CASE WHEN n_syn > 15 THEN coalesce(l1, 0) ELSE 0 END, 6) AS l0, round(CASE WHEN n_syn > 15 THEN coalesce(l10, 0) ELSE 0 END, 6) AS l9
    FROM st LEFT JOIN te USING (cell) LEFT JOIN la USING (cell) LEFT JOIN fa ON fa.cell = st.cell AND fa.comp = 'axon'""")
def n13_axon_vector(spark, d):
    v, names = _vectors(spark, d, "axon", 15)
    return v.select("cell", *[r6(F.col("features")[names.index(c)]).alias(c) for c in ("n_syn", "median_size", "std_size", "fraction_asym", "terminal_share", "l0", "l9")])


def _side_sql(comp: str, least: int) -> str:
    return f"""WITH {MARK}, st AS (SELECT cell, {STATS} FROM sd WHERE comp = '{comp}' GROUP BY cell)
    SELECT st.cell, CASE WHEN n_syn > {least} THEN n_syn ELSE 0 END::DOUBLE AS n_syn, round(CASE WHEN n_syn > {least} THEN mean_size ELSE 0 END, 6) AS mean_size, round(CASE WHEN n_syn > {least} THEN sum_size ELSE 0 END, 6) AS sum_size,
    round(CASE WHEN n_syn > {least} THEN coalesce(f, 0) ELSE 0 END, 6) AS fraction_asym FROM st LEFT JOIN fa ON fa.cell = st.cell AND fa.comp = '{comp}'"""


def _side(spark, d, comp: str, least: int):
    v, names = _vectors(spark, d, comp, least)
    return v.select("cell", *[r6(F.col("features")[names.index(c)]).alias(c) for c in ("n_syn", "mean_size", "sum_size", "fraction_asym")])


@query(_side_sql("dendrite", 15))
def n14_dendrite_vector(spark, d):
    return _side(spark, d, "dendrite", 15)


@query(_side_sql("soma", 5))
def n15_soma_vector(spark, d):
    return _side(spark, d, "soma", 5)


@query(f"""WITH {MARK}, st AS (SELECT cell, {STATS} FROM sd WHERE comp = 'axon' GROUP BY cell), f AS (SELECT cell, CASE WHEN n_syn > 15 THEN mean_size ELSE 0 END AS a, CASE WHEN n_syn > 15 THEN sum_size ELSE 0 END AS b FROM st),
    m AS (SELECT avg(nullif(a, 0)) AS ma, stddev_pop(nullif(a, 0)) AS sa, avg(nullif(b, 0)) AS mb, stddev_pop(nullif(b, 0)) AS sb FROM f)
    SELECT cell, round(CASE WHEN a <> 0 THEN (a - ma) / sa ELSE 0 END, 5) AS mean_size, round(CASE WHEN b <> 0 THEN (b - mb) / sb ELSE 0 END, 5) AS sum_size FROM f, m""")
def n16_standardised(spark, d):
    v, names = _vectors(spark, d, "axon", 15)
    t = v.select("cell", *[F.col("features")[names.index(c)].alias(c) for c in ("mean_size", "sum_size")], F.lit(0.0).alias("empty"))
    s = N.standardise(t, ["mean_size", "sum_size", "empty"])
    return s.select("cell", F.round("mean_size", 5).alias("mean_size"), F.round("sum_size", 5).alias("sum_size"))


@query(f"WITH {MARK}, st AS (SELECT cell, {STATS} FROM sd WHERE comp = 'axon' GROUP BY cell) SELECT cell, round(CASE WHEN n_syn > 15 THEN std_size ELSE 0 END, 6) AS std_size FROM st")
def n17_feature_subset(spark, d):
    v, names = _vectors(spark, d, "axon", 15)
    return v.select("cell", r6(F.col("features")[names.index("std_size")]).alias("std_size"))


#: Sizes are added as decimals, so that equal cells have equal means and sums whatever the order; places beyond the sixth are cut by a rule that both sides compute alike.
DISTANCE = f"""{MARK}, sx AS (SELECT cell, comp, CAST(sum(CAST(round(abs(size), 6) AS DECIMAL(18, 6))) AS DOUBLE) AS sum_size, CAST(sum(CAST(round(abs(size), 6) AS DECIMAL(18, 6))) AS DOUBLE) / count(size) AS mean_size FROM sd GROUP BY cell, comp),
    c AS (SELECT s_suppkey AS cell FROM supplier),
    pv AS (SELECT c.cell, coalesce(a.mean_size, 0) AS a1, coalesce(a.sum_size, 0) AS a2, coalesce(e.mean_size, 0) AS d1, coalesce(e.sum_size, 0) AS d2 FROM c LEFT JOIN sx a ON a.cell = c.cell AND a.comp = 'axon' LEFT JOIN sx e ON e.cell = c.cell AND e.comp = 'dendrite'),
    pr AS (SELECT p.cell AS a, q.cell AS b, CASE WHEN (p.a1 <> 0 OR p.a2 <> 0) AND (q.a1 <> 0 OR q.a2 <> 0) THEN nullif(sqrt((p.a1 - q.a1) * (p.a1 - q.a1) + (p.a2 - q.a2) * (p.a2 - q.a2)), 0) END AS x,
        CASE WHEN (p.d1 <> 0 OR p.d2 <> 0) AND (q.d1 <> 0 OR q.d2 <> 0) THEN nullif(sqrt((p.d1 - q.d1) * (p.d1 - q.d1) + (p.d2 - q.d2) * (p.d2 - q.d2)), 0) END AS y FROM pv p JOIN pv q ON p.cell < q.cell),
    fd AS (SELECT a, b, CASE WHEN x IS NULL AND y IS NULL THEN 1000 ELSE (coalesce(x, 0) + coalesce(y, 0)) / ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) END AS dist FROM pr)"""


def _parts(spark, d):
    from voxloom.session import read_table

    cells = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"))
    total = F.sum(F.round(F.abs("size"), 6).cast("decimal(18,6)")).cast("double")
    s = N.sides(_oriented(spark, d)[0]).groupBy("cell", "comp").agg((total / F.count("size")).alias("mean_size"), total.alias("sum_size"))
    for comp in ("axon", "dendrite"):
        part = s.where(F.col("comp") == comp).select("cell", F.array("mean_size", "sum_size").alias(comp))
        cells = cells.join(part, "cell", "left").withColumn(comp, F.coalesce(comp, F.array(F.lit(0.0), F.lit(0.0))))
    return cells


def _six(dist):
    return F.floor(dist * 1e6 + 0.5) / 1e6


@query(f"WITH {DISTANCE} SELECT a, b, floor(dist * 1e6 + 0.5) / 1e6 AS dist FROM fd")
def n18_pairwise_distance(spark, d):
    return N.pairwise_distance(_parts(spark, d), ["axon", "dendrite"]).withColumn("dist", _six(F.col("dist")))


@query(f"""WITH {DISTANCE}, mx AS (SELECT DISTINCT pre, post FROM o), i AS (SELECT post AS cell, pre AS partner FROM mx), u AS (SELECT pre AS cell, post AS partner FROM mx),
    ic AS (SELECT x.cell AS a, y.cell AS b, count(*) AS n FROM i x JOIN i y ON x.partner = y.partner AND x.cell < y.cell GROUP BY x.cell, y.cell), oc AS (SELECT x.cell AS a, y.cell AS b, count(*) AS n FROM u x JOIN u y ON x.partner = y.partner AND x.cell < y.cell GROUP BY x.cell, y.cell),
    ni AS (SELECT cell, count(*) AS n FROM i GROUP BY cell), nn AS (SELECT cell, count(*) AS n FROM u GROUP BY cell),
    t AS (SELECT fd.a, fd.b, fd.dist, coalesce(ic.n, 0) AS ci, coalesce(ia.n, 0) + coalesce(ib.n, 0) - coalesce(ic.n, 0) AS ui, coalesce(oc.n, 0) AS co, coalesce(oa.n, 0) + coalesce(ob.n, 0) - coalesce(oc.n, 0) AS uo
        FROM fd LEFT JOIN ic ON fd.a = ic.a AND fd.b = ic.b LEFT JOIN oc ON fd.a = oc.a AND fd.b = oc.b LEFT JOIN ni ia ON fd.a = ia.cell LEFT JOIN ni ib ON fd.b = ib.cell LEFT JOIN nn oa ON fd.a = oa.cell LEFT JOIN nn ob ON fd.b = ob.cell)
    SELECT a, b, floor((dist + (CASE WHEN ui > 0 THEN 1 - ci / ui ELSE 1 END + CASE WHEN uo > 0 THEN 1 - co / uo ELSE 1 END)) * 1e6 + 0.5) / 1e6 AS dist FROM t""")
def n19_combined_distance(spark, d):
    matrix = _oriented(spark, d)[0].select("pre", "post").distinct()
    return N.combined_distance(_parts(spark, d), ["axon", "dendrite"], matrix).withColumn("dist", _six(F.col("dist")))


@query(f"WITH {MARK}, st AS (SELECT cell, {STATS} FROM sd WHERE comp = 'axon' GROUP BY cell), ty AS (SELECT DISTINCT cell_1 AS cell, ct_1 AS cell_type FROM synapses UNION SELECT DISTINCT cell_2, ct_2 FROM synapses) SELECT st.cell, cell_type, round(CASE WHEN n_syn > 15 THEN mean_size ELSE 0 END, 6) AS mean_size FROM st JOIN ty ON st.cell = ty.cell")
def n20_feature_frame(spark, d):
    v, names = _vectors(spark, d, "axon", 15)
    kinds = W.partners(view(spark, d, "synapses")).select("cell", "cell_type").distinct()
    return v.join(kinds, "cell").select("cell", "cell_type", r6(F.col("features")[names.index("mean_size")]).alias("mean_size"))
