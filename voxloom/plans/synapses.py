"""Queries of the synapse operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import synapses as C
from voxloom.plans.registry import query
from voxloom.plans.views import view
from voxloom.session import cut

CELLS = "c AS (SELECT f.*, least(a.cell_id, b.cell_id) AS cell_lo, greatest(a.cell_id, b.cell_id) AS cell_hi FROM fragments f JOIN sv_cell a ON f.sv_1 = a.sv_id JOIN sv_cell b ON f.sv_2 = b.sv_id WHERE a.cell_id <> b.cell_id)"


def _fragments(spark, d):
    return C.between_cells(view(spark, d, "fragments"), view(spark, d, "sv_cell"))


@query("SELECT syn_id, CAST(least(sv_1, sv_2) * 4294967296 + greatest(sv_1, sv_2) AS VARCHAR) AS packed, least(sv_1, sv_2) AS lo, greatest(sv_1, sv_2) AS hi FROM fragments")
def c2_pair_ids(spark, d):
    f = view(spark, d, "fragments").withColumn("packed", C.encode_pair(F.col("sv_1"), F.col("sv_2")))
    lo, hi = C.decode_pair(F.col("packed"))
    return f.select("syn_id", F.col("packed").cast("string").alias("packed"), lo.alias("lo"), hi.alias("hi"))


@query(f"WITH {CELLS} SELECT cell_lo, cell_hi, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, min(syn_id) AS first FROM c GROUP BY cell_lo, cell_hi")
def c3_between_cells(spark, d):
    return _fragments(spark, d).groupBy("cell_lo", "cell_hi").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("syn_id").alias("first"))


@query(f"WITH {CELLS} SELECT syn_id, cell_lo, cell_hi FROM c WHERE cell_lo % 3 <> 0 AND cell_hi % 3 <> 0")
def c4_long_partners(spark, d):
    cells = view(spark, d, "sv_cell").where("cell_id % 3 <> 0").select("cell_id")
    return C.long_partners(_fragments(spark, d), cells).select("syn_id", "cell_lo", "cell_hi")


VOX = "v AS (SELECT x * 10000 + y * 100 + z AS id, x, y, z, sv_id, x % 3 AS sym, CAST(sv_id % 7 AS BIGINT) AS cell_lo, 7 AS cell_hi, sv_id * 100 + CAST(floor(y / 3) AS BIGINT) AS syn_id FROM voxels WHERE sv_id <> 0)"
LINK = "e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.cell_lo = b.cell_lo AND a.x BETWEEN b.x - 3 AND b.x + 3 AND a.y BETWEEN b.y - 3 AND b.y + 3 AND (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 4 OR (a.syn_id = b.syn_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 4)))"
CLOSE = "r(u, w) AS (SELECT src, src FROM e UNION SELECT r.u, e.dst FROM r JOIN e ON r.w = e.src), k AS (SELECT u AS id, min(w) AS component FROM r GROUP BY u), cl AS (SELECT v.*, component FROM v JOIN k USING (id))"


def _voxels(spark, d):
    v = view(spark, d, "voxels").where("sv_id <> 0")
    return v.select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).alias("id"), "x", "y", "z", (F.col("sv_id") * 100 + F.floor(F.col("y") / 3)).alias("syn_id"), (F.col("sv_id") % 7).alias("cell_lo"), F.lit(7).alias("cell_hi"))


def _clustered(spark, d):
    return C.cluster_voxels(_voxels(spark, d), 2.0, ["cell_lo", "cell_hi"], within=(["syn_id"], 2.0))


@query(f"WITH RECURSIVE {VOX}, {LINK}, {CLOSE} SELECT id, component FROM cl")
def c5_cluster_fragments(spark, d):
    return _clustered(spark, d).select("id", "component")


@query(f"WITH RECURSIVE {VOX}, e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.syn_id = b.syn_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 4), {CLOSE} SELECT syn_id, component, count(*) AS n FROM cl GROUP BY syn_id, component")
def c6_cluster_voxels(spark, d):
    return C.cluster_voxels(_voxels(spark, d), 2.0, ["syn_id"]).groupBy("syn_id", "component").agg(F.count("*").alias("n"))


ROWS = f"""{VOX}, {LINK}, {CLOSE}, g AS (SELECT cell_lo, component, syn_id, count(*) AS n FROM cl GROUP BY cell_lo, component, syn_id),
    s AS (SELECT cell_lo, component, sum((syn_id % 5) / 5.0 * n) / sum(n) AS sym, sum((syn_id % 3) / 3.0 * n) / sum(n) AS asym, count(*) AS n_fragments FROM g GROUP BY cell_lo, component),
    b AS (SELECT cell_lo, component, count(*) AS size, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_incl_x, max(y) AS max_incl_y, max(z) AS max_incl_z FROM cl GROUP BY cell_lo, component HAVING count(*) >= 5)"""


def _rows(spark, d):
    shares = {"sym_share": (F.col("syn_id") % 5) / 5.0, "asym_share": (F.col("syn_id") % 3) / 3.0}
    return C.synapse_rows(_clustered(spark, d).withColumns(shares), 5)


@query(f"WITH RECURSIVE {ROWS} SELECT cell_lo, component, size, min_x, min_y, min_z, max_incl_x, max_incl_y, max_incl_z, n_fragments FROM b JOIN s USING (cell_lo, component)")
def c7_synapse_rows(spark, d):
    return _rows(spark, d).select("cell_lo", "component", "size", *[f"{e}_{c}" for e in ("min", "max_incl") for c in "xyz"], "n_fragments")


@query("""WITH m AS (SELECT sv_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM voxels WHERE sv_id <> 0 GROUP BY sv_id),
    o AS (SELECT v.sv_id, x, y, z, row_number() OVER (PARTITION BY v.sv_id ORDER BY round(pow((x - mx) * 10, 2) + pow((y - my) * 10, 2) + pow((z - mz) * 20, 2), 6), x, y, z) AS rn FROM voxels v JOIN m ON v.sv_id = m.sv_id)
    SELECT sv_id, x AS rep_x, y AS rep_y, z AS rep_z FROM o WHERE rn = 1""")
def c8_medoid(spark, d):
    return C.medoid(view(spark, d, "voxels").where("sv_id <> 0").select("sv_id", "x", "y", "z"), ["sv_id"], (10.0, 10.0, 20.0))


@query(f"WITH RECURSIVE {ROWS} SELECT cell_lo, component, round(sym, 6) AS sym, round(asym, 6) AS asym FROM b JOIN s USING (cell_lo, component)")
def c9_weighted_shares(spark, d):
    return _rows(spark, d).select("cell_lo", "component", r6("sym").alias("sym"), r6("asym").alias("asym"))


@query("SELECT syn_id, round(CASE WHEN sym_share + asym_share > 0 THEN sym_share / (sym_share + asym_share) ELSE -1 END, 6) AS ratio, CASE WHEN round(CASE WHEN sym_share + asym_share > 0 THEN sym_share / (sym_share + asym_share) ELSE -1 END, 6) > 0.225 THEN -1 ELSE 1 END AS syn_sign FROM fragments")
def c10_sign(spark, d):
    ratio, _ = C.sign(F.col("sym_share"), F.col("asym_share"))
    f = view(spark, d, "fragments").select("syn_id", r6(ratio).alias("ratio"))
    return f.withColumn("syn_sign", F.when(F.col("ratio") > C.SYM_RATIO, -1).otherwise(1))


@query(f"WITH RECURSIVE {VOX}, {LINK}, {CLOSE} SELECT cell_lo, cell_hi, component, count(*) AS size FROM cl GROUP BY cell_lo, cell_hi, component")
def c11_cell_contacts(spark, d):
    return _clustered(spark, d).groupBy("cell_lo", "cell_hi", "component").agg(F.count("*").alias("size"))


#: A synapse an order: a run of eight voxels for each of its lines; its partners are two cells of a hundred parts.
PROX = """s0 AS (SELECT l_orderkey AS syn_id, CAST(floor(min(l_partkey) / 100) AS BIGINT) AS c, l_orderkey % 120 AS x, CAST(floor(l_orderkey / 8) AS BIGINT) % 50 AS y, l_orderkey % 37 AS z FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT syn_id, c + k AS cell_id, x, y, z FROM s0, (SELECT unnest([0, 1]) AS k) u),
    vx AS (SELECT DISTINCT syn_id, x + k AS x, y + l_linenumber AS y, z FROM s0 JOIN lineitem ON syn_id = l_orderkey, (SELECT unnest(range(8)) AS k) u),
    o AS (SELECT p_partkey AS obj_id, CAST(floor(p_partkey / 100) AS BIGINT) AS cell_id, 20 + p_partkey % 400 AS size, p_retailprice / 10 AS x, p_size AS y, p_partkey % 37 AS z FROM part),
    v AS (SELECT obj_id, k, x + k AS x, y, z FROM o, (SELECT unnest([0, 2, 4]) AS k) u),
    close AS (SELECT s.syn_id, s.cell_id, o.obj_id, o.size, v.k, v.x, v.y, v.z FROM s JOIN o ON s.cell_id = o.cell_id JOIN v ON v.obj_id = o.obj_id
        WHERE sqrt(pow(s.x + 3 - o.x, 2) + pow(s.y + 4 - o.y, 2) + pow(s.z - o.z, 2)) <= 30),
    vert AS (SELECT c.syn_id, c.cell_id, obj_id, size, k, min(sqrt(pow(vx.x - c.x, 2) + pow(vx.y - c.y, 2) + pow(vx.z - c.z, 2))) AS d FROM close c JOIN vx ON vx.syn_id = c.syn_id GROUP BY ALL),
    near AS (SELECT syn_id, cell_id, obj_id, size, count(*) AS n, min(d) AS d FROM vert WHERE d < 10.5 GROUP BY ALL),
    f AS (SELECT s.syn_id, s.cell_id, count(obj_id) AS n_objects, coalesce(sum(n / 3.0 * size), 0) AS voxels, coalesce(min(d), 1e12) AS min_dist FROM s LEFT JOIN near ON s.syn_id = near.syn_id AND s.cell_id = near.cell_id GROUP BY s.syn_id, s.cell_id)"""


def _synapse_voxels(spark, d):
    """Synapses with both partners, and their voxels."""
    from voxloom.session import read_table

    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("syn_id"), "l_linenumber", "l_partkey")
    place = ["syn_id % 120 AS x", "(syn_id div 8) % 50 AS y", "syn_id % 37 AS z"]
    syn = lines.groupBy("syn_id").agg(F.min("l_partkey").alias("p")).selectExpr("syn_id", "explode(array(p div 100, p div 100 + 1)) AS cell_id", *place)
    rep = syn.select("syn_id", "cell_id", (F.col("x") + 3).alias("x"), (F.col("y") + 4).alias("y"), "z")
    run = lines.select("syn_id", "l_linenumber").repartition("syn_id").distinct().selectExpr("syn_id", "l_linenumber", "explode(sequence(0, 7)) AS k", *place)
    return rep, run.selectExpr("syn_id", "x + k AS x", "y + l_linenumber AS y", "z")


def _proximity(spark, d):
    from voxloom.session import read_table

    syn, voxels = _synapse_voxels(spark, d)
    p = read_table(spark, d, "part")
    objs = p.select(F.col("p_partkey").alias("obj_id"), F.floor(F.col("p_partkey") / 100).alias("cell_id"), (F.col("p_partkey") % 400 + 20).alias("size"), (F.col("p_retailprice") / 10).alias("x"), F.col("p_size").alias("y"), (F.col("p_partkey") % 37).alias("z"))
    verts = objs.select("obj_id", F.explode(F.array(*map(F.lit, (0, 2, 4)))).alias("k"), "x", "y", "z").select("obj_id", (F.col("x") + F.col("k")).alias("x"), "y", "z")
    return C.proximity(syn, voxels, objs, verts, 30.0, 10.5)


@query(f"WITH {PROX} SELECT syn_id, cell_id, n_objects, round(voxels, 6) AS voxels, round(min_dist, 6) AS min_dist FROM f")
def c12_proximity(spark, d):
    return _proximity(spark, d).select("syn_id", "cell_id", "n_objects", r6("voxels").alias("voxels"), r6("min_dist").alias("min_dist"))


@query(f"WITH {PROX} SELECT syn_id, c AS cell_0, c + 1 AS cell_1, a.n_objects AS n_objects_0, b.n_objects AS n_objects_1, round(a.voxels, 6) AS voxels_0, round(b.voxels, 6) AS voxels_1 FROM s0 JOIN f a USING (syn_id) JOIN f b USING (syn_id) WHERE a.cell_id = c AND b.cell_id = c + 1")
def c13_pivot_partners(spark, d):
    p = cut(_proximity(spark, d))
    both = p.groupBy("syn_id").agg(F.min("cell_id").alias("cell_0"), F.max("cell_id").alias("cell_1"))
    own = C.pivot_partners(p, both, ["n_objects", "voxels"])
    return own.withColumns({"voxels_0": r6("voxels_0"), "voxels_1": r6("voxels_1")})


FEATURES = ["mesh_area", "syn_sign", "ax_1", "ax_2", "sp_1", "sp_2", "x", "y"]


def _labelled(spark, d):
    syn = view(spark, d, "synapses")
    return syn.withColumn("label", ((F.col("mesh_area") > 2.5) & (F.col("ax_2") < 3)).cast("double"))


@query("SELECT syn_id, round(mesh_area, 6) AS mesh_area, syn_sign, ax_1, ax_2, sp_1, sp_2, x, y FROM synapses")
def c14_feature_vector(spark, d):
    return _labelled(spark, d).select("syn_id", r6("mesh_area").alias("mesh_area"), *FEATURES[1:])


@query()
def c15_classify(spark, d):
    """Probabilities of the rows of one fold by a forest of the others; no SQL can express the forest."""
    rows = cut(_labelled(spark, d).select("syn_id", "label", *FEATURES).withColumn("fold", F.pmod(F.xxhash64("syn_id"), F.lit(5))))
    model = C.train_forest(rows.where("fold <> 0"), FEATURES, trees=20)
    return C.classify(rows.where("fold = 0"), model, ["syn_id", "label"])


@query()
def c16_cross_validate(spark, d):
    """Held-out probabilities of every row, ten folds."""
    return C.cross_validate(_labelled(spark, d), FEATURES, 10, 10)


@query("""WITH l AS (SELECT sv_id AS label_id, min(x) + 1 AS x, min(y) + 1 AS y, min(z) + 1 AS z FROM voxels WHERE sv_id <> 0 GROUP BY sv_id),
    s AS (SELECT mi_id AS syn_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM voxels WHERE mi_id <> 0 GROUP BY mi_id),
    n AS (SELECT label_id, syn_id, l.x AS lx, l.y AS ly, l.z AS lz, row_number() OVER (PARTITION BY label_id ORDER BY sqrt(pow(l.x - s.x, 2) + pow(l.y - s.y, 2) + pow(l.z - s.z, 2)), syn_id) AS rank FROM l CROSS JOIN s),
    h AS (SELECT label_id, n.syn_id, rank, min(abs(v.x - lx) + abs(v.y - ly) + abs(v.z - lz)) AS l1 FROM n JOIN voxels v ON v.mi_id = n.syn_id WHERE rank <= 20 GROUP BY label_id, n.syn_id, rank)
    SELECT label_id, arg_min(syn_id, rank) AS syn_id FROM h WHERE l1 < 2 GROUP BY label_id""")
def c17_match_labels(spark, d):
    v = view(spark, d, "voxels")
    labels = v.where("sv_id <> 0").groupBy(F.col("sv_id").alias("label_id")).agg(*[(F.min(c) + 1).alias(c) for c in "xyz"])
    syn = v.where("mi_id <> 0").groupBy(F.col("mi_id").alias("syn_id")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return C.match_labels(labels, syn, v.where("mi_id <> 0").withColumnRenamed("mi_id", "syn_id"), 20, 2.0)


@query("""WITH p AS (SELECT syn_id, cell_1 AS cell_id, ax_1 AS ax FROM synapses UNION ALL SELECT syn_id, cell_2, ax_2 FROM synapses)
    SELECT syn_id, cell_id, CASE WHEN syn_id % 3 = 0 THEN ax ELSE -1 END AS axoness, CAST(CASE WHEN syn_id % 5 = 0 THEN cell_id % 7 ELSE -1 END AS BIGINT) AS cell_type FROM p""")
def c18_partner_properties(spark, d):
    syn = view(spark, d, "synapses")
    p = syn.select("syn_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"cell_{s}").alias("c"), F.col(f"ax_{s}").alias("ax")) for s in (1, 2)])).alias("p")).select("syn_id", "p.side", F.col("p.c").alias("cell_id"), "p.ax")
    ax = p.where("syn_id % 3 = 0").select("syn_id", "side", F.col("ax").alias("axoness"))
    kind = p.where("syn_id % 5 = 0").select("syn_id", "side", (F.col("cell_id") % 7).alias("cell_type"))
    return C.partner_properties(p.select("syn_id", "side", "cell_id"), [ax, kind], {"axoness": -1, "cell_type": -1}, ("syn_id", "side")).drop("side")


@query("SELECT round(count(*) / 1452.0, 6) AS density, sum(CASE WHEN syn_sign = -1 THEN 1 ELSE 0 END)::BIGINT AS n_sym, sum(CASE WHEN syn_sign = 1 THEN 1 ELSE 0 END)::BIGINT AS n_asym FROM synapses WHERE round(syn_prob, 6) > 0.6")
def c19_density(spark, d):
    return C.density(view(spark, d, "synapses").where(r6("syn_prob") > 0.6), 1452.0).withColumn("density", r6("density"))
