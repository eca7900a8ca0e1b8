"""Queries of the voxel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import blocks as B
from voxloom.operators import contacts as K
from voxloom.operators import instances as I
from voxloom.operators import voxels as V
from voxloom.operators.components import graph_components
from voxloom.plans.registry import query
from voxloom.plans.views import view
from voxloom.session import cut, read_table

BOX = "min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) + 1 AS max_x, max(y) + 1 AS max_y, max(z) + 1 AS max_z"
FIRST = "min(x * 1000000 + y * 1000 + z)"
REP = "CAST(floor({0} / 1000000) AS BIGINT) AS rep_x, CAST(floor({0} / 1000) AS BIGINT) % 1000 AS rep_y, {0} % 1000 AS rep_z"
PROPS = f"""SELECT {{key}}, count(*) AS size, {BOX}, {FIRST} AS f FROM voxels WHERE {{key}} <> 0 GROUP BY {{key}}"""
OUT = "size, min_x, min_y, min_z, max_x, max_y, max_z, " + REP.format("f")
KINDS = {"mi": "mi_id", "sj": "sj_id"}


SIZE = (10, 10, 8)


def _vox(spark, d):
    return view(spark, d, "voxels")


def _shape(spark, d):
    """The volume: whole slabs along x, one for each 15,000 orders, read from that column alone."""
    return int(read_table(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0]) // 15000 * 25 + 25, 40, 8


def _label_blocks(spark, d, *flags):
    """Supervoxels as blocks; places that the table lacks are outside the volume."""
    return B.to_blocks(_vox(spark, d), "sv_id", SIZE, _shape(spark, d), K.OUTSIDE, list(flags))


def _two(spark, d):
    """Voxels with two organelle labels."""
    return _vox(spark, d).withColumn("sj_id", F.when(F.col("sj") == 1, F.col("mi_id") + 100).otherwise(0))


TWO = "two AS (SELECT *, CASE WHEN sj = 1 THEN mi_id + 100 ELSE 0 END AS sj_id FROM voxels)"


@query(f"SELECT sv_id, {OUT} FROM ({PROPS.format(key='sv_id')}) p")
def v1_object_properties(spark, d):
    return V.object_properties(_vox(spark, d), "sv_id")


def _pairs(spark, d):
    lo, hi = F.least("sv_id", "mi_id"), F.greatest("sv_id", "mi_id")
    return _vox(spark, d).select("x", "y", "z", "sj", "sym", "asym", lo.alias("id_lo"), hi.alias("id_hi")).where("id_lo > 0")


PAIRS = "pairs AS (SELECT x, y, z, sj, sym, asym, least(sv_id, mi_id) AS id_lo, greatest(sv_id, mi_id) AS id_hi FROM voxels WHERE least(sv_id, mi_id) > 0)"


@query(f"WITH {PAIRS} SELECT id_lo, id_hi, {OUT} FROM (SELECT id_lo, id_hi, count(*) AS size, {BOX}, {FIRST} AS f FROM pairs GROUP BY id_lo, id_hi) p")
def v2_pair_properties(spark, d):
    return V.object_properties(_pairs(spark, d), "id_lo", "id_hi")


@query(f"""WITH {TWO} SELECT 'mi' AS obj_type, mi_id AS obj_id, sv_id AS cell_id, count(*) AS n FROM two WHERE sv_id <> 0 AND mi_id <> 0 GROUP BY mi_id, sv_id
    UNION ALL SELECT 'sj', sj_id, sv_id, count(*) FROM two WHERE sv_id <> 0 AND sj_id <> 0 GROUP BY sj_id, sv_id""")
def v3_overlap_counts(spark, d):
    return V.overlap_counts(_two(spark, d), "sv_id", KINDS)


def _fused_sql(source: str, extra: str = "") -> str:
    parts = []
    for kind, key, second in (("cell", "sv_id", None), ("mi", "mi_id", None), ("mi:overlap", "mi_id", "sv_id"), ("sj", "sj_id", None), ("sj:overlap", "sj_id", "sv_id")):
        where = f"{key} <> 0" + (f" AND {second} <> 0" if second else "")
        parts.append(
            f"SELECT '{kind}' AS kind, {key} AS id, {second or 'CAST(NULL AS BIGINT)'} AS id2, count(*) AS size, {BOX}, {FIRST} AS f FROM {source} WHERE {where} GROUP BY {key}{', ' + second if second else ''}"
        )
    return " UNION ALL ".join(parts)


@query(f"WITH {TWO} SELECT kind, id, id2, {OUT} FROM ({_fused_sql('two')}) p")
def v4_fused_properties(spark, d):
    return V.fused_partials(_two(spark, d), "sv_id", KINDS)


@query(f"SELECT sv_id, {OUT} FROM ({PROPS.format(key='sv_id')}) p")
def v5_merge_partials(spark, d):
    vox = _vox(spark, d)
    parts = vox.where("sv_id <> 0").groupBy("block_x", "block_y", "sv_id").agg(F.count("*").alias("size"), *V.box_aggregates(), F.min(F.struct(*V.XYZ)).alias("rep"))
    flat = parts.select("*", *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in V.XYZ])
    return V.merge_partials(flat, "sv_id")


@query("SELECT mi_id, sv_id, count(*) AS n FROM voxels WHERE mi_id <> 0 AND sv_id <> 0 GROUP BY mi_id, sv_id")
def v6_merge_counts(spark, d):
    parts = _vox(spark, d).where("mi_id <> 0 and sv_id <> 0").groupBy("block_x", "block_y", "mi_id", "sv_id").agg(F.count("*").alias("n"))
    return V.merge_counts(parts, "mi_id", "sv_id")


@query("SELECT sv_id AS obj_id, x, y, z FROM voxels WHERE sv_id <> 0")
def v7_merge_voxel_lists(spark, d):
    parts = _vox(spark, d).where("sv_id <> 0").groupBy("block_x", "block_y", F.col("sv_id").alias("obj_id")).agg(F.collect_list(F.struct("x", "y", "z")).alias("voxels"))
    return V.merge_voxel_lists(parts, "obj_id").select("obj_id", F.explode("voxels").alias("v")).select("obj_id", "v.*")


@query("SELECT sv_id, mi_id, n FROM (SELECT mi_id, sv_id, count(*) AS n FROM voxels WHERE mi_id <> 0 AND sv_id <> 0 GROUP BY mi_id, sv_id) m")
def v8_invert_map(spark, d):
    counts = V.overlap_counts(_vox(spark, d), "sv_id", {"mi": "mi_id"})
    return counts.select(F.col("cell_id").alias("sv_id"), F.col("obj_id").alias("mi_id"), "n")


@query("SELECT obj_type, obj_id, sv_id, n, round(n / sum(n) OVER (PARTITION BY obj_type, obj_id), 6) AS ratio FROM overlap")
def v9_overlap_ratio(spark, d):
    return V.overlap_ratio(view(spark, d, "overlap"), "obj_type", "obj_id").select("obj_type", "obj_id", "sv_id", "n", r6("ratio").alias("ratio"))


@query("SELECT o.obj_type, o.obj_id, o.sv_id, o.n, b.size, round(o.n / b.size, 6) AS ratio FROM overlap o JOIN objects b ON o.obj_type = b.obj_type AND o.obj_id = b.obj_id WHERE b.size >= 50")
def v10_overlap_by_size(spark, d):
    objs = V.minimum_size(view(spark, d, "objects"), {"mi": 50, "vc": 50, "sj": 50})
    return V.overlap_by_size(view(spark, d, "overlap"), objs, ["obj_type", "obj_id"]).withColumn("ratio", r6("ratio"))


@query("SELECT sv_id, count(*) AS size, round(avg(sym), 6) AS sym_share, round(avg(asym), 6) AS asym_share FROM voxels WHERE sv_id <> 0 GROUP BY sv_id")
def v11_type_shares(spark, d):
    return V.type_shares(_vox(spark, d), "sv_id", ["sym", "asym"]).select("sv_id", "size", r6("sym_share").alias("sym_share"), r6("asym_share").alias("asym_share"))


@query("SELECT obj_type, obj_id, size FROM objects WHERE size >= CASE obj_type WHEN 'mi' THEN 100 WHEN 'vc' THEN 200 ELSE 50 END")
def v12_minimum_size(spark, d):
    return V.minimum_size(view(spark, d, "objects"), {"mi": 100, "vc": 200, "sj": 50}).select("obj_type", "obj_id", "size")


@query(f"""SELECT block_x, block_y, sv_id, size, min_x, min_y, max_x, max_y FROM (SELECT block_x, block_y, sv_id, count(*) AS size, {BOX} FROM voxels WHERE sv_id <> 0 GROUP BY block_x, block_y, sv_id) p
    WHERE size >= 40 OR min_x <= block_x * 10 OR max_x >= block_x * 10 + 10 OR min_y <= block_y * 10 OR max_y >= block_y * 10 + 10""")
def v13_interior_small(spark, d):
    parts = _vox(spark, d).where("sv_id <> 0").groupBy("block_x", "block_y", "sv_id").agg(F.count("*").alias("size"), *V.box_aggregates())
    low = {"x": F.col("block_x") * 10, "y": F.col("block_y") * 10, "z": F.lit(-1)}
    high = {"x": F.col("block_x") * 10 + 10, "y": F.col("block_y") * 10 + 10, "z": F.lit(10**6)}
    return V.interior_small(parts, 40, low, high).select("block_x", "block_y", "sv_id", "size", "min_x", "min_y", "max_x", "max_y")


BOUNDARY = """edge AS (SELECT DISTINCT a.x, a.y, a.z, a.sv_id FROM voxels a JOIN voxels b
    ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
    WHERE a.sv_id <> 0 AND b.sv_id <> a.sv_id)"""


@query(f"WITH {BOUNDARY} SELECT x, y, z, sv_id FROM edge")
def v14_boundary_voxels(spark, d):
    return K.boundary_voxels(_label_blocks(spark, d), SIZE).select("x", "y", "z", F.col("label").alias("sv_id"))


CONTACT = f"""{BOUNDARY}, near AS (SELECT a.x, a.y, a.z, a.sv_id AS own, b.sv_id AS other, count(*) AS n FROM edge a JOIN voxels b
    ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1
    WHERE b.sv_id <> 0 AND b.sv_id <> a.sv_id GROUP BY a.x, a.y, a.z, a.sv_id, b.sv_id),
    contact AS (SELECT x, y, z, least(own, other) AS id_lo, greatest(own, other) AS id_hi
        FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, other) AS rn FROM near) r WHERE rn = 1)"""


@query(f"WITH {CONTACT} SELECT x, y, z, id_lo, id_hi FROM contact")
def v15_contact_voxels(spark, d):
    return K.contact_voxels(_label_blocks(spark, d), SIZE)


@query(f"WITH {CONTACT} SELECT id_lo, id_hi, count(*) AS n FROM contact GROUP BY id_lo, id_hi")
def v16_contact_sizes(spark, d):
    return K.contact_sizes(_label_blocks(spark, d), SIZE)


@query(f"""WITH {PAIRS} SELECT id_lo, id_hi, count(*) AS cs_size, {BOX.replace('AS ', 'AS cs_')}, sum(sj) AS syn_size,
    min(CASE WHEN sj = 1 THEN x END) AS syn_min_x, min(CASE WHEN sj = 1 THEN y END) AS syn_min_y, min(CASE WHEN sj = 1 THEN z END) AS syn_min_z,
    max(CASE WHEN sj = 1 THEN x END) + 1 AS syn_max_x, max(CASE WHEN sj = 1 THEN y END) + 1 AS syn_max_y, max(CASE WHEN sj = 1 THEN z END) + 1 AS syn_max_z,
    CAST(sum(sj * sym) AS BIGINT) AS n_sym, CAST(sum(sj * asym) AS BIGINT) AS n_asym FROM pairs GROUP BY id_lo, id_hi""".replace("sum(sj) AS", "CAST(sum(sj) AS BIGINT) AS"))
def v18_contact_synapses(spark, d):
    return V.contact_synapse_properties(_pairs(spark, d), "sj", "sym", "asym")


@query("SELECT x, y, z, CASE WHEN sv_id BETWEEN 1 AND 10 THEN sv_id + 500 ELSE sv_id END AS sv_id FROM voxels")
def v19_relabel(spark, d):
    mapping = spark.range(1, 11).select(F.col("id").alias("old"), (F.col("id") + 500).alias("new"))
    return V.relabel(_vox(spark, d).select("x", "y", "z", "sv_id"), "sv_id", mapping).select("x", "y", "z", "sv_id")


@query("SELECT v.x, v.y, v.z, coalesce(m.cell_id, 0) AS sv_id FROM voxels v LEFT JOIN sv_cell m ON v.sv_id = m.sv_id")
def v20_sv_to_cell_volume(spark, d):
    mapping = view(spark, d, "sv_cell").select(F.col("sv_id").alias("old"), F.col("cell_id").alias("new"))
    return V.relabel(_vox(spark, d).select("x", "y", "z", "sv_id"), "sv_id", mapping, True).select("x", "y", "z", "sv_id")


@query("SELECT x, y, z, round(p, 6) AS p FROM voxels WHERE round(p, 6) > 0.55")
def v21_threshold(spark, d):
    return V.threshold(_vox(spark, d).select("x", "y", "z", r6("p").alias("p")), "p", 0.55)


@query("""WITH local AS (SELECT block_x, block_y, sv_id, dense_rank() OVER (PARTITION BY block_x, block_y ORDER BY sv_id) AS label FROM voxels WHERE sv_id <> 0),
    most AS (SELECT block_x, block_y, max(label) AS m FROM local GROUP BY block_x, block_y),
    shift AS (SELECT block_x, block_y, coalesce(sum(m) OVER (ORDER BY block_x, block_y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM most)
    SELECT block_x, block_y, sv_id, CAST(label + s AS BIGINT) AS label, count(*) AS n FROM local JOIN shift USING (block_x, block_y) GROUP BY block_x, block_y, sv_id, label + s""")
def v24_unique_labels(spark, d):
    from pyspark.sql.window import Window

    rank = F.dense_rank().over(Window.partitionBy("block_x", "block_y").orderBy("sv_id"))
    local = _vox(spark, d).where("sv_id <> 0").select("block_x", "block_y", "sv_id", rank.cast("long").alias("label"))
    made = V.unique_labels(local, ["block_x", "block_y"])
    return made.groupBy("block_x", "block_y", "sv_id", "label").agg(F.count("*").alias("n"))


def _halo(spark, d):
    """Every voxel in its own block and, at the first layer of a block, in the block before it in x too."""
    own = _vox(spark, d).select("x", "y", "z", F.col("block_x").alias("block"), (F.col("block_x") * 1000000 + F.col("sv_id")).alias("label")).where("sv_id <> 0")
    extra = _vox(spark, d).where("sv_id <> 0 and x % 10 = 0 and x > 0").select("x", "y", "z", (F.col("block_x") - 1).alias("block"), ((F.col("block_x") - 1) * 1000000 + F.col("sv_id")).alias("label"))
    return own.unionByName(extra)


HALO = """halo AS (SELECT x, y, z, block_x AS block, block_x * 1000000 + sv_id AS label FROM voxels WHERE sv_id <> 0
    UNION ALL SELECT x, y, z, block_x - 1, (block_x - 1) * 1000000 + sv_id FROM voxels WHERE sv_id <> 0 AND x % 10 = 0 AND x > 0),
    stitch AS (SELECT a.block AS b1, a.label AS l1, b.block AS b2, b.label AS l2, count(*) AS n FROM halo a JOIN halo b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.block < b.block
    GROUP BY a.block, a.label, b.block, b.label)"""


@query(f"WITH {HALO} SELECT b1, l1, b2, l2, n FROM stitch")
def v25_stitch_pairs(spark, d):
    return V.stitch_pairs(_halo(spark, d), "block", "label")


@query(f"""WITH RECURSIVE {HALO}, e AS (SELECT l1 AS u, l2 AS v FROM stitch UNION SELECT l2, l1 FROM stitch),
    reach(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
    SELECT u AS node, min(v) AS component FROM reach GROUP BY u""")
def v26_merge_list(spark, d):
    return graph_components(V.stitch_pairs(_halo(spark, d), "block", "label"), "l1", "l2")


@query(f"""WITH RECURSIVE {HALO}, e AS (SELECT l1 AS u, l2 AS v FROM stitch UNION SELECT l2, l1 FROM stitch),
    reach(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
    m AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
    SELECT coalesce(m.c, h.label) AS label, count(*) AS n FROM halo h LEFT JOIN m ON h.label = m.u WHERE h.block * 10 <= h.x AND h.x < h.block * 10 + 10 GROUP BY coalesce(m.c, h.label)""")
def v27_apply_merge_list(spark, d):
    halo = _halo(spark, d)
    merge = graph_components(V.stitch_pairs(halo, "block", "label"), "l1", "l2").select(F.col("node").alias("old"), F.col("component").alias("new"))
    own = halo.where("block * 10 <= x and x < block * 10 + 10").select("x", "y", "z", "label")
    return V.relabel(own, "label", merge).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT sv_id, count(*) AS n FROM voxels WHERE round(p, 6) > 0.5 AND sv_id <> 0 GROUP BY sv_id) SELECT sv_id, n FROM s WHERE n >= 8")
def v29_seed_filter(spark, d):
    seeds = V.threshold(_vox(spark, d).withColumn("p", r6("p")), "p", 0.5).where("sv_id <> 0").groupBy("sv_id").agg(F.count("*").alias("n"))
    return seeds.where("n >= 8")


@query("SELECT x, y, z, sv_id FROM voxels WHERE x >= 7 AND x < 17 AND y >= 12 AND y < 28 AND z >= 2 AND z < 6")
def v30_in_box(spark, d):
    return V.in_box(_vox(spark, d).select("x", "y", "z", "sv_id"), (12, 20, 4), (10, 16, 4))


@query("SELECT x - (SELECT min(x) FROM voxels WHERE sv_id = 7) AS x, y - (SELECT min(y) FROM voxels WHERE sv_id = 7) AS y, z - (SELECT min(z) FROM voxels WHERE sv_id = 7) AS z FROM voxels WHERE sv_id = 7")
def v31_tight_crop(spark, d):
    return V.tight_crop(_vox(spark, d).where("sv_id = 7").select("x", "y", "z"))


@query("""SELECT sv_id, CAST(least(greatest(min_x, 0), 60) AS BIGINT) AS min_x, CAST(least(greatest(min_y, 0), 50) AS BIGINT) AS min_y, CAST(least(greatest(min_z, 0), 80) AS BIGINT) AS min_z,
    CAST(least(greatest(max_x, 0), 60) AS BIGINT) AS max_x, CAST(least(greatest(max_y, 0), 50) AS BIGINT) AS max_y, CAST(least(greatest(max_z, 0), 80) AS BIGINT) AS max_z FROM sv""")
def v32_clip_boxes(spark, d):
    return V.clip_boxes(view(spark, d, "sv"), (60, 50, 80)).select("sv_id", *[f"{e}_{c}" for e in ("min", "max") for c in V.XYZ])


@query("SELECT DISTINCT sv_id, CAST(floor(x / 4) * 4 AS BIGINT) AS x, CAST(floor(y / 4) * 4 AS BIGINT) AS y, CAST(floor(z / 2) * 2 AS BIGINT) AS z FROM voxels WHERE sv_id <> 0")
def v33_downsample(spark, d):
    return V.downsample(_vox(spark, d).where("sv_id <> 0"), "sv_id", (4, 4, 2))


def _contacts(spark, d):
    return _vox(spark, d).where("sj = 1").select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).alias("contact_id"), "x", "y", "z")


@query("""WITH c AS (SELECT x * 10000 + y * 100 + z AS contact_id, x AS cx, y AS cy, z AS cz FROM voxels WHERE sj = 1),
    f AS (SELECT contact_id, sv_id, count(*) AS n FROM c JOIN voxels v ON v.x >= cx - 3 AND v.x < cx + 3 AND v.y >= cy - 3 AND v.y < cy + 3 AND v.z >= cz - 2 AND v.z < cz + 2
        WHERE sv_id <> 0 GROUP BY contact_id, sv_id HAVING count(*) >= 3)
    SELECT contact_id, round(sum(CASE WHEN sv_id % 3 = 0 THEN n ELSE 0 END) / sum(n), 6) AS fraction FROM f GROUP BY contact_id""")
def v34_box_fraction(spark, d):
    special = _vox(spark, d).where("sv_id % 3 = 0").select("sv_id").distinct()
    return V.box_fraction(_contacts(spark, d), _vox(spark, d), (6, 6, 4), 3, "sv_id", special).withColumn("fraction", r6("fraction"))


@query(f"""WITH {BOUNDARY}, n AS (SELECT * FROM edge WHERE sv_id % 3 <> 0), g AS (SELECT * FROM edge WHERE sv_id % 3 = 0),
    hit AS (SELECT DISTINCT n.x, n.y, n.z, n.sv_id FROM n JOIN g ON (n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y) + (n.z - g.z) * (n.z - g.z) <= 4 AND g.x BETWEEN n.x - 2 AND n.x + 2 AND g.y BETWEEN n.y - 2 AND n.y + 2)
    SELECT n.sv_id, count(*) AS n_boundary, count(hit.x) AS n_covered FROM n LEFT JOIN hit USING (x, y, z) GROUP BY n.sv_id""")
def v35_coverage(spark, d):
    from voxloom.operators.spatial import pairs_within

    edge = V.boundary_voxels(_vox(spark, d), "sv_id")
    own, other = edge.where("sv_id % 3 <> 0"), edge.where("sv_id % 3 = 0")
    ids = own.withColumn("id", F.concat_ws(":", "x", "y", "z"))
    hit = pairs_within(ids, other.withColumn("id", F.concat_ws(":", "x", "y", "z")), 2.0).select(F.col("id_a").alias("id"), F.lit(1).alias("hit")).distinct()
    return ids.join(hit, "id", "left").groupBy("sv_id").agg(F.count("*").alias("n_boundary"), F.count("hit").alias("n_covered"))


@query("""WITH node AS (SELECT x * 10000 + y * 100 + z AS node_id, x AS cx, y AS cy, z AS cz FROM voxels WHERE sj = 1)
    SELECT node_id, count(v.x) AS n_above, count(v.x) / 64.0 > 0.1 AS vote FROM node LEFT JOIN (SELECT * FROM voxels WHERE round(p, 6) > 0.5) v
    ON v.x >= cx - 2 AND v.x < cx + 2 AND v.y >= cy - 2 AND v.y < cy + 2 AND v.z >= cz - 2 AND v.z < cz + 2 GROUP BY node_id""")
def v36_cube_vote(spark, d):
    return V.cube_vote(_contacts(spark, d).withColumnRenamed("contact_id", "node_id"), _vox(spark, d).withColumn("p", r6("p")), 4, "p", 0.5, 0.1)


@query("SELECT x, y, z, CASE sv_id WHEN 3 THEN 1 WHEN 5 THEN 7 ELSE 0 END AS sv_id FROM voxels")
def v37_recode(spark, d):
    return V.recode(_vox(spark, d).select("x", "y", "z", "sv_id"), "sv_id", [3, 5], {5: 7})


@query("""WITH pr AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS x2, b.y AS y2, b.z AS z2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
        FROM voxels a JOIN voxels b ON a.sv_id = 7 AND b.sv_id = 8),
    m AS (SELECT min(ceil(dist)) AS r FROM pr WHERE dist <= 8)
    SELECT DISTINCT x, y, z FROM (SELECT ax AS x, ay AS y, az AS z, dist FROM pr UNION ALL SELECT x2, y2, z2, dist FROM pr) u, m WHERE dist <= r""")
def v38_contact_of_two(spark, d):
    from voxloom.operators.spatial import contact_points

    vox = _vox(spark, d).select("x", "y", "z", "sv_id")
    return contact_points(vox.where("sv_id = 7").drop("sv_id"), vox.where("sv_id = 8").drop("sv_id"), 8)


@query("SELECT x, y, z FROM voxels WHERE x >= 0 AND x < 6 AND y >= 0 AND y < 6 AND z >= 0 AND z < 6")
def v39_inside_cube(spark, d):
    return V.inside_cube(_vox(spark, d).select("x", "y", "z"), 6)




INSIDE = "x BETWEEN 0 AND (SELECT CAST(floor(max(x) / 25) AS BIGINT) * 25 + 24 FROM voxels) AND y BETWEEN 0 AND 39 AND z BETWEEN 0 AND 7"


def _mask(spark, d, t):
    return V.threshold(_vox(spark, d).withColumn("p", r6("p")), "p", t).select("x", "y", "z", F.lit(1).alias("on"))


@query(f"SELECT CASE kind WHEN 'mi' THEN 'sub' WHEN 'mi:overlap' THEN 'sub:overlap' ELSE kind END AS kind, id, coalesce(id2, 0) AS id2, {OUT} FROM ({_fused_sql('two')}) p WHERE kind IN ('cell', 'mi', 'mi:overlap')".replace("FROM two", "FROM (SELECT *, 0 AS sj_id FROM voxels) two"))
def v4_fused_blocks(spark, d):
    vox = _vox(spark, d)
    shape = _shape(spark, d)
    return B.fused_partials(B.to_blocks(vox, "sv_id", SIZE, shape), B.to_blocks(vox, "mi_id", SIZE, shape), SIZE)


SIX_SQL = "(SELECT unnest([1, -1, 0, 0, 0, 0]) AS dx, unnest([0, 0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 0, 1, -1]) AS dz)"
#: Contacts closed and grown by one voxel: a background voxel goes to the smallest pair that reaches it.
FILLED = f"""{CONTACT}, s0 AS (SELECT x, y, z, id_lo * 4294967296 + id_hi AS pair FROM contact),
    s1 AS (SELECT x, y, z, pair FROM s0 UNION SELECT x + dx, y + dy, z + dz, pair FROM s0, {SIX_SQL} s),
    s2 AS (SELECT a.x, a.y, a.z, a.pair FROM s1 a, {SIX_SQL} s JOIN s1 b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.pair = a.pair GROUP BY a.x, a.y, a.z, a.pair HAVING count(*) = 6),
    s3 AS (SELECT x, y, z, pair FROM s2 UNION SELECT x + dx, y + dy, z + dz, pair FROM s2, {SIX_SQL} s),
    filled AS (SELECT x, y, z, pair FROM s0 UNION ALL SELECT x, y, z, min(pair) FROM s3 WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.x = s3.x AND s0.y = s3.y AND s0.z = s3.z) GROUP BY x, y, z)"""
LO_HI = "CAST(floor(pair / 4294967296) AS BIGINT) AS id_lo, CAST(pair % 4294967296 AS BIGINT) AS id_hi"
IN_VOLUME = "x BETWEEN 0 AND (SELECT CAST(floor(max(l_orderkey) / 15000) AS BIGINT) * 25 + 24 FROM lineitem) AND y BETWEEN 0 AND 39 AND z BETWEEN 0 AND 7"


@query(f"WITH {FILLED} SELECT {LO_HI}, count(*) AS n FROM filled WHERE {IN_VOLUME} GROUP BY pair")
def v17_fill_contacts(spark, d):
    """Places that the table lacks are background here, and are filled too."""
    return K.filled_sizes(_label_blocks(spark, d), SIZE, closing=1, dilation=1)


@query(f"""WITH m AS (SELECT x, y, z FROM voxels WHERE round(p, 6) > 0.56), g AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM m, {SIX_SQL} s UNION SELECT x, y, z FROM m),
    dil AS (SELECT x, y, z FROM g WHERE {INSIDE}), c AS (SELECT dil.x, dil.y, dil.z, count(*) AS n FROM dil, {SIX_SQL} s JOIN dil o ON o.x = dil.x + dx AND o.y = dil.y + dy AND o.z = dil.z + dz GROUP BY dil.x, dil.y, dil.z)
    SELECT x, y, z FROM c WHERE n = 6""")
def v22_morphology(spark, d):
    shape = _shape(spark, d)
    closed = B.morphology(B.to_blocks(_mask(spark, d, 0.56), "on", SIZE, shape), [("closing", 1)], SIZE, shape)
    # the closing of what lies in blocks; the volume's faces are eroded like any other
    return B.to_voxels(closed, SIZE).select("x", "y", "z")


OBJECTS = """m AS (SELECT x, y, z, x * 10000 + y * 100 + z AS id, {0} AS b FROM voxels WHERE round(p, 6) > 0.6),
    e AS (SELECT a.id AS src, o.id AS dst FROM m a JOIN m o ON abs(a.x - o.x) + abs(a.y - o.y) + abs(a.z - o.z) <= 1 AND a.b = o.b),
    r(u, w) AS (SELECT src, src FROM e UNION SELECT r.u, e.dst FROM r JOIN e ON r.w = e.src), k AS (SELECT u AS id, min(w) AS label FROM r GROUP BY u)"""


@query(f"WITH RECURSIVE {OBJECTS.format('block_x * 1000 + block_y')}, s AS (SELECT b, label, count(*) AS n FROM m JOIN k USING (id) GROUP BY b, label) SELECT n AS size, count(*) AS n_objects FROM s GROUP BY n")
def v23_label_blocks(spark, d):
    made = B.map_blocks(B.to_blocks(_mask(spark, d, 0.6), "on", SIZE, _shape(spark, d)), lambda a: B.label_components(a != 0), 0, SIZE)
    sizes = B.to_voxels(made, SIZE).groupBy("bx", "by", "bz", "label").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_objects"))


@query(f"WITH RECURSIVE {OBJECTS.format('1')}, s AS (SELECT label, count(*) AS n FROM m JOIN k USING (id) GROUP BY label) SELECT n AS size, count(*) AS n_objects FROM s GROUP BY n")
def v28_instance_segmentation(spark, d):
    shape = _shape(spark, d)
    labels, _ = I.instance_segmentation(B.to_blocks(_mask(spark, d, 0.6), "on", SIZE, shape), SIZE, shape)
    return I.label_sizes(labels).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n_objects"))


@query(f"SELECT v.x, v.y, v.z, CAST(sum(o.sv_id) + max(v.sv_id) AS BIGINT) AS label FROM voxels v, {SIX_SQL} s JOIN voxels o ON o.x = v.x + dx AND o.y = v.y + dy AND o.z = v.z + dz GROUP BY v.x, v.y, v.z HAVING sum(o.sv_id) + max(v.sv_id) <> 0")
def u1_map_blocks(spark, d):
    total = B.map_blocks(B.to_blocks(_vox(spark, d), "sv_id", SIZE, _shape(spark, d)), lambda a: a + sum(B.shifted(a, k) for k in V.SIX), 1, SIZE)
    vox = _vox(spark, d).select("x", "y", "z")
    return B.to_voxels(total, SIZE).select("x", "y", "z", "label").join(vox, ["x", "y", "z"], "left_semi")


@query(f"""WITH {FILLED}, j AS (SELECT x, y, z, pair, sj, sym, asym FROM filled JOIN voxels USING (x, y, z)) SELECT {LO_HI}, count(*) AS cs_size, CAST(sum(sj) AS BIGINT) AS syn_size, CAST(sum(sj * sym) AS BIGINT) AS n_sym, CAST(sum(sj * asym) AS BIGINT) AS n_asym,
    {BOX.replace("AS ", "AS cs_")}, {", ".join(f"{f}(CASE WHEN sj = 1 THEN {c} END){p} AS syn_{f}_{c}" for f, p in (("min", ""), ("max", " + 1")) for c in "xyz")} FROM j GROUP BY pair HAVING count(*) >= 10""")
def c1_contact_extraction(spark, d):
    return K.contact_sites(_label_blocks(spark, d, "sj", "sym", "asym"), ["sj", "sym", "asym"], SIZE, closing=1, dilation=1, least=10)


DENSE = """lim AS (SELECT CAST(floor(max(x) / 25) AS BIGINT) * 25 + 25 AS m FROM voxels),
    grid AS (SELECT g.x, g.y, g.z, coalesce(CAST(round(v.p * 1000000) AS BIGINT), 0) AS p FROM (SELECT x, y, z FROM lim, unnest(range(0, m)) a(x), unnest(range(0, 40)) b(y), unnest(range(0, 8)) c(z)) g LEFT JOIN voxels v ON v.x = g.x AND v.y = g.y AND v.z = g.z)"""


def _fixed(spark, d):
    """The probability map in millionths, as blocks, and the volume's shape."""
    vox = _vox(spark, d)
    shape = _shape(spark, d)
    return B.to_blocks(vox.withColumn("fixed", F.round(F.col("p") * 1000000).cast("long")), "fixed", SIZE, shape), shape


@query(f"""WITH {DENSE}, k AS (SELECT d, exp(-0.5 * d * d) AS w FROM unnest(range(-2, 3)) u(d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
    sx AS (SELECT x, y, z, sum(w * g2p) AS p FROM (SELECT g.x, g.y, g.z, w, (SELECT m FROM lim) AS m, g.x + d AS c FROM grid g, kn) s JOIN (SELECT x AS x2, y AS y2, z AS z2, p AS g2p FROM grid) o
        ON y2 = s.y AND z2 = s.z AND x2 = CASE WHEN c < 0 THEN -c - 1 WHEN c >= m THEN 2 * m - 1 - c ELSE c END GROUP BY x, y, z),
    sy AS (SELECT x, y, z, sum(w * p2) AS p FROM (SELECT sx.x, sx.y, sx.z, w, sx.y + d AS c FROM sx, kn) s JOIN (SELECT x AS x2, y AS y2, z AS z2, p AS p2 FROM sx) o
        ON x2 = s.x AND z2 = s.z AND y2 = CASE WHEN c < 0 THEN -c - 1 WHEN c >= 40 THEN 79 - c ELSE c END GROUP BY x, y, z),
    sz AS (SELECT x, y, z, sum(w * p2) AS p FROM (SELECT sy.x, sy.y, sy.z, w, sy.z + d AS c FROM sy, kn) s JOIN (SELECT x AS x2, y AS y2, z AS z2, p AS p2 FROM sy) o
        ON x2 = s.x AND y2 = s.y AND z2 = CASE WHEN c < 0 THEN -c - 1 WHEN c >= 8 THEN 15 - c ELSE c END GROUP BY x, y, z)
    SELECT x, y, z, CAST(round(p) AS BIGINT) AS p FROM sz WHERE round(p) <> 0""")
def v21_smoothed(spark, d):
    """The probability map smoothed before the threshold, in millionths."""
    blocks, shape = _fixed(spark, d)
    return B.to_voxels(B.gaussian(blocks, (1.0, 1.0, 1.0), SIZE, shape, 2.0), SIZE, "p").select("x", "y", "z", "p")


@query(f"""WITH {DENSE}, o AS (SELECT * FROM grid WHERE p > 450000), b AS (SELECT * FROM grid WHERE p <= 450000)
    SELECT o.x, o.y, o.z, CAST(coalesce(min(pow(o.x - b.x, 2) + pow(o.y - b.y, 2) + pow(2 * (o.z - b.z), 2)), 36) AS BIGINT) AS d2 FROM o LEFT JOIN b ON b.x BETWEEN o.x - 5 AND o.x + 5 AND b.y BETWEEN o.y - 5 AND o.y + 5 AND b.z BETWEEN o.z - 2 AND o.z + 2
        AND pow(o.x - b.x, 2) + pow(o.y - b.y, 2) + pow(2 * (o.z - b.z), 2) < 36 GROUP BY o.x, o.y, o.z""")
def v28_distances(spark, d):
    """Squared distances to the background of the thresholded map, up to six units; a step along z counts two."""
    shape = _shape(spark, d)
    mask = _vox(spark, d).where(F.round(F.col("p") * 1000000) > 450000).withColumn("on", F.lit(1))
    return B.to_voxels(B.distance_transform(B.to_blocks(mask, "on", SIZE, shape), SIZE, shape, 6, (1, 1, 2)), SIZE, "d2").select("x", "y", "z", "d2")


@query()
def v28_watershed(spark, d):
    """The thresholded map parted by seeds where it is widest, flooded down the distances; held against brute force in the tests."""
    shape = _shape(spark, d)
    mask = _vox(spark, d).where(F.round(F.col("p") * 1000000) > 450000).withColumn("on", F.lit(1))
    heights = B.distance_transform(B.to_blocks(mask, "on", SIZE, shape), SIZE, shape, 6)
    heights = cut(heights)
    seeds, _ = I.instance_segmentation(I.pointwise(heights, lambda a: a >= 2), SIZE, shape)
    return B.to_voxels(I.watershed(seeds, heights, SIZE, shape), SIZE).select("x", "y", "z", "label")
