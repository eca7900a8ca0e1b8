"""Queries of sources, sinks and completeness checks; files go through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import graph as G
from voxloom.operators import wiring as W
from voxloom.plans.registry import query
from voxloom.plans.views import view
from voxloom.session import shared_dir
from voxloom.sources import objects as O
from voxloom.sources import text as T


def _path(spark) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def _blocks(spark, d):
    vox = view(spark, d, "voxels").groupBy("block_x", "block_y").agg(F.count("*").alias("n"))
    return vox.select((F.col("block_x") * 10).alias("x0"), (F.col("block_y") * 10).alias("y0"), F.lit(0).cast("long").alias("z0"), F.lit(10).alias("nx"), F.lit(10).alias("ny"), F.lit(10).alias("nz"), "n")


@query("SELECT x, y, z, sv_id FROM voxels WHERE x >= 10 AND x < 20 AND y >= 20 AND y < 30")
def s1_read_subvolume(spark, d):
    path = _path(spark)
    view(spark, d, "voxels").select("x", "y", "z", "sv_id", "block_x", "block_y").repartition("block_x", "block_y").write.partitionBy("block_x", "block_y").parquet(path)  # a file a block, not one a task and block
    return spark.read.parquet(path).where("block_x = 1 and block_y = 2").select("x", "y", "z", "sv_id")


@query("SELECT block_x * 10 AS x0, block_y * 10 AS y0, count(*) AS n FROM voxels WHERE block_x * 10 < 15 AND block_x * 10 + 10 > 5 AND block_y * 10 < 31 AND block_y * 10 + 10 > 12 GROUP BY block_x, block_y")
def s2_blocks_in_box(spark, d):
    return O.blocks_in_box(_blocks(spark, d), (5, 12, 0), (10, 19, 5)).select("x0", "y0", "n")


@query("SELECT src, dst FROM edges")
def s3_read_edges(spark, d):
    path = _path(spark)
    T.write_edges(view(spark, d, "edges"), path)
    return T.read_edges(spark, path)


@query("SELECT src || ' ' || dst AS value FROM edges")
def s4_write_edges(spark, d):
    path = _path(spark)
    T.write_edges(view(spark, d, "edges"), path)
    return spark.read.text(path)


@query("SELECT m.sv_id, f.first AS cell_id FROM sv_cell m JOIN (SELECT cell_id, min(sv_id) AS first FROM sv_cell GROUP BY cell_id) f ON m.cell_id = f.cell_id")
def s5_read_agglomeration(spark, d):
    path = _path(spark)
    T.write_agglomeration(view(spark, d, "sv_cell"), path)
    return T.read_agglomeration(spark, path)


@query("SELECT string_agg(CAST(sv_id AS VARCHAR), ',' ORDER BY sv_id) AS value FROM sv_cell GROUP BY cell_id")
def s6_write_agglomeration(spark, d):
    path = _path(spark)
    T.write_agglomeration(view(spark, d, "sv_cell"), path)
    return spark.read.text(path)


@query("SELECT cell_id, count(DISTINCT sv_id) AS n, min(sv_id) AS first FROM sv_cell GROUP BY cell_id")
def s7_assemble(spark, d):
    return G.members(view(spark, d, "sv_cell")).select("cell_id", F.size("sv_ids").cast("long").alias("n"), F.element_at("sv_ids", 1).alias("first"))


@query("SELECT obj_type, obj_id, size, x, y, z FROM objects")
def s8_object_cache(spark, d):
    path = _path(spark)
    O.write_objects(view(spark, d, "objects"), path)
    return spark.read.parquet(path).select("obj_type", "obj_id", "size", "x", "y", "z")


@query("SELECT cell_id, CAST(sum(size) AS BIGINT) AS size, CASE WHEN max(max_x) < 109 THEN max(max_x) END AS max_x FROM (SELECT sv.*, cell_id FROM sv JOIN sv_cell ON sv.sv_id = sv_cell.sv_id) j GROUP BY cell_id HAVING max(max_x) < 109")
def s9_cell_cache(spark, d):
    cells = G.cell_rollup(view(spark, d, "sv"), view(spark, d, "sv_cell")).withColumn("max_x", F.when(F.col("max_x") < 109, F.col("max_x")))
    return O.cell_cache(cells, ["size", "max_x"])


@query("SELECT obj_id, size FROM objects WHERE obj_type = 'mi'")
def s10_load_column(spark, d):
    path = _path(spark)
    O.write_objects(view(spark, d, "objects"), path)
    return O.load_column(spark, path, "mi", "size")


@query("SELECT syn_id, cell_1, cell_2, round(mesh_area / 2 * syn_sign, 6) AS size FROM synapses WHERE round(syn_prob, 6) > 0.8")
def s11_connectivity_file(spark, d):
    path = _path(spark)
    syn = view(spark, d, "synapses").withColumn("syn_prob", r6("syn_prob"))
    T.write_connectivity(W.export_table(syn, 0.8).select("syn_id", "cell_1", "cell_2", r6("size").alias("size")), path)
    return T.read_connectivity(spark, path, "syn_id long, cell_1 long, cell_2 long, size double")


@query("""SELECT 'out' AS direction, pre_type AS cell_type, post_type AS partner_type, count(*) AS n FROM (
    SELECT CASE WHEN a1 = 1 THEN ct_1 ELSE ct_2 END AS pre_type, CASE WHEN a1 = 1 THEN ct_2 ELSE ct_1 END AS post_type FROM (
        SELECT *, CASE WHEN ax_1 IN (3, 4) THEN 1 ELSE ax_1 END AS a1, CASE WHEN ax_2 IN (3, 4) THEN 1 ELSE ax_2 END AS a2 FROM synapses WHERE round(syn_prob, 6) >= 0.6 AND mesh_area BETWEEN 0.5 AND 4) w WHERE a1 + a2 = 1) h
    GROUP BY pre_type, post_type""")
def s12_type_sum_files(spark, d):
    path = _path(spark)
    sums = W.type_sums(view(spark, d, "synapses").withColumn("syn_prob", r6("syn_prob")), 0.6, (0.5, 4.0))
    T.write_type_sums(sums, path)
    back = spark.read.schema("partner_type int, area double, n long, direction string, cell_type int").option("header", True).csv(path)
    return back.where("direction = 'out'").select("direction", "cell_type", "partner_type", "n")


@query("SELECT count(*) AS n, round(sum(mesh_area / 2), 6) AS total FROM synapses WHERE round(syn_prob, 6) > 0.8")
def s13_read_connectivity(spark, d):
    back = s11_connectivity_file(spark, d)
    return back.agg(F.count("*").alias("n"), r6(F.sum(F.abs("size"))).alias("total"))


@query("SELECT cell_id, count(*) AS n_sv FROM sv_cell WHERE cell_id % 5 = 0 GROUP BY cell_id")
def s14_copy_cells(spark, d):
    m = view(spark, d, "sv_cell")
    cells = m.groupBy("cell_id").agg(F.count("*").alias("n_sv"))
    return O.copy_cells(cells, m.where("cell_id % 5 = 0"))


@query("SELECT sv_id, cell_id FROM sv_cell WHERE sv_id <> 0")
def s15_merge_list(spark, d):
    path = _path(spark)
    lists = view(spark, d, "sv_cell").groupBy("cell_id").agg(F.sort_array(F.collect_list("sv_id")).alias("m"))
    line = F.concat_ws("\n", F.concat_ws(" ", "cell_id", F.lit("1"), F.lit("0"), F.array_join("m", " "), F.lit("0")), F.lit("10 20 30"), F.lit(""), F.lit("# comment 5"))
    lists.select(line.alias("value")).write.text(path)
    return T.read_merge_list(spark, path)


@query("SELECT obj_id FROM objects WHERE obj_id NOT IN (SELECT obj_id FROM overlap WHERE sv_id % 60 = 0)")
def q1_missing_attributes(spark, d):
    return O.missing(view(spark, d, "objects").select("obj_id"), view(spark, d, "overlap").where("sv_id % 60 = 0"))


@query("SELECT count(*) AS n_missing FROM sv WHERE sv_id NOT IN (SELECT sv_id FROM sv_cell)")
def q2_missing_predictions(spark, d):
    return O.missing(view(spark, d, "sv"), view(spark, d, "sv_cell"), "sv_id").agg(F.count("*").alias("n_missing"))


@query("SELECT CAST(floor(obj_id / 1000) AS BIGINT) % 10 AS bucket, CAST(sum(size) AS BIGINT) AS load FROM objects GROUP BY 1")
def q3_load_distribution(spark, d):
    return O.load_distribution(view(spark, d, "objects"), 10, "size")


@query("SELECT l_orderkey AS id, CAST(floor(l_orderkey / 1000) AS BIGINT) % 100 AS bucket FROM lineitem")
def q4_buckets(spark, d):
    from voxloom.session import read_table

    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), O.bucket("l_orderkey", 100).alias("bucket"))


@query("SELECT k.obj_id, b.size FROM (SELECT DISTINCT l_partkey * 2 AS obj_id FROM lineitem) k LEFT JOIN objects b ON k.obj_id = b.obj_id")
def q5_bulk_lookup(spark, d):
    from voxloom.session import read_table

    ids = read_table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("obj_id")).distinct()
    return O.bulk_lookup(ids, view(spark, d, "objects"), ["size"], True)
