"""Queries of the mapping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import mapping as M
from voxloom.operators import wiring as W
from voxloom.plans.registry import query
from voxloom.plans.views import view

RULES = {"mi": M.Thresholds(0.3, 1.0, 60), "vc": M.Thresholds(0.1, 0.9, 30), "sj": M.Thresholds(0.2, 1.0, 100)}
RATIO = "r AS (SELECT obj_type, obj_id, sv_id, n * 4.0 / (20 + obj_id % 400) AS ratio FROM overlap)"
CELL = f"{RATIO}, c AS (SELECT obj_type, obj_id, cell_id, sum(ratio) AS ratio FROM r JOIN sv_cell ON r.sv_id = sv_cell.sv_id GROUP BY obj_type, obj_id, cell_id HAVING sum(ratio) > 0)"
KEEP = """(obj_type = 'mi' AND round(ratio, 6) > 0.3 AND size > 60) OR (obj_type = 'vc' AND round(ratio, 6) > 0.1 AND round(ratio, 6) <= 0.9 AND size > 30) OR (obj_type = 'sj' AND round(ratio, 6) > 0.2 AND size > 100)"""


def _overlap(spark, d):
    return view(spark, d, "overlap").withColumn("ratio", F.col("n") * 4.0 / (20 + F.col("obj_id") % 400))


@query(f"WITH {CELL} SELECT obj_type, obj_id, cell_id, round(ratio, 6) AS ratio FROM c")
def m1_cell_ratios(spark, d):
    return M.cell_ratios(_overlap(spark, d), view(spark, d, "sv_cell")).withColumn("ratio", r6("ratio"))


@query(f"WITH {CELL} SELECT c.obj_type, c.obj_id, cell_id, round(ratio, 6) AS ratio, size FROM c JOIN objects b ON c.obj_type = b.obj_type AND c.obj_id = b.obj_id WHERE {KEEP.replace('obj_type', 'c.obj_type')}")
def m2_decide(spark, d):
    ratios = M.cell_ratios(_overlap(spark, d), view(spark, d, "sv_cell")).withColumn("ratio", r6("ratio"))
    return M.decide(ratios, view(spark, d, "objects"), RULES)


CORRECT = f"""{CELL}, z AS (SELECT obj_type, obj_id, CASE WHEN cell_id % 10 = 0 THEN 0 ELSE cell_id END AS cell_id, sum(ratio) AS ratio FROM c GROUP BY 1, 2, 3),
    bg AS (SELECT obj_type, obj_id, least(ratio, 0.5) AS bg FROM z WHERE cell_id = 0)"""


def _with_background(spark, d):
    ratios = M.cell_ratios(_overlap(spark, d), view(spark, d, "sv_cell"))
    cell = F.when(F.col("cell_id") % 10 == 0, 0).otherwise(F.col("cell_id")).cast("long")
    z = ratios.groupBy("obj_type", "obj_id", cell.alias("cell_id")).agg(F.sum("ratio").alias("ratio"))
    return z.withColumn("ratio", F.when(F.col("cell_id") == 0, F.least("ratio", F.lit(0.5))).otherwise(F.col("ratio")))


@query(f"WITH {CORRECT} SELECT z.obj_type, z.obj_id, cell_id, round(ratio / (1 - coalesce(bg, 0)), 6) AS ratio FROM z LEFT JOIN bg ON z.obj_type = bg.obj_type AND z.obj_id = bg.obj_id WHERE cell_id <> 0")
def m3_background_corrected(spark, d):
    return M.background_corrected(_with_background(spark, d)).withColumn("ratio", r6("ratio"))


@query(f"WITH {CELL} SELECT c.obj_type, c.obj_id, cell_id, size FROM c JOIN objects b ON c.obj_type = b.obj_type AND c.obj_id = b.obj_id WHERE {KEEP.replace('obj_type', 'c.obj_type').replace('round(ratio, 6)', 'ratio')}")
def m4_full_mapping(spark, d):
    return M.full_mapping(_overlap(spark, d), view(spark, d, "sv_cell"), view(spark, d, "objects"), RULES).drop("ratio")


@query("SELECT cell, syn_id FROM (SELECT syn_id, syn_prob, cell_1 AS cell FROM synapses UNION ALL SELECT syn_id, syn_prob, cell_2 FROM synapses) p WHERE round(syn_prob, 6) > 0.8")
def m5_synapses_to_cells(spark, d):
    return W.partners(view(spark, d, "synapses").where(r6("syn_prob") > 0.8)).select("cell", "syn_id")


@query(f"WITH {CELL} SELECT obj_type, obj_id, cell_id, round(ratio, 6) AS ratio FROM c WHERE cell_id IN (SELECT cell_id FROM sv_cell WHERE sv_id < 40)")
def m6_objects_of_cells(spark, d):
    ratios = M.cell_ratios(_overlap(spark, d), view(spark, d, "sv_cell")).withColumn("ratio", r6("ratio"))
    return M.objects_of_cells(ratios, view(spark, d, "sv_cell").where("sv_id < 40")).select("obj_type", "obj_id", "cell_id", "ratio")
