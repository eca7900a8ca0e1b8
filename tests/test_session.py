"""Tables in the shared folder: who owns them and when they go."""

from pathlib import Path

from pyspark.sql import functions as F

from voxloom.operators.voxels import merge_voxel_lists
from voxloom.session import cut, cut_in_buckets, drop_cut, owned_dir, release, scratch


def held(spark):
    at = Path(owned_dir(spark).removeprefix("file:"))
    return sorted(p.name for p in at.iterdir()) if at.exists() else []


def test_cut_tables_have_an_owner(spark):
    assert spark.sparkContext.applicationId in owned_dir(spark)
    before = held(spark)
    one = cut(spark.range(5))
    two = cut_in_buckets(spark.range(5), ["id"])
    assert len(held(spark)) == len(before) + 2 and one.count() == two.count() == 5
    drop_cut(one)
    assert len(held(spark)) == len(before) + 1
    with scratch(spark):
        cut_in_buckets(spark.range(3), ["id"])
        cut(spark.range(3))
    assert len(held(spark)) == len(before) + 1
    release(spark)
    assert held(spark) == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("voxloom_")]


def test_long_voxel_lists_are_cut(spark):
    parts = spark.range(40).select((F.col("id") % 3).alias("obj"), F.array(*[F.struct((F.col("id") * 10 + k).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")) for k in range(10)]).alias("voxels"))
    got = merge_voxel_lists(parts, "obj", step=50).collect()
    assert sorted(v.x for r in got for v in r.voxels) == list(range(400)) and max(len(r.voxels) for r in got) < 100
    whole = merge_voxel_lists(parts, "obj").collect()
    assert sorted((r.obj, r.part, len(r.voxels)) for r in whole) == [(0, 0, 140), (1, 0, 130), (2, 0, 130)]
