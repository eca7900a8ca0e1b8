"""A stream of partial rows ends with what one batch gives."""

from voxloom.operators import voxels as V
from voxloom.plans.views import view
from voxloom.streaming.properties import running_properties, stream_blocks


def test_stream_equals_batch(spark, tmp_path):
    vox = view(spark, "/root/testdata/sf0.001", "voxels")
    parts = V.fused_partials(vox, "sv_id", {"mi": "mi_id"}).where("kind = 'cell'").drop("kind", "id2")
    halves = vox.where("x < 12"), vox.where("x >= 12")
    for h in halves:
        V.fused_partials(h, "sv_id", {}).where("kind = 'cell'").drop("kind", "id2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_properties(stream_blocks(spark, str(tmp_path / "in"), parts.schema, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("props").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("props").select(*parts.columns).collect()) == sorted(parts.collect())
