"""Object properties over a stream of partial rows: the merge of V5 as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def running_properties(parts: DataFrame, key: str = "id") -> DataFrame:
    """Size, box and first voxel per object over all partial rows so far; use with output mode ``complete`` or ``update``.

    The state is one row per object; partial rows may come in any order and any batches.
    """
    low, high = [F.min(f"min_{c}").alias(f"min_{c}") for c in XYZ], [F.max(f"max_{c}").alias(f"max_{c}") for c in XYZ]
    rep = F.min(F.struct(*[f"rep_{c}" for c in XYZ])).alias("rep")
    got = parts.groupBy(key).agg(F.sum("size").alias("size"), *low, *high, rep)
    return got.select(key, "size", *[f"{e}_{c}" for e in ("min", "max") for c in XYZ], *[F.col(f"rep.rep_{c}").alias(f"rep_{c}") for c in XYZ])


def stream_blocks(spark, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Block or partial-row files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
