"""Object tables and blocks as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_objects(objects: DataFrame, path: str) -> None:
    """One folder per object type, so that a type is read without the others."""
    objects.write.mode("overwrite").partitionBy("obj_type").parquet(path)


def load_column(spark: SparkSession, path: str, obj_type: str, column: str) -> DataFrame:
    """One attribute of one type; only its folder and column are read."""
    return spark.read.parquet(path).where(F.col("obj_type") == obj_type).select("obj_id", column)


def cell_cache(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The chosen attributes of cells that have all of them."""
    return cells if keys is None else cells.select("cell_id", *keys).dropna(subset=keys)


def blocks_in_box(blocks: DataFrame, offset: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Blocks that meet a box; a range predicate on the origins, which Parquet can prune."""
    for c, o, s in zip("xyz", offset, size):
        blocks = blocks.where((F.col(f"{c}0") < o + s) & (F.col(f"{c}0") + F.col(f"n{c}") > o))
    return blocks


def copy_cells(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen cells, for a new version of the table."""
    return cells.join(chosen.select("cell_id").distinct(), "cell_id", "left_semi")


def missing(objects: DataFrame, attributes: DataFrame, key: str = "obj_id") -> DataFrame:
    """Q1, Q2: objects without a row of attributes."""
    return objects.join(attributes.select(key).distinct(), key, "left_anti")


def bucket(c: str, n: int, per: int = 1000):
    """Q4: storage bucket of an id."""
    return F.pmod(F.floor(F.col(c) / per).cast("long"), F.lit(n))


def load_distribution(objects: DataFrame, n: int, size: str | None = None) -> DataFrame:
    """Q3: objects, or summed sizes, per bucket."""
    total = F.count("*") if size is None else F.sum(size)
    return objects.groupBy(bucket("obj_id", n).alias("bucket")).agg(total.alias("load"))


def bulk_lookup(ids: DataFrame, objects: DataFrame, columns: list[str], allow_missing: bool) -> DataFrame:
    """Q5: attributes of a list of ids; absent ones are null or left out."""
    return ids.join(objects.select("obj_id", *columns), "obj_id", "left" if allow_missing else "inner")
