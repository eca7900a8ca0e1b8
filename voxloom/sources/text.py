"""Edge lists, agglomeration lists and merge lists as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``src dst`` lines parted by white space, plain or compressed; other lines are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return rows.select(F.expr("try_cast(p[0] AS bigint)").alias("src"), F.expr("try_cast(p[1] AS bigint)").alias("dst")).where("src is not null and dst is not null")


def write_edges(edges: DataFrame, path: str) -> None:
    """S4."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def read_agglomeration(spark: SparkSession, path: str) -> DataFrame:
    """One comma-joined component a line; its id is the smallest member."""
    ids = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("long"))
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(ids.alias("ids"))
    return rows.select(F.array_min("ids").alias("cell_id"), F.explode("ids").alias("sv_id")).select("sv_id", "cell_id")


def write_agglomeration(mapping: DataFrame, path: str) -> None:
    """S6."""
    lists = mapping.groupBy("cell_id").agg(F.array_join(F.sort_array(F.collect_set("sv_id")), ",").alias("value"))
    lists.select("value").write.mode("overwrite").text(path)


def read_merge_list(spark: SparkSession, path: str) -> DataFrame:
    """Of every four lines the first counts: its first number is the cell, those from the fourth on are members; zeros go.

    Lines are numbered within their file by their place in it.
    """
    numbers = F.transform(F.regexp_extract_all("value", F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("long"))
    rows = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    kept = rows.where("line % 4 = 0").select(numbers.alias("n")).where(F.size("n") > 3)
    members = kept.select(F.element_at("n", 1).alias("cell_id"), F.explode(F.slice("n", 4, F.size("n"))).alias("sv_id"))
    return members.where("sv_id <> 0").select("sv_id", "cell_id")


def write_connectivity(table: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_connectivity(spark: SparkSession, path: str, schema) -> DataFrame:
    """The same file with a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_type_sums(sums: DataFrame, path: str) -> None:
    """One folder per direction and cell type."""
    sums.write.mode("overwrite").partitionBy("direction", "cell_type").option("header", True).csv(path)


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 over few rows (types, cells), not over voxels."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
