"""Session helpers: reading tables, shared scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark alone touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests) gets a fresh temporary
    folder once; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def owned_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application owns: what it cuts lies there, and nothing else."""
    return f"{shared_dir(spark)}/voxloom-{spark.sparkContext.applicationId}"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside are deleted at the end; what is made of them has to be written by then."""
    mine: list[str] = []
    before = _MADE.set(mine)
    try:
        yield
    finally:
        _MADE.reset(before)
        for folder in mine:
            _drop(spark, folder)


def _drop(spark: SparkSession, folder: str) -> None:
    name = folder.rsplit("/", 1)[1]
    if name.startswith("voxloom_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; what is made of them has to be written by then.

    Of an application that has died, its id names the folder to delete.
    """
    for t in spark.catalog.listTables():
        if t.name.startswith("voxloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    delete(spark, owned_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read of the files and
    never a recomputation of the steps before them.
    """
    path = f"{owned_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_buckets(df: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`cut` into buckets by ``keys``, as many as there are shuffle partitions: a later join by the keys moves the other side alone."""
    spark = df.sparkSession
    name = f"voxloom_{uuid.uuid4().hex}"
    path = f"{owned_dir(spark)}/{name}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns more that name a row alike in every scan, and their names: its file and its place there.

    How files are split over tasks changes with the cluster, these do not. A table that
    is not read from Parquet files directly is written first.
    """
    names = []
    for name in ("file_of_row", "place_of_row"):
        while name in docs.columns:
            name = "_" + name
        names.append(name)
    where = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    read_directly = docs._jdf.queryExecution().analyzed().children().isEmpty()  # joins and the like repeat rows of a file
    try:
        if read_directly:
            return docs.select("*", *where), names
    except AnalysisException:  # not from files
        pass
    return cut(docs).select("*", *where), names


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/voxloom-" in folder:
            delete(spark, folder)


def running_total(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, in the order of ``by`` (which tells rows apart).

    Rows are dealt by ranges of ``by``; each range sums its own, and one row a range
    carries the sums of the ranges before. No task sorts the whole table.
    """
    dealt = cut(df.withColumn("value_of_row", value.cast("long")).repartitionByRange(*by).withColumn("range_of_row", F.spark_partition_id()))
    sums = dealt.groupBy("range_of_row").agg(F.sum("value_of_row").alias("s"))
    before = sums.select("range_of_row", F.coalesce(F.sum("s").over(Window.orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("value_of_row").over(Window.partitionBy("range_of_row").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("inside", inside).join(F.broadcast(before), "range_of_row")  # one row a partition
    return out.withColumn(name, F.col("before") + F.col("inside")).select(*df.columns, name)
