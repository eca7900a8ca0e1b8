"""Numbers in a global order, and joins whose hot keys are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.session import cut

#: Keys with more than one row in so many are joined by broadcast: fewer keys than this, whatever the table.
HEAVY = 1000


def numbered(df: DataFrame, by: list[str], name: str = "nr") -> DataFrame:
    """``df`` with a number from 0 on in the order of ``by`` (nulls first), written to the shared folder.

    Rows are dealt by ranges and numbered within each; one row a range carries the
    sizes of the ranges before. No task sorts the whole table; rows that are alike in
    all of ``by`` can lie in several ranges too.
    """
    apart = df.withColumn("nr_as_read", F.monotonically_increasing_id())
    dealt = apart.repartitionByRange(*by, "nr_as_read").sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())
    dealt = cut(dealt.drop("nr_as_read"))
    part, inside = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("part_of_row")).agg(F.count("*").alias("size_of_part"))
    up_to = Window.orderBy("part_of_row").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = sizes.select("part_of_row", F.coalesce(F.sum("size_of_part").over(up_to), F.lit(0)).alias("before"))
    return dealt.withColumn("part_of_row", part).join(F.broadcast(before), "part_of_row").select(*df.columns, (inside + F.col("before")).alias(name))


def heavy_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each key once, and in ``weight`` how many of the ``total`` rows have it.

    Keys with more than one row in HEAVY are fewer than HEAVY and go by broadcast, so
    no task of the shuffle gets a hot key.
    """
    is_heavy = F.col(weight) * HEAVY > total
    heavy, light = table.where(is_heavy), table.where(~is_heavy)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on, how))
