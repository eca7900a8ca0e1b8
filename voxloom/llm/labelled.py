"""Labelled rows shared by the trained scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit reads at most, whatever the size of the tables.
TRAIN_ROWS = 6000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", limit: int = TRAIN_ROWS) -> DataFrame:
    """``(text, lang?, y)`` of at most ``limit`` labelled rows that pass ``keep``, picked by the hash of the id.

    Null labels and null ids are left out; ids with more than one label give one
    of them (the largest), ids with more than one row one row (the smallest by the
    hash of the text), so that the limit holds for rows. Of ``docs`` only the id, text
    and lang go on.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(keep).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    picked = one.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    wanted = [c for c in docs.columns if c in ("text", "lang")]
    texts = docs.select(id_col, *wanted).join(F.broadcast(picked), id_col)
    row = F.struct(F.xxhash64("text").alias("h"), *wanted, "y")
    return texts.groupBy(id_col).agg(F.min(row).alias("row")).select(id_col, *[f"row.{c}" for c in (*wanted, "y")])
