"""Most frequent values with explicit rules for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_smallest(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent ``value`` per ``keys``, ties to the smallest. Two partial aggregations, no window."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
    return counts.groupBy(*keys).agg(best["v"].alias(name), (-best["n"]).alias(f"{name}_count"))


def mode_nearest(df: DataFrame, keys: list[str], value: str, rank: str, name: str = "mode") -> DataFrame:
    """The most frequent ``value`` per ``keys``, ties to the one seen at the smallest ``rank``."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.min(rank).alias("_r"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_r").alias("r"), F.col("_v").alias("v")))
    return counts.groupBy(*keys).agg(best["v"].alias(name))


def argmax(values: Column) -> Column:
    """Place of the first largest element of an array, from 0."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda x: F.exp(x.cast("double") - F.array_max(values).cast("double")))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def r6(c: Column | str) -> Column:
    """Rounded to six places; sums of doubles differ in order beyond that."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_plain(c: Column | str) -> Column:
    """:func:`r6` of values from 0 on by arithmetic alone, for rows without number: halves go up, as in SQL's ``round`` of a double."""
    y = (F.col(c) if isinstance(c, str) else c) * 1e6
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / F.lit(1e6)
