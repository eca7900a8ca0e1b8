"""Organelle to cell mapping by overlap ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """What a type needs to be mapped: ratio above ``lower``, at most ``upper`` where that is below 1, size above ``size``."""

    lower: float = 0.5
    upper: float = 1.0
    size: int = 0


def cell_ratios(overlap: DataFrame, sv_cell: DataFrame, keys: tuple[str, ...] = ("obj_type", "obj_id")) -> DataFrame:
    """M1: overlap ratios of supervoxels summed per cell; sums that are not positive drop out."""
    return overlap.join(sv_cell, "sv_id").groupBy(*keys, "cell_id").agg(F.sum("ratio").alias("ratio")).where("ratio > 0")


def decide(ratios: DataFrame, sizes: DataFrame, rules: dict[str, Thresholds]) -> DataFrame:
    """M2: mapped objects, with each type's own thresholds; types without any drop out."""
    joined = ratios.join(sizes.select("obj_type", "obj_id", "size"), ["obj_type", "obj_id"])
    keep = F.lit(False)
    for kind, t in rules.items():
        ok = (F.col("obj_type") == kind) & (F.col("ratio") > t.lower) & (F.col("size") > t.size)
        keep = keep | (ok & (F.col("ratio") <= t.upper) if t.upper < 1 else ok)
    return joined.where(keep)


def background_corrected(ratios: DataFrame) -> DataFrame:
    """M3: ratios over what is not background: r / (1 - r of cell 0); cell 0 itself drops out."""
    background = ratios.where("cell_id = 0").select("obj_type", "obj_id", F.col("ratio").alias("bg"))
    rest = ratios.where("cell_id <> 0").join(background, ["obj_type", "obj_id"], "left")
    return rest.withColumn("ratio", F.col("ratio") / (1 - F.coalesce("bg", F.lit(0.0)))).drop("bg")


def full_mapping(overlap: DataFrame, sv_cell: DataFrame, sizes: DataFrame, rules: dict[str, Thresholds], corrected: tuple[str, ...] = ("sj",)) -> DataFrame:
    """M4: M1, then the correction for the types that need it, then M2."""
    ratios = cell_ratios(overlap, sv_cell)
    apart = F.col("obj_type").isin(list(corrected))
    return decide(ratios.where(~apart).unionByName(background_corrected(ratios.where(apart))), sizes, rules)


def objects_of_cells(mapped: DataFrame, cells: DataFrame) -> DataFrame:
    """M6: mapped objects of the given cells."""
    return mapped.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
