"""Corpus pipeline: documents -> clean, distinct, uncontaminated, redacted texts -> packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``, extra
ones included. Empty tables give empty results, null texts count as empty,
repeated rows are rows (of which near-dedup keeps one), texts of any length are worked on
whole, ties go by id and then by place, and columns of any further name come along unchanged,
also where an operator uses the same name inside. What an operator finds is
joined back to the rows by their place in the files, which no change of the
cluster alters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import packing, quality, secrets, simhash, winnow
from voxloom.llm.queries import vocabulary_path
from voxloom.session import delete, located, read_table, scratch, shared_dir

#: Scores below go.
MIN_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is MIN_QUALITY or more.

    The model is fitted on labelled rows outside fold 0 of 5; with an empty or
    one-sided label table every document gets the same score.
    """
    model = quality.fit_quality(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), folds=5, held_out=0)
    score = "quality"
    while score in docs.columns:
        score = "_" + score
    return quality.score_texts(docs, model, score_col=score).where(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    placed, place = located(docs)
    kept = simhash.near_text_groups(placed, shingle=5, similarity=0.8, carry=place).where("rid = rep").select(*place)
    return placed.join(kept, place, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    placed, place = located(docs)
    hit = winnow.contamination(placed, read_table(spark, sf_dir, "benchmark"), carry=place).where("contaminated").select(*place)
    return placed.join(hit, place, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. ``n_chars`` follows the text."""
    placed, place = located(docs)
    spans = secrets.secret_spans(placed, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"), carry=place)
    found = spans.where(F.size("spans") > 0).select(*place, F.struct("spans").alias("found"))
    rest = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")  # so that no column of docs meets one made here
    masked = placed.select(*place, rest).join(found, place, "left")
    text = F.when(F.col("found").isNotNull(), secrets.redact(F.coalesce("doc.text", F.lit("")), F.col("found.spans"))).otherwise(F.col("doc.text"))
    masked = masked.select("doc", "found", text.alias("text"))
    n_chars = F.when(F.col("found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    made = {"text": F.col("text"), "n_chars": n_chars.alias("n_chars")}
    return masked.select(*[made.get(c, F.col("doc")[c].alias(c)) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts' tokens in sequences of at most 4096."""
    pieces = packing.token_pieces(docs, vocabulary_path())
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express the trained classifier or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole ``documents`` table; of their tables the last one stays."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
