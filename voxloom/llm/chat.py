"""Chat formatting: cumulative-snapshot collapse, then rendering; DataFrame operations alone.

A logger that stores a conversation after every turn leaves snapshots that are
prefixes of later ones. Every turn gets a rolling hash of the conversation up to
it: running XORs of two independent 64-bit hashes of (position, role, text).
Positions are inside the hashes, so equal running values mean equal prefixes.
The hash at the last turn identifies the conversation; where it also occurs
inside another conversation, an anti-join drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.session import cut


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text, n, h1, h2)``: each turn with the rolling hashes up to it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    picked = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    placed = picked.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    one = F.xxhash64("pos", "role", "text")
    two = F.xxhash64(F.lit("second"), "text", "role", "pos")
    return placed.withColumn("h1", F.bit_xor(one).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "h2", F.bit_xor(two).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n)`` of the conversations that are no proper prefix of another; of equal ones the smallest id.

    Turns are taken in order of ``turn``, ties by role and text; null roles and
    texts count as empty; turns without conversation are left out.
    """
    marks = turn_prefixes(turns).select("conv_id", "pos", "n", "h1", "h2")
    marks = cut(marks)
    ends = marks.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inside = marks.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(inside, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def chatml(role: Column, text: Column) -> Column:
    """A turn between marks; what looks like the head of a mark in a role or text gets a space, so that no text forges a turn."""
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, render=chatml) -> DataFrame:
    """``(conv_id, n_turns, n_assistant, rendered)``, one row per maximal conversation.

    A conversation's own text is the only thing gathered in one row. Turns are in
    order of ``turn``, ties by role and text; a repeated row is one more turn; null roles
    and texts are empty; texts of any length are whole. Empty tables give empty results;
    other columns do not matter.
    """
    kept = maximal_conversations(turns)
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).join(kept.select("conv_id"), "conv_id", "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sum((F.col("role") == "assistant").cast("long")).alias("n_assistant"),
        F.array_join(F.transform(lines, lambda x: render(x["role"], x["text"])), "").alias("rendered"),
    )
