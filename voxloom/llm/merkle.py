"""Merkle manifest of a dataset: one tree a group, one over the groups, a proof for every row.

Leaves are ranked within their group. The binary digits of the rank become columns,
and a block of 256 leaves shares the digits above. Within a block one digit after the
other is grouped away, lowest first: what is left of the two children goes into a struct
with the hash of both, until a block is one row that nests its whole tree. All
these groupings find their rows in place after one shuffle by block, sorted once. Blocks are
the leaves of the level above. For the proofs each block comes
apart again by transforms, the path growing on the way down, and one explode; blocks meet
the path above them by their number, one row of either a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.ranks import heavy_join, numbered
from voxloom.session import cut

#: Binary digits that a block groups away.
DIGITS = 8
STEP = "struct<left string, right string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts one behind the other; hashes go in as hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def roll_up(nodes: DataFrame) -> DataFrame:
    """``nodes(grp, nr, n, node)`` to ``(grp, n, block, node)``, one row a block.

    ``node`` is a struct that begins with its hash ``h``; ``n`` is how many nodes the group
    has. Digits above the group's root change nothing.
    """
    digits = [f"digit_{k}" for k in range(DIGITS)]
    placed = nodes.select("grp", "n", F.shiftright("nr", DIGITS).alias("block"), *[F.shiftright("nr", k).bitwiseAND(1).alias(d) for k, d in enumerate(digits)], "node")
    placed = placed.repartition("grp", "block")
    for k, d in enumerate(digits):
        child = lambda bit: F.first(F.when(F.col(d) == bit, F.col("node")), ignorenulls=True)  # noqa: B023, E731
        placed = placed.groupBy("grp", "n", "block", *digits[:k:-1]).agg(child(0).alias("a"), child(1).alias("b"))
        both = digest(F.col("a.h"), F.coalesce("b.h", F.lit("")))
        kids = F.filter(F.array("a", "b"), lambda c: c.isNotNull())
        placed = placed.withColumn("node", F.struct(F.when(F.col("n") > 1 << k, both).otherwise(F.col("a.h")).alias("h"), kids.alias("kids"))).drop("a", "b")
    return placed


def take_apart(blocks: DataFrame, carry: list[str]) -> DataFrame:
    """Rows of ``roll_up`` with the ``path`` above each to one row a node of the block: ``(grp, h, item, path, *carry)``."""

    def down(k: int):
        def kids_of(e: Column) -> Column:
            kids = e["node"]["kids"]

            def child(kid: Column, i: Column) -> Column:
                step = F.struct(F.when(i == 1, kids[0]["h"]).alias("left"), F.when(i == 0, F.get(kids, F.lit(1))["h"]).alias("right"))
                return F.struct(kid.alias("node"), F.concat(F.when(F.col("n") > 1 << k, F.array(step)).otherwise(F.array()), e["path"]).alias("path"))

            return F.transform(kids, child)

        return kids_of

    start = F.array(F.struct("node", F.col("path")))
    apart = reduce(lambda x, k: F.flatten(F.transform(x, down(k))), range(DIGITS - 1, -1, -1), start)
    rows = blocks.select("grp", F.explode(apart).alias("e"), *carry)
    return rows.select("grp", F.col("e.node.h").alias("h"), F.col("e.node.item").alias("item"), F.col("e.path").alias("path"), *carry)


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Block tables from the leaves up; in the last one every group is one block. ``most``: nodes of the largest group."""
    levels = [cut(roll_up(nodes))]
    while most > 1 << DIGITS:
        most = -(-most >> DIGITS)
        item = F.struct(F.col("block").alias("nr"))
        nodes = levels[-1].select("grp", F.col("block").alias("nr"), F.ceil(F.col("n") / (1 << DIGITS)).alias("n"), F.struct(F.col("node.h").alias("h"), item.alias("item")).alias("node"))
        levels.append(cut(roll_up(nodes)))
    return levels


def leaves_of(levels: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """``grow`` back down: ``tops`` is its last table with a ``path`` above each group."""
    rows = take_apart(tops, carry)
    for blocks in levels[-2::-1]:
        above = rows.select("grp", F.col("item.nr").alias("block"), "path", *carry)
        rows = take_apart(blocks.join(above, ["grp", "block"]), carry)
    return rows


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """``(id, leaf, *carry, subroot, root, path)``, one row per row of ``docs``.

    ``leaf`` is the hash of a row. Leaves stand in order of the id within their group; every two
    neighbours become the hash of both, a last one alone the hash of itself, until one is left, the
    subroot; subroots in bytewise order of the groups likewise give the root. ``path`` lists, from the leaf
    up, what stood left and right of the row's ancestor: one of both, or neither for a last one alone.

    A null group comes first and is a group like any other. Null ids come first within their group; equal ids
    stand in order of their hashes, so repeated rows are leaves of their own and the result does not depend
    on the order of the input. Texts only enter through ``leaf``, whatever their length. An empty table gives an
    empty result. Columns of ``docs`` that are not named do not matter, nor do their names.
    """
    carry = carry or {}
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    item = F.struct(F.col(id_col).alias("id"), *[c.alias(k) for k, c in carry.items()])
    leaves = cut(docs.select(grp.alias("grp"), leaf.alias("h"), item.alias("item")).withColumn("id", F.col("item.id")))
    groups = cut(leaves.groupBy("grp").agg(F.count("*").alias("n")))
    total, most, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()

    placed = numbered(leaves, ["grp", "id", "h"])
    starts = placed.groupBy("grp").agg(F.min("nr").alias("start"), F.count("*").alias("n"))
    ranked = heavy_join(placed, starts, ["grp"], "n", total)
    levels = grow(ranked.select("grp", (F.col("nr") - F.col("start")).alias("nr"), "n", F.struct("h", "item").alias("node")), most)

    top = levels[-1]
    subroots = numbered(top.select("grp", F.col("node.h").alias("h")), ["grp"])
    name = F.struct("h", F.struct("grp").alias("item"))
    over = grow(subroots.select(F.lit("").alias("grp"), "nr", F.lit(n_groups).cast("long").alias("n"), name.alias("node")), n_groups)
    named = leaves_of(over, over[-1].select("*", F.array().cast(f"array<{STEP}>").alias("path"), F.col("node.h").alias("root")), ["root"])
    above = named.select(F.col("item.grp").alias("grp"), "path", "root")
    rows = leaves_of(levels, top.join(above, "grp").withColumn("subroot", F.col("node.h")), ["subroot", "root"])
    return rows.select("item.id", F.col("h").alias("leaf"), *[f"item.{k}" for k in carry], "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """The hashes of a path, from the leaf up."""
    return F.filter(F.transform(path, lambda s: F.coalesce(s["left"], s["right"])), lambda h: h.isNotNull())


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    side = lambda h: F.coalesce(h, F.lit(""))
    return F.aggregate(path, leaf, lambda h, s: digest(side(s["left"]), h, side(s["right"])))
