"""Prefix trie of conversations by collapse of whole sequences.

A turn's prefix is told by its depth and two running XORs of 64-bit hashes of (position, role, text).
Equal conversations become one sequence with a weight and the list of those that
end there. A sequence whose last prefix also lies inside another one is no leaf (an anti-join).
Each sequence gives a row a prefix with its weight; rows of one prefix are a node. Sums over
a node's subtree are sums over the sequences through it:

* leaves: the sequences that are no proper prefix;
* bytes of all members below a node: weight times what a sequence holds from there on;
* bytes of the distinct nodes below: every node belongs to its smallest member, which owns all of its
  own sequence from some depth on; so a sequence adds the lesser of what it holds and what it owns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.batches import few_rows
from voxloom.llm.ranks import heavy_join, numbered
from voxloom.session import cut

#: Ids that go into one text of an end list.
LISTED = 256
KEY = ["depth", "h1", "h2"]
PARENT = ["p_depth", "p_h1", "p_h2"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, t1, t2, bytes)``: turns numbered from 1 in order of ``turn`` (null first), ties by role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    picked = turns.where("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    placed = numbered(picked, ["conv_id", "turn", "role", "text"])
    rows = placed.select("conv_id", "nr", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role", F.lit(1)).alias("t2"), F.octet_length("text").cast("long").alias("bytes"))
    rows = cut(rows)
    starts = rows.groupBy("conv_id").agg(F.min("nr").alias("start"), F.count("*").alias("n"))
    return heavy_join(rows, starts, ["conv_id"], "n", rows.count()).select("conv_id", (F.col("nr") - F.col("start") + 1).alias("pos"), "n", "t1", "t2", "bytes")


def borrow_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """``(conv_id, pos, t1, t2, bytes)`` of conversations that begin with the first ``heads`` turns of another one.

    ``base`` is the id of that one and ``heads`` (at most ``most``) how many turns it lends, both in terms of conv_id;
    its own turns follow, after as many. Position 0 is a row of every conversation.
    """
    turns = cut(turns)
    convs = turns.groupBy("conv_id").agg(F.first("n").alias("n")).select("conv_id", "n", base.alias("base"), heads.cast("long").alias("heads"))
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = cut(convs.join(lent, "base", "left").withColumn("lent", F.least("heads", F.coalesce("n_base", F.lit(0)))))
    head = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(convs.where("base <> conv_id").select("base", "conv_id", "heads"), "base")
    own = heavy_join(turns, convs.select("conv_id", "base", "heads", "lent", F.col("n").alias("n_own")), ["conv_id"], "n_own", turns.count())
    own = own.where("base = conv_id or pos > heads").withColumn("pos", F.when(F.col("base") == F.col("conv_id"), F.col("pos")).otherwise(F.col("pos") - F.col("heads") + F.col("lent")))
    named = ["conv_id", "pos", "t1", "t2", "bytes"]
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("pos"), none.alias("t1"), none.alias("t2"), none.alias("bytes"))
    return head.where("pos <= heads").select(named).unionByName(own.select(named)).unionByName(roots)


def with_prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, h1, h2, p_h1, p_h2, bytes, up_to)``: every prefix with the hashes of it and of its parent, and the bytes up to it.

    Running sums and XORs are taken within ranges of (conv_id, pos); only conversations that lie
    in several ranges, fewer than there are ranges, need what came before.
    """
    at = [F.when(F.col("pos") > 0, F.xxhash64("pos", t)).otherwise(F.lit(0).cast("long")) for t in ("t1", "t2")]
    dealt = cut(turns.select("conv_id", "pos", at[0].alias("a1"), at[1].alias("a2"), "bytes").repartitionByRange("conv_id", "pos").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("*", F.bit_xor("a1").over(w).alias("x1"), F.bit_xor("a2").over(w).alias("x2"), F.sum("bytes").over(w).alias("s"))
    ends = dealt.groupBy("conv_id", "part").agg(F.bit_xor("a1").alias("x1"), F.bit_xor("a2").alias("x2"), F.sum("bytes").alias("s"))
    # a conversation in several ranges is the first or last one of each
    edge = dealt.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z")).select("part", F.explode(F.array_distinct(F.array("a", "z"))).alias("conv_id"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(F.broadcast(edge), ["conv_id", "part"], "left_semi").select(
        "conv_id", "part", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2"), F.sum("s").over(before).alias("c")
    )
    rows = inside.join(F.broadcast(carried.where("c1 is not null")), ["conv_id", "part"], "left")  # at most two rows a range
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    h1, h2 = (F.col(x).bitwiseXOR(zero(F.col(c))) for x, c in (("x1", "c1"), ("x2", "c2")))
    return rows.select(
        "conv_id", F.col("pos").alias("depth"), h1.alias("h1"), h2.alias("h2"), h1.bitwiseXOR(F.col("a1")).alias("p_h1"), h2.bitwiseXOR(F.col("a2")).alias("p_h2"),
        "bytes", (F.col("s") + zero(F.col("c"))).alias("up_to"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, h1, h2, digest)``: SHA-256 of the conv_ids that end at each prefix, ascending, comma-joined.

    Ids are joined in texts of LISTED first, by ranges over tasks; a digest then reads
    its texts in order and holds one at a time, so a list may be of any length.
    """

    def listed(batches):
        key, first, ids, out = None, None, [], []

        def close():
            if ids:
                out.append((*key, first, ",".join(ids)))

        for b in few_rows(batches):
            for d, h1, h2, c in zip(*(col.to_pylist() for col in b.columns)):
                if (d, h1, h2) != key or len(ids) == LISTED:
                    close()
                    key, first, ids = (d, h1, h2), c, []
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=[*KEY, "first", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=[*KEY, "first", "ids"])

    def digested(batches):
        key, state, out = None, None, []
        for b in few_rows(batches):
            for d, h1, h2, _, ids in zip(*(col.to_pylist() for col in b.columns)):
                if (d, h1, h2) == key:
                    state.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, h1, h2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "digest"])
                out.clear()
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "digest"])

    kinds = "depth long, h1 long, h2 long"
    by = [*KEY, "conv_id"]
    lists = ends.select(by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(listed, f"{kinds}, first long, ids string")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, f"{kinds}, digest string")


def trie(prefixes: DataFrame) -> DataFrame:
    """One row a node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_digest)`` of rows by :func:`with_prefixes`."""
    prefixes = cut(prefixes)
    last = F.max_by(F.struct("h1", "h2", "up_to"), "depth")
    ends = cut(prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"), last.alias("e")).select("conv_id", "depth", "e.h1", "e.h2", F.col("e.up_to").alias("whole")))
    sequences = cut(ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("whole").alias("whole")))
    kept = heavy_join(prefixes, sequences.select("conv_id", "weight", "whole", (F.col("depth") + 1).alias("rows_of_key")), ["conv_id"], "rows_of_key", prefixes.count())
    kept = cut(kept.withColumn("rest", F.col("whole") - F.col("up_to") + F.col("bytes")).withColumn("p_depth", F.col("depth") - 1).drop("whole", "up_to", "rows_of_key"))

    nodes = kept.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"), F.first(F.struct(*PARENT)).alias("p"))
    nodes = cut(nodes.select(*KEY, "conv_id", "bytes", "p.*"))
    inside = nodes.where("depth > 0").select(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY)])
    children = cut(inside.groupBy(*KEY).agg(F.count("*").alias("n_children")))
    leaves = sequences.join(children, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"))
    shares = sequences.select("conv_id", (F.col("depth") + 1).alias("rows_of_key")).join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    n_rows = kept.count()
    shared = heavy_join(kept, shares, ["conv_id"], "rows_of_key", n_rows)
    saved = F.col("weight") * F.col("rest") - F.least("rest", F.coalesce("owned", F.lit(0)))
    sums = shared.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.sum(saved).alias("saved"))

    found = nodes.join(sums, KEY).join(children, KEY, "left").join(end_digests(ends), KEY, "left")
    found = cut(found.select(*KEY, *PARENT, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_digest")))
    parents = found.where("n_children > 0").select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows_of_key"))
    below = heavy_join(found.where("depth > 0"), parents, PARENT, "rows_of_key", found.count())
    root = found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(found.schema["conv_id"].dataType))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_digest"]
    return below.select(out).unionByName(root.select(out))


def prefix_trie(turns: DataFrame, base: Column | None = None, heads: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of all conversations of ``turns(conv_id, turn, role, text)``, one row a distinct prefix, the textless root included.

    With ``base`` and ``heads`` every conversation first gets the head of another one, see :func:`borrow_heads`.
    ``saved`` sums, over a node's subtree, the UTF-8 bytes of a node's last text times its members but one:
    what a cache of the prefixes saves. ``conv_id`` is the smallest member.

    Conv_ids are integers. Turns stand in order of ``turn``, nulls first, ties by role and text; a repeated row is one
    more turn. Null roles and texts are empty, texts of any length count whole. Turns without conversation
    are left out. A conversation left without turns is a member of the root alone. An empty table
    has no node. Other columns do not matter, nor do their names.
    """
    rows = ordered_turns(turns.withColumn("conv_id", F.col("conv_id").cast("long")))
    rows = borrow_heads(rows, F.col("conv_id") if base is None else base, F.lit(0) if heads is None else heads, most)
    return trie(with_prefixes(rows))
