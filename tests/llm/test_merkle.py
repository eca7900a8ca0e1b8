"""The Merkle manifest against plain trees."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root and, for each leaf, its path of (left, right)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            pair = i ^ 1
            paths[leaf].append((level[pair] if pair < i else None, level[pair] if i < pair < len(level) else None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    """rows: (id, group, hash); a list of (id, hash, subroot, root, path)."""
    groups = collections.defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    return [
        (i if known else None, leaf, trees[g][0], root, tuple(path + above[k]))
        for k, g in enumerate(names)
        for (known, i, leaf), path in zip(sorted(groups[g]), trees[g][1])
    ]


def order(rows):
    return sorted(rows, key=repr)


def found(spark, rows, **kinds):
    docs = spark.createDataFrame([(i, g, x, "n") for i, g, x in rows], "doc_id long, lang string, h string, item string")
    return [(r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in merkle.manifest(docs.repartition(5), F.col("h"), **kinds).collect()]


@pytest.mark.parametrize("digits", [8, 2, 1])
def test_all_shapes(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    sizes = {None: 3, "": 1, "a": 2, "b": 33 if digits < 8 else 300, "é": 5, "z": 16, "Z": 17} if digits < 8 else {None: 3, "a": 1, "b": 517, "é": 257, "z": 256}
    rnd = random.Random(2)
    rows = [(rnd.randrange(10**6), g, h(str(rnd.random()))) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "a", h("null id")), (5, "b", h("x")), (5, "b", h("x")), (5, "b", h("y"))]  # null id, repeated rows, ties
    assert order(found(spark, rows)) == order(plain_manifest(rows))


def test_one_row_and_none(spark):
    assert found(spark, [(1, None, h("only"))]) == [(1, h("only"), h("only"), h("only"), ())]
    assert found(spark, []) == []


def test_many_groups(spark):
    rows = [(i, f"g{i % 700}", h(str(i))) for i in range(1500)]
    assert order(found(spark, rows)) == order(plain_manifest(rows))


def test_fold_and_fields(spark):
    rows = [(i, "ab"[i % 2], h(str(i))) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, h string")
    out = merkle.manifest(docs, F.col("h"), carry={"path_of_row": F.col("doc_id") + 1})
    assert "path_of_row" in out.columns
    good = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.lit(h("no")), F.col("path")) == F.col("root")).alias("bad"))
    assert [tuple(r) for r in good.distinct().collect()] == [(True, False)]
    one = spark.createDataFrame([("é", None, 12)], "a string, b string, c long")
    assert one.select(merkle.digest(*[merkle.field(F.col(c)) for c in "abc"])).first()[0] == h("2:é", "-", "2:12")


def test_plan_sorts_and_shuffles_once_a_block(spark):
    i = F.col("id")
    node = F.struct(i.cast("string").alias("h"), F.struct("id").alias("item")).alias("node")
    nodes = spark.range(2000).select((i % 3).cast("string").alias("grp"), i.alias("nr"), (i % 3 + 2000).alias("n"), node)
    plan = merkle.roll_up(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("- Sort [") == 1
