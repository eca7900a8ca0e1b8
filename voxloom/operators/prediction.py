"""Prediction post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.modes import argmax, mode_smallest, softmax


def cell_class(samples: DataFrame, key: str = "cell_id", logits: str = "logits") -> DataFrame:
    """The most frequent arg-max class of a cell's samples, ties to the lowest class."""
    return mode_smallest(samples.select(key, argmax(F.col(logits)).alias("c")), [key], "c", "cell_class").drop("cell_class_count")


def merge_class(values: Column, source: int, target: int) -> Column:
    """Adds one class' value to another's and removes it."""
    added = F.transform(values, lambda x, i: F.when(i == target, x + values[source]).otherwise(x))
    return F.concat(F.slice(added, 1, source), F.slice(added, source + 2, F.greatest(F.size(values) - source - 1, F.lit(0))))


def certainty(samples: DataFrame, classes: int, key: str = "cell_id", logits: str = "logits", is_logit: bool = True) -> DataFrame:
    """1 - H / ln C of the mean class probabilities of each key; 0 ln 0 is 0."""
    p = softmax(F.col(logits)) if is_logit else F.col(logits)
    means = samples.select(key, p.alias("p")).groupBy(key).agg(*[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(classes)])
    h = sum(F.when(F.col(f"p{i}") > 0, -F.col(f"p{i}") * F.log(f"p{i}")).otherwise(0.0) for i in range(classes))
    return means.select(key, (1 - h / F.log(F.lit(float(classes)))).alias("certainty"))


def vertex_votes(vertices: DataFrame, votes: DataFrame) -> DataFrame:
    """The most frequent of a vertex' predictions, ties to the lowest, -1 without any."""
    best = mode_smallest(votes, ["vertex_id"], "label", "label").drop("label_count")
    return vertices.join(best, "vertex_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def fuse_labels(coarse: Column, axon: Column, dendrite: Column) -> Column:
    """Seven classes from three: coarse (0 dendrite, 1 axon, 2 soma), axon (0 shaft, 1 en passant, 2 terminal), dendrite (0 shaft, 1 neck, 2 head)."""
    ax = F.when(axon == 1, 3).when(axon == 2, 4).otherwise(1)
    de = F.when(dendrite == 1, 5).when(dendrite == 2, 6).otherwise(0)
    return F.when(coarse == 1, ax).when(coarse == 0, de).otherwise(2)


def to_compartment(fused: Column) -> Column:
    """Compartment code: necks and heads belong to the dendrite."""
    return F.when(fused.isin(5, 6), 0).otherwise(fused)


def to_spine(fused: Column) -> Column:
    """Spine code: 0 neck, 1 head, 2 shaft, 3 other."""
    return F.when(fused == 5, 0).when(fused == 6, 1).when(fused == 0, 2).otherwise(3)


def pixel_votes(vertices: DataFrame, pixels: DataFrame, background: int, unpredicted: int) -> DataFrame:
    """Per vertex the most frequent pixel label that is not background, ties to the lowest."""
    best = mode_smallest(pixels.where(F.col("label") != background), ["vertex_id"], "label", "label").drop("label_count")
    return vertices.join(best, "vertex_id", "left").withColumn("label", F.coalesce("label", F.lit(unpredicted)))


def decode(df: DataFrame, code: str, names: dict[int, str], name: str = "name") -> DataFrame:
    """P10: code to name; a fixed vocabulary, so a CASE."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(code) == k, v).otherwise(out)
    return df.withColumn(name, out)


def encode(df: DataFrame, name: str, names: dict[int, str], code: str = "code") -> DataFrame:
    """P10: name to code, -1 for unknown names."""
    out = F.lit(-1)
    for k, v in names.items():
        out = F.when(F.col(name) == v, k).otherwise(out)
    return df.withColumn(code, out)


def performance(pairs: DataFrame, truth: str = "truth", predicted: str = "label") -> DataFrame:
    """Per class precision, recall, F score (0 where undefined) and the overall accuracy. One pass over the rows."""
    confusion = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = F.explode(
        F.array(
            F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
        )
    ).alias("r")
    hit = F.when((F.col("t") == F.col("p")) & (F.col("r.support") > 0), F.col("n")).otherwise(0)
    by = confusion.select("t", "p", "n", each).groupBy(F.col("r.c").alias("class")).agg(F.sum("r.support").alias("support"), F.sum("r.called").alias("called"), F.sum(hit).alias("hits"))
    total = confusion.agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = by.withColumns({"precision": ratio(F.col("hits"), F.col("called")), "recall": ratio(F.col("hits"), F.col("support"))})
    f = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("fscore", f).crossJoin(F.broadcast(total)).select("class", "support", "precision", "recall", "fscore", "accuracy")


def fixed_subsets(samples: DataFrame, size: int, seed: int, key: str = "cell_id", sample: str = "sample_id") -> DataFrame:
    """``(key, subset, place, sample)``: each key's samples in hash order, in subsets of ``size``.

    A remainder is dropped unless it is all there is; then samples from the first on fill it.
    """
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.col(sample), F.lit(seed)), sample)
    ranked = samples.select(key, sample).withColumn("rn", F.row_number().over(w) - 1)
    n = samples.groupBy(key).agg(F.count("*").alias("n"))
    joined = ranked.join(n, key)
    full = joined.where("n >= {0} and rn < n - n % {0}".format(size)).select(key, F.floor(F.col("rn") / size).cast("int").alias("subset"), (F.col("rn") % size).alias("place"), sample)
    few = joined.where(f"n < {size}").select(key, "rn", "n", sample)
    padded = few.select(key, F.lit(0).alias("subset"), F.explode(F.sequence(F.col("rn"), F.lit(size - 1), F.col("n").cast("int"))).alias("place"), sample)
    return full.unionByName(padded)


def whitened_pca(vectors: DataFrame, k: int, column: str = "v") -> DataFrame:
    """``k`` principal components, centred, each scaled to unit variance; signs make the largest loading positive."""
    import numpy as np
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    mean = rows.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    pc = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), range(k)])
    x = vector_to_array(F.col("_v"))
    proj = [sum(((x[i] - float(mean[i])) * float(pc[i, j]) for i in range(len(mean))), F.lit(0.0)) for j in range(k)]
    made = rows.select("*", *[p.alias(f"_c{j}") for j, p in enumerate(proj)])
    sd = made.agg(*[F.stddev_samp(f"_c{j}").alias(f"_s{j}") for j in range(k)])
    return made.crossJoin(F.broadcast(sd)).select(*vectors.columns, F.array(*[F.col(f"_c{j}") / F.when(F.col(f"_s{j}") > 0, F.col(f"_s{j}")).otherwise(1.0) for j in range(k)]).alias("pca"))


#: Vectors in a block (in expectation).
BLOCK = 2048


def knn_classify(queries: DataFrame, train: DataFrame, k: int, dims: int) -> DataFrame:
    """Majority class of the ``k`` nearest training vectors, ties to the lowest class.

    Training vectors and queries are dealt into blocks of BLOCK rows; each pair of blocks
    keeps the ``k`` best of every query, and a window merges the blocks. Distances are
    sums over the places of a vector in order; they are made of those alone that matrix products do not tell to be farther.
    """
    import numpy as np
    import pandas as pd

    n, m = (max(1, -(-t.count() // BLOCK)) for t in (train, queries))
    blocks = train.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(m)).alias("qb")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(blocks, "block")

    def run(frames):
        for f in frames:
            for asked_, rows in zip(f["asked"], f["rows"]):
                q = np.stack([np.asarray(r["v"], float)[:dims] for r in asked_])
                t = np.stack([np.asarray(r["v"], float)[:dims] for r in rows])
                ids, labels = np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows])
                order = np.argsort(ids, kind="stable")
                t, ids, labels, most, out = t[order], ids[order], labels[order], min(k, len(order)), []
                # products tell what is surely farther than the k nearest; exact sums are made of what is left
                q2, t2 = (q * q).sum(1), (t * t).sum(1)
                slack = 1e-9 * (q2 + t2.max() + 1)
                for a in range(0, len(q), 64):
                    some = slice(a, a + 64)
                    rough = q2[some, None] + t2[None] - 2 * (q[some] @ t.T)
                    far = np.partition(rough, most - 1, axis=1)[:, most - 1] + slack[some]
                    at, to = np.nonzero(~(rough > far[:, None]))  # not a number is kept too
                    d = np.zeros(len(at))
                    for j in range(q.shape[1]):
                        d += (q[some][at, j] - t[to, j]) ** 2
                    order = np.lexsort((to, d, at))
                    first = np.searchsorted(at, np.arange(len(q[some])))
                    kept = order[np.arange(len(order)) - first[at] < most]
                    name = np.array([r["query_id"] for r in asked_[some]])[at[kept]]
                    out.append(pd.DataFrame({"query_id": name, "id": ids[to[kept]], "label": labels[to[kept]], "dist": d[kept]}))
                yield pd.concat(out)

    near = pairs.select("asked", "rows").mapInPandas(run, "query_id long, id long, label int, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    best = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return mode_smallest(best, ["query_id"], "label", "label").drop("label_count")


def apply_model(samples: DataFrame, load, columns: list[str], schema: str) -> DataFrame:
    """A user's model over rows: ``load()`` runs once a task and returns a function of a pandas frame."""

    def run(frames):
        model = load()
        for f in frames:
            yield model(f)

    return samples.select(*columns).mapInPandas(run, schema)
