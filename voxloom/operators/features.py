"""Neuron features from oriented synapses, skeletons and organelles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut

AXON_LIKE = [1, 3, 4]
COMPARTMENT = {"axon": 1, "dendrite": 0, "soma": 2}


def orient(syn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oriented rows ``pre .. post``, and the numbers of rejected rows by the first reason that holds.

    A row counts if no code is -1, one side is axon-like and the other dendrite
    or soma, the size is finite and not 0, and the post spine code is known.
    """
    fwd = F.col("ax_1").isin(AXON_LIKE) & F.col("ax_2").isin(0, 2)
    rev = F.col("ax_2").isin(AXON_LIKE) & F.col("ax_1").isin(0, 2)
    pick = lambda a, b: F.when(fwd, F.col(a)).otherwise(F.col(b))
    post_sp = pick("sp_2", "sp_1")
    size_ok = F.col("size").isNotNull() & ~F.isnan("size") & (F.abs("size") != float("inf")) & (F.col("size") != 0)
    reason = (
        F.when((F.col("ax_1") == -1) | (F.col("ax_2") == -1), "unknown_compartment").when(~fwd & ~rev, "not_axodendritic").when(~size_ok, "size").when(post_sp == -1, "unknown_spine")
    )
    marked = syn.withColumns(
        {"reason": reason, "pre": pick("cell_1", "cell_2"), "post": pick("cell_2", "cell_1"), "pre_morph": pick("ax_1", "ax_2"), "post_comp": pick("ax_2", "ax_1"), "post_morph": post_sp}
    )
    kept = marked.where("reason is null").select("syn_id", "pre", "post", "pre_morph", "post_comp", "post_morph", "size", "latent_id")
    return kept, marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def sides(oriented: DataFrame) -> DataFrame:
    """One row per synapse and cell: axon side for pre, dendrite or soma side for post."""
    pre = F.struct(F.col("pre").alias("cell"), F.lit("axon").alias("comp"), F.col("post").alias("partner"))
    post = F.struct(F.col("post").alias("cell"), F.when(F.col("post_comp") == 2, "soma").otherwise("dendrite").alias("comp"), F.col("pre").alias("partner"))
    return oriented.select("*", F.explode(F.array(pre, post)).alias("s")).select(*oriented.columns, "s.*")


def analysis_set(oriented: DataFrame, dendritic: int = 50, axonic: int = 50) -> DataFrame:
    """Cells with more than ``dendritic`` synapses on dendrites or at least ``axonic`` on the axon."""
    n = sides(oriented).groupBy("cell").agg(F.count_if(F.col("comp") == "dendrite").alias("d"), F.count_if(F.col("comp") == "axon").alias("a"))
    return n.where((F.col("d") > dendritic) | (F.col("a") >= axonic)).select("cell")


def compartment_paths(weighted: DataFrame) -> DataFrame:
    """Path length per compartment; an edge belongs to its first node's label, boutons apart."""
    comp = F.when(F.col("axoness_a") == 0, "dendrite").when(F.col("axoness_a") == 1, "axon").when(F.col("axoness_a") == 2, "soma")
    return weighted.select("cell_id", comp.alias("comp"), "length").where("comp is not null").groupBy("cell_id", "comp").agg(F.sum("length").alias("path"))


def compartment_stats(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """Objects per cell and compartment: number, mean and median size, number and volume per path (0 without path)."""
    agg = objects.groupBy("cell_id", "comp", "obj_type").agg(
        F.count("*").alias("n"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.sum("size").alias("total")
    )
    joined = agg.join(paths, ["cell_id", "comp"], "left")
    per = lambda c: F.when(F.col("path") > 0, F.col(c) / F.col("path")).otherwise(0.0)
    return joined.select("cell_id", "comp", "obj_type", "n", "mean_size", "median_size", per("n").alias("n_density"), per("total").alias("volume_density"))


def fraction_asymmetric(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positive size over all absolute size; null without any."""
    plus, minus = F.sum(F.when(F.col("size") > 0, F.col("size")).otherwise(0.0)), F.sum(F.when(F.col("size") < 0, -F.col("size")).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.when(plus + minus > 0, plus / (plus + minus)).alias("fraction_asym"))


def head_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute size on spine heads over all absolute size."""
    return rows.groupBy(*keys).agg((F.sum(F.when(F.col("post_morph") == 1, F.abs("size")).otherwise(0.0)) / F.sum(F.abs("size"))).alias("head_ratio"))


def branch_density(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of degree 2 and more per path length."""
    degree = edges.select("cell_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("cell_id", "node").agg(F.count("*").alias("d"))
    n = degree.groupBy("cell_id").agg(F.count_if(F.col("d") >= 2).alias("n"))
    return lengths.join(n, "cell_id", "left").select("cell_id", F.when(F.col("length") > 0, F.coalesce("n", F.lit(0)) / F.col("length")).otherwise(0.0).alias("branch_density"))


def radius_shares(nodes: DataFrame, comp: int, low: float, high: float) -> DataFrame:
    """Shares of a compartment's nodes that are thin, in between and thick."""
    d = F.col("diameter")
    share = lambda c: F.avg(c.cast("double"))
    return nodes.where(F.col("axoness") == comp).groupBy("cell_id").agg(
        share(d < low).alias("thin"), share((d >= low) & (d < high)).alias("middle"), share(d >= high).alias("thick")
    )


def partner_means(oriented: DataFrame) -> DataFrame:
    """Means of partner fraction times absolute size: axons over their targets' dendrites, dendrites over their inputs' axons."""
    s = sides(oriented)
    own = fraction_asymmetric(s, ["cell", "comp"])
    side = s.where(F.col("comp").isin("axon", "dendrite")).withColumn("partner_comp", F.when(F.col("comp") == "axon", "dendrite").otherwise("axon"))
    partner = own.select(F.col("cell").alias("partner"), F.col("comp").alias("partner_comp"), F.col("fraction_asym").alias("f"))
    joined = side.join(partner, ["partner", "partner_comp"], "left")
    return joined.groupBy("cell", "comp").agg(F.avg(F.coalesce("f", F.lit(0.0)) * F.abs("size")).alias("partner_mean"))


def terminal_share(oriented: DataFrame) -> DataFrame:
    """Terminal boutons' share of the bouton area of a cell's axon; 0 without boutons."""
    area = lambda k: F.sum(F.when(F.col("pre_morph") == k, F.abs("size")).otherwise(0.0))
    return oriented.groupBy(F.col("pre").alias("cell")).agg(F.when(area(3) + area(4) > 0, area(4) / (area(3) + area(4))).otherwise(0.0).alias("terminal_share"))


def size_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, mean, median, spread and sum of absolute synapse sizes."""
    a = F.abs("size")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_syn"), F.avg(a).alias("mean_size"), F.percentile(a, 0.5).alias("median_size"), F.stddev_pop(a).alias("std_size"), F.sum(a).alias("sum_size")
    )


def mean_latent(rows: DataFrame, latents: DataFrame, key: str, dims: int = 10) -> DataFrame:
    """Mean of the synapses' embeddings per cell, element by element."""
    joined = rows.join(latents.select("latent_id", "latent"), "latent_id")
    return joined.groupBy(key).agg(F.array(*[F.avg(F.col("latent")[i].cast("double")) for i in range(dims)]).alias("latent"))


def feature_vectors(stats: DataFrame, parts: list[DataFrame], key: str, n_syn: str, more_than: int, names: list[str]) -> DataFrame:
    """One array per cell of the named columns; zeros where the cell has too few synapses or a value is missing."""
    out = stats
    for p in parts:
        out = out.join(p, key, "left")
    value = lambda c: F.when(F.col(n_syn) > more_than, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)
    return out.select(key, F.array(*[value(c) for c in names]).alias("features"))


def standardise(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by mean and spread of their non-zero entries; zeros stay, spread 0 counts as 1.

    Columns with NaN or null, or with a zero sum, go; columns with infinities stay as they are.
    """
    seen = table.agg(
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}__bad") for c in columns],
        *[F.count_if(F.abs(c) == float("inf")).alias(f"{c}__inf") for c in columns],
        *[F.sum(c).alias(f"{c}__sum") for c in columns],
        *[F.avg(F.when(F.col(c) != 0, F.col(c))).alias(f"{c}__m") for c in columns],
        *[F.stddev_pop(F.when(F.col(c) != 0, F.col(c))).alias(f"{c}__s") for c in columns],
    ).first()
    out = [c for c in table.columns if c not in columns]
    for c in columns:
        if seen[f"{c}__bad"] or seen[f"{c}__sum"] in (0, None):
            continue
        if seen[f"{c}__inf"]:
            out.append(F.col(c))
            continue
        m, s = seen[f"{c}__m"], seen[f"{c}__s"]
        s = s if s and not math.isnan(s) else 1.0
        out.append(F.when(F.col(c) != 0, (F.col(c) - m) / s).otherwise(0.0).alias(c))
    return table.select(*out)


#: Cells of a block of the pairs of a set, at most (in expectation).
PAIR_BLOCK = 4000


def pair_blocks(cells: int, most: int, tasks: int) -> int:
    """Blocks of a set of cells: of ``most`` cells, or as many more as give each of ``tasks`` some pairs of blocks of at least 64 cells."""
    return max(-(-cells // most), min(math.isqrt(32 * tasks), -(-cells // 64)), 1)


def pairwise_distance(vectors: DataFrame, parts: list[str], key: str = "cell") -> DataFrame:
    """Mean of the parts' Euclidean distances that are above 0, parts that are all zero on a side left out; 1000 if none.

    The result has a row for each pair of the stated set of cells. Each pair of blocks of cells is joined once, by as many tasks as
    the session has partitions, and the pairs are neither shuffled nor held. The parts' elements are columns, so that a pair is plain arithmetic.
    """
    vectors = cut(vectors.where(F.col(key).isNotNull()).select(key, *parts))  # counted and joined
    seen = vectors.agg(F.count("*"), *[f(F.when(F.col(p).isNotNull(), F.size(p))) for f in (F.max, F.min) for p in parts]).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, wide, least = pair_blocks(seen[0], PAIR_BLOCK, tasks), [w or 0 for w in seen[1 : len(parts) + 1]], [w or 0 for w in seen[len(parts) + 1 :]]
    own = F.pmod(F.xxhash64(key), F.lit(n))
    some = lambda p: F.coalesce(F.exists(p, lambda x: x != 0), F.lit(False))

    def side(s: str, i: Column, j: Column) -> DataFrame:
        values = [F.get(p, F.lit(k)).cast("double").alias(f"{p}_{k}_{s}") for p, w in zip(parts, wide) for k in range(w)]
        sizes = [F.size(p).alias(f"{p}_size_{s}") for p, w, m in zip(parts, wide, least) if m < w]
        flat = vectors.select(F.col(key).alias(s), *sizes, *[some(p).alias(f"{p}_{s}") for p in parts], *values, own.alias("own"))
        return flat.withColumn("i", i).withColumn("j", j).drop("own").repartition(tasks, "i", "j")

    each = lambda low, high: F.explode(F.sequence(low, high))
    left = side("p", F.col("own"), each(F.col("own"), F.lit(n - 1).cast("long")))
    right = side("q", each(F.lit(0).cast("long"), F.col("own")), F.col("own"))
    pairs = left.join(right.hint("merge"), ["i", "j"]).where("i < j or p < q")

    def apart(p: str, w: int, least: int) -> Column:
        ended = lambda k: (F.col(f"{p}_size_p") <= k) & (F.col(f"{p}_size_q") <= k)
        squares = [(F.col(f"{p}_{k}_p") - F.col(f"{p}_{k}_q")) * (F.col(f"{p}_{k}_p") - F.col(f"{p}_{k}_q")) for k in range(w)]
        squares = [x if k < least else F.when(ended(k), 0.0).otherwise(x) for k, x in enumerate(squares)]
        return F.when(F.col(f"{p}_p") & F.col(f"{p}_q"), F.sqrt(sum(squares, F.lit(0.0))))

    dists = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *[apart(p, *w).alias(p) for p, *w in zip(parts, wide, least)])
    good = [F.col(p) > 0 for p in parts]
    total = sum((F.when(g, F.col(p)).otherwise(0.0) for g, p in zip(good, parts)), F.lit(0.0))
    number = sum((F.when(g, 1).otherwise(0) for g in good), F.lit(0))
    return dists.select("a", "b", F.when(number > 0, total / number).otherwise(1000.0).alias("dist"))


def combined_distance(vectors: DataFrame, parts: list[str], matrix: DataFrame) -> DataFrame:
    """Feature distance plus wiring distance of each pair of cells. Both are made where the pair is, so that no pair is joined or moved."""
    from voxloom.operators.wiring import pair_distances

    return pair_distances(matrix, vectors, parts=parts)
