"""Connectivity analytics on the synapse table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.features import pair_blocks
from voxloom.session import cut, running_total


def fold_boutons(c: str) -> Column:
    """Boutons (3, 4) are axon (1)."""
    return F.when(F.col(c).isin(3, 4), 1).otherwise(F.col(c))


def export_table(syn: DataFrame, threshold: float) -> DataFrame:
    """Synapses above the threshold with a signed size, two columns per partner property."""
    return syn.where(F.col("syn_prob") > threshold).withColumn("size", F.col("mesh_area") / 2 * F.col("syn_sign")).drop("mesh_area", "syn_sign")


def filtered_synapses(syn: DataFrame, threshold: float, axodendritic: bool) -> DataFrame:
    """Synapses from the threshold on, boutons folded; optionally those whose codes add up to 1."""
    kept = syn.where(F.col("syn_prob") >= threshold).withColumns({"ax_1": fold_boutons("ax_1"), "ax_2": fold_boutons("ax_2"), "size": F.col("mesh_area") / 2})
    return kept.where(F.col("ax_1") + F.col("ax_2") == 1) if axodendritic else kept


def directed(syn: DataFrame) -> DataFrame:
    """The partner coded 1 is pre. Of rows where both are, the first is pre."""
    first = F.col("ax_1") == 1
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return syn.withColumns(
        {"pre": pick("cell_1", "cell_2"), "post": pick("cell_2", "cell_1"), "pre_type": pick("ct_1", "ct_2"), "post_type": pick("ct_2", "ct_1")}
    )


def wiring_graph(syn: DataFrame) -> DataFrame:
    """One edge for each directed pair of cells."""
    return directed(syn).select("pre", "post").distinct()


def wiring_matrix(syn: DataFrame) -> DataFrame:
    """``(pre, post, types, weight)``, the summed area with the sign of the larger of both signs' sums.

    Rows and columns have their places in the order of (type, id).
    """
    d = directed(syn)
    inhibitory = F.sum(F.when(F.col("syn_sign") < 0, F.col("size")).otherwise(0.0))
    total = F.sum("size")
    return d.groupBy("pre", "post", "pre_type", "post_type").agg(
        F.when(inhibitory > total - inhibitory, -total).otherwise(total).alias("weight"), F.count("*").alias("n")
    )


def matrix_places(matrix: DataFrame, side: str) -> DataFrame:
    """Row or column places of a wiring matrix: cells by type and id. One row per cell, not per synapse."""
    cells = matrix.select(F.col(side).alias("cell"), F.col(f"{side}_type").alias("cell_type")).distinct()
    return running_total(cells, ["cell_type", "cell"], F.lit(1), "place")


def type_blocks(matrix: DataFrame, least: float) -> DataFrame:
    """Per pair of types the blocks' summed weight over the number of cell pairs; below ``least`` it is 0."""
    pre = matrix.select("pre", "pre_type").distinct().groupBy("pre_type").agg(F.count("*").alias("n_pre"))
    post = matrix.select("post", "post_type").distinct().groupBy("post_type").agg(F.count("*").alias("n_post"))
    negative = F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0))
    area = F.sum(F.abs("weight"))
    sums = matrix.groupBy("pre_type", "post_type").agg(F.when(negative > area - negative, -area).otherwise(area).alias("total"))
    density = F.col("total") / (F.col("n_pre") * F.col("n_post"))
    joined = sums.join(pre, "pre_type").join(post, "post_type")
    return joined.select("pre_type", "post_type", F.when(F.abs(density) < least, 0.0).otherwise(density).alias("density"))


def type_sums(syn: DataFrame, threshold: float, area: tuple[float, float]) -> DataFrame:
    """Incoming and outgoing area and count per pair of types; 3, 4 become 1 and 5, 6 become 0."""
    fold = lambda c: F.when(F.col(c).isin(3, 4), 1).when(F.col(c).isin(5, 6), 0).otherwise(F.col(c))
    kept = syn.where((F.col("syn_prob") >= threshold) & F.col("mesh_area").between(*area)).withColumns({"ax_1": fold("ax_1"), "ax_2": fold("ax_2")})
    d = directed(kept.where(F.col("ax_1") + F.col("ax_2") == 1))
    both = F.explode(
        F.array(
            F.struct(F.lit("out").alias("direction"), F.col("pre_type").alias("cell_type"), F.col("post_type").alias("partner_type")),
            F.struct(F.lit("in").alias("direction"), F.col("post_type").alias("cell_type"), F.col("pre_type").alias("partner_type")),
        )
    ).alias("r")
    return d.select("mesh_area", both).groupBy("r.direction", "r.cell_type", "r.partner_type").agg(F.sum("mesh_area").alias("area"), F.count("*").alias("n"))


def top_partners(sums: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent partner types, ties to the smaller type."""
    w = Window.partitionBy("direction", "cell_type").orderBy(F.desc("n"), "partner_type")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def partners(syn: DataFrame) -> DataFrame:
    """M5: one row for each synapse and side: the cell and what its partner is."""
    side = lambda a, b: F.struct(
        F.lit(int(a)).alias("side"), F.col(f"cell_{a}").alias("cell"), F.col(f"ct_{a}").alias("cell_type"), F.col(f"ax_{a}").alias("ax"),
        F.col(f"cell_{b}").alias("partner"), F.col(f"ax_{b}").alias("partner_ax"), F.col(f"ct_{b}").alias("partner_type"),
    )
    return syn.select("*", F.explode(F.array(side("1", "2"), side("2", "1"))).alias("p")).select(*syn.columns, "p.*")


def synapses_per_cell(syn: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Synapses of each cell of a list, 0 where there is none."""
    counts = partners(syn.where(F.col("syn_prob") >= threshold)).groupBy("cell").agg(F.count("*").alias("n"))
    return cells.join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sign_ratio(syn: DataFrame, comps: list[int], partner_comps: list[int], weighted: bool) -> DataFrame:
    """Share of symmetric synapses per cell by own and partner compartment; -1 where there is none."""
    size = F.col("mesh_area") if weighted else F.lit(1.0)
    inside = F.col("ax").isin(comps) & F.col("partner_ax").isin(partner_comps)
    both = partners(syn)
    total = F.sum(F.when(inside, size))
    symmetric = F.sum(F.when(inside & (F.col("syn_sign") == -1), size))
    return both.groupBy("cell").agg(F.when(total > 0, F.coalesce(symmetric, F.lit(0.0)) / total).otherwise(-1.0).alias("ratio"))


def sign_ratio_of(rows: DataFrame, comps: list[int]) -> DataFrame:
    """Share of symmetric area per ``cell`` among rows whose ``own`` compartment is in ``comps``; -1 where there is none."""
    inside = F.col("own").isin(comps)
    total = F.sum(F.when(inside, F.col("mesh_area")))
    symmetric = F.sum(F.when(inside & (F.col("syn_sign") == -1), F.col("mesh_area")))
    return rows.groupBy("cell").agg(F.when(total > 0, F.coalesce(symmetric, F.lit(0.0)) / total).otherwise(-1.0).alias("ratio"))


def by_sign(syn: DataFrame) -> DataFrame:
    """X11: synapses of each cell by sign."""
    return partners(syn).groupBy("cell", "syn_sign").agg(F.count("*").alias("n"), F.sum("mesh_area").alias("area"))


def of_cell(syn: DataFrame, cell: int) -> DataFrame:
    """Synapses of one cell, on either side."""
    return syn.where((F.col("cell_1") == cell) | (F.col("cell_2") == cell))


def dense_matrix(syn: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """Summed absolute size of synapses above ``least`` between cells of a set, long format."""
    d = directed(syn).where(F.abs("size") > least)
    ids = cells.select("cell").distinct()
    inside = d.join(ids.withColumnRenamed("cell", "pre"), "pre", "left_semi").join(ids.withColumnRenamed("cell", "post"), "post", "left_semi")
    return inside.groupBy("pre", "post").agg(F.sum(F.abs("size")).alias("size"))


#: Cells in a block of the pairs of a set (in expectation).
PAIR_BLOCK = 1000
#: Distances of the parts of cells that a task works on at a time.
STRIPE = 200_000


def wiring_distance(matrix: DataFrame, cells: DataFrame, compat: bool = False) -> DataFrame:
    """Per pair of cells (1 - IoU of inputs) + (1 - IoU of outputs); a term without any partner is 1.

    The result has a row for each pair of the given set of cells. With ``compat`` the second
    term counts inputs and outputs together, as if the counters ran on.
    """
    return pair_distances(matrix, cells.select("cell").distinct(), compat)


def pair_distances(matrix: DataFrame, cells: DataFrame, compat: bool = False, parts: list[str] | None = None) -> DataFrame:
    """:func:`wiring_distance` for each pair of rows of ``cells``; with ``parts`` (arrays of numbers) their distance (N18) is added to it.

    Common partners come from a join on the partner. Pairs are made by pairs of blocks of cells, in the task that gets the blocks' counts and
    parts and their pairs with common partners. So the rest of the pairs is never shuffled or held, and a task holds those of two blocks.
    """
    parts = parts or []
    cells = cut(cells.where("cell is not null").select("cell", *parts))
    matrix = cut(matrix.select("pre", "post").distinct())  # read by either side's counts and common partners
    ids = cells.select("cell").distinct()
    tasks = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = pair_blocks(cells.count(), PAIR_BLOCK, tasks)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n))

    def partners_of(own: str, partner: str) -> DataFrame:
        return matrix.select(F.col(own).alias("cell"), F.col(partner).alias("partner")).join(ids.hint("merge"), "cell", "left_semi")

    # rows of a pair of blocks (i, j): kind 0 and 1 are the cells of i and j with their counts and parts, 2 and 3 pairs with common inputs and outputs
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(ids.schema["cell"].dataType)
    sides = {"in": partners_of("post", "pre"), "out": partners_of("pre", "post")}
    counted = cells
    for name, e in sides.items():
        counted = counted.join(e.groupBy("cell").agg(F.count("*").alias(name)).hint("merge"), "cell", "left")
    counts = [F.coalesce(name, zero).alias(c) for name, c in zip(sides, ("n", "m"))]
    # parts that are all zero or not all known have no distance; they are empty, not null, since Arrow's writer looks through all nulls before a row to size a batch
    blank = F.array().cast("array<double>")
    known = [F.when(F.coalesce(F.exists(p, lambda x: x != 0), F.lit(False)) & ~F.exists(p, lambda x: x.isNull()), F.col(p).cast("array<double>")).otherwise(blank).alias(p) for p in parts]
    each = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long") if isinstance(a, int) else a, F.lit(b).cast("long") if isinstance(b, int) else b))
    own = counted.select(F.col("cell").alias("a"), none.alias("b"), *counts, *known, block("cell").alias("own"))
    rows = own.select(F.col("own").alias("i"), each(F.col("own"), n - 1).alias("j"), F.lit(0).alias("kind"), "a", "b", "n", "m", *parts)
    rows = rows.unionByName(own.select(each(0, F.col("own")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("kind"), "a", "b", "n", "m", *parts))
    for kind, e in enumerate(sides.values(), 2):
        common = e.toDF("a", "partner").join(e.toDF("b", "partner").hint("merge"), "partner").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
        turned = block("a") > block("b")
        ends = [F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))]
        rows = rows.unionByName(common.select(block(ends[0]).alias("i"), block(ends[1]).alias("j"), F.lit(kind).alias("kind"), ends[0].alias("a"), ends[1].alias("b"), "n", zero.alias("m"), *[blank.alias(p) for p in parts]))

    def apart(group: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """N18 of the cells in the rows ``left`` and ``right``."""
        total, number = np.zeros((2, len(left), len(right)))
        for p in parts:
            column = group.column(p).combine_chunks()
            flat, start, size = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.value_lengths().to_numpy()
            for w in np.unique(size[left][size[left] > 0]):
                one, two = np.flatnonzero(size[left] == w), np.flatnonzero(size[right] == w)
                if not len(two):
                    continue
                at = [flat[start[rows][:, None] + np.arange(w)] for rows in (left[one], right[two])]
                for s in range(0, len(one), step := max(1, STRIPE // len(two))):
                    d = np.zeros((len(one[s : s + step]), len(two)))
                    for k in range(w):
                        by = at[0][s : s + step, k, None] - at[1][None, :, k]
                        by *= by
                        d += by
                    d = np.sqrt(d, out=d)
                    good = ~(d <= 0)
                    to = np.ix_(one[s : s + step], two)
                    total[to] += np.where(good, d, 0.0)
                    number[to] += good
        return np.divide(total, number, out=np.full(total.shape, 1000.0), where=number > 0)

    def run(group: pa.Table) -> pa.Table:
        kind, left, right, n, m = (group.column(c).to_numpy() for c in ("kind", "a", "b", "n", "m"))
        rows = [at[np.argsort(left[at], kind="stable")] for at in (np.flatnonzero(kind == k) for k in (0, 1))]
        one, two = (left[at] for at in rows)
        shared = np.zeros((2, len(one), len(two)), np.int32)
        for k in (2, 3):
            if (at := np.flatnonzero(kind == k)).size:
                places = []
                for cells, wanted in ((one, left[at]), (two, right[at].astype(two.dtype))):  # a cell may have several rows
                    first, last = np.searchsorted(cells, wanted), np.searchsorted(cells, wanted, side="right")
                    places.append((first, last - first))
                (r, many), (c, more) = places
                if (many == 1).all() and (more == 1).all():
                    shared[k - 2, r, c] = n[at]
                else:
                    for x, y, z, w, v in zip(r, many, c, more, n[at]):
                        shared[k - 2, x : x + y, z : z + w] = v
        wired = np.full(shared.shape[1:], 2.0)  # pairs without a common partner
        r, c = np.nonzero(shared[0] | shared[1])
        terms = []
        for k, count in enumerate((n, m)):
            both = shared[k, r, c].astype(np.int64)
            terms.append((both, count[rows[0]][r] + count[rows[1]][c] - both))
        if compat:
            terms[1] = (terms[0][0] + terms[1][0], terms[0][1] + terms[1][1])
        wired[r, c] = sum(np.where(u > 0, 1 - c / np.maximum(u, 1), 1.0) for c, u in terms)
        dist = apart(group, *rows) + wired if parts else wired
        low, high = np.minimum(one[:, None], two[None, :]), np.maximum(one[:, None], two[None, :])
        if group.column("i")[0] == group.column("j")[0]:  # a block with itself has each pair twice and every cell with itself
            kept = one[:, None] < two[None, :]
            return pa.table({"a": low[kept], "b": high[kept], "dist": dist[kept]})
        return pa.table({"a": low.ravel(), "b": high.ravel(), "dist": dist.ravel()})

    kind = ids.schema["cell"].dataType.simpleString()
    return rows.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, dist double")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new version of ``table`` with the non-null values of ``changes`` put in, new keys added."""
    cols = [c for c in dict.fromkeys([*table.columns, *changes.columns]) if c != key]
    t, u = table.alias("t"), changes.alias("u")
    has = lambda d, a, c: F.col(f"{a}.{c}") if c in d.columns else F.lit(None)
    joined = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    return joined.select(F.coalesce(f"t.{key}", f"u.{key}").alias(key), *[F.coalesce(has(changes, "u", c), has(table, "t", c)).alias(c) for c in cols])
