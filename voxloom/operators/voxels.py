"""Voxel operators on ``voxels(x, y, z, <label columns>)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def box_aggregates(prefix: str = "") -> list[Column]:
    """Half-open box of the voxels of a group."""
    low = [F.min(c).alias(f"{prefix}min_{c}") for c in XYZ]
    return low + [(F.max(c) + 1).alias(f"{prefix}max_{c}") for c in XYZ]


def object_properties(voxels: DataFrame, *keys: str) -> DataFrame:
    """V1, V2: size, half-open box and first voxel in scan order of every label; label 0 is background.

    With two keys (a pair label) a voxel counts if the first key is not 0.
    """
    rep = F.min(F.struct(*XYZ))
    return (
        voxels.where(F.col(keys[0]) != 0)
        .groupBy(*keys)
        .agg(F.count("*").alias("size"), *box_aggregates(), rep.alias("rep"))
        .select(*keys, "size", *[f"{e}_{c}" for e in ("min", "max") for c in XYZ], *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in XYZ])
    )


def overlap_counts(voxels: DataFrame, cell: str, kinds: dict[str, str]) -> DataFrame:
    """V3: voxels shared by each organelle and cell, both not 0; one scan for all kinds."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("obj_type"), F.col(c).alias("obj_id")) for k, c in kinds.items()])).alias("o")
    rows = voxels.where(F.col(cell) != 0).select(F.col(cell).alias("cell_id"), each).select("o.obj_type", "o.obj_id", "cell_id")
    return rows.where("obj_id <> 0").groupBy("obj_type", "obj_id", "cell_id").agg(F.count("*").alias("n"))


def fused_partials(voxels: DataFrame, cell: str, kinds: dict[str, str]) -> DataFrame:
    """V4: properties of cells and organelles and their overlaps in one pass and one shuffle.

    Rows ``(kind, id, id2, size, box, first voxel)``; id2 is null but for overlaps,
    whose kind is ``<organelle>:overlap``.
    """
    none = F.lit(None).cast("long")
    items = [F.struct(F.lit("cell").alias("kind"), F.col(cell).alias("id"), none.alias("id2"))]
    for k, c in kinds.items():
        items.append(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id"), none.alias("id2")))
        items.append(F.struct(F.lit(f"{k}:overlap").alias("kind"), F.col(c).alias("id"), F.col(cell).alias("id2")))
    rows = voxels.select(*XYZ, F.explode(F.array(*items)).alias("o")).select(*XYZ, "o.*").where("id <> 0 and (id2 is null or id2 <> 0)")
    rep = F.min(F.struct(*XYZ))
    return (
        rows.groupBy("kind", "id", "id2")
        .agg(F.count("*").alias("size"), *box_aggregates(), rep.alias("rep"))
        .select("kind", "id", "id2", "size", *[f"{e}_{c}" for e in ("min", "max") for c in XYZ], *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in XYZ])
    )


def merge_partials(parts: DataFrame, *keys: str) -> DataFrame:
    """V5: partial properties of chunks to final ones; the first voxel is the smallest, whatever the order."""
    rep = F.min(F.struct(*[f"rep_{c}" for c in XYZ]))
    low, high = [F.min(f"min_{c}").alias(f"min_{c}") for c in XYZ], [F.max(f"max_{c}").alias(f"max_{c}") for c in XYZ]
    return (
        parts.groupBy(*keys)
        .agg(F.sum("size").alias("size"), *low, *high, rep.alias("rep"))
        .select(*keys, "size", *[f"{e}_{c}" for e in ("min", "max") for c in XYZ], *[F.col(f"rep.rep_{c}").alias(f"rep_{c}") for c in XYZ])
    )


def merge_counts(parts: DataFrame, *keys: str, count: str = "n") -> DataFrame:
    """V6: partial counts by key."""
    return parts.groupBy(*keys).agg(F.sum(count).alias(count))


def overlap_ratio(counts: DataFrame, *objects: str, count: str = "n") -> DataFrame:
    """V9: share of each row in its object's total overlap; a join with the totals, so a hot object can be split."""
    total = counts.groupBy(*objects).agg(F.sum(count).alias("total"))
    return counts.join(total, list(objects)).withColumn("ratio", F.col(count) / F.col("total")).drop("total")


def overlap_by_size(counts: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap over object size; objects that are not in the table drop out."""
    return counts.join(objects.select(*keys, "size"), keys).withColumn("ratio", F.col("n") / F.col("size"))


def type_shares(voxels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of an object's voxels with each mask set; 0 where none is."""
    return voxels.where(F.col(key) != 0).groupBy(key).agg(
        F.count("*").alias("size"), *[F.coalesce(F.count_if(F.col(c) != 0) / F.count("*"), F.lit(0.0)).alias(f"{c}_share") for c in columns]
    )


def merge_voxel_lists(parts: DataFrame, key: str, column: str = "voxels", step: int = 1 << 16) -> DataFrame:
    """V7: partial voxel lists of chunks to lists of whole objects, ``(key, part, voxels)``.

    A list of more than ``step`` voxels is cut by the places' hash, so that no row grows with the object; small
    objects have one row, part 0.
    """
    sizes = parts.groupBy(key).agg(F.ceil(F.sum(F.size(column)) / step).alias("n_parts"))
    each = parts.join(sizes, key).select(key, "n_parts", F.explode(column).alias("v"))
    part = F.when(F.col("n_parts") > 1, F.pmod(F.xxhash64("v"), F.col("n_parts"))).otherwise(F.lit(0).cast("long"))
    return each.groupBy(key, part.alias("part")).agg(F.collect_list("v").alias(column))


def minimum_size(objects: DataFrame, least: dict[str, int], kind: str = "obj_type", size: str = "size") -> DataFrame:
    """Objects that reach their type's least size; a handful of thresholds, so a CASE and no join."""
    limit = F.lit(0)
    for k, v in least.items():
        limit = F.when(F.col(kind) == k, v).otherwise(limit)
    return objects.where(F.col(size) >= limit)


def interior_small(parts: DataFrame, size: int, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    """Partial objects of a chunk without those that are small and touch no face of it."""
    touches = F.lit(False)
    for c in XYZ:
        touches = touches | (F.col(f"min_{c}") <= low[c]) | (F.col(f"max_{c}") >= high[c])
    return parts.where(touches | (F.col("size") >= size))


def neighbours(voxels: DataFrame, label: str, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each voxel's label beside the labels at ``offsets`` from it (voxels of the table only)."""
    shift = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip(XYZ, o)]) for o in offsets])).alias("o")
    seen = voxels.select(*XYZ, F.col(label).alias("other"), shift).select(*[(F.col(c) - F.col(f"o.d{c}")).alias(c) for c in XYZ], "other")
    return voxels.select(*XYZ, F.col(label).alias("own")).join(seen, list(XYZ))


def boundary_voxels(voxels: DataFrame, label: str) -> DataFrame:
    """Voxels of an object with another label, background too, among their six neighbours."""
    return neighbours(voxels.where("true"), label, SIX).where("own <> 0 and other <> own").select(*XYZ, F.col("own").alias(label)).distinct()


def stencil(sx: int, sy: int, sz: int) -> list[tuple[int, int, int]]:
    """Offsets of an odd box stencil without its centre."""
    return [
        (a, b, c) for a in range(-(sx // 2), sx // 2 + 1) for b in range(-(sy // 2), sy // 2 + 1) for c in range(-(sz // 2), sz // 2 + 1) if (a, b, c) != (0, 0, 0)
    ]


def contact_voxels(voxels: DataFrame, label: str, shape: tuple[int, int, int] = (3, 3, 3)) -> DataFrame:
    """At boundary voxels the most frequent other label round them, ties to the smallest; the pair is sorted."""
    edge = boundary_voxels(voxels, label).select(*XYZ)
    near = neighbours(voxels, label, stencil(*shape)).where("own <> 0 and other <> 0 and other <> own").join(edge, list(XYZ), "left_semi")
    counts = near.groupBy(*XYZ, "own", "other").agg(F.count("*").alias("n"))
    best = counts.groupBy(*XYZ, "own").agg(F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("b"))
    return best.select(*XYZ, F.least("own", "b.other").alias("id_lo"), F.greatest("own", "b.other").alias("id_hi"))


def contact_synapse_properties(voxels: DataFrame, mask: str, sym: str, asym: str) -> DataFrame:
    """Contact and synapse properties of pair labels in one aggregation."""
    on = F.col(mask) != 0
    box = [F.min(F.when(on, F.col(c))).alias(f"syn_min_{c}") for c in XYZ] + [(F.max(F.when(on, F.col(c))) + 1).alias(f"syn_max_{c}") for c in XYZ]
    return voxels.groupBy("id_lo", "id_hi").agg(
        F.count("*").alias("cs_size"), *box_aggregates("cs_"), F.count_if(on).alias("syn_size"), *box,
        F.count_if(on & (F.col(sym) != 0)).alias("n_sym"), F.count_if(on & (F.col(asym) != 0)).alias("n_asym"),
    )


def relabel(voxels: DataFrame, label: str, mapping: DataFrame, missing_to_zero: bool = False) -> DataFrame:
    """Labels by ``mapping(old, new)``; others stay, or become 0."""
    other = F.lit(0).cast("long") if missing_to_zero else F.col(label)
    return voxels.join(mapping.select(F.col("old").alias(label), "new"), label, "left").withColumn(label, F.coalesce("new", other)).drop("new")


def threshold(voxels: DataFrame, p: str, t: float, membrane: str | None = None) -> DataFrame:
    """Voxels above ``t``, optionally where the membrane map is above 0.4 of 255."""
    kept = voxels.where(F.col(p) > t)
    return kept if membrane is None else kept.where(F.col(membrane) > 0.4 * 255)


def unique_labels(local: DataFrame, order: list[str], label: str = "label") -> DataFrame:
    """Labels that are unique over chunks: each chunk's are shifted by the largest labels before it.

    The running sum is over one row per chunk, not over voxels.
    """
    from pyspark.sql.window import Window

    most = local.groupBy(*order).agg(F.max(label).alias("most"))
    before = F.sum("most").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return local.join(most.select(*order, F.coalesce(before, F.lit(0)).alias("shift")), order).withColumn(
        label, F.when(F.col(label) > 0, F.col(label) + F.col("shift")).otherwise(F.lit(0))
    ).drop("shift")


def stitch_pairs(halo: DataFrame, block: str, label: str, min_share: float | None = None) -> DataFrame:
    """Pairs of labels of different chunks on the same voxel, optionally by their relative overlap."""
    rows = halo.where(F.col(label) != 0).select(*XYZ, F.col(block).alias("b"), F.col(label).alias("l"))
    pairs = rows.toDF(*XYZ, "b1", "l1").join(rows.toDF(*XYZ, "b2", "l2"), list(XYZ)).where("b1 < b2")
    counts = pairs.groupBy("b1", "l1", "b2", "l2").agg(F.count("*").alias("n"))
    if min_share is None:
        return counts
    sizes = rows.groupBy("b", "l").agg(F.count("*").alias("s"))
    both = counts.join(sizes.toDF("b1", "l1", "s1"), ["b1", "l1"]).join(sizes.toDF("b2", "l2", "s2"), ["b2", "l2"])
    return both.where(F.col("n") / F.least("s1", "s2") > min_share).select("b1", "l1", "b2", "l2", "n")


def in_box(points: DataFrame, centre: tuple, size: tuple) -> DataFrame:
    """Points inside a box given by centre and edge lengths; the upper face is outside."""
    for c, m, s in zip(XYZ, centre, size):
        points = points.where((F.col(c) >= m - s / 2) & (F.col(c) < m + s / 2))
    return points


def tight_crop(points: DataFrame) -> DataFrame:
    """Points moved so that their tight box starts at 0."""
    low = points.agg(*[F.min(c).alias(f"low_{c}") for c in XYZ])
    return points.crossJoin(F.broadcast(low)).withColumns({c: F.col(c) - F.col(f"low_{c}") for c in XYZ}).drop(*[f"low_{c}" for c in XYZ])


def clip_boxes(boxes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Boxes clipped to a volume of ``shape``."""
    clip = {}
    for c, n in zip(XYZ, shape):
        clip[f"min_{c}"] = F.least(F.greatest(F.col(f"min_{c}"), F.lit(0)), F.lit(n))
        clip[f"max_{c}"] = F.least(F.greatest(F.col(f"max_{c}"), F.lit(0)), F.lit(n))
    return boxes.withColumns(clip)


def downsample(voxels: DataFrame, key: str, step: tuple[int, int, int]) -> DataFrame:
    """An object's voxels on a coarser grid."""
    return voxels.select(key, *[(F.floor(F.col(c) / s) * s).alias(c) for c, s in zip(XYZ, step)]).distinct()


def box_fraction(contacts: DataFrame, voxels: DataFrame, edge: tuple[int, int, int], least: int, label: str, special: DataFrame) -> DataFrame:
    """Share of special labels among the voxels in a box round each contact, small fragments left out.

    A range join by grid cells of the box's size: each contact looks into the at most eight cells that its box meets.
    """
    cell = lambda c, e: F.floor(c / e).cast("long")
    low = {c: F.col(c) - e / 2 for c, e in zip(XYZ, edge)}
    reach = contacts.select("contact_id", *[F.col(c).alias(f"c_{c}") for c in XYZ], *[F.explode(F.sequence(cell(low["x"], edge[0]), cell(low["x"] + edge[0], edge[0]))).alias("g_x")])
    for c, e in list(zip(XYZ, edge))[1:]:
        reach = reach.select("*", F.explode(F.sequence(cell(F.col(f"c_{c}") - e / 2, e), cell(F.col(f"c_{c}") + e / 2, e))).alias(f"g_{c}"))
    vox = voxels.where(F.col(label) != 0).select(*XYZ, F.col(label).alias("sv"), *[cell(F.col(c), e).alias(f"g_{c}") for c, e in zip(XYZ, edge)])
    pairs = reach.join(vox, [f"g_{c}" for c in XYZ])
    for c, e in zip(XYZ, edge):
        pairs = pairs.where((F.col(c) >= F.col(f"c_{c}") - e / 2) & (F.col(c) < F.col(f"c_{c}") + e / 2))
    counts = pairs.groupBy("contact_id", "sv").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    marked = counts.join(special.select(F.col("sv_id").alias("sv"), F.lit(1).alias("special")).distinct(), "sv", "left")
    return marked.groupBy("contact_id").agg((F.sum(F.when(F.col("special") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))


def cube_vote(nodes: DataFrame, voxels: DataFrame, edge: int, p: str, t: float, majority: float) -> DataFrame:
    """Is the share of voxels above ``t`` in a cube round each node over ``majority``? The cube's size is the denominator."""
    cell = lambda c: F.floor(c / edge).cast("long")
    half = edge / 2
    reach = nodes.select("node_id", *[F.col(c).alias(f"c_{c}") for c in XYZ])
    for c in XYZ:
        reach = reach.select("*", F.explode(F.sequence(cell(F.col(f"c_{c}") - half), cell(F.col(f"c_{c}") + half))).alias(f"g_{c}"))
    vox = voxels.where(F.col(p) > t).select(*XYZ, *[cell(F.col(c)).alias(f"g_{c}") for c in XYZ])
    pairs = reach.join(vox, [f"g_{c}" for c in XYZ])
    for c in XYZ:
        pairs = pairs.where((F.col(c) >= F.col(f"c_{c}") - half) & (F.col(c) < F.col(f"c_{c}") + half))
    hit = pairs.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(hit, "node_id", "left").select(
        "node_id", F.coalesce("n", F.lit(0)).alias("n_above"), (F.coalesce("n", F.lit(0)) / float(edge**3) > majority).alias("vote")
    )


def recode(df: DataFrame, label: str, foreground: list[int], target: dict[int, int] | None = None) -> DataFrame:
    """Foreground ids to 1 (or to their targets), all else to 0."""
    out = F.lit(0)
    for k in foreground:
        out = F.when(F.col(label) == k, (target or {}).get(k, 1)).otherwise(out)
    return df.withColumn(label, out)


def inside_cube(points: DataFrame, edge: int) -> DataFrame:
    """Points inside [0, edge) on every axis."""
    for c in XYZ:
        points = points.where((F.col(c) >= 0) & (F.col(c) < edge))
    return points
