"""Synapses from contact fragments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.clusters import clusters
from voxloom.operators.components import graph_components
from voxloom.operators.spatial import k_nearest_anywhere
from voxloom.session import cut

XYZ = ("x", "y", "z")
PAIR = ["cell_lo", "cell_hi"]
#: Sign rule: symmetric share above which a synapse is inhibitory.
SYM_RATIO = 0.225


def encode_pair(a: Column, b: Column) -> Column:
    """Order-independent packed id (low * 2**32 + high) as DECIMAL(20, 0), which no pair overflows."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (lo.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + hi).cast("decimal(20,0)")


def decode_pair(packed: Column) -> tuple[Column, Column]:
    """The two ids of a packed one."""
    lo = F.floor(packed / F.lit(4294967296).cast("decimal(20,0)")).cast("long")
    return lo, (packed - lo.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)")).cast("long")


def between_cells(fragments: DataFrame, sv_cell: DataFrame) -> DataFrame:
    """Fragments whose supervoxels belong to two different cells, keyed by the unordered pair."""
    side = lambda n: sv_cell.select(F.col("sv_id").alias(f"sv_{n}"), F.col("cell_id").alias(f"c{n}"))
    both = fragments.join(side(1), "sv_1").join(side(2), "sv_2").where("c1 <> c2")
    return both.withColumns({"cell_lo": F.least("c1", "c2"), "cell_hi": F.greatest("c1", "c2")}).drop("c1", "c2")


def long_partners(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """C4: pairs of which both cells are in the list of those with enough path length."""
    out = pairs
    for c in PAIR:
        out = out.join(cells.select(F.col("cell_id").alias(c)).distinct(), c, "left_semi")
    return out


def _cell(gap: float, scale, name: str) -> dict[str, Column]:
    """Grid cells whose diagonal is ``gap``: any two places in one are nearer."""
    edge = gap / 3**0.5 * (1 - 1e-9)
    return {f"{name}{c}": F.floor(F.col(c) * float(s) / edge).cast("long") for c, s in zip(XYZ, scale)}


def _near_cells(cells: DataFrame, gap: float, strict: bool, on: list[str], name: str, differ: Column | None = None) -> DataFrame:
    """Pairs of cells with a place in each that are within ``gap``: columns of the first as they are, of the second with ``_b``.

    ``cells`` has ``on``, the cell, ``low`` and ``high`` corners and ``places``. Cells that are too far by their corners are
    left out, those that are near in any case taken; the others are searched up to the first near pair.
    """
    grid = [f"{name}{c}" for c in XYZ]
    reach = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0) or (differ is not None and (a, b, c) == (0, 0, 0))]
    shift = F.explode(F.array(*[F.struct(*[F.lit(k).alias(g) for g, k in zip(grid, o)]) for o in reach])).alias("o")
    left = cells.select("*", shift).withColumns({g: F.col(g) + F.col(f"o.{g}") for g in grid}).drop("o")
    right = cells.withColumnsRenamed({c: f"{c}_b" for c in cells.columns if c not in [*on, *grid]})
    pairs = left.join(right, [*on, *grid])
    pairs = pairs if differ is None else pairs.where(differ)
    near = lambda d2: F.sqrt(d2) < gap if strict else F.sqrt(d2) <= gap
    apart = sum(F.greatest(F.col(f"low_b.{c}") - F.col(f"high.{c}"), F.col(f"low.{c}") - F.col(f"high_b.{c}"), F.lit(0.0)) ** 2 for c in XYZ)
    across = sum(F.greatest(F.col(f"high_b.{c}") - F.col(f"low.{c}"), F.col(f"high.{c}") - F.col(f"low_b.{c}")) ** 2 for c in XYZ)
    found = F.exists("places", lambda p: F.exists("places_b", lambda q: near(sum((p[c] - q[c]) ** 2 for c in XYZ))))
    return pairs.where(near(apart)).where(F.when(near(across), True).otherwise(found))


def _cells(voxels: DataFrame, by: list[str], scale, *more: Column) -> DataFrame:
    place = F.struct(*[(F.col(c) * float(s)).alias(c) for c, s in zip(XYZ, scale)])
    corner = lambda f: F.struct(*[f(F.col(c) * float(s)).alias(c) for c, s in zip(XYZ, scale)])
    return voxels.groupBy(*by).agg(*more, corner(F.min).alias("low"), corner(F.max).alias("high"), F.collect_set(place).alias("places"))


def cluster_voxels(
    voxels: DataFrame, gap: float, key: list[str], scale=(1.0, 1.0, 1.0), within: tuple[list[str], float] | None = None, gate: float | None = None, strict: bool = True
) -> DataFrame:
    """Components of voxels of one key that are less than ``gap`` apart (KD-tree bounds are strict).

    ``voxels`` has id, x, y, z and the key. ``within = (columns, r)`` also links
    voxels at most ``r`` voxels apart that agree on more columns (one fragment). With ``gate`` (which needs
    ``within``) two clusters of a fragment are only joined if their representatives, the voxels of smallest id,
    are at most that far apart.

    Blocks of space find the components of their voxels (:mod:`voxloom.operators.clusters`).
    """
    if gate is not None:
        return _gated(voxels, gap, key, scale, within, gate)
    return clusters(voxels, gap, key, scale, strict, within)


def _gated(voxels: DataFrame, gap: float, key: list[str], scale, within, gate: float) -> DataFrame:
    cols, r = within
    grid = [f"g{c}" for c in XYZ]
    parts = cluster_voxels(voxels, r, key + cols, strict=False).withColumnRenamed("component", "part")
    parts = cut(parts.withColumns(_cell(gap, scale, "g")))
    rep = parts.where("id = part").select("part", F.struct(*[(F.col(c) * float(s)).alias(c) for c, s in zip(XYZ, scale)]).alias("rep"))
    cells = _cells(parts, [*key, *grid, "part"], scale).join(rep, "part")
    open_gate = F.sqrt(sum((F.col(f"rep.{c}") - F.col(f"rep_b.{c}")) ** 2 for c in XYZ)) <= gate
    pairs = _near_cells(cells, gap, True, key, "g", differ=(F.col("part") != F.col("part_b")) & open_gate)
    links = pairs.select(F.col("part").alias("src"), F.col("part_b").alias("dst")).unionByName(parts.select(F.col("part").alias("src"), F.col("part").alias("dst"))).distinct()
    comp = graph_components(links)
    return parts.join(comp.withColumnRenamed("node", "part"), "part").drop("part", *grid)


def medoid(points: DataFrame, key: list[str], scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """The member nearest to the group's mean, ties to the smallest coordinates."""
    mean = points.groupBy(*key).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    dist = F.round(sum(((F.col(c) - F.col(f"m{c}")) * float(s)) ** 2 for c, s in zip(XYZ, scale)), 6)
    best = points.join(mean, key).groupBy(*key).agg(F.min(F.struct(dist.alias("d"), *XYZ)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(f"rep_{c}") for c in XYZ])


def synapse_rows(clustered: DataFrame, least: int) -> DataFrame:
    """Size, inclusive box, fragments and shares of each component of a pair; small components go.

    C9: the shares are weighted by the fragments' voxels in the component.
    """
    key = [*PAIR, "component"]
    ends = {**{f"min_{c}": (F.min, c) for c in XYZ}, **{f"max_incl_{c}": (F.max, c) for c in XYZ}}
    frag = clustered.groupBy(*key, "syn_id", "sym_share", "asym_share").agg(F.count("*").alias("n"), *[f(c).alias(e) for e, (f, c) in ends.items()])
    share = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    rows = frag.groupBy(*key).agg(
        F.sum("n").alias("size"), *[f(e).alias(e) for e, (f, _) in ends.items()], share("sym_share").alias("sym"), share("asym_share").alias("asym"), F.count("*").alias("n_fragments")
    )
    return rows.where(F.col("size") >= least)


def sign(sym: Column, asym: Column, limit: float = SYM_RATIO) -> tuple[Column, Column]:
    """Symmetric ratio (-1 if both shares are 0) and sign."""
    ratio = F.when(sym + asym > 0, sym / (sym + asym)).otherwise(-1.0)
    return ratio, F.when(ratio > limit, -1).otherwise(1)


#: Distances that a task works on at a time in :func:`proximity`.
DISTANCES = 200_000


def proximity(synapses: DataFrame, voxels: DataFrame, objects: DataFrame, vertices: DataFrame, prefilter: float, near: float) -> DataFrame:
    """Per synapse and partner: close objects, voxels they contribute, smallest distance (1e12 without any).

    ``synapses`` has syn_id, cell_id (a row a partner) and the representative coordinate, ``voxels(syn_id, x, y, z)``
    all their voxels; objects are of the same cell, and within ``prefilter`` of the representative. A vertex is close
    if the nearest voxel of the synapse is less than ``near`` away; an object's voxels count by the share of its
    vertices that are close. A synapse without voxels has no close vertex.

    A synapse with its voxels and an object with its vertices are a row each. Synapses whose corners or representative are too far from all
    that their partner has are left out; the others go to the partner's objects. A task reads a cell's objects first and
    then its synapses as they come, so that it holds the objects of one cell; a few cells are split over the tasks by synapse.
    """
    tasks = int(synapses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists, at = [f"{c}s" for c in XYZ], [F.col(c).cast("double").alias(c) for c in XYZ]
    known = voxels.select("syn_id", *at).where(" and ".join(f"abs({c}) < double('infinity')" for c in XYZ))
    corners = known.groupBy("syn_id").agg(*[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("min_", F.min), ("max_", F.max))])
    asked = synapses.select("syn_id", "cell_id", *at).dropDuplicates(["syn_id", "cell_id"]).join(corners.hint("merge"), "syn_id")
    # a vertex without a coordinate counts and is never close
    drawn = vertices.groupBy("obj_id").agg(*[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(f"{c}s") for c in XYZ])
    held = objects.select("obj_id", "cell_id", F.col("size").cast("double").alias("size"), *at).join(drawn.hint("merge"), "obj_id").drop("obj_id")
    finite = lambda c: F.filter(c, lambda v: ~F.isnan(v))
    corner = [e.alias(n) for c in XYZ for n, e in ((f"low_{c}", F.min(c)), (f"high_{c}", F.max(c)), (f"first_{c}", F.min(F.array_min(finite(f"{c}s")))), (f"last_{c}", F.max(F.array_max(finite(f"{c}s")))))]
    box = cut(held.groupBy("cell_id").agg(*corner))
    pieces = -(-4 * tasks // max(box.count(), 1))
    apart = lambda a, b, c, d: F.greatest(a - d, c - b, F.lit(0.0)) ** 2
    reach = asked.join(box, "cell_id")
    far = sum(apart(F.col(c), F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")) for c in XYZ)
    away = sum(apart(F.col(f"min_{c}"), F.col(f"max_{c}"), F.col(f"first_{c}"), F.col(f"last_{c}")) for c in XYZ)
    reach = cut(reach.where((far <= prefilter**2 * (1 + 1e-9)) & (away < near**2 * (1 + 1e-9))).select("syn_id", "cell_id", *XYZ))
    sets = known.join(reach.select("syn_id").hint("shuffle_hash"), "syn_id", "left_semi").groupBy("syn_id").agg(*[F.collect_list(c).alias(f"{c}s") for c in XYZ])
    reach = reach.join(sets.hint("merge"), "syn_id")
    kinds = {f.name: f.dataType for f in synapses.schema}
    names = ["cell_id", "piece", "kind", "syn_id", "size", *XYZ, *lists]
    rows = held.withColumns({"piece": F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))), "kind": F.lit(0), "syn_id": F.lit(None).cast(kinds["syn_id"])}).withColumn("cell_id", F.col("cell_id").cast(kinds["cell_id"])).select(names)
    rows = rows.unionByName(reach.withColumns({"piece": F.pmod(F.xxhash64("syn_id"), F.lit(pieces)).cast("int"), "kind": F.lit(1), "size": F.lit(None).cast("double")}).select(names))
    rows = rows.repartition(tasks, "cell_id", "piece").sortWithinPartitions("cell_id", "piece", "kind")

    def places(batch):
        """Row numbers, first places and numbers of places of the rows, and all their places."""
        column = batch.column("xs")
        start = np.asarray(column.offsets, np.int64)
        return start[:-1] - start[0], np.diff(start), [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in lists]

    def middle(batch):
        return [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in XYZ]

    def objects_of(batches):
        size = np.concatenate([b.column("size").fill_null(0).to_numpy(zero_copy_only=False) for b in batches])
        found = [places(b) for b in batches]
        count = np.concatenate([n for _, n, _ in found])
        ends = [np.concatenate(e) for e in zip(*[v for *_, v in found])]
        return [np.concatenate(m) for m in zip(*map(middle, batches))], size, count, np.repeat(np.arange(len(count)), count), ends

    def measure(objs, batch):
        centre, size, drawn, owner, ends = objs
        first, many, flat = places(batch)
        mine = middle(batch)
        s0, parts = 0, []
        step = max(1, DISTANCES // max(len(owner), 1))
        while s0 < len(first):
            rows = slice(s0, s0 + step)
            start, count = first[rows], many[rows]
            n, inside = len(start), slice(start[0], start[-1] + count[-1])
            wide = sum(np.square(centre[k][None, :] - mine[k][rows, None]) for k in range(3))
            low, high = ([f.reduceat(v[inside], start - start[0]) for v in flat] for f in (np.minimum, np.maximum))
            out = sum(np.square(np.maximum(np.maximum(low[k][:, None] - ends[k][None, :], ends[k][None, :] - high[k][:, None]), 0)) for k in range(3))
            s, v = np.nonzero((out < near**2 * (1 + 1e-9)) & (np.sqrt(wide) <= prefilter)[:, owner])
            dist, total = np.empty(len(s)), np.cumsum(count[s])
            p = 0
            while p < len(s):
                q = max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + DISTANCES, side="right")))
                each = count[s[p:q]]
                begin = np.cumsum(each) - each
                place = np.arange(each.sum()) + np.repeat(start[s[p:q]] - begin, each)
                d = np.zeros(len(place))
                for k in range(3):
                    by = flat[k][place]
                    by -= np.repeat(ends[k][v[p:q]], each)
                    by *= by
                    d += by
                dist[p:q] = np.sqrt(np.minimum.reduceat(d, begin))
                p = q
            close = dist < near
            s, v, dist = s[close], v[close], dist[close]
            seen = np.bincount(s * len(drawn) + owner[v], minlength=n * len(drawn)).reshape(n, len(drawn))
            least = np.full(n, np.inf)
            np.minimum.at(least, s, dist)
            share = np.where(seen > 0, seen / np.maximum(drawn, 1) * size, 0.0)
            hit = np.flatnonzero(np.isfinite(least))
            parts.append((hit + s0, ((seen > 0) & (size > 0)).sum(1)[hit], share.sum(1)[hit], least[hit]))
            s0 += step
        row, n_objects, share, least = (np.concatenate(c) for c in zip(*parts))
        picked = [batch.column(c).take(pa.array(row)) for c in ("syn_id", "cell_id")]
        return pa.RecordBatch.from_arrays([*picked, pa.array(n_objects, pa.int64()), pa.array(share), pa.array(least)], names=["syn_id", "cell_id", "n_objects", "voxels", "min_dist"])

    def run(batches):
        key, seen, objs = None, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("cell_id", "piece", "kind")]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a][:2] != key:
                    key, seen, objs = keys[a][:2], [], None
                part = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    seen.append(part)
                elif seen:
                    objs = objs or objects_of(seen)
                    yield measure(objs, part)

    got = rows.mapInArrow(run, f"syn_id {kinds['syn_id'].simpleString()}, cell_id {kinds['cell_id'].simpleString()}, n_objects long, voxels double, min_dist double")
    return synapses.select("syn_id", "cell_id").join(got.hint("merge"), ["syn_id", "cell_id"], "left").select(
        "syn_id", "cell_id", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("voxels", F.lit(0.0)).alias("voxels"), F.coalesce("min_dist", F.lit(1e12)).alias("min_dist")
    )


def pivot_partners(features: DataFrame, synapses: DataFrame, columns: list[str]) -> DataFrame:
    """Per-partner features to ``_0`` and ``_1`` columns; missing partners give nulls. One join and one grouping by synapse, for both partners."""
    own = features.groupBy("syn_id").agg(F.collect_list(F.struct("cell_id", *columns)).alias("of"))
    both = synapses.select("syn_id", "cell_0", "cell_1").join(own, "syn_id", "left")
    at = lambda s: F.filter("of", lambda p: p["cell_id"] == F.col(f"cell_{s}"))
    found = both.select("syn_id", "cell_0", "cell_1", *[F.get(at(s), F.lit(0)).alias(f"p{s}") for s in (0, 1)])
    return found.select("syn_id", "cell_0", "cell_1", *[F.col(f"p{s}.{c}").alias(f"{c}_{s}") for c in columns for s in (0, 1)])


def train_forest(rows: DataFrame, features: list[str], label: str = "label", trees: int = 2000, depth: int = 8, seed: int = 0):
    """A random forest with sqrt features per split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(rows)


def classify(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """Synapse probability from a fitted forest."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("syn_prob"))


def cross_validate(rows: DataFrame, features: list[str], folds: int = 10, trees: int = 100, key: str = "syn_id", label: str = "label") -> DataFrame:
    """Held-out probabilities by folds of the key's hash. The rows are made once; each fold reads them from the shared folder."""
    rows = cut(rows.select(key, label, *features).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds))))
    out = None
    for k in range(folds):
        part = classify(rows.where(F.col("fold") == k), train_forest(rows.where(F.col("fold") != k), features, label, trees), [key, label])
        out = part if out is None else out.unionByName(part)
    return out


def match_labels(labels: DataFrame, synapses: DataFrame, voxels: DataFrame, k: int, most: float) -> DataFrame:
    """C17: a labelled coordinate's synapse: of the ``k`` nearest by coordinate, at any distance, the first with a voxel at L1 distance below ``most``; rows without one drop out."""
    near = labels.select("label_id", *[F.col(c).alias(f"l{c}") for c in XYZ])
    found = k_nearest_anywhere(labels.withColumnRenamed("label_id", "query_id"), synapses.withColumnRenamed("syn_id", "id"), k, 4 * most)
    cand = found.select(F.col("query_id").alias("label_id"), F.col("id").alias("syn_id"), "rank")
    l1 = sum(F.abs(F.col(c) - F.col(f"l{c}")) for c in XYZ)
    hit = cand.join(near, "label_id").join(voxels.select("syn_id", *XYZ), "syn_id").groupBy("label_id", "syn_id", "rank").agg(F.min(l1).alias("l1")).where(F.col("l1") < most)
    return hit.groupBy("label_id").agg(F.min(F.struct("rank", "syn_id")).alias("b")).select("label_id", F.col("b.syn_id").alias("syn_id"))


def partner_properties(synapses: DataFrame, lookups: list[DataFrame], defaults: dict[str, object], key: tuple[str, ...] = ("syn_id", "cell_id")) -> DataFrame:
    """Per synapse and partner, values of lookup tables with one row a ``key``; missing ones get their default.

    Where a cell has synapses with itself, the key needs the partner's side as well.
    """
    out = synapses
    for t in lookups:
        out = out.join(t, list(key), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def density(synapses: DataFrame, volume_um3: float) -> DataFrame:
    """Synapses per µm³ and their numbers by sign."""
    return synapses.agg(
        (F.count("*") / volume_um3).alias("density"), F.count_if(F.col("syn_sign") == -1).alias("n_sym"), F.count_if(F.col("syn_sign") == 1).alias("n_asym")
    )
