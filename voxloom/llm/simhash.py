"""SimHash near-duplicates: segment-popcount embedding and a grid join under Manhattan distance.

A 64-bit fingerprint is cut into 32 segments of two bits. Sorting the bits inside
each segment gives its *unary* popcount code, so that the XOR popcount of two
codes is the Manhattan distance of the two 32-dimensional popcount vectors. That
distance never exceeds the Hamming distance of the fingerprints, hence every pair
within Hamming radius r lies within Manhattan radius r.

Grid: the segments are dealt into 2r groups. Within Manhattan radius r at most r
groups can differ, so at least r groups agree exactly and each such pair meets in
at least one of the C(2r, r) grid cells "these r groups have these counts". Cells
are joined by equality; inside a cell pairs are kept if the Manhattan distance is
at most r and then verified by the exact Hamming distance.

Hot cells (many near copies) are split into square tiles, so that no task holds
more than two tiles of fingerprints, and a tile returns the spanning star of each
group it links rather than all of its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.operators.components import connected_components
from voxloom.session import cut, drop_cut

EVEN_BITS = 0x5555555555555555
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of bits unpacked at a time; bounds the memory of a very long text.
BIT_ROWS = 1 << 15
#: Fingerprints or texts, and shingles of texts, on one side of a tile of a hot cell.
TILE, TILE_SHINGLES = 1024, 1 << 20


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words (repeats included) of the text in lower case (A-Z only)."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(flat[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is 1 where over half the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BIT_ROWS):
        part = np.ascontiguousarray(hashes[a : a + BIT_ROWS]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every row of ``docs``: whole texts, repeated shingles counted.

    A null or blank text gets fingerprint 0. Repeated rows and null ids are kept.
    """

    def run(batches):
        for b in few_rows(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = [fingerprint(shingle_hashes(t, shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def popcount_code(fp: Column) -> Column:
    """Per-segment bit counts of a fingerprint, two bits a segment, in unary code."""
    m, half = F.lit(EVEN_BITS), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(m).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(m), 1))


def grid_masks(radius: int) -> list[int]:
    """A mask for each choice of ``radius`` of the 2 * radius groups of segments."""
    groups = [sum(3 << (2 * s) for s in range(32) if s % (2 * radius) == g) for g in range(2 * radius)]
    masks = [sum(c) for c in itertools.combinations(groups, radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _codes(x: np.ndarray) -> np.ndarray:
    m, half = np.uint64(EVEN_BITS), x >> np.uint64(1)
    return ((x | half) & m) | ((x & half & m) << np.uint64(1))


def _tile_links(fps: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components of ``fps`` (distinct, uint64) within ``radius``."""
    codes, parent = _codes(fps), np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, len(fps), rows):
        near = np.bitwise_count(codes[a : a + rows, None] ^ codes[None, a:]) <= radius
        i, j = np.nonzero(near)
        i, j = i[i < j] + a, j[i < j] + a
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        i, j = i[ok], j[ok]
        while len(i):  # what is joined already drops out at once
            x, y = parent[i], parent[j]
            for p, q in set(zip(x[x != y].tolist(), y[x != y].tolist())):
                p, q = root(p), root(q)
                parent[max(p, q)] = min(p, q)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            left = parent[i] != parent[j]
            i, j = i[left], j[left]
    off = np.nonzero(parent != np.arange(len(fps)))[0]
    return fps[parent[off]], fps[off]


def hamming_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``(src, dst)`` edges that connect what fingerprints within ``radius`` bits connect.

    ``fps`` has one distinct non-null long column ``fp``. Every pair within the
    radius is joined by a path of edges, each of which is itself within the
    radius or runs inside a linked group; no pair is capped or sampled.
    """
    cells = fps.select("fp", popcount_code(F.col("fp")).alias("code")).select(
        "fp", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in grid_masks(radius)])).alias("combo", "cell")
    )
    met = cells.groupBy("combo", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1")
    near = F.bit_count(popcount_code(F.col("src")).bitwiseXOR(popcount_code(F.col("dst")))) <= radius
    exact = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    met = cut(met)
    pairs = met.where("n = 2").where(near).where(exact).select("src", "dst")

    side = F.ceil(F.col("n") / tile).cast("int")
    crowded = met.where("n > 2").select("combo", "cell", side.alias("side"))
    salted = cells.join(crowded, ["combo", "cell"]).withColumn("at", F.pmod(F.xxhash64("fp"), F.col("side")).cast("int"))
    tiles = salted.select("combo", "cell", "fp", "at", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other")).select(
        "combo", "cell", F.least("at", "other").alias("ti"), F.greatest("at", "other").alias("tj"), "fp"
    )
    keys = ["combo", "cell", "ti", "tj"]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []

        def close():
            if held:
                a, b = _tile_links(np.unique(np.concatenate([h[1] for h in held])), radius)
                src.append(a), dst.append(b)
                held.clear()

        def out():
            s, d = np.concatenate(src or [np.empty(0, np.uint64)]), np.concatenate(dst or [np.empty(0, np.uint64)])
            src.clear(), dst.clear()
            both = np.unique(np.stack([s.view(np.int64), d.view(np.int64)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])

        for b in batches:
            key = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(4)], 1)
            fp = np.asarray(b.column(4)).view(np.uint64)
            new = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
            for part, ids in zip(np.split(key, new), np.split(fp, new)):
                if held and (held[0][0] != part[0]).any():
                    close()
                if len(part):
                    held.append((part[0], ids.copy()))
            yield out()
        close()
        yield out()

    stars = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable by links of at most ``radius``
    differing bits. Equal fingerprints are one vertex, so exact copies cost one
    aggregation row each. Null ids take part and get their group's smallest id. Texts of any
    length are read whole, piece by piece. Null texts count as empty; repeated rows are rows.
    Empty tables give empty results; columns of ``docs`` beyond the two used do
    not matter.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    first = cut(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    groups = connected_components(hamming_links(first.select("fp"), radius))
    named = first.join(groups, first.fp == groups.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Min-wise samples of a text and shingles in each. A pair at a similarity of 0.8 shares none with a probability of
#: (1 - 0.8**4)**20 = 0.00003, a pair at 0.25 shares one with 0.08.
SAMPLES, SAMPLE_SIZE = 20, 4
#: Mixed hashes held at a time; bounds the memory of a very long text.
MIXED = 1 << 20


def sample_fingerprints(hashes: np.ndarray, samples: int = SAMPLES, size: int = SAMPLE_SIZE) -> list[int]:
    """SimHashes of min-wise samples of distinct shingle hashes: sample t holds the ``size`` smallest under mixing t."""
    odd = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    size, least = min(size, len(hashes)), []
    for a in range(0, samples, step := max(1, MIXED // max(1, len(hashes)))):
        m = hashes[None, :] * odd[a : a + step, None]
        m ^= m >> np.uint64(29)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        least.append(np.partition(m, size - 1, axis=1)[:, :size])
    low = np.ascontiguousarray(np.concatenate(least))
    ones = np.unpackbits(low.view(np.uint8).reshape(samples, size, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def _text_links(rids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what pairs at ``similarity`` or more connect, beyond what ``comps`` already joins.

    Every pair of rows of different components is compared, unless links found before have joined it.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    sizes, rids, comps = sizes[order], rids[order], comps[order]
    distinct, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    _, label = np.unique(comps, return_inverse=True)
    mark, links = np.zeros(len(distinct), np.int32), []
    for i in np.nonzero(label != np.bincount(label).argmax())[0].tolist():  # one of each pair is outside the largest
        lo = int(np.searchsorted(sizes, int(similarity * sizes[i]), "left"))
        hi = int(np.searchsorted(sizes, sizes[i] / similarity + 1, "right"))
        apart = np.nonzero(label[lo:hi] != label[i])[0]
        if not len(apart):
            continue
        mine = flat[ends[i] : ends[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo])[apart]
        mark[mine] = 0
        for j in (lo + apart[common >= similarity * (sizes[i] + sizes[lo + apart] - common)]).tolist():
            if label[j] != label[i]:
                links.append((int(rids[i]), int(rids[j])))
                label[label == label[j]] = label[i]
    return links


def _links_inside(members: DataFrame, sets: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)``: verified links that join all that is alike inside each cell, by square tiles of bounded size.

    ``members`` has cell, rid and component, ``sets`` rid and shingles, ``cells`` cell and the side of its square.
    """
    salted = members.join(cells, "cell").withColumn("at", F.pmod(F.xxhash64("rid"), F.col("side")).cast("int"))
    tiles = salted.select("cell", "rid", "component", "at", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other")).select(
        "cell", F.least("at", "other").alias("ti"), F.greatest("at", "other").alias("tj"), "rid", "component"
    )
    keys = ["cell", "ti", "tj"]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        at = None

        def close():
            rids, comps, texts = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
            held.clear()
            links = _text_links(rids, comps, texts, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for b in batches:
            key = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)], 1)
            rids, comps, lists = np.asarray(b.column(3)), np.asarray(b.column(4)), b.column(5)
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            new = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(key)]):
                if a == z:
                    continue
                if held and (at != key[a]).any():
                    yield close()
                at = key[a].copy()
                held.append((rids[a:z].copy(), comps[a:z].copy(), [values[offsets[i] : offsets[i + 1]].copy() for i in range(a, z)]))
        if held:
            yield close()

    dealt = tiles.join(sets, "rid").select(*keys, "rid", "component", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3, tile: int = TILE, carry: Sequence[str] = ()) -> DataFrame:
    """``(rid, id, rep)`` for every row: rep is the row that stays for its group (rid = rep).

    Groups are the components of links between texts whose sets of ``shingle``-word
    shingles have a Jaccard ``similarity`` or more (sets of 32 bits of each hash); texts
    of equal words are one vertex. Candidates share a cell: their whole-text fingerprints
    are joined by steps of ``radius`` bits, by the grid join, or, since at a similarity of
    0.8 whole-text fingerprints already differ in about ten bits, one of their min-wise
    samples of the shingles has the same fingerprint (see SAMPLES). Every pair of a cell
    is verified on the sets unless verified links join it already: first the links to the
    first row of the cell and of finer cells, then, where that leaves a cell in parts, all
    pairs of different parts in tiles of bounded size.

    The row that stays is the one with the smallest id (nulls last), then the
    smallest row number. Null texts count as empty; wordless texts are one group;
    repeated rows are copies; texts of any length are whole. Empty tables give empty results. Columns of ``docs`` named
    in ``carry`` come along, others do not matter. rid is made here and fits no other
    scan of ``docs``.
    """

    def run(batches):
        import xxhash

        for b in few_rows(batches):
            keys, fps, samples, sets = [], [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                words = b" ".join(text.translate(LOWER).split()) if text else b""
                keys.append(xxhash.xxh3_128_digest(words))
                h = np.unique(shingle_hashes(words, shingle))
                fps.append(fingerprint(h))
                samples.append(sample_fingerprints(h) if len(h) else [])
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            made = [pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(samples, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, *b.columns[3:]], names=["rid", "id", "key", "fp", "m", "samples", "shingles", *carry])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string"), *carry)
    rows = cut(picked.mapInArrow(run, f"rid long, id {kind}, key binary, fp long, m int, samples array<bigint>, shingles array<int>{more}"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    texts = cut(rows.groupBy("key").agg(F.min(order).alias("first")).select("key", F.col("first.rid").alias("v"), "first"))
    firsts = rows.where("m > 0").select("rid", "fp", "m", "samples").join(texts.select(F.col("v").alias("rid")), "rid", "left_semi")

    marks = cut(firsts)
    joined = connected_components(hamming_links(cut(marks.select("fp").distinct()), radius)).withColumnsRenamed({"node": "fp", "component": "group"})
    # a cell is named by one hash; should two share it, their members are compared for nothing
    t, s = F.col("t"), F.col("s")
    sampled = marks.select("rid", "m", F.explode(F.transform("samples", lambda x, i: F.struct(i.alias("t"), x.alias("s"), F.element_at("samples", F.pmod(i + 1, F.lit(SAMPLES)) + 1).alias("next")))).alias("e")).select("rid", "m", "e.*")
    cells = sampled.select("rid", "m", F.xxhash64(t, s).alias("cell"), F.xxhash64(t, s, "next").alias("finer"))
    grouped = marks.select("rid", "m", "fp").join(joined, "fp", "left").select("rid", "m", F.xxhash64(F.lit(SAMPLES), F.coalesce("group", "fp")).alias("cell"), F.xxhash64(F.lit(SAMPLES), "fp").alias("finer"))
    cells = cut(cells.unionByName(grouped))
    met = cut(cells.join(cells.groupBy("cell").agg(F.min("rid").alias("src"), F.count("*").alias("n")).where("n > 1"), "cell"))
    drop_cut(cells)
    finer = met.groupBy("finer").agg(F.min("rid").alias("nearer"), F.count("*").alias("k")).where("k > 1").drop("k")
    edges = met.select("src", "rid", "m").unionByName(met.select("finer", "rid", "m").join(finer, "finer").select(F.col("nearer").alias("src"), "rid", "m"))
    sized = edges.where("src <> rid").distinct().join(marks.select(F.col("rid").alias("src"), F.col("m").alias("m_src")), "src")
    edges = cut(sized.where(F.least("m", "m_src") >= similarity * F.greatest("m", "m_src")).select("src", F.col("rid").alias("dst")))
    drop_cut(marks)
    sets = rows.select("rid", "shingles")
    paired = edges.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    common = F.size(F.array_intersect("a", "b"))
    alike = cut(paired.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("src", "dst"))
    groups = cut(connected_components(alike))

    parts = cut(
        met.where("n > 2").select("cell", "rid", "m").join(groups.withColumnRenamed("node", "rid"), "rid", "left")
        .select("cell", "rid", "m", F.coalesce("component", "rid").alias("component"))
    )
    drop_cut(met), drop_cut(edges)
    side = F.ceil(F.greatest(F.count("*") / tile, F.sum("m") / TILE_SHINGLES)).cast("int")
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64("rid", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("y")]
    mixed = (
        parts.groupBy("cell").agg(*members, side.alias("side"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        .groupBy("n", "x", "y").agg(F.min(F.struct("cell", "side")).alias("cell")).select("cell.*")  # cells of the same members count once
    )
    mixed = cut(mixed)
    if mixed.take(1):
        more = cut(_links_inside(parts, sets, mixed, similarity))
        groups = cut(connected_components(alike.unionByName(more)))
    drop_cut(parts)
    named = texts.join(groups.withColumnRenamed("node", "v"), "v", "left").select("key", "first", F.coalesce("component", "v").alias("component"))
    named = cut(named)
    stays = named.groupBy("component").agg(F.min("first").alias("best")).select("component", F.col("best.rid").alias("rep"))
    of_key = named.select("key", "component").join(stays, "component").select("key", "rep")
    out = cut(rows.select("rid", "id", "key", *carry).join(of_key, "key").select("rid", "id", "rep", *carry))
    drop_cut(rows), drop_cut(texts), drop_cut(named)
    return out
