"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Dimensions are the terms. The candidates of a block are kept as postings, one
list of (candidate, weight) per term. A query is a sparse row of (term, weight);
term by term its weight times the postings is scattered into a dense array of
scores for the block. The k best of each block are picked by partition selection
and a window over the blocks' winners merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.session import cut

#: Vectors in a candidate block and in a query block (in expectation).
BLOCK, QUERY_BLOCK = 4096, 512
#: Queries whose dense score arrays are held at a time.
LIVE = 16
#: The ends of the 64-bit numbers.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, w)``: floor(scale * component) as whole doubles; rows with nulls or non-finite components left out.

    A component whose product with ``scale`` is beyond all doubles counts as non-finite.
    """
    w = F.transform(vec_col, lambda v: v.cast("double") * scale)
    bad = F.exists(w, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(w, lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v))  # larger doubles have no fraction
    return vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad).select(F.col(id_col).alias("id"), whole.alias("w"))


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """A row for each of ``n`` hash blocks: its ids and weights."""
    return rows.groupBy(F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("rid", "id", "w")).alias("rows"))


def _rows(w: list[np.ndarray], dims: int, kind) -> np.ndarray:
    """Weights as a table, short rows padded by zeros."""
    out = np.zeros((len(w), dims), kind)
    for i, x in enumerate(w):
        out[i, : len(x)] = x if kind is not object else [int(v) for v in x.tolist()]
    return out


def _largest(w: list[np.ndarray]) -> int:
    return max((int(np.abs(x).max()) for x in w if len(x)), default=0)


def sum_kind(largest_query: int, largest_candidate: int, dims: int):
    """The narrowest numbers in which no sum of products can overflow: 32 or 64 bits, else Python's own integers."""
    bound = largest_query * largest_candidate * dims
    return np.int32 if bound < 1 << 30 and max(largest_query, largest_candidate) < 1 << 31 else np.int64 if bound < 1 << 62 and max(largest_query, largest_candidate) < 1 << 62 else object


class Postings:
    """The candidates of a block, term by term: who has a weight other than 0, and the weights.

    A term that many candidates have keeps its weights in candidate order, zeros
    included, and no list of who.
    """

    def __init__(self, w: list[np.ndarray], kind):
        self.n, self.dims = len(w), max(map(len, w), default=0)
        self.lists = []
        for row in np.ascontiguousarray(_rows(w, self.dims, kind).T):
            at = np.nonzero(row)[0]
            self.lists.append((None, row) if 8 * len(at) >= self.n else (at, row[at]))


def scores(queries: np.ndarray, postings: Postings) -> np.ndarray:
    """Dense (query, candidate) sums of a few sparse query rows, accumulated term by term."""
    acc = np.zeros((len(queries), postings.n), queries.dtype)
    part = np.empty_like(acc)
    for t in range(min(queries.shape[1], postings.dims)):
        at, weight = postings.lists[t]
        rows = np.nonzero(queries[:, t])[0]
        if not len(weight) or not len(rows):
            continue
        if at is not None:
            acc[np.ix_(rows, at)] += queries[rows, t, None] * weight
        elif 2 * len(rows) >= len(queries):
            np.multiply(queries[:, t, None], weight, out=part)
            acc += part
        else:
            acc[rows] += queries[rows, t, None] * weight
    return acc


def _block_best(asked: tuple, cands: tuple, k: int):
    """``(query row, query id, ids, scores)``: the ``k`` best of a block for each query of another."""
    (qrid, qid, q), (crid, cid, c) = asked, cands
    order = np.argsort(crid, kind="stable")
    order = order[np.argsort(cid[order], kind="stable")]
    crid, cid, c = crid[order], cid[order], [c[o] for o in order]
    dims = max(map(len, [*q, *c]), default=0)
    kind = sum_kind(_largest(q), _largest(c), dims)
    table, postings = _rows(q, dims, kind), Postings(c, kind)
    for a in range(0, len(q), LIVE):
        acc = scores(table[a : a + LIVE], postings)
        own = qrid[a : a + LIVE, None] == crid
        if kind is object:
            for r in range(len(acc)):
                acc[r] = [min(max(x, LOW), HIGH) for x in acc[r]]
                at = sorted(np.nonzero(~own[r])[0].tolist(), key=lambda j: (-acc[r, j], j))[:k]
                yield qrid[a + r], qid[a + r], cid[at].tolist(), [acc[r, j] for j in at]
            continue
        least = np.iinfo(kind).min
        acc[own] = least
        kth = np.partition(acc, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(acc), least)
        for r in range(len(acc)):
            at = np.nonzero((acc[r] >= kth[r]) & (acc[r] > least))[0]
            at = at[np.argsort(-acc[r, at].astype(np.int64), kind="stable")[:k]]
            yield qrid[a + r], qid[a + r], cid[at].tolist(), acc[r, at].tolist()


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest integer inner products of each query.

    ``is_query`` is a condition on ``id``. A row is no candidate of its own query;
    ties go to the smaller id; fewer rows than ``k`` give all. Rows that repeat an id
    are rows of their own: each is a candidate of the others, and each that asks has a
    ranking. Vectors that are null or hold null or non-finite components take no part;
    vectors of different lengths are padded by zeros. Sums are exact at any size of the
    components; a score beyond 64 bits counts as the nearest 64-bit number. Queries and candidates are dealt into blocks of bounded size;
    each pair of blocks is one unit of work. An empty table gives an empty result.
    """
    rows = cut(quantised(vectors, scale, id_col, vec_col).withColumn("rid", F.monotonically_increasing_id()))
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    cands = _blocks(rows, blocks, "block")
    each = _blocks(asked, query_blocks, "query_block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = each.withColumnRenamed("rows", "asked").join(cands, "block").select("asked", "rows")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                unpack = lambda c: (*(np.asarray(c[i].values.field(f)) for f in ("rid", "id")), [np.asarray(x.values) for x in c[i].values.field("w")])
                found = list(_block_best(unpack(b.column(0)), unpack(b.column(1)), k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f[0] for f in found for _ in f[3]], pa.int64()), pa.array([f[1] for f in found for _ in f[3]], b.column(0).type.value_type.field("id").type),
                            pa.array([x for f in found for x in f[2]], b.column(0).type.value_type.field("id").type), pa.array([x for f in found for x in f[3]], pa.int64()),
                        ],
                        names=["rid", "query_id", "id", "score"],
                    )

    best = pairs.mapInArrow(run, f"rid long, query_id {kind}, id {kind}, score long")
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
