"""Benchmark decontamination by winnowing.

Texts become words; k-gram hashes slide over them and in every window of
``span`` consecutive words the smallest k-gram hash (the rightmost on ties) is
kept. The choice depends on the words of the window alone, so a span of ``span``
words that a document shares with a benchmark item has the same kept k-gram on
both sides: joining kept fingerprints finds every shared span. Hits are then
extended word by word to the whole window, which makes the result exact.

A benchmark item of fewer than ``span`` words is one window of its own length;
documents keep every gram of those lengths (winnowing with a window of one).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.session import cut

#: ASCII outside 0-9, A-Z and a-z parts words, A-Z becomes a-z, all else belongs to words.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SPAN, KGRAM = 10, 5
#: Bits of a benchmark hash that the prefilter looks at: 2**20 flags, 128 KB, whatever the benchmark's size.
FILTER_BITS = 20
#: Words whose hashes a task remembers before it starts afresh.
REMEMBERED = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> XXH64; a bounded memory of what has been hashed."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One mixed 64-bit hash for each run of k words (given as word hashes)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * ODD
        h ^= h >> np.uint64(29)
    return h


def kept_of_each_window(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams, the place of its smallest one, the rightmost on ties."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    rolled = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.arange(len(rolled)) + width - 1 - np.argmin(rolled[:, ::-1], axis=1)


def _hash_words(words: list[bytes], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN, k: int = KGRAM) -> DataFrame:
    """``(item_id, h, offset, size, gram)``: each window of each item with its kept k-gram."""

    def run(batches):
        seen = WordHashes()
        for b in few_rows(batches):
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                hashed = _hash_words(words, seen)
                if 0 < len(words) < span:
                    grams = gram_hashes(hashed, len(words)).view(np.int64)
                    rows.append((i, int(grams[0]), 0, len(words), b" ".join(words)))
                elif words:
                    grams = gram_hashes(hashed, k)
                    kept = kept_of_each_window(grams, span - k + 1)
                    at = grams[kept].view(np.int64)
                    rows += [(i, int(at[a]), int(kept[a]) - a, span, b" ".join(words[a : a + span])) for a in range(len(kept))]
            i, h, o, s, g = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i, pa.int64())), pa.array(h, pa.int64()), pa.array(o, pa.int32()), pa.array(s, pa.int32()), pa.array([x.decode() for x in g], pa.string())],
                names=["item_id", "h", "offset", "size", "gram"],
            )

    kind = items.schema[id_col].dataType.simpleString()
    picked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"item_id {kind}, h long, offset int, size int, gram string").distinct()


CANDIDATES = "array<struct<pos:int,h:bigint,from:int,words:array<string>>>"


def scan_documents(docs: DataFrame, flags: bytes, sizes: list[int], id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = KGRAM, carry: Sequence[str] = ()) -> DataFrame:
    """``(rid, id, n_words, candidates)``: kept k-grams whose hash passes ``flags``, with the words round them."""

    def run(batches):
        seen = WordHashes()
        bits = np.frombuffer(flags, np.uint8)
        item = pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("from", pa.int32()), ("words", pa.list_(pa.string()))])

        def passing(grams: np.ndarray) -> np.ndarray:
            at = grams >> np.uint64(64 - FILTER_BITS)
            return np.nonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]

        for b in few_rows(batches):
            counts, found = [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text)
                n, mine = len(words), []
                counts.append(n)
                hashed = _hash_words(words, seen)
                if n >= span:
                    grams = gram_hashes(hashed, k)
                    likely = passing(grams)
                    if len(likely):
                        kept = np.unique(kept_of_each_window(grams, span - k + 1))
                        for p in np.intersect1d(likely, kept, assume_unique=True).tolist():
                            a, z = max(0, p - (span - k)), min(n, p + span)
                            mine.append((p, int(grams[p].view(np.int64)), a, words[a:z]))
                for s in sizes:
                    grams = gram_hashes(hashed, s)
                    for p in passing(grams).tolist() if len(grams) else []:
                        mine.append((p, int(grams[p].view(np.int64)), p, words[p : p + s]))
                found.append([{"pos": p, "h": h, "from": a, "words": [w.decode("utf-8", "replace") for w in ws]} for p, h, a, ws in mine])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(found, pa.list_(item)), *b.columns[3:]], names=["rid", "id", "n_words", "candidates", *carry]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string"), *carry)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return picked.mapInArrow(run, f"rid long, id {kind}, n_words long, candidates {CANDIDATES}{more}")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = KGRAM, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document row: ``rid, id, n_words, n_hit, n_items, item_ids, contaminated``.

    A document word is hit if it lies in any occurrence of a window of any item.
    Texts of any length are whole, repeated rows and ids are rows of their own.
    Null and wordless texts have no words and no hits; wordless items have no
    windows; repeated items count once by id; an empty benchmark leaves every
    document clean. Other columns of either table do not matter, but those of ``docs`` named in
    ``carry`` come along. rid is made here and fits no other scan of ``docs``.

    The benchmark's fingerprints meet the documents' in an equi-join; only a
    fixed 128 KB table of hash flags travels with the tasks, whatever the
    benchmark's size. Common passages meet in joins that Spark can split, and a
    document gathers no more than its own hits.
    """
    windows = cut(benchmark_windows(items, item_id, item_text, span, k))
    flags = np.zeros(1 << FILTER_BITS, np.uint8)
    for (f,) in windows.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int")).distinct().collect():
        flags[f] = 1
    sizes = sorted(r[0] for r in windows.where(F.col("size") < span).select("size").distinct().collect())
    scanned = cut(scan_documents(docs, np.packbits(flags, bitorder="little").tobytes(), sizes, id_col, text_col, span, k, carry))

    start = F.col("c.pos") - F.col("offset")
    inside = (start >= F.col("c.from")) & (start + F.col("size") <= F.col("c.from") + F.size("c.words"))
    same = F.array_join(F.slice("c.words", start - F.col("c.from") + 1, F.col("size")), " ") == F.col("gram")
    hits = cut(
        scanned.where(F.size("candidates") > 0)
        .select("rid", F.explode("candidates").alias("c"))
        .withColumn("h", F.col("c.h"))
        .join(windows.select("h", "offset", "size", "gram").distinct(), "h")
        .where(inside)
        .where(same)
        .select("rid", start.alias("start"), (start + F.col("size")).alias("end"), "gram")
        .distinct()
    )
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")
        ),
        lambda s: s["n"].cast("long"),
    )
    n_hit = hits.groupBy("rid").agg(covered.alias("n_hit"))
    named = (
        hits.select("rid", "gram").distinct().join(windows.select("gram", "item_id").distinct(), "gram").groupBy("rid")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    none = F.array().cast("array<string>")
    return (
        scanned.select("rid", "id", "n_words", *carry)
        .join(n_hit, "rid", "left")
        .join(named, "rid", "left")
        .select(
            "rid", "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *carry,
        )
    )
