"""Sum-of-squares packing of token sequences.

The state of a packing is N(g), the number of open bins with g tokens left. A
piece of s tokens goes to the bin - an open one with gap g >= s or a new one -
for which the sum of N(g)**2 over 1 <= g < capacity is smallest afterwards, ties
to the smallest gap that remains. Pieces come longest first, so that the short
ones fill what the long ones leave.

Pieces are dealt by hash into shards of one fixed size that are packed side by
side. Pieces that no other can join are done at once. Bins that a shard leaves
open are taken apart and dealt anew, so that what is left of several shards meets
in one, until a single shard is left or a round saves less than a sequence a shard.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.session import cut

CAPACITY = 4096
#: Pieces that one task packs (in expectation), and parts of texts whose ids a task remembers: twice as many at most, 0.4 KB each.
SHARD, REMEMBERED = 16_384, 80_000
#: Characters of text that are parted at a time.
HELD = 1 << 20
#: Texts of these characters alone are parted here, the same way as by the vocabulary's own rule.
PLAIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: What a character of such a text is, lower-cased, in Latin-1: white space, a letter, a digit or a mark.
WHITE, LETTER, DIGIT, MARK = range(4)
KIND = np.array([WHITE if c in b"\t\n\r " else DIGIT if 48 <= c <= 57 else LETTER if 97 <= c <= 122 or c >= 0xDF and c != 0xF7 else MARK for c in range(256)], np.uint8)
#: Endings that an apostrophe at the head of a run of marks takes along.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: A bin is taken apart for the next round if more than this share of it is empty.
OPEN_SHARE = 0.002
#: Rounds are told apart by the upper bits of the sequence ids.
FIRST_LEVEL, LAST_LEVEL = 64, 127


def part_starts(chars: np.ndarray) -> np.ndarray:
    """True where a part begins: a run of letters, a digit, a run of marks or an apostrophe with its ending."""
    kind = KIND[chars]
    starts = kind != WHITE
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    heads = np.nonzero(starts & (chars == 39))[0]
    for ending in ENDINGS if len(heads) else ():
        at = heads[heads + len(ending) < len(chars)]
        for j, c in enumerate(ending):
            at = at[chars[at + 1 + j] == c]
        starts[at + 1] = False
        behind = at + 1 + len(ending)
        behind = behind[behind < len(chars)]
        starts[behind[kind[behind] == LETTER]] = True
    return starts


class TextIds:
    """The token ids of texts as little-endian bytes.

    The vocabulary lower-cases a text, drops white space and encodes each run of
    letters, each digit and each run of marks by itself. Plain texts are parted
    that way here, so that each distinct part of some texts is encoded once and
    looked up from then on (a bounded memory). A full memory is set aside, what is
    still in use moves on to the next, the rest goes with the one after. Other texts,
    and those that may hold a special token, go through the tokenizer whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        names = tokenizer.get_vocab()
        self.is_last = np.zeros(max(names.values()) + 1, bool)  # tokens that end a part
        self.is_last[[i for t, i in names.items() if t.endswith("</w>")]] = True

    def _learn(self, parts: list[bytes]) -> None:
        text = b" ".join(parts).decode("latin-1")
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.nonzero(self.is_last[ids])[0] + 1)
        assert len(ends) == len(parts), "each part is encoded by itself"
        raw, begin = ids.tobytes(), 0
        for w, z in zip(parts, ends.tolist()):
            self.known[w] = raw[begin:z]
            begin = z

    def _of_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, parts))
        fresh = [p for p, x in zip(parts, found) if x is None]
        if fresh:
            again = [(p, self.before[p]) for p in fresh if p in self.before]
            self.known.update(again)
            if len(again) < len(fresh):
                self._learn([p for p in fresh if p not in self.before])
            found = list(map(self.known.__getitem__, parts))
        return found

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.lower().encode("latin-1") for t in texts]
        chars = np.frombuffer(b"\n".join(raw), np.uint8)
        starts = part_starts(chars)
        solid = KIND[chars] != WHITE
        packed = chars[solid]
        offsets = np.append(np.nonzero(starts[solid])[0], len(packed)).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        ids = self._of_parts(cells.dictionary.to_pylist())
        which = cells.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        joined = flat[np.arange(upto[-1]) + np.repeat(at[which] - upto[:-1], n)].tobytes()
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        done = 4 * upto[np.concatenate(([0], np.cumsum(starts)))[np.minimum(ends, len(chars))]]
        return [joined[a:z] for a, z in zip([0, *done[:-1].tolist()], done.tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each of a few texts."""
        plain = [bool(PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        made = iter(self._plain([t for t, ok in zip(texts, plain) if ok])) if any(plain) else iter(())
        whole = lambda t: np.asarray(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return [next(made) if ok else whole(t) for t, ok in zip(texts, plain)]


@lru_cache(1)
def tokenizer(vocabulary: str):
    """One per worker process; of a fixed size, whatever passes through it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _few(texts: list[str | None]):
    """Runs of consecutive texts of about HELD characters; a longer text comes alone."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > HELD:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``(rid, id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut at ``capacity``.

    Null texts are empty and give the end id alone; texts of any length are encoded whole; repeated rows and
    ids are rows of their own; other columns do not matter, nor do their names; an empty table gives an empty result. ``vocabulary`` is the path of
    a tokenizers file, the same on every machine.
    """

    def run(batches):
        known = TextIds(tokenizer(vocabulary))  # what is learnt goes with the task
        end, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for b in few_rows(batches):
            rows: list[tuple] = []
            made = (ids + end for few in _few(b.column(2).to_pylist()) for ids in known.ids(few))
            for i, ids in enumerate(made):
                rows += [(i, k, a // 4, min(step, len(ids) - a) // 4, zlib.crc32(ids[a : a + step])) for k, a in enumerate(range(0, len(ids), step))]
            i, piece, start, length, crc = zip(*rows) if rows else ([],) * 5
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["rid", "id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"rid long, id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, and the final gap of each bin."""
    n = np.zeros(capacity + 1, np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        g = np.nonzero(n[s:capacity])[0] + s
        best, cost = capacity, 2 * n[capacity - s] + 1 if s < capacity else 0
        if len(g):
            left = g - s
            costs = np.where(left > 0, 2 * (n[left] - n[g]) + 2, 1 - 2 * n[g])
            k = int(np.argmin(costs))  # the first, that is the smallest gap
            if costs[k] <= cost:
                best = int(g[k])
        if best == capacity:
            at = len(gaps)
            gaps.append(capacity)
        else:
            at = free[best].pop()
            n[best] -= 1
        where[i], offset[i] = at, capacity - best
        gaps[at] = best - s
        if best > s:
            free[best - s].append(at)
            n[best - s] += 1
    return where, offset, np.asarray(gaps, np.int64)


def _pack_round(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """Adds sequence_id, offset and the sequence's gap; each partition packs its own rows."""
    base = level << 56

    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (first := next(batches, None)) is None else pa.Table.from_batches([first, *batches])
        table = table.sort_by([("length", "descending"), ("rid", "ascending"), ("piece", "ascending")])
        where, offset, gaps = sum_of_squares(table.column("length").to_numpy(), capacity)
        seq = where + (base + (TaskContext.get().partitionId() << 32))
        for k, c in (("sequence_id", seq), ("offset", offset), ("gap", gaps[where])):
            table = table.append_column(k, pa.array(c, pa.int64()))
        yield from table.to_batches(10_000)

    def guarded(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            yield from run(iter([first, *batches]))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(shards, F.xxhash64("rid", "piece", F.lit(level))).mapInArrow(guarded, f"{fields}, sequence_id long, offset long, gap long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (columns rid, piece, length among others) with ``sequence_id`` and ``offset``.

    Every piece is placed once; the pieces of a sequence lie gapless from offset
    0 and fit in ``capacity``. Pieces that have no room for the shortest one need no
    packing. A task packs ``shard`` pieces in expectation, whatever their lengths.
    Empty input gives an empty result. Pieces of equal length are taken by rid and piece; repeated
    pieces are pieces of their own; columns of the names made here are not allowed.
    """
    pieces = cut(pieces)
    length, gap = F.col("length"), F.col("gap")
    least = pieces.agg(F.min("length")).first()[0] or 0
    whole = pieces.where(length + least > capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level = pieces.where(length + least <= capacity), [whole], FIRST_LEVEL
    n, before, bins = rest.count(), None, None
    while n:
        shards = -(-n // shard)
        packed = cut(_pack_round(rest, shards, level, capacity))
        is_open = gap > OPEN_SHARE * capacity
        counts = packed.groupBy(is_open.alias("open"), "length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect()
        made = sum(c.bins for c in counts)
        if before is not None and made > bins:  # the round before did better
            done.append(before)
            break
        if shards == 1 or level == LAST_LEVEL or (before is not None and made > bins - shards):
            done.append(packed.drop("gap"))
            break
        least = min((c.length for c in counts if c.open), default=capacity)
        joins = is_open & (length + least <= capacity)
        done.append(packed.where(~joins).drop("gap"))
        before = packed.where(joins).drop("gap")
        rest = before.drop("sequence_id", "offset")
        left = [c for c in counts if c.open and c.length + least <= capacity]
        n, bins, level = sum(c.n for c in left), sum(c.bins for c in left), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
