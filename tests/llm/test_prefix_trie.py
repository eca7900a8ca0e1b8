"""The trie of conversations against a plain one."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voxloom.llm import prefix_trie, ranks
from voxloom.llm.queries import op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, base=lambda c: c, heads=lambda c: 0):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    built = {c: tuple(own[c] if base(c) == c else own.get(base(c), [])[: heads(c)] + own[c][heads(c) :]) for c in own}
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_bytes = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * own_bytes + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
    ended = collections.defaultdict(list)
    for c in sorted(built):
        ended[built[c]].append(str(c))
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(ended[n]).encode()).hexdigest())
        for n in members
    )


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def many(seed, n=120, longest=6):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "c " * 9])))
    rnd.shuffle(rows)
    return rows


def test_plain_trie_of_odd_rows(spark):
    rows = many(1) + [(7, 0, "user", "a"), (7, 0, "user", "a"), (None, 1, "user", "lost"), (100_000, 0, "user", "long " * 200_000), (100_001, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], TURNS + ", depth int").repartition(6)
    assert found(prefix_trie.prefix_trie(df)) == plain_trie(rows)
    assert found(prefix_trie.prefix_trie(df.limit(0))) == []


def test_heads_of_other_conversations(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HEAVY", 20)  # some keys go by broadcast, the others by shuffle
    rows = many(2, longest=14)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    heads = lambda c: zlib.crc32(str(c).encode()) % 9
    conv = F.col("conv_id")
    got = found(prefix_trie.prefix_trie(df, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))
    want = plain_trie(rows, lambda c: c - c % 5, heads)
    assert got == want


def test_conversation_over_many_ranges_and_copies(spark):
    long = [(1, t, "user", f"t{t % 50}") for t in range(3000)]
    copies = [(c, t, "user", f"t{t}") for c in range(10, 900) for t in range(3)]
    alone = [(c, 0, "x", str(c)) for c in range(1000, 1400)]
    rows = long + copies + alone
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_trie(rows)


def test_turnless_conversations(spark):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)  # its base is absent
    rows = [(c, 0, "user", "gone")]
    conv = F.col("conv_id")
    got = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))
    assert got == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("listed", [1, 3, 256])
def test_end_lists(spark, monkeypatch, listed):
    monkeypatch.setattr(prefix_trie, "LISTED", listed)
    ends = [(1, 5, 6, c) for c in range(700)] + [(1, 5, 7, 3), (2, 5, 6, 4), (2, 5, 6, -1)]
    got = {tuple(r)[:3]: r.digest for r in prefix_trie.end_digests(spark.createDataFrame(ends, "depth long, h1 long, h2 long, conv_id long").repartition(5)).collect()}
    want = collections.defaultdict(list)
    for *k, c in sorted(ends):
        want[tuple(k)].append(str(c))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    assert found(op13_prefix_trie(spark, d)) == plain_trie(rows, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
