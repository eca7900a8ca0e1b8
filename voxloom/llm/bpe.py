"""Byte-level BPE: texts to token ids and back, by a trie of the words.

A part of a valid encoding is valid, and tokens side by side are valid if each two
neighbours are: merging their bytes gives just these two again. So a word's
encoding is known from one state a prefix, the last token of the prefix's encoding: the
one token that ends there and may stand behind the state where it begins. The
distinct words of a few texts go into a trie, and a depth-first walk carries
the states down, so that what words share at their head is encoded once. In sorted
order words lie as that walk meets them; the states on the path to a word are a stack.

Texts stay in their partition: nothing is shuffled, and a task remembers a bounded
number of words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows

#: How a text falls into words: a fixed value of the vocabulary's family.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A place that always parts two words.
SAFE = regex.compile(r"(?<=[a-z])(?= [a-z])")
#: Characters that are parted at a time, and words that a task remembers: twice as many at most.
HELD, REMEMBERED = 1 << 20, 80_000
#: Pairs of tokens whose test a worker remembers.
PAIRS = 200_000
NEVER = 1 << 62


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: bytes that print stand for themselves, the others follow from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file; merges stand in the order in which they were learnt."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        as_byte = byte_of_char()
        raw = lambda token: bytes(map(as_byte.__getitem__, token))
        names = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.ids = {raw(t): i for t, i in names.items() if t not in self.special}
        self.pieces = [b""] * (1 + max([*names.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.pieces[i] = t
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # of a merged token: left, right, rank
        for k, m in enumerate(told["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, whole = names[a], names[b], names[a + b]
            self.rank[left, right] = k
            self.halves.setdefault(whole, (left, right, k))
        sizes: dict[bytes, set[int]] = {}
        for t in self.ids:
            sizes.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {tail: sorted(n, reverse=True) for tail, n in sizes.items()}  # of the tokens that end in (up to) three bytes
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self._apart: dict[int, bool] = {}

    def edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one side (0 left, 1 right) of a token while it is merged, and the rank of the merge that ends it."""
        known = self._edges[side]
        if token not in known:
            chain, end, t = [], NEVER, token
            while True:
                chain.append((t, end))
                if t not in self.halves:
                    break
                end, t = self.halves[t][2], self.halves[t][side]
            known[token] = chain[::-1]
        return known[token]

    def apart(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        if (known := self._apart.get(pair)) is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            known = self._apart[pair] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` in a row are merged into these two tokens again.

        They are unless, at some time, the edges that face each other merge before either
        goes into a larger part of its own token; of equal merges the left one comes first.
        """
        left, right = self.edges(a, 1), self.edges(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            meet = self.rank.get((x, y), NEVER)
            if meet < x_ends and meet <= y_ends and meet != NEVER:
                return False
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _sizes_at(self, w: bytes, d: int) -> Iterator[int]:
        """Sizes that a token at the end of the first ``d`` bytes may have, longest first."""
        for n in self.sizes.get(w[d - 3 : d], ()) if d >= 3 else ():
            if n <= d:
                yield n
        if d >= 2:
            yield 2
        yield 1

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, depth first through the words' trie."""
        ids, apart, pieces = self.ids, self.apart, self.pieces
        last, before = [-1], b""  # last[d]: the last token of the first d bytes
        for w in sorted(set(words)):
            shared = len(commonprefix((before, w)))
            del last[shared + 1 :]
            for d in range(shared + 1, len(w) + 1):
                n = len(pieces[last[-1]]) + 1 if d > 1 else 1  # the state before, one byte longer, is the likeliest
                if (t := ids.get(w[d - n : d])) is None or n < d and not apart(last[d - n], t):
                    t = next(t for n in self._sizes_at(w, d) if (t := ids.get(w[d - n : d])) is not None and (n == d or apart(last[d - n], t)))
                last.append(t)
            out, d = [], len(w)
            while d:
                out.append(last[d])
                d -= len(pieces[last[d]])
            yield w, out[::-1]
            before = w


@lru_cache(1)
def vocabulary_at(path: str) -> Vocabulary:
    """One per worker process; of a fixed size, whatever passes through it."""
    return Vocabulary(path)


@lru_cache(4096)
def _is_new(char: str) -> bool:
    return unicodedata.category(char) == "Cn"


def sections(text: str, held: int = HELD) -> Iterator[str]:
    """A long text in pieces of some ``held`` characters, cut where words part whatever stands around."""
    a = 0
    while len(text) - a > held and (m := SAFE.search(text, a + held)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def text_words(text: str) -> list[str]:
    """The words of a text without special tokens; white space goes with them, nothing is lost.

    Characters younger than Python's tables may be classed otherwise by the vocabulary's
    library, so texts that hold some are parted by that.
    """
    if not text.isascii() and any(map(_is_new, set(text))):
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:z] for _, (a, z) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    return WORD.findall(text)


class WordMemory:
    """Ids of texts; words are encoded once as long as they are remembered.

    A full memory is set aside; what is still in use moves on to the next, the rest goes.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        fresh = words.difference(self.known)
        again = fresh.intersection(self.before)
        self.known.update((w, self.before[w]) for w in again)
        named = {w.encode(): w for w in fresh - again}
        for raw, ids in self.vocabulary.encode(named):
            self.known[named[raw]] = np.asarray(ids, "<u4").tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        words = [text_words(t) for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def _whole(self, text: str) -> bytes:
        """A long text, or one that holds special tokens."""
        special = self.vocabulary.special
        out = []
        for k, part in enumerate(self.vocabulary.parts.split(text) if special else [text]):
            out += [np.asarray([special[part]], "<u4").tobytes()] if k % 2 else [x for s in sections(part) for x in self._plain([s])]
        return b"".join(out)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            alone = len(t) > HELD or any(s in t for s in self.vocabulary.special)
            if held and (alone or size + len(t) > HELD):
                out += self._plain(held)
                held, size = [], 0
            if alone:
                out.append(self._whole(t))
            else:
                held.append(t)
                size += len(t)
        return out + self._plain(held) if held else out


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)``, one row per row of ``docs``: the token ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a byte-level BPE file, the same on every machine. Strings of
    special tokens become these tokens. Null and empty texts have no tokens; texts of any length
    are encoded whole; repeated rows and ids are rows of their own, an id may be null; an
    empty table gives an empty result. Other columns do not matter.
    """

    def run(batches):
        memory = WordMemory(vocabulary_at(vocabulary))  # what is learnt goes with the task
        for b in few_rows(batches):
            ids = memory.ids(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; special tokens stand as their strings.

    Ids outside the vocabulary are left out; bytes that are no UTF-8 become replacement characters;
    null ids give the empty text. A column named ``text_col`` is replaced.
    """
    kept = [f for f in coded.schema if f.name != text_col]
    at = [f.name for f in kept].index(ids_col)

    def run(batches):
        pieces = vocabulary_at(vocabulary).pieces
        for b in few_rows(batches):
            texts = []
            for ids in b.column(at).to_pylist():
                ids = np.frombuffer(ids or b"", "<u4")
                texts.append(b"".join(map(pieces.__getitem__, ids[ids < len(pieces)].tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*[f.name for f in kept], text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return coded.select([f.name for f in kept]).mapInArrow(run, f"{fields}, `{text_col}` string")
