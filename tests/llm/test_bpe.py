"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from voxloom.llm import bpe
from voxloom.llm.queries import op11_bpe, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def library_ids(t, texts):
    return [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_token_is_its_own_encoding():
    v = bpe.Vocabulary(PATH)
    assert len(v.ids) == 50_256
    assert all(ids == [v.ids[w]] for w, ids in v.encode(v.ids))


def test_pairs_stay_apart_as_by_plain_merging():
    v, rnd = bpe.Vocabulary(PATH), random.Random(3)

    def merged(raw):
        parts = [v.ids[raw[i : i + 1]] for i in range(len(raw))]
        while True:
            found = [(v.rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in v.rank]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [v.ids[v.pieces[parts[i]] + v.pieces[parts[i + 1]]]]

    words = [t for t in v.ids if len(t) < 12]
    outcomes = set()
    for a, b in ((rnd.choice(words), rnd.choice(words)) for _ in range(3000)):
        stays = v.stay_apart(v.ids[a], v.ids[b])
        assert stays == (merged(a + b) == [v.ids[a], v.ids[b]]), (a, b)
        outcomes.add(stays)
    for t in rnd.sample(words, 1500):  # what a token itself is cut into
        for k in range(1, len(t)):
            if t[:k] in v.ids and t[k:] in v.ids:
                stays = v.stay_apart(v.ids[t[:k]], v.ids[t[k:]])
                assert not stays or merged(t) == [v.ids[t[:k]], v.ids[t[k:]]]
                outcomes.add(stays)
    assert outcomes == {True, False}


def test_words_of_all_characters():
    """One character of each block of eight and all of the first 12,000, between a letter, a digit, marks and spaces."""
    own, part = ByteLevel(add_prefix_space=False), lambda s, spans: [s[a:z] for a, z in spans]
    for c in [*range(12_000), *range(12_000, sys.maxunicode, 8)]:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)} b"
            assert bpe.text_words(s) == part(s, [o for _, o in own.pre_tokenize_str(s)]), hex(c)


def odd_texts():
    rnd = random.Random(1)
    chars = "aabcde  \n\t'st<|>endof ext12.,-éß漢字🙂‍՘\x1c    "
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "\n\n a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "I'll we've 'S 's", "a" * 5000, "=-" * 3000, " " * 700]
    return texts + ["lo" * 200_000 + " x y" * 400_000, "word " * 300_000 + "<|endoftext|>" + "word " * 300_000]


def test_ids_of_odd_and_long_texts(library):
    texts = odd_texts()
    v = bpe.Vocabulary(PATH)
    expected = library_ids(library, texts)
    assert bpe.WordMemory(v).ids(texts) == expected
    assert bpe.WordMemory(v, remembered=50).ids(texts[:500]) == expected[:500]  # words are forgotten and learnt again


def test_sections_part_nothing():
    text = "one two, three  four's five " * 50
    cut = list(bpe.sections(text, held=40))
    assert len(cut) > 20 and "".join(cut) == text
    assert [w for s in cut for w in bpe.text_words(s)] == bpe.text_words(text)
    assert list(bpe.sections("漢" * 100, held=40)) == ["漢" * 100]


def test_query_is_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_bpe(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (1, "a b", None), (1, "a b", None), (None, "<|endoftext|>", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH)
    back = sorted((r.id or 0, r.n_tokens, r.decoded) for r in bpe.decode(coded, PATH).collect())
    assert back == [(0, 1, "<|endoftext|>"), (1, 0, ""), (1, 2, "a b"), (1, 2, "a b")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    named = coded.withColumn("decoded", coded.n_tokens)
    assert bpe.decode(named, PATH).columns == ["id", "n_tokens", "ids", "decoded"]


def test_decoding_arbitrary_ids(spark, library):
    rnd = random.Random(5)
    lists = [[rnd.randrange(50_257) for _ in range(rnd.randrange(9))] for _ in range(400)] + [[60_000, 64], None]
    coded = spark.createDataFrame([(i, None if x is None else bytearray(np.asarray(x, "<u4").tobytes())) for i, x in enumerate(lists)], "id int, ids binary")
    got = {r.id: r.decoded for r in bpe.decode(coded, PATH).collect()}
    assert all(got[i] == ("" if x is None else library.decode(x, skip_special_tokens=False)) for i, x in enumerate(lists))
