import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = B.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = B.unpacked(B.packed_kinds())
TEXTS = [
    None, "", " ", "   ", "a", "Hello  world \n\n it's we'll I'd they're '", "don't'sing ''s !'s a'red 'r e 'rex 'll'l", "\t x\n y z　　q \r\n", "naïve 日本語 ١٢٣ ²½ Ⅷ 😀👩‍👩‍👧 é",
    "<|endoftext|>", "x" * 20_000, "ab" * 9000, " " * 5000 + "x", "word 's\n'sx 'S" * 500, "\x00\x1c\x85 ", "कि ক্ষ 가각", "''''s 're're 've'd",
]


def pieces(texts):
    sizes = np.asarray([len(x) for x in texts])
    ends = np.cumsum(sizes)
    at = B.boundaries("".join(texts), np.unique((ends - sizes)[sizes > 0]), TABLE)
    return at.tolist()


def wanted(texts):
    import regex

    out, base = [], 0
    for x in texts:
        out += [base + m.start() for m in regex.finditer(public_tokenizers.PATTERN, x)]
        base += len(x)
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé 's'rvelltmd\n\t1²! 日"), max_size=25), min_size=1, max_size=5), st.sampled_from([1, 3, 7, 1000]))
def test_boundaries(texts, window):
    before, B.WINDOW = B.WINDOW, window
    try:
        assert pieces(texts) == wanted(texts)
    finally:
        B.WINDOW = before


def test_many_blocks(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("ab 's'llre  \n1!") for _ in range(50_000))
    assert pieces([text, text[1:]]) == wanted([text, text[1:]])
    monkeypatch.setattr(B, "WINDOW", 999)
    assert pieces([text]) == wanted([text])


def test_every_character():
    """Each code point between a letter and a number, and in a run of its own."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c}{c}'s" for c in every)
    at = pieces([text])
    got = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
    assert [x for p in got for x in B.merged(p.encode(), RANKS)] == PLAIN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text(alphabet="aeinst h", max_size=200).map(str.encode)))
def test_merged(piece):
    if piece:
        assert B.merged(piece, RANKS) == PLAIN._encode_single_piece(piece)


def test_automaton():
    generator, compose, apply, _ = B.automaton()
    rng = random.Random(1)
    for _ in range(2000):
        f, g, h = (rng.randrange(len(apply)) for _ in range(3))
        assert compose[compose[f, g], h] == compose[f, compose[g, h]]
        assert (apply[g][apply[f]] == apply[compose[f, g]]).all()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("bpe")), random.Random(3)
    docs = list(enumerate(TEXTS)) + [(50 + k, "".join(rng.choice(" ab'sétmn\n12.,日") for _ in range(rng.randrange(400)))) for k in range(300)] + [(5, TEXTS[5])] * 2 + [(None, "no id")]
    spark.createDataFrame([(*d, "c", 5) for d in docs], "doc_id long, text string, ids string, offsets int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_query(spark, folder, monkeypatch):
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, B.op13_byte_bpe(spark, folder).collect())) == want


def test_offsets_and_parts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(1).alias("extra"))
    encoded = B.encode(docs, ["doc_id", "text", "extra"], PATH)
    for r in encoded.collect():
        raw, ends = (r["text"] or "").encode(), [*r["offsets"][1:], len((r["text"] or "").encode())]
        assert [PLAIN.decode_single_token_bytes(k) for k in r["ids"]] == [raw[a:b] for a, b in zip(r["offsets"], ends)]
    whole = B.decode(encoded, ["text"], PATH).collect()
    assert len(whole) == docs.count() and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in whole)
    part = encoded.filter(F.size("ids") > 4).select("text", F.slice("ids", 3, 2).alias("i"), F.slice("offsets", 3, 3).alias("o"))
    for r in B.decode(part.withColumn("o2", F.slice("o", 1, 2)), ["text", "o"], PATH, "i", "o2").collect():
        assert bytes(r["decoded"]) == r["text"].encode()[r["o"][0] : r["o"][2]]
    with pytest.raises(ValueError):
        B.Vocabulary(RANKS).decoded(np.asarray([5, 6]), np.asarray([0, 9]))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.decode(B.encode(none, ["doc_id"], PATH), ["doc_id"], PATH).count() == 0
