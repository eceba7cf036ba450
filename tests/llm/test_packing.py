import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, World.  hello\tworld\n\nÉté İstanbul ΣΑΣ Σ. naïve é don't I'LL 's", "a<|endoftext|>b <|startoftext|>", "x y\x1cz\x85w\x0bv", "...,,, a.. b., .c", "ﬁ ǅ straße STRASSE K", "ªº µ ÿ ß ÀÖØÞ÷× naïve", "word " * 9000, "\U0001f600!! ###"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer):
    ids = P.Ids(PATH)
    for _ in range(2):
        for x in TEXTS:
            assert np.frombuffer(ids.of(x or ""), "<u4").tolist() == plain(tokenizer, x)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sTéÉİΣσ́\x1c\x85\xa0 aB1#"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_any_ids(text):
    if not hasattr(test_any_ids, "ids"):
        test_any_ids.t, test_any_ids.ids = Tokenizer.from_file(PATH), P.Ids(PATH)
    assert np.frombuffer(test_any_ids.ids.of(text), "<u4").tolist() == plain(test_any_ids.t, text)


def test_every_letter_before_a_mark(tokenizer):
    ids, texts = P.Ids(PATH), []
    for c in filter(str.isalpha, map(chr, range(0x110000))):
        texts += [f"{c}.", f"ab{c},", f"{c}{c}. {c}"]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert not [x for x, e in zip(texts, want) if np.frombuffer(ids.of(x), "<u4").tolist() != e.ids]


def test_mixed_scripts(tokenizer):
    rng, ids = random.Random(9), P.Ids(PATH)
    letters = [*"aZéİΣςжЇßﬁǅ日本가각ㅏ", *map(chr, (0x958, 0x9DF, 0xA33, 0xB5C, 0xFB1D, 0x5D0, 0x627, 0x64E, 0x93C, 0x307, 0x301, 0x1100, 0x1161, 0x11A8, 0x1F88))]
    texts = ["".join(rng.choice([*letters, *letters, *".,. '-\n1"]) for _ in range(rng.randrange(1, 12))) for _ in range(100_000)]
    for a in range(0, len(texts), 20_000):
        for x, e in zip(texts[a:], tokenizer.encode_batch_fast(texts[a : a + 20_000], add_special_tokens=False)):
            assert np.frombuffer(ids.of(x), "<u4").tolist() == e.ids, x


def test_forgetting(monkeypatch, tokenizer):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    ids = P.Ids(PATH)
    for x in TEXTS[1:4] * 3:
        assert np.frombuffer(ids.of(x), "<u4").tolist() == plain(tokenizer, x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins, offsets, fills = P.best_fit(sizes, 50)
    assert sum(fills) == sum(sizes) and max(fills, default=0) <= 50
    order, open_ = sorted(range(len(sizes)), key=lambda i: -sizes[i]), []
    for i in order:  # brute force: the fullest bin with room
        fit = [f for f in open_ if f + sizes[i] <= 50]
        if fit:
            open_[open_.index(max(fit))] += sizes[i]
        else:
            open_.append(sizes[i])
    assert sorted(open_) == sorted(fills)


def check(rows, docs, tokenizer, limit):
    want = {}
    for d, x in docs:
        ids = [*plain(tokenizer, x), 1]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want.setdefault((d, k // limit, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())), 0)
            want[(d, k // limit, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    got, seqs = {}, {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= limit
    return len(seqs), sum(r["length"] for r in rows)


def test_query(spark, tmp_path, tokenizer):
    rng = random.Random(1)
    docs = list(enumerate(TEXTS)) + [(100 + k, " ".join(rng.choice(["alpha", "beta", "corpus"]) for _ in range(rng.randrange(900)))) for k in range(400)] + [(3, TEXTS[3]), (None, "no number")]
    spark.createDataFrame([(*d, "c", 5) for d in docs], "doc_id long, text string, bin string, offset int").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    n, total = check(P.op5_best_fit_packing(spark, str(tmp_path)).collect(), docs, tokenizer, P.LIMIT)
    assert n <= -(-total // P.LIMIT) * 1.02 + 1


def test_rounds_and_ids(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "NODE", 8)
    docs = [(k, "alpha " * (k % 37)) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    packed = P.pack(df, PATH, limit=64, keep_ids=True)
    n, total = check(packed.collect(), docs, tokenizer, 64)
    assert n <= -(-total // 64) * 1.1
    for r in P.sequences(packed).collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= 64 and r["ids"].count(1) == len(r["doc_ids"])


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
