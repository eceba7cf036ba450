import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import near_dup as N


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, width=4, percent=80):
    """Rows (doc_id, number of shingles, component, kept) by comparing all pairs."""
    s = [sets(x, width) for _, x in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s[i]), least.get(top(i)), d is not None and d == least.get(top(i))) for i, (d, _) in enumerate(docs)]


def test_shingles():
    rng = random.Random(1)
    for n, v in ((0, 1), (1, 1), (3, 2), (4, 4), (60, 3), (500, 90), (9000, 8000)):
        words = [b"w%d" % rng.randrange(v) for _ in range(n)]
        for width in (4, 5):
            k = min(width, n)
            want = {tuple(words[i : i + k]) for i in range(n - k + 1)} if n else set()
            got = N.shingles(words, width)
            assert len(got) == len(want) == len(np.unique(got))
    assert set(N.shingles([b"a", b"b"], 4)) != set(N.shingles([b"b", b"a"], 4))


def test_signatures_estimate():
    rng = random.Random(2)
    base = [b"x%d" % rng.randrange(10**6) for _ in range(1000)]
    a, b = N.shingles(base[:900], 1), N.shingles(base[100:], 1)
    match = (N.signature(a) == N.signature(b)).mean()
    assert abs(match - 0.8) < 0.1


def test_sequential_test_misses_little():
    assert N.least_matches(80)[0][1] < N.BATCH * 0.8 and N.least_matches(80)[-1][1] > 120
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20_000, N._H), dtype=np.uint8)
    for p, low, high in ((0.8, 0.9999, 1), (0.5, 0, 0.001)):
        b = np.where(rng.random(a.shape) < p, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        assert low <= len(N.surviving(a, b, 80)[0]) / len(a) <= high


def test_chance_matches_of_long_texts():
    """Signature bytes of unrelated texts agree in one of 256 cases, however many shingles they have."""
    for n in (50, 3000):
        docs = [N.shingles([b"d%d-%d" % (k, j) for j in range(n)], 4) for k in range(24)]
        rows = []
        for x in docs:
            sig = N.signature(x)
            rows.append(N.bytes_of(sig))
        a = np.array([np.frombuffer(r, np.uint8) for r in rows])
        share = np.mean([(a[i] == a[j]).mean() for i in range(24) for j in range(i)])
        assert share < 2 / 256


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs = []
    for _ in range(60):
        docs.append(" ".join(word() for _ in range(rng.randrange(1, 120))))
    for _ in range(12):  # chains and clusters about the threshold
        base = [word() for _ in range(rng.randrange(20, 100))]
        for _ in range(rng.randrange(2, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    docs += [None, "", " \t\n", None, "one", "ONE", "one two three", "One two THREE", "Two one three", "É a b c d", "é a b c d", docs[0], docs[0], docs[1].upper(), "x\x1cy z\x85w", "a\xa0b"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows + [rows[0], (None, docs[3]), (None, "nobody else has this text at all"), (None, None)]


@pytest.mark.parametrize(("seed", "small", "chunk"), [(1, 48, 512), (2, 2, 4)])
def test_query_against_all_pairs(spark, tmp_path, monkeypatch, seed, small, chunk):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "CHUNK", chunk)
    docs = corpus(seed)
    spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, class string, label int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = N.op10_minhash_near_dedup(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(docs))


def test_large_components(spark, monkeypatch):
    """Ids of large components by broadcast, and by a join where there are too many."""
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(N, "LARGE", 3)
    for most in (8 << 20, 1):
        monkeypatch.setattr(N, "BROADCAST", most)
        assert Counter(map(tuple, N.near_duplicates(df).drop("text_hash", "component").collect())) == Counter(brute(docs))


def test_five_words(spark):
    docs = corpus(4)
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=5).drop("text_hash", "component").collect()
    assert Counter(map(tuple, got)) == Counter(brute(docs, 5))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201)]
    rng.shuffle(edges)
    key = lambda i: bytes([i])
    got = {r[0]: r[1] for r in N.components(spark.createDataFrame([(bytearray(key(a)), bytearray(key(b))) for a, b in edges], "a binary, b binary")).collect()}
    want = {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert {k[0]: v[0] for k, v in got.items()} == want


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each(spark):
    docs = corpus(6)
    df = spark.createDataFrame([(*d, "c", k) for k, d in enumerate(docs)], "doc_id long, text string, component string, __c1 int")
    out = N.deduplicated(df)
    assert out.columns == df.columns
    rows = out.collect()
    want = {d for d, n, c, kept in brute(docs) if n and kept}
    with_words = [r for r in rows if sets(r["text"], 4)]
    assert sorted(r["doc_id"] for r in with_words if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in with_words) == 1  # the null row whose text no other has
    assert len(rows) - len(with_words) == sum(not sets(x, 4) for _, x in docs)
