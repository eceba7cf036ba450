import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, least=12):
    """All runs, by trying every period: a stretch that agrees with itself q words on, whose period is not a smaller one's multiple."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q) and not any(a <= s and e <= a + m and q % p == 0 for a, m, p in out):
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(texts, least=12, gram=6):
    sizes = np.asarray([len(x) for x in texts])
    ids = np.asarray([c for x in texts for c in x], np.int64)
    start, length, period = R.maximal_runs(ids, np.repeat(np.cumsum(sizes), sizes), least, gram)
    at, out = np.cumsum(sizes) - sizes, [[] for _ in texts]
    for s, m, q in zip(start.tolist(), length.tolist(), period.tolist()):
        k = int(np.searchsorted(np.cumsum(sizes), s, side="right"))
        out[k].append((s - int(at[k]), m, q))
    return out


block = st.lists(st.integers(0, 2), min_size=1, max_size=9)
periodic = st.lists(st.tuples(block, st.integers(1, 5)), max_size=6).map(lambda x: [c for b, k in x for c in b * k])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(periodic, st.lists(st.integers(0, 3), max_size=60)), min_size=1, max_size=4), st.sampled_from([(12, 6), (12, 2), (4, 2), (2, 1)]))
def test_runs(texts, bounds):
    assert runs(texts, *bounds) == [plain(x, bounds[0]) for x in texts]


def test_long(monkeypatch):
    rng = random.Random(4)
    fib = [1], [0]
    while len(fib[1]) < 700:
        fib = fib[1], fib[1] + fib[0]
    base = [rng.randrange(50) for _ in range(97)]
    texts = [[1] * 900, [1, 2] * 300 + [1], fib[1], base * 7 + base[:40], [rng.randrange(2) for _ in range(800)], list(range(500)) * 2, base + [7] * 30 + base + [7] * 30, []]
    want = [plain(x) for x in texts]
    assert runs(texts) == want and all(want[:-1])
    monkeypatch.setattr(R, "AT_ONCE", 8)
    assert runs(texts) == want


def test_work_grows_slowly():
    """Texts that make comparison by comparison square: one word, and a long period, a million words each."""
    one = R.maximal_runs(np.zeros(1_000_000, np.int64), np.full(1_000_000, 1_000_000))
    assert [x.tolist() for x in one] == [[0], [1_000_000], [1]]
    own = np.random.default_rng(1).integers(0, 1000, 100_000)
    two = R.maximal_runs(np.tile(own, 10)[:950_001], np.full(950_001, 950_001))
    assert (0, 950_001, 100_000) in set(zip(*[x.tolist() for x in two]))


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def contract(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found = plain(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("runs")), random.Random(5)
    line = "all of this is one line of words and no more\n"
    texts = [None, "", " \n\t", "one", "a " * 40, line * 5, "x\x85y z\xa0" * 30, "a b " * 7 + "c " * 20, "é " * 12, "A a " * 9]
    docs = [(k, texts[k % len(texts)]) for k in range(120)] + [(None, line * 3), (5, line * 5), (5, line * 5)]
    docs += [(200 + k, " ".join(rng.choice(["w1", "w2", "w3", *map(str, range(40))]) for _ in range(rng.randrange(1, 300)))) for k in range(200)]
    spark.createDataFrame([(*d, "c", 5, "w") for d in docs], "doc_id long, text string, runs string, g int, w string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = R.op11_periodic_runs(spark, folder).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(contract(r["doc_id"], r["text"]) for r in rows)
    assert any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 and r["n_runs"] for r in got if r["doc_id"] is not None)


def test_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(1).alias("extra"))
    for r in R.periodic_runs(docs, ["doc_id", "text", "extra"], least=4, gram=2).collect():
        w = WORD.findall(r["text"] or "")
        found = plain(w, 4)
        assert [tuple(x) for x in r["runs"]] == found
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found))
    assert R.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        runs([[1] * 20], 4, 6)
