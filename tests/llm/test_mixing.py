import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    p = M.Permutation(n, "x")
    k = np.arange(n)
    assert sorted(p.at(k).tolist()) == list(range(n))
    assert (p.where(p.at(k)) == k).all()
    assert n < 60 or (p.at(k) != M.Permutation(n, "y").at(k)).any()


def test_targets_stop_at_twice_the_size():
    t = M.targets({"b": 100, "a": 10, None: 50, "c": 40, "d": 0})
    assert list(t) == ["a", "b", "c", "d", None]
    assert t["a"] == 20 and t["d"] == 0 and abs(sum(t.values()) - 300) < 1e-9
    assert all(t[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 50, "c": 40}.items())
    assert M.targets({}) == {} and M.targets({"x": 0}) == {"x": 0}


@pytest.mark.parametrize(("size", "target"), [(1, 2.0), (5, 7.4), (128, 128.0), (129, 130.9), (1000, 1999.0), (1000, 999.0), (1000, 2000.0), (777, 0.4)])
def test_slots_hold_the_target_exactly(size, target):
    s = M.source("sx", size, target, 16, 0)
    words = 0
    for k in range(s.slots):
        b = int(M.Permutation(s.blocks, f"0/{k // s.blocks}/sx").at(k % s.blocks)[0])
        n = min(16, size - b * 16)
        words += s.last if s.last and k == s.slots - 1 else n
    assert words == int(target)


def test_shards_draw_what_there_is():
    slots = np.array([500, 3, 0, 1200])
    n = -(-int(slots.sum()) // 100)
    draws = [M.shard_draw(slots, i, 100, 7) for i in range(n)]
    assert (sum(c for c, _ in draws) == slots).all()
    at = np.zeros(4, int)
    for c, first in draws:
        assert (first == at).all()
        at += c
    assert all(c.sum() == 100 for c, _ in draws[:-1]) and len({tuple(c) for c, _ in draws}) > 3
    big = M._split(np.array([10**12, 3 * 10**12]), 10**11, np.random.default_rng(1))
    assert big.sum() == 10**11 and abs(big[0] / 10**11 - 0.25) < 1e-3


@pytest.mark.parametrize(("good", "bad", "n"), [(7, 5, 6), (40, 300, 60), (300, 40, 250), (5000, 9000, 1200), (3, 10**6, 5), (12, 4, 9)])
def test_draws_follow_the_distribution(good, bad, n):
    from math import comb

    rng = np.random.default_rng(good)
    draws = Counter(M.hypergeometric(good, bad, n, rng) for _ in range(20_000))
    assert sum(draws.values()) == 20_000
    total = comb(good + bad, n)
    far = 0.0
    for x in range(max(0, n - bad), min(good, n) + 1):
        p = comb(good, x) * comb(bad, n - x) / total if min(good, n) < 10**4 else 0.0
        far = max(far, abs(draws[x] / 20_000 - p) / max(0.002, (p * (1 - p) / 20_000) ** 0.5))
    assert far < 5


def test_draws_of_any_size_have_the_right_spread():
    rng = np.random.default_rng(2)
    good, bad, n = 3 * 10**11, 10**12, 10**11
    x = np.array([M.hypergeometric(good, bad, n, rng) for _ in range(4000)], float)
    p, total = good / (good + bad), good + bad
    deviation = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    assert abs(x.mean() - n * p) < 5 * deviation / 4000**0.5 and abs(x.std() / deviation - 1) < 0.06


def test_very_long_text(spark, tmp_path):
    rows = [(1, "long word " * 200_000, "a"), (2, "short", "a"), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in M.op1_source_mixing(spark, str(tmp_path)).collect()}
    assert got[1]["size"] == 400_000 and got[1]["taken"] + got[2]["taken"] == int(got[1]["target"]) and got[3]["taken"] == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(4), []
    for k in range(400):
        text = rng.choice([None, "", " \n"]) if k % 40 == 0 else " ".join(f"w{k}x{j}" for j in range(rng.randrange(1, 400)))
        rows.append((k, text, rng.choice(["a", "a", "a", "b", "c", None, "é"]), "clash", 1))
    rows += [rows[5], rows[5], rows[40], rows[40], (None, "no number here", "b", "clash", 1), (9999, "lonely", "zz", "clash", 1)]
    path = str(tmp_path_factory.mktemp("mix"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, key string, part int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_query(spark, folder):
    path, rows = folder
    got = M.op1_source_mixing(spark, path).collect()
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(x)) for d, x, *_ in rows)
    sizes = Counter()
    for _, x, s, *_ in rows:
        sizes[s] += size(x)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    want = M.targets(dict(sizes))
    assert {(sizes[s], round(t, 6)) for s, t in want.items()} == set(by)
    for (_, target), own in by.items():
        assert abs(sum(own) - target) <= 1
    again = M.op1_source_mixing(spark, path).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_pieces_against_a_plain_walk(spark, folder):
    m = M.mix(spark.read.parquet(f"{folder[0]}/documents.parquet"), block=16, shard=50)
    docs = {(r["key"], r["part"], r["number"]): r for r in m.documents.collect()}
    got = Counter()
    for p in m.pieces.collect():
        d = docs[p["key"], p["part"], p["number"]]
        for w in range(p["from_word"], p["to_word"]):
            assert (d["start"] + w) // 16 == p["block"]
            got[p["key"], d["start"] + w, p["pass"]] += 1
    want = Counter()
    for s in m.sources.values():
        for k in range(s.slots):
            b = int(M.Permutation(s.blocks, f"0/{k // s.blocks}/{s.key}").at(k % s.blocks)[0])
            n = s.last if s.last and k == s.slots - 1 else min(16, s.size - 16 * b)
            for w in range(16 * b, 16 * b + n):
                want[s.key, w, k // s.blocks] += 1
    assert got == want and set(got.values()) == {1}


def test_documents_of_a_mix(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumn("n_chars", M.F.length("text").cast("long"))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    texts = {}
    for d, x, *_ in folder[1]:
        texts.setdefault(d, set()).add(x)
    words = Counter()
    for r in rows:
        have = set(next(iter(texts[r["doc_id"]])).split())
        assert set(r["text"].split()) <= have and r["n_chars"] == len(r["text"]) and r["key"] == "clash"
        words[r["source"]] += len(r["text"].split())
    m = M.mix(docs)
    assert all(abs(words[s] - x.target) <= 1 for s, x in m.sources.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.taken(M.mix(docs)).count() == 0 and M.mixed_documents(docs).count() == 0
