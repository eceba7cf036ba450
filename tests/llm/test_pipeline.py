"""The pipeline's stages, each on its own input, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from tessella.llm import mixing, quality, secret_scan
from tests.llm.test_near_dup import brute as near_brute

WORDS = [f"{a}{b}" for a in ("wa", "sto", "ri", "fie", "brid", "gre", "lea") for b in ("ter", "ne", "ver", "ld", "ge", "en", "ves")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(7), []
    for k in range(240):
        rows.append((k, prose(rng, rng.randrange(40, 200)), "en", f"s{k % 3}"))
    for k in range(240, 270):  # near copies
        words = rows[k - 240][1].split()
        words[len(words) // 2] = "changed"
        rows.append((k, " ".join(words), "en", "s1"))
    rows += [(270, rows[3][1], "en", "s2"), (271, prose(rng, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(rng, 20), "en", "s0")]
    rows += [(300 + k, " ".join(f"{w}###" for w in prose(rng, 60).split()), "en", "s0") for k in range(5)] + [(310, None, "en", "s0"), (311, "too short", None, None), (None, prose(rng, 80), None, None)]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame([(d, t, g, s, len(t) if t is not None else None) for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mix", "pack"]
    steps = dict(P.STAGES)

    kept = steps["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    verdict = quality.judged(quality.measure(docs, ["doc_id", "lang", "source"]))
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r["doc_id"] for r in verdict.collect() if r["kept"])
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert set(range(272)) <= ids and None in ids and not ids & {300, 301, 302, 303, 304, 310, 311}

    one = steps["near_duplicates"](spark, kept, folder)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {d for d, _, c, k in near_brute(rows, 5) if k or c is None}
    got = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and len(got) == len(set(got)) and set(got) == want and 240 not in want

    clean = steps["secrets"](spark, one, folder)
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (one, clean))
    scanner = secret_scan.Scanner(secret_scan.RULES)
    assert before.keys() == after.keys() and not any(scanner.spans(list(after.values())))
    assert {d for d in before if before[d] != after[d]} == {271} and "[SECRET]" in after[271]

    mixed = steps["mix"](spark, clean, folder)
    size = lambda x: len((x or "").split())
    sizes, words = Counter(), Counter()
    for r in clean.collect():
        sizes[r["source"]] += size(r["text"])
    for r in mixed.collect():
        words[r["source"]] += size(r["text"])
    assert mixed.columns == docs.columns
    assert all(abs(words[s] - t) <= 1 for s, t in mixing.targets(dict(sizes)).items())

    packed = steps["pack"](spark, mixed, folder).collect()
    assert len({r["doc_id"] for r in packed}) == len({r["doc_id"] for r in mixed.collect()})
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
