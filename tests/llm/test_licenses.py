"""Licence windows against all windows of a text, and licences in the places where they occur."""

import random
from collections import Counter

import pytest

from tessella.llm import licenses as L
from tessella.llm.license_texts import TEMPLATES

BODIES = dict(TEMPLATES)
SOME = (("one", "a b c a b d e f g h"), ("two", "b c a b"), ("three", "x x x x x y"), ("four", "a long word stands among these few others here now"))


def windows(text, body):
    """(start, words, score) of all windows that open with a template's bigram, are at the threshold and no better one overlaps."""
    w, bag = L.normal(text).split(), L.bigrams(body)
    b = sum(bag.values())
    found = []
    for i in range(len(w) - 1):
        if f"{w[i]} {w[i + 1]}" in bag:
            part = w[i : i + b + 1]
            got = Counter(f"{x} {y}" for x, y in zip(part, part[1:], strict=False))
            score = 2_000_000 * sum((got & bag).values()) // (len(part) - 1 + b)
            if score >= 1000 * L.THRESHOLD:
                found.append((i, " ".join(part), score))
    return [x for x in found if not any(abs(x[0] - y[0]) <= b and (y[2], -y[0]) > (x[2], -x[0]) for y in found)]


def expected(text, templates):
    flat = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789\n" else " " for c in text.translate(str.maketrans(L.UPPER, L.LOWER)))
    parts, out = set(flat.split("\n")) | {flat.replace("\n", " ")}, set()
    block = []
    for line in [*flat.split("\n"), ""]:
        if line.strip():
            block.append(line)
        else:
            parts.add(" ".join(block))
            block = []
    for name, body in templates:
        bag = L.bigrams(body)
        b = sum(bag.values())
        for u in {L.normal(x) for x in parts}:
            got = L.bigrams(u)
            if got and 2000 * sum((got & bag).values()) >= L.THRESHOLD * (sum(got.values()) + b):
                out.add((name, 2_000_000 * sum((got & bag).values()) // (sum(got.values()) + b), u))
        out |= {(name, score, u) for _, u, score in windows(text, body)}
    return sorted(out)


def scanned(spark, texts, templates=TEMPLATES):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    return {r["n"]: [(m["license"], m["score"], m["unit"]) for m in r["matches"]] for r in L.scan(rows, ["n"], templates=templates).collect()}


def test_all_windows(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice("abcdefghxyz") for _ in range(rng.randrange(4))] + [rng.choice([x, x, "q"]) for x in rng.choice(SOME)[1].split()][rng.randrange(3) :]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", "\n\n", ", "]) for x in words))
    got = scanned(spark, texts, SOME)
    assert sum(map(bool, got.values())) > 100
    for n, text in enumerate(texts):
        assert got[n] == expected(text, SOME), text


def test_changed_licences(spark):
    """Words of whole licences dropped, changed and added, inside other words."""
    rng, texts = random.Random(6), []
    for _, body in TEMPLATES:
        for rate in (0, 0.03, 0.1):
            w = body.split(" ")
            w = [y for x in w for y in ([x] if rng.random() >= rate else rng.choice([[], ["other"], [x, "more"]]))]
            texts.append("some words first " + " ".join(w) + " and others, under a license, after")
    got = scanned(spark, texts)
    for n, text in enumerate(texts):
        assert got[n] == expected(text, TEMPLATES)


@pytest.mark.parametrize("name", ["BSD-3-Clause", "MIT", "Zlib", "PostgreSQL", "BSL-1.0"])
def test_first_words_do_not_matter(spark, name):
    w = BODIES[name].split()
    cut = ["Whereas", "nobody", "said", "so", *w[4:]]
    texts = ["on one line " + " ".join(cut) + " with more words", "\n".join(f" * {x}" for x in cut) + "\nint main;", "words " * 3000 + " ".join(cut) + " words" * 3000, " ".join(cut[: len(cut) // 2])]
    got = scanned(spark, texts)
    for n in range(3):
        assert any(x[0] == name and x[1] > 950_000 for x in got[n]), n
    assert all(x[0] != name for x in got[3])


def test_own_name_scores_best(spark):
    got = scanned(spark, [f"before it {body} after it" for _, body in TEMPLATES])
    for n, (name, _) in enumerate(TEMPLATES):
        assert (name, 1_000_000) in [x[:2] for x in got[n]]


def test_many_copies(spark):
    """A very long text with a thousand licences of one kind, and one with a template's words all over."""
    body = L.normal(BODIES["ISC"])
    got = scanned(spark, [" ".join(f"{body} number {k}" for k in range(1000)), "the software is provided as is and the software " * 20_000])
    assert [x for x in got[0] if x[0] == "ISC" and x[1] == 1_000_000] == [("ISC", 1_000_000, body)] and got[1] == []


def test_anchors_are_in_every_unit_at_the_threshold():
    for _, body in TEMPLATES:
        w, some = L.normal(body).split(), set(L.anchors(body))
        b = len(w) - 1
        assert sum(not {x, y} & some for x, y in zip(w, w[1:], strict=False)) < L.bounds(b)[0]
