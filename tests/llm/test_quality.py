import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\v\x1c\x85\xa0#é", max_size=80))
def test_counts(text):
    assert Q.measured(text)[:5] == brute(text)


def test_counts_of_repeats():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(60))]
        text = " ".join(words + words[5:25] + words[: rng.randrange(20)])
        assert Q.measured(text)[:5] == brute(text)
    assert Q.measured(None) == Q.measured("") == (0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert Q.measured("a " * 30_000)[4] == 30_000


def prose(rng, n):
    return " ".join(rng.choice("the of and water letters reading in corpus with that stone river".split()) for _ in range(n))


def test_fences_follow_their_group(spark, tmp_path):
    rng, rows = random.Random(2), []
    for k in range(300):
        rows.append((k, prose(rng, 60), "en", "plain", "clash"))
    for k in range(300, 600):  # a source that marks its words up, all clean
        rows.append((k, " ".join(w + "#" for w in prose(rng, 60).split()), "en", "code", "clash"))
    junk = " ".join(w + "###" for w in prose(rng, 60).split())
    rows += [(1000, junk, "en", "plain", ""), (1001, junk.replace("###", "#"), "en", "plain", ""), (1002, " ".join(w + " " + w for w in prose(rng, 50).split()), "en", "plain", "")]
    rows += [(1003, None, "en", "plain", ""), (1004, "", None, None, ""), (1005, prose(rng, 60), None, None, ""), (1005, prose(rng, 60), None, "plain", ""), (None, prose(rng, 60), "xx", "rare", "")]
    rows += [(1006, prose(rng, 60).upper(), "en", "plain", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op4_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(600)) <= kept and {1005, None} <= kept
    assert not kept & {1000, 1001, 1002, 1003, 1004, 1006}


def test_sketches_merge(spark):
    rng = random.Random(3)
    values = [(str(k % 3), rng.lognormvariate(1, 1)) for k in range(3000)]
    df = spark.createDataFrame(values, "lang string, word_length double").withColumns({r: Q.F.lit(0.0) for r in Q.RATIOS if r != "word_length"})
    parts = Q.sketches(df, ["lang"])
    whole = Q.quartiles(Q.merged(parts, []), []).filter("ratio = 'word_length'").first()
    exact = sorted(v for _, v in values)
    for q in (25, 50, 75):
        assert abs(whole[f"q{q}"] / exact[int(3000 * q / 100) - 1] - 1) < 2.1 * Q.ERROR
    assert whole["total"] == 3000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judged(Q.measure(docs, ["doc_id", "lang", "source"])).count() == 0


def test_many_groups_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, prose(rng, 40), "en", f"s{k % 9}", 1) for k in range(60)] + [(99, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_words int")
    want = sorted(r["doc_id"] for r in Q.filtered(docs).collect())
    monkeypatch.setattr(Q, "BROADCAST", 2)
    out = Q.filtered(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == want == list(range(60))


def brute_kept(rows):
    """Verdicts of (text, lang, source) by exact walks over all values: no sketches of Spark, no windows, no joins."""
    import math
    from collections import Counter, defaultdict

    step = math.log((1 + Q.ERROR) / (1 - Q.ERROR))
    measures = []
    for text, lang, source in rows:
        n, chars, symbols, dup, repeat, lines, stutter, upper = Q.measured(text)
        own = {"word_length": chars / max(1, n), "symbol_share": symbols / max(1, n), "dup_line_share": dup / max(1, lines), "repeat_share": repeat / max(1, n), "stutter_share": stutter, "upper_share": upper}
        measures.append((lang, source, n < 20 or 100 * repeat > 30 * n, own))
    place = lambda v: -math.inf if v < Q.SMALLEST else math.ceil(math.log(v) / step)
    value = lambda b: 0.0 if b == -math.inf else math.exp(b * step) * (1 - Q.ERROR)
    groups = defaultdict(lambda: defaultdict(list))
    for lang, source, failed, own in measures:
        if not failed:
            for key in ((2, lang, source), (1, lang), (0,)):
                for r, v in own.items():
                    groups[key][r].append(place(v))

    def limits(places, both):
        places = sorted(places)
        n = len(places)
        q = [value(places[math.ceil(n * k / 4) - 1]) for k in (1, 2, 3)]
        high, low, best = math.inf, -math.inf, math.log(Q.GAP)
        at = sorted(Counter(places).items())
        log = lambda b: max(math.log(Q.FLOOR), b * step)
        for i, (a, _) in enumerate(at):
            if sum(c for _, c in at[: i + 1]) < n / 2:
                continue
            for j in range(i + 1, len(at)):
                within, above = sum(c for _, c in at[i + 1 : j]), sum(c for _, c in at[j:])
                if within <= min(Q.DIRT * n, above / 4) and log(at[j][0] - 1) - log(a) > best:
                    best, high = log(at[j][0] - 1) - log(a), math.exp((log(at[j][0] - 1) + log(a)) / 2)
        if q[1] >= Q.FLOOR:
            s = Q.SPREADS * min(q[1] - q[0], q[2] - q[1]) + Q.NEAR * q[1]
            high = min(high, q[1] + s)
            low = q[1] - s if both else low
        return low, high

    known, out = {}, []
    for lang, source, failed, own in measures:
        ok = not failed
        for r, both in Q.RATIOS.items():
            key = next((k for k in ((2, lang, source), (1, lang)) if len(groups[k][r]) >= Q.LEAST), (0,))
            if groups[key][r]:
                if (key, r) not in known:
                    known[key, r] = limits(groups[key][r], both)
                low, high = known[key, r]
                ok = ok and low <= own[r] <= high
        out.append(ok)
    return out


def test_kept_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for k in range(700):  # groups with many and few clean, noisy and junk documents
        words = prose(rng, rng.randrange(20, 90)).split()
        share = rng.choice([0, 0, 0.02, 0.1, 0.3, 0.9]) if k % 3 else 0
        text = " ".join(w + "#" * (rng.random() < share) for w in words)
        rows.append((text, rng.choice(["en", "xx", None]), rng.choice(["a", "b", None])))
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    got = {r["doc_id"]: r["kept"] for r in Q.judged(Q.measure(docs, ["doc_id", "lang", "source"])).collect()}
    want = dict(enumerate(brute_kept(rows)))
    assert got == want and 100 < sum(want.values()) < len(want) - 100


def marked(rng, ratio, share, n=60):
    """A text with about that share."""
    words = [w for w in prose(rng, n).split()]
    if ratio == "word_length":
        return " ".join(w + "x" * round(share * 20) for w in words)
    if ratio == "symbol_share":
        return " ".join(w + "#" * (rng.random() < share) for w in words)
    if ratio == "upper_share":
        return " ".join(w.upper() if rng.random() < share else w for w in words)
    if ratio == "stutter_share":
        return " ".join(f"{w} {w}" if rng.random() < share else w for w in " ".join(f"u{k}" for k in range(n)).split())
    if ratio == "dup_line_share":
        return "\n".join(f"{words[k]} u{k}" + "\nthe same line" * (rng.random() < share) for k in range(30))
    words = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    return " ".join(words + words[: round(share * 400)])


def test_same_text_kept_here_and_rejected_there(spark):
    for ratio, share in {"word_length": 0.5, "symbol_share": 0.5, "dup_line_share": 0.8, "repeat_share": 0.13, "stutter_share": 0.6, "upper_share": 0.6}.items():
        rng = random.Random(ratio)
        low = 0.15 if ratio == "repeat_share" else 1.0
        rows = [(marked(rng, ratio, 0), "en", "plain") for _ in range(200)] + [(marked(rng, ratio, low * rng.random()), "en", "rich") for _ in range(200)]
        text = marked(rng, ratio, share)
        rows += [(text, "en", "plain"), (text, "en", "rich")]
        docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
        got = {r["doc_id"]: r["kept"] for r in Q.judged(Q.measure(docs, ["doc_id", "lang", "source"])).collect()}
        assert (got[400], got[401]) == (False, True), ratio


def test_labelled_documents(spark):
    """Of those that pass the base rules, the good ones stay and the bad ones go."""
    folder = "/root/testdata/sf0.01"
    got = Q.judged(Q.measure(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "lang", "source"])).filter("not base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share = {r["quality"]: r["kept"] for r in got.join(labels, "doc_id").groupBy("quality").agg(Q.F.avg(Q.F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1
