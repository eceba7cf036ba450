import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import scores as S
from tessella.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_fuzzy_goldens():
    assert S.fuzzy("demo", "demo.py") == (pytest.approx(1.0), [0, 1, 2, 3])
    assert S.fuzzy("dmo", "demo.py")[0] == pytest.approx(0.8718, abs=1e-4) and S.fuzzy("DEMO", "demo.py")[0] == pytest.approx(0.9070, abs=1e-4)
    assert S.fuzzy("py", "demo.py")[0] == 1.0 and S.fuzzy("xyz", "demo.py") == (0.0, []) and S.fuzzy("demo", "dem.py") == (0.0, []) and S.fuzzy("", "x") == (1.0, [])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=6), st.text(max_size=20))
def test_fuzzy_properties(p, c):
    score, at = S.fuzzy(p, c)
    assert 0 <= score <= 1 and not math.isnan(score) and at == sorted(set(at))


def brute_edits(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits(a, b):
    assert S.edit_distance(a, b) == brute_edits(a, b)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 2.0], 1.0), ([1.0, 0.0], [-3.0, 0.0], 2.0), ([0.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 1.0), (None, [1.0], 1.0), ([], [], 1.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double").withColumn("d", S.cosine_distance(F.col("a"), F.col("b")))
    assert all(r["d"] == pytest.approx(r["want"]) for r in df.collect())
    for a, b, want in rows:
        d = spark.createDataFrame([(a,)], "a array<float>").select(S.cosine_distance_to(F.col("a"), b).alias("d")).first()["d"]
        assert d == pytest.approx(want)


def test_paths(spark):
    cases = {
        "/a/b.tar.gz": ("b.tar.gz", "/a", "b.tar"), "/a//b/./c/../.config.toml": (".config.toml", "/a/b", ".config"), "x": ("x", "", "x"), "/x": ("x", "/", "x"),
        "": ("", "", ""), "/": ("", "", ""), ".": ("", "", ""), "a/": ("a", "", "a"), ".bashrc": (".bashrc", "", ".bashrc"), "/..": ("", "", ""), "../x.y": ("x.y", "..", "x"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", X.path_parts(F.col("p")).alias("r"))
    assert {r["p"]: tuple(r["r"]) for r in df.collect()} == cases


def test_contents(spark):
    cases = [(b"", False), (b"abc", True), (b"a\0b", False), (b"\xff\xfe", False), ("é".encode() * 5000, True), (b"x" + "é".encode() * 5000, True), (b"a" * 8000 + b"\xff" + b"a" * 400, False), (b"\x10\x01" * 10, True), (None, False)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, w) for b, w in cases], "b binary, w boolean").select("w", X.is_text(F.col("b")).alias("g"))
    assert all(r["w"] == r["g"] for r in df.collect())
    assert one(spark, X.file_kind(F.lit("/a/B.JPG"))) == "image" and one(spark, X.file_kind(F.lit("x.weird"))) == "" and one(spark, X.file_kind(F.lit("x"), F.lit(b"hi"))) == "text"
    assert one(spark, X.media_type(F.lit("a.mov"))) == "video/quicktime" and one(spark, X.preview(F.lit(b"hello"))) == "hello"


def test_chunks(spark):
    def loop(n):
        out, at = [], 0
        while n:
            out.append((at, min(2000, n - at)))
            if at + 2000 >= n:
                break
            at += 1800
        return out

    sizes = [0, 1, 1999, 2000, 2001, 3800, 3801, 5600, 12345]
    df = spark.createDataFrame([(n, bytearray(b"a" * n)) for n in sizes], "n int, b binary").select("n", X.byte_chunks(F.col("b")).alias("c"))
    for r in df.collect():
        assert [(x["chunk_index"] * 1800, len(x["content"])) for x in r["c"]] == loop(r["n"])
    assert [tuple(x) for x in one(spark, X.time_ranges(F.lit(60.0)))] == [(0, 30), (25, 55), (50, 60)] and one(spark, X.time_ranges(F.lit(0.0))) == []
    assert [tuple(x) for x in one(spark, X.page_ranges(F.lit(12)))] == [(1, 6), (6, 11), (11, 12)] and [tuple(x) for x in one(spark, X.page_ranges(F.lit(6)))] == [(1, 6)]
    assert one(spark, F.size(X.document_chunks(F.lit("x" * 99)))) == 0 and one(spark, F.size(X.document_chunks(F.lit("x" * 100)))) == 1


@pytest.mark.parametrize(
    ("q", "kind"),
    [(q, "filename") for q in ("f:demo.py", "F:Report", "*.py", "demo.py", ".py")] + [(q, "hybrid") for q in ("getUserById", "report_q3", "helpers", "two words")]
    + [(q, "content") for q in ("the report", "find a movie about cats", "four word query without stopwords", "")],
)
def test_routes(spark, q, kind):
    assert one(spark, X.route(F.lit(q)))["kind"] == kind


def test_globs_and_ranges(spark):
    df = spark.createDataFrame([("/a/file_.go",), ("/a/file1.go",), ("/a/FILE.GO",), ("/a/x.py",)], "p string")
    hits = lambda g: {r[0] for r in df.filter(F.lower("p").rlike(X.glob_regex(g))).collect()}
    assert hits("*.py") == {"/a/x.py"} and hits("*file?.go") == {"/a/file_.go", "/a/file1.go"} and hits("file*") == set()
    assert [tuple(r) for r in one(spark, S.ranges(F.array(*map(F.lit, (0, 1, 2, 5, 7, 8)))))] == [(0, 3), (5, 6), (7, 9)]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 9), (0, 2), (1, 4), (8, 40), (50, 60))])
    assert [tuple(r) for r in one(spark, S.merged_ranges(spans, F.lit(20)))] == [(0, 4), (5, 20)]


def test_occurrences(spark):
    cases = {"abcABC.ab": [(0, 3), (3, 6)], "éabc": [(2, 5)], "": [], "ab": [], "xxabcxx": [(2, 5)]}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.occurrences(F.col("s"), "aBc").alias("r"))
    assert {r["s"]: [tuple(x) for x in r["r"]] for r in df.collect()} == cases


def test_registered(spark):
    from tessella.functions.registered import register

    register(spark)
    assert spark.sql("SELECT edits('imgae', 'image') AS e").first()["e"] == 1
    assert spark.sql("SELECT count(*) AS n FROM chunk_text(repeat('a', 2001))").first()["n"] == 2
    assert spark.sql("SELECT fuzzy_match('dm', 'demo').matched AS m").first()["m"] == [0, 2]


def test_embedding(spark):
    from tessella.sources import embedding as E

    waits, calls = [], iter([ConnectionError(), ConnectionError(), [[1.0]]])

    def call(_):
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert E.with_retries(call, ["a"], waits.append) == [[1.0]] and waits == [2.0, 4.0]
    with pytest.raises(E.CountMismatch):
        E.with_retries(lambda t: [], ["a"])
    assert E.from_bytes(E.to_bytes([1.5, -2.0])) == [1.5, -2.0]
    with pytest.raises(ValueError):
        E.from_bytes(b"abc")
    df = E.embed(spark.createDataFrame([(k, f"t{k % 3}") for k in range(10)], "k int, text string"), E.stand_in(4), batch=3)
    by = {}
    for r in df.collect():
        by.setdefault(r["text"], set()).add(tuple(r["embedding"]))
    assert len(by) == 3 and all(len(v) == 1 for v in by.values())


def test_shown_sizes(spark):
    import duckdb

    shown = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END"
    sizes = [None, -5, 0, 1023, (1 << 63) - 1, (1 << 53) + 1]
    for power, step in ((10, 512), (20, 1 << 18), (30, 1 << 28)):  # halves, and their neighbours
        sizes += [(1 << power) + k * step + x for k in range(40) for x in (-1, 0, 1)] + [(1 << power + 10) - step + x for x in (-1, 0, 1)]
    con = duckdb.connect()
    expected = [con.execute(f"SELECT {shown} FROM (SELECT ?::BIGINT AS n)", [n]).fetchone()[0] for n in sizes]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(sizes)), "k long, n long").orderBy("k").select(X.shown_size(F.col("n"))).collect()]
    assert [x for x in zip(sizes, expected, got, strict=True) if x[1] != x[2]] == []


def test_settings(spark):
    from tessella.operators import tables as T

    s = T.put_setting(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), "a", "9")
    assert {tuple(r) for r in s.collect()} == {("a", "9"), ("b", "2")}
    n = T.with_name(T.with_name(spark.createDataFrame([("x",)], "pattern string"), "y"), "y")
    assert sorted(r[0] for r in n.collect()) == ["x", "y"] and T.without_name(n, "x").count() == 1
