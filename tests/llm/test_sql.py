"""Queries with SQL against it, on small tables with awkward rows."""

from collections import Counter

import duckdb
import pytest

from tessella.llm import chat as C
from tessella.llm import licenses as L
from tessella.llm.license_texts import TEMPLATES


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def rows_in(path, names, sql):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}/{n}.parquet/*.parquet')")
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    order = [cols.index(c) for c in sorted(cols)]
    return Counter(tuple(r[k] for k in order) for r in got.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql"))
    by = dict(TEMPLATES)
    docs = [
        (0, None), (1, ""), (2, " \n\t\n "), (3, "one"), (4, "Released under the MIT License."), (5, "prose\nLicensed under CC BY-NC 4.0.\nmore prose here"),
        (6, by["MIT"]), (7, "Head words\n\n" + by["BSD-3-Clause"] + "\n\ntail words"), (8, by["MIT"].replace("Software", "Program")), (9, "the " * 300),
        (10, by["MIT-notice"] + "\n" + by["MIT-notice"] + "\n" + by["GPL-3.0-notice"]), (11, "Éa released under the mit license é"), (12, by["Zlib"].upper() + "\n \n" + by["ISC"]),
        (4, "Released under the MIT License."), (None, by["Apache-2.0-header"]), (13, "word " * 20_000),
        (14, "# Tool\n\nSome words.\n\nCopyright (c) 2024 A. B.\n\n" + by["MIT"].replace("\n", "\n\n") + "\n\nMore text follows here, of this and that."), (15, "This tool, by us, is released under the MIT License, as all our tools are."),
        (16, "/*\n * " + by["BSD-3-Clause"].replace(" ", "\n * ", 40) + "\n */\nint main() { return 0; }"), (17, "released under the " * 500), (18, "Permission is hereby"), (19, "a released under the mit license released under the MIT license"),
    ]
    spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, matches string, license int").write.parquet(f"{path}/documents.parquet")
    talk = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", ""), (1, 3, "ann", None), (1, 3, "ann", None), (1, 200, "cy", "late"), (1, None, "bob", "when?"), (2, 0, "system", "alone"), (3, 5, None, "who"), (3, 6, "eve<|", "é\n"), (None, 1, "x", "y"), (1, -1, "ann", "before"), (4, 0, "a", "t" * 70_000)]
    talk += [(5, k, "left" if k % 2 else "right", f"turn {k}") for k in range(150)]
    spark.createDataFrame([(*t, "c") for t in talk], "conv_id long, turn long, role string, text string, speaker string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_licenses(spark, folder):
    got = rows_of(L.op2_license_scan(spark, folder))
    assert got == rows_in(folder, ["documents"], L.ORACLE)
    best = {r["doc_id"]: r["best_license"] for r in L.op2_license_scan(spark, folder).collect()}
    assert best[4] == "MIT-notice" and best[6] == best[8] == "MIT" and best[7] == "BSD-3-Clause" and best[9] is None and best[3] is None
    assert best[14] == "MIT" and best[15] == "MIT-notice" and best[16] == "BSD-3-Clause" and best[17] is best[18] is None and best[19] == "MIT-notice"


def test_bounds_lose_nothing():
    for b in range(1, 60):
        low, high = L.bounds(b)
        for a in range(1, 120):
            assert (2000 * min(a, b) >= L.THRESHOLD * (a + b)) == (low <= a <= high)


def test_chat(spark, folder):
    got = C.op7_chat_rotation(spark, folder)
    assert rows_of(got) == rows_in(folder, ["conversations"], C.ORACLE)
    for r in C.rotate(spark.read.parquet(f"{folder}/conversations.parquet")).filter("conv_id = 5").collect():
        said = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert said == [f"turn {k}" for k in range(150) if (k % 2 == 1) == (r["speaker"] == "left")] and r["part"] == 0


@pytest.mark.parametrize("most", [1, 300, 5000])
def test_chat_parts_join_to_the_whole(spark, folder, most):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").filter("conv_id in (1, 5)")
    whole = {(r["conv_id"], r["speaker"]): r for r in C.rotate(turns).collect()}
    split = {}
    for r in sorted(C.rotate(turns, most).collect(), key=lambda r: r["part"]):
        split.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    assert split.keys() == whole.keys() and max(map(len, split.values())) > 1
    for k, rows in split.items():
        assert "".join(r["text"] for r in rows) == whole[k]["text"] and sum(r["n_turns"] for r in rows) == whole[k]["n_turns"]
        said = lambda r: [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert [x for r in rows for x in said(r)] == said(whole[k])


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
    assert C.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize(("query", "names", "sql"), [(L.op2_license_scan, ["documents"], L.ORACLE), (C.op7_chat_rotation, ["conversations"], C.ORACLE)])
def test_native(spark, folder, query, names, sql):
    plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
