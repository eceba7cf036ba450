import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fim as M

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = [None, "", "\n", "one line", "one\n", "\n\n\nx", "é\nü\n\n日本\n", "has <P> in it\nand more", "a<M>", "<S>", "a\rb c\x85d\n\x00e\n", "line\n" * 30_000, "x" * 100_000, ("w" * 4095 + "\n") * 5, "\n" * 9000, "< P>\n<\nP>\n😀\n😀"]


def plain(doc_id, text, rate=100, spm=50):
    """The contract, word by word."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab\n日", max_size=40), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 2**32), st.integers(0, 2**32))
def test_cuts(texts, chunk, f, g):
    raw = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    n, at = M.line_cuts(np.frombuffer(b"".join(raw), np.uint8), offsets, np.asarray([[f, g]] * len(raw)), chunk)
    for d, x in enumerate(raw):
        units = UNIT.findall(x.decode())
        assert n[d] == len(units)
        assert [int(v) - offsets[d] for v in at[d]] == [len("".join(units[: v % (len(units) + 1)]).encode()) for v in (f, g)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fim"))
    docs = [(k, TEXTS[k % len(TEXTS)]) for k in range(6 * len(TEXTS))] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[6]), (-5, TEXTS[6])]
    spark.createDataFrame([(*d, "c", 5, "f") for d in docs], "doc_id long, text string, output string, n int, form string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_query(spark, folder):
    got = Counter(map(tuple, M.op12_fill_in_middle(spark, folder).collect()))
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n, form, p, m, out = plain(r["doc_id"], r["text"])
        want[(r["doc_id"], n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert got == want and len({r[2] for r in got}) == 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert Counter(con.execute(M.ORACLE).fetchall()) == got


def test_rates_chunks_and_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit("kept").alias("extra"))
    small = M.fill_in_middle(docs, ["doc_id", "text", "extra"], rate=40, spm=100, chunk=7).withColumn("again", M.restored(F.col("output"), F.col("form")))
    forms = set()
    for r in small.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], 40, 100)
        assert r["again"] == (r["text"] or "") and r["extra"] == "kept"
        forms.add(r["form"])
    assert forms == {"plain", "spm"}


def test_empty(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
