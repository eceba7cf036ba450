"""Trigram postings: equal to a scan of all names, after changes too, and only the query's trigrams are read."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.operators import filenames
from tessella.operators.postings import NameIndex

FIELDS = "file_id long, basename string, parent string, stem string, extension string"
QUERIES = ["aaaa", "abab", "REPORT_q", "é😀x", "zzz", "ab"]


def files(spark, ids, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["aa", "ab", "b", "report", "Report_Q3", "doc", ".", "é😀x", "/"]) for _ in range(rng.randrange(6)))
    rows = [(k, word(), word() if k % 7 else None, word(), rng.choice([".md", ".doc", ""])) for k in ids]
    return spark.createDataFrame(rows, FIELDS).withColumn("path", F.concat(F.lit("/"), F.col("file_id").cast("string")))


def scores(df):
    return {r["file_id"]: (round(r["raw"], 9), round(r["score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    i = NameIndex(spark, f"file://{tmp_path_factory.mktemp('names')}/n")
    i.build(files(spark, range(400), 1).drop("path"))
    return i


def test_equal_to_a_scan(spark, index):
    f = files(spark, range(400), 1).cache()
    some = 0
    for q in QUERIES:
        want = scores(filenames.bm25(f, q))
        assert scores(filenames.bm25(f, q, index)) == want
        some += bool(want)
    assert some >= 4


def test_only_the_querys_trigrams_are_read(index):
    plan = index.rows(["rep", "epo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "In(gram, [epo,rep])" in plan or "In(gram, [rep,epo])" in plan
    read = {r[0].split("/bucket=")[1].split("/")[0] for r in index.rows(["rep", "epo"]).select(F.input_file_name()).distinct().collect()}
    assert len(read) <= 2


def test_changes(spark, tmp_path):
    one = files(spark, range(60), 1).cache()
    i = NameIndex(spark, f"file://{tmp_path}/n")
    assert not i.exists()
    i.build(one)
    new, changed = files(spark, range(100, 130), 2).cache(), files(spark, range(10), 3).cache()
    i.update(added=new)
    i.update(removed=one.filter("file_id between 20 and 29"))
    i.update(added=changed, removed=one.filter("file_id < 10"))
    i.update(added=one.filter("file_id = 25"))  # comes back
    now = one.filter("file_id >= 10 and not file_id between 20 and 29 or file_id = 25").unionByName(new).unionByName(changed).cache()
    for step in (lambda: i, lambda: NameIndex(spark, i.store.root), lambda: i.save() or i):
        own = step()
        assert own.figures() == (now.count(), now.agg(F.sum(filenames.name_length())).first()[0])
        for q in ("aaa", "report"):
            assert scores(filenames.bm25(now, q, own)) == scores(filenames.bm25(now, q))


def test_empty(spark, tmp_path):
    i = NameIndex(spark, f"file://{tmp_path}/n")
    i.build(files(spark, range(3), 1).limit(0))
    assert i.hits("report").count() == 0 and i.figures() == (0, 0)


def test_the_engine_reads_its_names(spark, tmp_path):
    f = files(spark, range(200), 5).withColumns({"file_type": F.lit("text"), "size_bytes": F.lit(1).cast("long"), "modified_at": F.lit("2024-01-01").cast("timestamp"), "content_hash": F.lit("h"), "indexed_at": F.lit("2024-01-01").cast("timestamp"), "thumbnail_path": F.lit("")})
    e = Engine(spark, f.select("file_id", "path", "file_type", "extension", "size_bytes", "modified_at", "indexed_at", "content_hash", "thumbnail_path", "basename", "parent", "stem"), embed=lambda _: [1.0], root=f"file://{tmp_path}/e")
    want = [r["path"] for r in e.search("f:report", 10)[0].collect()]
    e.build_names()
    assert [r["path"] for r in e.search("f:report", 10)[0].collect()] == want and want
    e.remove_paths(spark.createDataFrame([(want[0],)], "path string"))
    assert e.names.figures()[0] == 199
    got = [r["path"] for r in e.search("f:report", 10)[0].collect()]
    e.names = None
    assert got == [r["path"] for r in e.search("f:report", 10)[0].collect()] and want[0] not in got
