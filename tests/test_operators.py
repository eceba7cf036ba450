import io
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.operators import filenames, ranking, reports, tables, vectors
from tessella.plans.clauses import Clause, Spec, predicate
from tessella.schema import CHUNKS
from tessella.sources import documents, folders
from tessella.streaming import watch

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark):
    paths = ["/proj/docs/report_q3.md", "/proj/internal/engine.go", "/proj/scripts/demo.py", "/proj/demo/readme.txt", "/proj2/demo.py", "/proj/photo.jpg"]
    rows = [(k, p, "image" if p.endswith("jpg") else "text", "." + p.rpartition(".")[2], 100 * (k + 1), T0 + timedelta(days=k), "h" if k else "") for k, p in enumerate(paths)]
    from tessella.functions.text import path_parts

    df = spark.createDataFrame(rows, "file_id long, path string, file_type string, extension string, size_bytes long, modified_at timestamp, content_hash string")
    parts = path_parts(F.col("path"))
    return df.withColumns({n: parts[n] for n in ("basename", "parent", "stem")}).cache()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 6, f"f{k % 6}-c{k // 6}", k // 6, 0.0, 0.0, [float(x) for x in rng.normal(size=8)], "m" if k % 5 else "old", 8) for k in range(24)]
    return spark.createDataFrame(rows, CHUNKS).cache()


def test_names(files):
    got = filenames.search(files, "demo").collect()
    assert [r["basename"] for r in got] == ["demo.py", "demo.py"] and all(r["highlights"][0]["start"] == 0 for r in got)
    assert filenames.search(files, "demo.py").first()["match_kind"] == "exact"
    assert [r["path"] for r in filenames.search(files, "*.PY").collect()] == ["/proj2/demo.py", "/proj/scripts/demo.py"]
    assert filenames.search(files, "  ").count() == 0 and filenames.bm25(files, "de").count() == 0


def test_batches_are_exact(spark, chunks):
    rng = np.random.default_rng(2)
    qs = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(7)]
    got = vectors.nearest_batch(spark.createDataFrame(qs, "query_id long, vector array<float>"), chunks, 3, block=3).collect()
    all_rows = chunks.collect()
    for q, v in qs:
        d = sorted((1 - np.dot(np.float32(v), r["embedding"]) / np.linalg.norm(np.float32(v)) / np.linalg.norm(r["embedding"]), r["vector_id"]) for r in all_rows)[:3]
        assert [r["vector_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [x for _, x in d]


def test_gate(chunks):
    assert vectors.current_model(chunks, "m").count() < chunks.count() == vectors.current_model(chunks, None).count()
    with pytest.raises(vectors.ModelMismatch):
        vectors.check_model(chunks, vectors.current_model(chunks, "none"))
    assert vectors.search_width(20, 10, 100_000, 5000) == 500 and vectors.search_width(20, 10, 100, 0) == 64


def test_rerank_goldens(spark):
    df = spark.createDataFrame([("a", "document", ".x", T0, 0.4)], "path string, file_type string, extension string, modified_at timestamp, distance double")
    assert ranking.rerank(df, Spec("", (), (), (Clause("file_type", "eq", "document", 1.5),))).first()["final_score"] == pytest.approx(1.2)
    assert ranking.rerank(df, Spec("", (Clause("modified_at", "gte", T0),))).first()["final_score"] == pytest.approx(0.96)
    assert ranking.rerank(df, Spec("", (Clause("modified_at", "gt", T0),))).first()["final_score"] == pytest.approx(0.8)


def plain_ladder(rows, spec, order=ranking.DROP_ORDER):
    """Drop clauses one by one, as many plans."""
    must, note = list(spec.must), ""
    while True:
        left = rows
        for c in must:
            left = left.filter(predicate(c))
        for c in spec.must_not:
            left = left.filter(predicate(c, True))
        got = {r["path"] for r in left.collect()}
        drop = next((c for f in order for c in must if c.field == f), None)
        if got or drop is None:
            if not got and must:
                note = note or "all filters"
                got = {r["path"] for r in rows.collect()}
            return got, note
        must.remove(drop)
        note = ranking.banner(drop)


def test_relaxation_against_the_loop(files):
    rng = random.Random(3)
    pool = [
        Clause("modified_at", "lt", T0), Clause("modified_at", "gte", T0 + timedelta(days=2)), Clause("size_bytes", "gt", 10_000), Clause("size_bytes", "lte", 300),
        Clause("path", "contains", "nowhere"), Clause("file_type", "eq", "image"), Clause("extension", "eq", ".py"), Clause("extension", "in_set", []),
    ]
    out, note = ranking.relaxed(files, Spec("", (Clause("extension", "eq", ".py"),)))
    assert {r["path"] for r in out.collect()} == {"/proj/scripts/demo.py", "/proj2/demo.py"} and note == ""
    for _ in range(12):
        spec = Spec("", tuple(rng.sample(pool, rng.randrange(4))), tuple(rng.sample([Clause("path", "contains", "proj2")], rng.randrange(2))))
        out, note = ranking.relaxed(files, spec)
        want, want_note = plain_ladder(files, spec)
        assert {r["path"] for r in out.collect()} == want and note == want_note


def test_fusion(spark):
    sem = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, rank int")
    names = spark.createDataFrame([("b", 1, "exact"), ("d", 2, "fuzzy")], "path string, rank int, match_kind string")
    got = {r["path"]: (r["score"], r["match_kind"]) for r in ranking.fuse(sem, names).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61 + 0.05), "both") and got["d"][1] == "filename" and got["a"][1] == "content"
    assert [r["path"] for r in ranking.names_first(names, sem, 3).collect()] == ["b", "d", "a"]


def test_tables(spark, files, chunks, tmp_path):
    f, c, ids = tables.delete_files(files, chunks, spark.createDataFrame([("/proj2/demo.py",)], "path string"))
    assert f.count() == 5 and c.count() == 20 and ids.count() == 4
    assert tables.delete_folder(files, chunks, "/proj")[0].count() == 1  # /proj2 stays
    assert tables.to_index(files, chunks, chunks.filter("file_id != 3")).count() == 2
    store = tables.Store(spark, f"file://{tmp_path}/store")
    assert not store.exists("files")
    for k in (3, 6):
        store.write("files", files.limit(k))
        assert store.read("files").count() == k
    s = spark.createDataFrame([("a", "1")], "key string, value string")
    assert tables.setting(s, "a", "x") == "1" and tables.setting(s, "b", "x") == "x"


def test_reports(spark):
    rows = [(k, f"p{k % 7}", ["A", "B", "ERR_EMBED_FAILED"][k % 3], T0) for k in range(30)]
    reg = reports.registry(spark.createDataFrame(rows, "seq long, path string, code string, last_failed_at timestamp"), 5)
    assert {r["path"] for r in reg.collect()} == {"p2", "p3", "p4", "p5", "p6"}
    groups = reports.failure_groups(reg).collect()
    assert [g["n"] for g in groups] == sorted((g["n"] for g in groups), reverse=True) and all(len(g["sample_files"]) <= 3 for g in groups)
    assert reports.call_stats(spark.createDataFrame([], "ms long, hit boolean")).first()["avg_ms"] == 0


def test_admission():
    ok, held = watch.admit([0, 1, 2, 60.5, 61.5], [], 2, 60)
    assert ok == [True, True, False, True, True] and held == [60.5, 61.5]
    assert watch.admit([1, 5], [], 9, 60, paused_until=3)[0] == [False, True]


def test_streams(spark, tmp_path):
    rows = [("a", "write", T0), ("a", "remove", T0 + timedelta(milliseconds=100)), ("b", "create", T0), ("a", "write", T0 + timedelta(seconds=5)), ("c", "chmod", T0), ("z", "write", T0 + timedelta(minutes=5))]
    spark.createDataFrame(rows, "path string, op string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema("path string, op string, ts timestamp").parquet(f"{tmp_path}/in")
    q = watch.debounced(watch.file_events(raw)).writeStream.format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["path"], r["type"], r["n"]) for r in spark.table("bursts").collect()}
    assert {("a", "deleted", 2), ("a", "modified", 1), ("b", "created", 1)} <= got
    seen, gone = [], []
    q = watch.apply_events(watch.file_events(raw), lambda d: seen.extend(r[0] for r in d.collect()), lambda d: gone.extend(r[0] for r in d.collect()), f"{tmp_path}/c2")
    q.awaitTermination(120)
    assert set(seen) == {"a", "b", "z"} and gone == []
    req = spark.createDataFrame([("k", T0 + timedelta(seconds=i)) for i in range(5)], "key string, ts timestamp")
    req.coalesce(1).write.parquet(f"{tmp_path}/req")
    stream = watch.admitted(spark.readStream.schema(req.schema).parquet(f"{tmp_path}/req"), 3)
    q = stream.writeStream.format("memory").queryName("admissions").option("checkpointLocation", f"{tmp_path}/c3").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["admitted"] for r in spark.table("admissions").orderBy("ts").collect()] == [True, True, True, False, False]
    due = watch.reschedule(spark.createDataFrame([("p", "ERR_EMBED_FAILED", 2, T0), ("q", "X", 1, T0)], "path string, code string, attempts int, failed_at timestamp"))
    assert {r["path"]: r["recorded"] for r in due.collect()} == {"p": False, "q": True} and watch.due_retries(due, "2024-01-01 00:00:02").count() == 1


def docx(text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    return b.getvalue()


def test_documents():
    assert documents.extracted(docx("one"), ".docx") == ("one\ntwo", None, None)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<a xmlns:a="a"><a:p><a:t>slide {n}</a:t></a:p></a>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
    assert documents.extracted(b.getvalue(), ".pptx")[0] == "slide 2\nslide 10" and documents.extracted(b.getvalue(), ".xlsx")[0] == "shared\t7"
    pdf = b"%PDF /Type /Page /Type /Pages /Type/Page\n(Hello) Tj <576f> Tj"
    assert documents.extracted(pdf, ".pdf") == ("Hello\nWo", 2, None)
    assert documents.extracted(b"junk", ".docx")[2] == documents.extracted(b"x", ".rtf")[2] == "ERR_EXTRACTION_FAILED"


def test_engine(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, body in {"cats/a.txt": b"cats sleep", "cats/b.md": b"cats play " * 300, "boats/boats.txt": b"boats sail", "node_modules/x.txt": b"skip", "d.docx": docx("boats " * 40), "e.bin": b"\0\1", "f.docx": b"bad"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    vec = lambda t: [float(t.count("cats")), float(t.count("boats")), 0.1]

    def embed(pieces):
        import pandas as pd

        @F.pandas_udf("array<float>")
        def e(t: pd.Series) -> pd.Series:
            return t.map(lambda x: [float(x.count("cats")), float(x.count("boats")), 0.1])

        return pieces.withColumn("embedding", e("text"))

    engine = Engine(spark, embed=vec, model="m")
    failures = engine.add_folder(f"file://{root}", embed).collect()
    assert [r["code"] for r in failures] == ["ERR_EXTRACTION_FAILED"]
    engine.save(f"file://{tmp_path}/store")
    engine.load(f"file://{tmp_path}/store")
    assert {r[0].rpartition("/")[2] for r in engine.files.select("path").collect()} == {"a.txt", "b.md", "boats.txt", "d.docx"}
    assert folders.count_indexable(spark, [f"file://{root}"]) == 5
    hits, how = engine.search("all about cats please", 3)
    assert how["kind"] == "content" and {r["path"].rpartition("/")[2] for r in hits.limit(2).collect()} == {"a.txt", "b.md"}
    hits, how = engine.search("a.txt")
    assert how["kind"] == "filename" and hits.first()["path"].endswith("a.txt")
    hits, how = engine.search("boats")
    assert how["kind"] == "hybrid" and hits.first()["match_kind"] == "both"
    hits, how = engine.search("ext:md size:>900mb the cats", 5)
    assert how["banner"] == "size filter" and [r["path"].rpartition("/")[2] for r in hits.collect()] == ["b.md"]
    assert Engine(spark, engine.files, engine.chunks).search("boats")[0].count() == 1
    assert not engine.needs_reindex() and tables.stale(folders.walk(spark, f"file://{root}"), engine.files).filter("stale").count() == 1
    engine.remove_folder(f"{root}/cats")
    assert engine.files.count() == 2
