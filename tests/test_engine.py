"""Indexing end to end: identity, two phases, one call of the provider, streams, settings, the stored index and migrations."""

import os
import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.engine import ConfigInvalid, Engine, StaleGeneration, VectorCache
from tessella.operators import migrations, tables, vectors
from tessella.operators.index import VectorIndex
from tessella.sources import folders, media
from tessella.sources import tables as src
from tests.test_pdf import made as pdf_of


def vec(text):
    return [float(text.count("cats")), float(text.count("boats")), 0.1]


@pytest.fixture
def corpus(tmp_path):
    def write(name, body, at=None):
        p = tmp_path / "corpus" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
        if at:
            os.utime(p, (at, at))
        return str(p)

    write("cats/a.txt", b"cats sleep")
    write("cats/long.txt", b"cats play " * 900)
    write("boats/b.txt", b"boats sail")
    return write


@pytest.fixture
def engine(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(pieces):
        def run(frames):
            for rows in frames:
                calls.add(len(rows))
                yield rows.assign(embedding=[vec(t) for t in rows["text"]])

        return pieces.mapInPandas(run, "file_id long, chunk_index int, text string, embedding array<float>")

    e = Engine(spark, embed=vec, model="m", root=f"file://{tmp_path}/store")
    e.embed_chunks, e.calls_made = embed, calls
    return e


def names(df):
    return sorted(r["path"].rpartition("/")[2] for r in df.select("path").collect())


def test_reindexing_keeps_ids_and_replaces_chunks(engine, corpus, tmp_path):
    root = f"file://{tmp_path}/corpus"
    engine.add_folder(root, engine.embed_chunks)
    assert engine.calls_made.value == engine.chunks.count() == 7
    ids = {r["path"]: r["file_id"] for r in engine.files.collect()}
    assert all(r["content_hash"] for r in engine.files.collect())
    engine.search("all about cats please", 3)[0].collect()
    assert engine.calls_made.value == 7  # nothing is embedded again by later actions
    corpus("cats/long.txt", b"cats rest")
    engine.add_folder(root, engine.embed_chunks)
    assert engine.calls_made.value == 8 and {r["path"]: r["file_id"] for r in engine.files.collect()} == ids
    assert engine.chunks.count() == 3 and engine.chunks.select("file_id").distinct().count() == 3
    engine.add_folder(root, engine.embed_chunks)
    assert engine.calls_made.value == 8
    engine.reindex(engine.embed_chunks)
    assert engine.calls_made.value == 11 and {r["path"]: r["file_id"] for r in engine.files.collect()} == ids


def test_a_lost_job_leaves_incomplete_files(engine, corpus, tmp_path):
    root = f"file://{tmp_path}/corpus"

    def broken(pieces):
        raise ConnectionError("provider gone")

    with pytest.raises(ConnectionError):
        engine.add_folder(root, broken)
    assert engine.files.filter("content_hash = ''").count() == 3 and engine.chunks.count() == 0
    engine.add_folder(root, engine.embed_chunks)
    assert engine.files.filter("content_hash = ''").count() == 0 and engine.chunks.count() == 7

    def reset(pieces):
        engine.reset()
        return engine.embed_chunks(pieces)

    corpus("new.txt", b"cats")
    with pytest.raises(StaleGeneration):
        engine.add_folder(root, reset)
    assert engine.chunks.count() == 7


def test_pause_failures_and_reports(engine, corpus, tmp_path):
    corpus("bad.docx", b"no archive")
    corpus("node_modules/x.txt", b"skipped")
    corpus("film.mp4", b"frames")
    engine.pause()
    engine.add_folder(f"file://{tmp_path}/corpus", engine.embed_chunks)
    assert engine.files.count() == 0 and engine.status().first()["total"] == 0
    engine.resume()
    assert engine.files.count() == 3 and names(engine.failures()) == ["bad.docx", "film.mp4"]
    assert [tuple(r)[:3] for r in engine.failure_groups().collect()] == [("ERR_EXTRACTION_FAILED", "text extraction from file failed", 1), ("ERR_UNSUPPORTED_FORMAT", "file format is not supported for indexing", 1)]
    assert not engine.missing_vectors() and not engine.needs_reindex()
    assert engine.file_preview(f"{tmp_path}/corpus/cats/a.txt") == "cats sleep" and engine.file_preview(f"{tmp_path}/corpus/bad.docx") == "no archive"
    engine.model = "other"
    assert engine.needs_reindex()
    with pytest.raises(vectors.ModelMismatch):
        engine.search("where are the cats now")


def test_characters_cut_by_chunks(engine, corpus, tmp_path):
    corpus("cats/umlauts.txt", "x".encode() + "ü".encode() * 5000)
    engine.add_folder(f"file://{tmp_path}/corpus", engine.embed_chunks)
    assert engine.files.filter("path like '%umlauts.txt' and content_hash <> ''").count() == 1
    shown = engine.file_preview(f"{tmp_path}/corpus/cats/umlauts.txt")
    assert shown.startswith("xü") and 4096 <= len(shown) <= 4097


def test_settings_and_caches(engine):
    assert engine.indexing() == {"workers": 4, "rate_limit_per_minute": 55} and engine.exact_threshold() == 5000
    with pytest.raises(ConfigInvalid):
        engine.set_indexing(workers=8, rate_limit_per_minute=0)
    assert engine.indexing()["workers"] == 4
    engine.set_indexing(workers=8, rate_limit_per_minute=100)
    assert engine.indexing() == {"workers": 8, "rate_limit_per_minute": 100}
    engine.settings = tables.put_setting(tables.put_setting(engine.settings, "indexing.workers", "99"), "brute_force_threshold", "7")
    assert engine.indexing()["workers"] == 4 and engine.exact_threshold() == 7
    assert engine.pre_embed(" Cats ") and not engine.pre_embed("  ") and "cats" in engine.vectors.rows
    c = VectorCache(2, 10)
    for k in range(3):
        c.put(str(k), [k], k)
    assert c.get("0", 3) is None and c.get("1", 3) == [1] and c.get("2", 12) is None
    assert engine.stats().first()["calls"] == 0


def test_streams_and_rescans_feed_the_index(engine, corpus, tmp_path, spark):
    root = f"file://{tmp_path}/corpus"
    engine.add_folder(root, engine.embed_chunks)
    fresh = corpus("boats/new.txt", b"boats again")
    rows = [(fresh, "created", "2024-01-01 00:00:00"), (f"{tmp_path}/corpus/vanished.txt", "created", "2024-01-01 00:00:00"), (corpus("dist/skip.txt", b"x"), "modified", "2024-01-01 00:00:00"), (f"{tmp_path}/corpus/cats/a.txt", "deleted", "2024-01-01 00:00:01")]
    pd.DataFrame(rows, columns=["path", "type", "ts"]).assign(ts=lambda x: pd.to_datetime(x["ts"])).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    events = spark.readStream.schema("path string, type string, ts timestamp_ntz").option("pathGlobFilter", "events.parquet").parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    q = engine.watch(events, f"{tmp_path}/progress", engine.embed_chunks)
    q.awaitTermination()
    assert names(engine.files) == ["b.txt", "long.txt", "new.txt"]
    os.remove(f"{tmp_path}/corpus/boats/b.txt")
    corpus("boats/other.txt", b"boats")
    corpus("cats/long.txt", b"short", at=1_700_000_000)
    got = {r["path"].rpartition("/")[2]: r["action"] for r in engine.rescan(root, engine.embed_chunks).collect()}
    assert got["b.txt"] == "gone" and got["long.txt"] == "changed"
    assert {"long.txt", "new.txt", "other.txt"} <= set(names(engine.files)) and "b.txt" not in names(engine.files)
    engine.remove_folder(f"file://{tmp_path}/corpus/cats")
    assert "long.txt" not in names(engine.files)


def eventually(check, seconds=90):
    end = time.monotonic() + seconds
    while not check():
        assert time.monotonic() < end
        time.sleep(0.2)


def test_failed_files_are_tried_again(engine, corpus, tmp_path, spark):
    corpus("bad.docx", b"no archive")
    seen = spark.sparkContext.accumulator(0)

    def flaky(pieces):
        def run(frames):
            for rows in frames:
                seen.add(1)
                boats = rows["text"].str.contains("boats")
                yield rows.assign(embedding=[vec(t) for t in rows["text"]], error=boats.map({True: "ERR_EMBED_FAILED", False: None}).astype(object))

        return pieces.mapInPandas(run, "file_id long, chunk_index int, text string, embedding array<float>, error string")

    got = engine.add_folder(f"file://{tmp_path}/corpus", flaky)
    assert {(r["path"].rpartition("/")[2], r["code"]) for r in got.collect()} == {("b.txt", "ERR_EMBED_FAILED"), ("bad.docx", "ERR_EXTRACTION_FAILED")}
    assert names(engine.failures()) == ["bad.docx"] and names(engine.files.filter("content_hash = ''")) == ["b.txt"]  # the others are committed
    q = engine.retries(f"{tmp_path}/retries", flaky, 0.2)
    eventually(lambda: engine.failures().count() == 2)
    q.stop()
    assert {r["path"].rpartition("/")[2]: r["attempts"] for r in engine.failures().collect()} == {"bad.docx": 1, "b.txt": 3}
    engine.reset()
    engine.index_paths([f"{tmp_path}/corpus/boats/b.txt"], flaky)
    q = engine.retries(f"{tmp_path}/retries", engine.embed_chunks, 0.2)
    eventually(lambda: engine.files.filter("content_hash = ''").count() == 0)
    q.stop()
    assert engine.failures().count() == 0 and "b.txt" in names(engine.files)


def test_a_reset_stops_a_running_job(engine, corpus, tmp_path):
    outcome, mark = [], tmp_path / "began"

    def slow(pieces):
        def run(frames):
            for rows in frames:
                mark.touch()
                time.sleep(300)
                yield rows.assign(embedding=[[1.0]] * len(rows))

        return pieces.mapInPandas(run, "file_id long, chunk_index int, text string, embedding array<float>")

    def work():
        try:
            engine.add_folder(f"file://{tmp_path}/corpus", slow)
        except Exception as e:
            outcome.append(e)

    t = threading.Thread(target=work)
    t.start()
    eventually(mark.exists)
    engine.reset()
    t.join(60)
    assert not t.is_alive() and isinstance(outcome[0], StaleGeneration)
    assert engine.chunks.count() == 0 and engine.files.filter("content_hash = ''").count() == 3


def test_queued_texts_are_embedded_within_the_limit(engine, corpus, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Limited(ConnectionError):
        retry_after = 1.5

    def call(texts):
        n = len(os.listdir(log))
        (log / f"{time.time():.6f}-{len(texts)}-{random.random()}").touch()
        if n == 0:
            raise Limited
        return [vec(t) for t in texts]

    engine.CALL = 2
    engine.add_folder(f"file://{tmp_path}/corpus", queued=True)
    assert engine.chunks.count() == 0 and engine.files.filter("content_hash = ''").count() == 3
    q = engine.embedder(f"{tmp_path}/embedder", call, 2, 2.0)
    eventually(lambda: engine.files.filter("content_hash <> ''").count() == 3 or not q.isActive, 200)
    q.stop()
    assert q.exception() is None and engine.chunks.count() == 7 and engine.failures().count() == 0
    made = sorted((float(at), int(n)) for at, n, _ in (x.split("-", 2) for x in os.listdir(log)))
    assert len(made) >= 6 and max(n for _, n in made) == 2
    assert all(sum(t <= u < t + 2 for u, _ in made) <= 2 for t, _ in made)
    found = engine.search("all about cats please", 3)[0].collect()
    assert len(found) == 3


def test_ignored_folders(engine, corpus, tmp_path, spark):
    engine.ignore_folder("boats")
    engine.ignore_folder("boats")
    assert engine.ignored_folders().count("boats") == 1
    with pytest.raises(ConfigInvalid):
        engine.ignore_folder("a/b")
    engine.add_folder(f"file://{tmp_path}/corpus")
    assert names(engine.files) == ["a.txt", "long.txt"]
    engine.save(f"file://{tmp_path}/saved")
    again = Engine(spark, root=f"file://{tmp_path}/other")
    again.load(f"file://{tmp_path}/saved")
    assert "boats" in again.ignored_folders() and again.folders == [f"file://{tmp_path}/corpus"]
    again.unignore_folder("boats")
    again.add_folder(f"file://{tmp_path}/corpus")
    assert names(again.files) == ["a.txt", "b.txt", "long.txt"]


def test_a_watched_folder(engine, corpus, tmp_path):
    q = engine.watch_folder(f"file://{tmp_path}/corpus", f"{tmp_path}/watching", engine.embed_chunks, 0.2)
    try:
        eventually(lambda: q.lastProgress is not None)
        corpus("later/new.txt", b"cats again")
        eventually(lambda: "new.txt" in names(engine.files))
        os.remove(f"{tmp_path}/corpus/later/new.txt")
        eventually(lambda: "new.txt" not in names(engine.files))
    finally:
        q.stop()


def test_a_rescan_opens_what_changed(engine, corpus, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/corpus"
    engine.add_folder(root, engine.embed_chunks)
    opened, real = [], folders.walk
    monkeypatch.setattr(folders, "walk", lambda spark, folder, patterns, paths=None: opened.append(sorted(p.rpartition("/")[2] for p in paths)) or real(spark, folder, patterns, paths))
    corpus("cats/a.txt", b"cats wake", at=1_700_000_000)
    corpus("boats/c.txt", b"boats")
    engine.rescan(root, engine.embed_chunks)
    assert opened == [["a.txt", "c.txt"]] and engine.files.filter("content_hash = ''").count() == 0
    assert names(engine.files) == ["a.txt", "b.txt", "c.txt", "long.txt"]


def test_large_files_are_not_opened(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "MOST_BYTES", 1000)
    corpus("big.pdf", b"x" * 2000)
    corpus("big.mp4", b"x" * 2000)
    corpus("big.bin", b"\0" * 2000)
    x = folders.walk(spark, f"file://{tmp_path}/corpus")
    got = {r["path"].rpartition("/")[2]: r for r in x.collect()}
    assert {n: r["error"] for n, r in got.items()} == {"a.txt": None, "b.txt": None, "long.txt": None, "big.pdf": "ERR_FILE_TOO_LARGE", "big.mp4": "ERR_FILE_TOO_LARGE"}
    assert got["big.pdf"]["content_hash"] == "" and got["long.txt"]["size_bytes"] == 9000
    assert "LessThanOrEqual(length,1000)" in x._jdf.queryExecution().toString()


def test_store(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/s")
    for k in range(4):
        assert store.write("t", spark.range(k + 1)).count() == k + 1
    assert store.read("t").count() == 4 and len(store.versions("t")) == 2 and store.versions("t")[-1] == store.version("t")
    store.drop("t")
    assert not store.exists("t")


def test_tables(spark):
    f = spark.createDataFrame([(5, "/a/b.txt", "h")], "file_id long, path string, content_hash string").withColumns({n: F.lit("") for n in ("basename", "parent", "stem")})
    with pytest.raises(FileNotFoundError):
        tables.rename(f, "/nothing", "/x")
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 0, "z")], "key string, seq int, v string").repartition(3)
    assert tables.latest(rows, "key").collect() == [("k", 1, "b")]


def test_migrations(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/m")
    assert migrations.migrate(store) == [1, 2, 3, 4, 5] and migrations.migrate(store) == []
    old = tables.Store(spark, f"file://{tmp_path}/old")
    old.write("files", spark.createDataFrame([(1, "/a/b.c.txt")], "file_id long, path string"))
    old.write("chunks", spark.createDataFrame([(1, "v")], "file_id long, vector_id string"))
    assert migrations.migrate(old) == [2, 3, 4, 5]
    assert old.read("files").first().asDict() == {"file_id": 1, "path": "/a/b.c.txt", "basename": "b.c.txt", "parent": "/a", "stem": "b.c", "thumbnail_path": ""}
    assert old.read("chunks").first()["embedding_dims"] == 0
    with pytest.raises(migrations.Downgrade):
        migrations.migrate(old, migrations.STEPS[:3])


def test_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    rows = [(f"v{k}", k, [float(x) for x in centers[k % 12] + 0.15 * rng.normal(size=16)]) for k in range(1200)]
    df = spark.createDataFrame(rows, "vector_id string, file_id long, embedding array<float>")
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(df.filter("file_id < 1000"), 12)
    index.add(df.filter("file_id >= 1000"))
    assert index.delete(spark.createDataFrame([("v3",), ("v1100",), ("none",)], "vector_id string")) == 2
    index.add(spark.createDataFrame([("v5", 5, [9.0] + [0.0] * 15)], df.schema))
    now = {v: (f, np.array([9.0] + [0.0] * 15) if v == "v5" else np.array(e)) for v, f, e in rows if v not in ("v3", "v1100")}

    def nearest(q, k):
        d = lambda e: 1 - float(np.dot(e, q) / np.linalg.norm(e) / np.linalg.norm(q))
        return [v for _, v in sorted((d(e), v) for v, (_, e) in now.items())[:k]]

    hits, total = 0, 0
    for k in range(0, 1200, 100):  # recall against brute force
        q = rows[k][2]
        want = nearest(np.array(q), 10)
        assert [r["vector_id"] for r in index.search(q, 10).collect()] == want
        got = [r["vector_id"] for r in index.search(q, 10, probes=2).collect()]
        hits, total = hits + len(set(got) & set(want)), total + 10
    assert hits / total >= 0.9
    index.save()
    again = VectorIndex(spark, f"file://{tmp_path}/i")
    assert again.rows().count() == 1198 and [r["vector_id"] for r in again.search(rows[0][2], 10).collect()] == nearest(np.array(rows[0][2]), 10)
    assert {r["vector_id"]: r["has"] for r in again.has(spark.createDataFrame([("v3",), ("v4",)], "vector_id string")).collect()} == {"v3": False, "v4": True}
    empty = VectorIndex(spark, f"file://{tmp_path}/e")
    empty.build(df.limit(0))
    assert empty.search([1.0], 3).count() == 0


def test_search_plan_prunes(spark):
    """The filter reaches the scan before distances, and the distance aggregate hashes."""
    d = "/root/testdata/sf0.001"
    rng = random.Random(1)
    q = [rng.random() for _ in range(64)]
    from tessella.plans.clauses import Clause, Spec

    spec = Spec("", (Clause("extension", "eq", ".md"),))
    got = vectors.nearest_files(src.files(spark, d), src.chunks(spark, d), q, spec, 5)
    assert got.count() == 5 and {r["extension"] for r in got.collect()} == {".md"}


def test_batch_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(f"v{k}", k, [float(x) for x in rng.normal(size=4)]) for k in range(60)], "vector_id string, file_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(9)], "query_id long, vector array<double>")
    shown = lambda df: sorted((*r[:3], round(r[3], 9), r[4]) for r in df.collect())
    want = shown(vectors.nearest_batch(queries, chunks, 3))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 100)
    assert shown(vectors.nearest_batch(queries, chunks, 3, block=2)) == want and len(want) == 27


def test_packed_vectors(spark):
    from tessella.sources import embedding

    rows = [(1, [1.5, -2.0]), (2, None), (3, []), (4, [0.0] * 300), (5, [3.25])]
    x = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1).withColumn("b", embedding.packed("v"))
    got = {r["id"]: r for r in x.withColumn("u", embedding.unpacked("b")).collect()}
    assert all(r["u"] == dict(rows)[k] and (r["b"] is None) == (dict(rows)[k] is None) for k, r in got.items())
    assert bytes(got[1]["b"]) == embedding.to_bytes([1.5, -2.0])
    odd = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"abcd"),), (None,)], "b binary").coalesce(1)
    assert [r[0] is None for r in odd.select(embedding.unpacked("b")).collect()] == [True, False, True]


def test_ticks_and_periodic_saves(engine, corpus, tmp_path):
    engine.add_folder(f"file://{tmp_path}/corpus", engine.embed_chunks)
    seen = []
    ticks = engine.tick(seen.append, f"{tmp_path}/ticks", "200 milliseconds")
    saves = engine.autosave(f"file://{tmp_path}/saved", f"{tmp_path}/saves", "200 milliseconds")
    until = time.monotonic() + 60
    while (len(seen) < 2 or not tables.Store(engine.spark, f"file://{tmp_path}/saved").exists("migrations")) and time.monotonic() < until:
        time.sleep(0.2)
    ticks.stop()
    saves.stop()
    assert seen[0] == {"total": 3, "indexed": 3, "failed": 0, "pending": 0}
    again = Engine(engine.spark, embed=vec, model="m")
    again.load(f"file://{tmp_path}/saved")
    assert again.files.count() == 3 and len(tables.Store(engine.spark, f"file://{tmp_path}/saved").versions("files")) == 1


def test_images_audio_and_pages_are_embedded_as_they_are(engine, corpus, tmp_path, spark):
    corpus("cats/nine.pdf", pdf_of(9))
    corpus("cats/one.pdf", pdf_of(1))
    corpus("cats/cat.PNG", b"\x89PNG cats cats")
    corpus("cats/purr.mp3", b"ID3 \xff\xfe boats")
    corpus("cats/empty.gif", b"")  # empty files are passed by
    corpus("cats/new.heic", b"heic")
    corpus("cats/clip.mp4", b"video")
    seen = spark.sparkContext.accumulator(0)

    def embed_media(parts):
        def run(frames):
            for rows in frames:
                seen.add(len(rows))
                bad = ["ERR_EMBED_FAILED" if m == "audio/mpeg" and c.startswith(b"broken") else None for m, c in zip(rows["media_type"], rows["content"], strict=True)]
                out = rows[["file_id", "chunk_index"]].assign(embedding=[[float(c.count(b"cats")), float(c.count(b"/Type /Page ")), 0.2] for c in rows["content"]])
                yield out.assign(error=pd.Series(bad, index=rows.index, dtype=object))

        return parts.mapInPandas(run, "file_id long, chunk_index int, embedding array<float>, error string")

    folder = f"file://{tmp_path}/corpus"
    failed = {r["path"].rpartition("/")[2]: r["code"] for r in engine.add_folder(folder, engine.embed_chunks).collect()}
    assert failed == dict.fromkeys(["cat.PNG", "purr.mp3", "new.heic", "clip.mp4"], "ERR_UNSUPPORTED_FORMAT") and seen.value == 0

    engine.embed_media = embed_media
    failed = {r["path"].rpartition("/")[2]: r["code"] for r in engine.add_folder(folder, engine.embed_chunks, force=True).collect()}
    assert failed == {"new.heic": "ERR_UNSUPPORTED_FORMAT", "clip.mp4": "ERR_UNSUPPORTED_FORMAT"}
    assert seen.value == 2 + 1 + 1 + 1  # nine pages in two parts of six with one in common, one page, the image, the sound
    rows = engine.chunks.join(engine.files.select("file_id", "basename"), "file_id").orderBy("basename", "chunk_index").collect()
    of = lambda n: [(r["chunk_index"], [round(x, 1) for x in r["embedding"]]) for r in rows if r["basename"] == n]
    assert of("cat.PNG") == [(0, [2.0, 0.0, 0.2])] and of("purr.mp3") == [(0, [0.0, 0.0, 0.2])]
    assert of("nine.pdf")[:2] == [(0, [0.0, 6.0, 0.2]), (1, [0.0, 4.0, 0.2])] and [k for k, _ in of("nine.pdf")] == list(range(len(of("nine.pdf"))))
    assert len(of("nine.pdf")) > 2 and of("nine.pdf")[2][1][2] == 0.1  # its text follows
    assert all(r["content_hash"] for r in engine.files.filter("basename in ('nine.pdf', 'cat.PNG', 'purr.mp3')").collect())
    assert names(engine.search("ext:png cats")[0]) == ["cat.PNG"]

    corpus("cats/purr.mp3", b"broken sound")  # its other files stay as they are
    failed = {r["path"].rpartition("/")[2]: r["code"] for r in engine.add_folder(folder).collect()}
    assert failed["purr.mp3"] == "ERR_EMBED_FAILED" and engine.files.filter("basename = 'purr.mp3'").first()["content_hash"] == "" and engine.chunks.filter("embedding_dims = 3").count() == len(rows) - 1


def test_media_parts(spark):
    files = spark.createDataFrame([(1, ".pdf", "application/pdf", bytearray(pdf_of(13)), 5), (2, ".png", "image/png", bytearray(b"x"), 5), (3, None, None, None, 5), (4, ".gif", None, bytearray(), 5), (2, ".png", "image/png", bytearray(b"x"), 5)], "file_id long, extension string, media_type string, body binary, page_start int")
    got = sorted((r["file_id"], r["chunk_index"], r["page_start"] or 0, r["page_end"] or 0) for r in media.parts(files, "body").collect())
    assert got == [(1, 0, 1, 6), (1, 1, 6, 11), (1, 2, 11, 13), (2, 0, 0, 0), (2, 0, 0, 0)]
    assert media.parts(files.limit(0), "body").count() == 0
