"""Streams with timers and state, and the source of a folder's changes: against plain walks, across restarts."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.sources import watching
from tessella.streaming import timers, watch


class Feed:
    """A stream of files: each call adds a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0
        os.makedirs(self.folder)

    def add(self, *rows):
        self.n += 1
        df = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        df.write.parquet(f"{self.folder}/../made-{self.n}")
        part = next(f for f in os.listdir(f"{self.folder}/../made-{self.n}") if f.endswith(".parquet"))
        os.rename(f"{self.folder}/../made-{self.n}/{part}", f"{self.folder}/{self.n}.parquet")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


class Sink:
    def __init__(self):
        self.rows = []

    def start(self, df, folder, **trigger):
        def take(batch, _):
            self.rows += [(time.monotonic(), r) for r in batch.collect()]

        return df.writeStream.foreachBatch(take).option("checkpointLocation", str(folder)).trigger(**trigger or {"processingTime": "0 seconds"}).start()

    def until(self, n, seconds=60):
        end = time.monotonic() + seconds
        while len(self.rows) < n and time.monotonic() < end:
            time.sleep(0.1)
        return [r for _, r in self.rows]


def test_debounce_needs_no_later_event(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "path string, type string, us long")
    feed.add(("a", "created", 1), ("a", "modified", 2), ("b", "created", 5), (None, "created", 1))
    stream = feed.stream().withColumn("ts", F.timestamp_micros("us"))
    sink = Sink()
    q = sink.start(timers.debounced(stream, 1.0), tmp_path / "cp")
    got = {(r["path"], r["type"], r["n"]) for r in sink.until(3)}
    assert got == {("a", "modified", 2), ("b", "created", 1), (None, "created", 1)}
    feed.add(("a", "deleted", 9))
    got = sink.until(4)[3:]
    assert [(r["path"], r["type"], r["n"]) for r in got] == [("a", "deleted", 1)] and timers.settled(q)
    q.stop()


RETRY = "seq long, kind string, path string, code string, attempts int, generation long, until timestamp"


def test_retries(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", RETRY)
    sink = Sink()
    fail = lambda seq, path, attempts=1, code="ERR_EMBED_FAILED", generation=1: (seq, "failed", path, code, attempts, generation, None)
    far = __import__("datetime").datetime(2100, 1, 1)
    feed.add((0, "pause", None, None, None, None, far), fail(1, "a"), fail(2, "gone"), fail(3, "bad", code="ERR_FILE_TOO_LARGE"), fail(4, "w", code="ERR_RATE_LIMITED"), (5, "cancel", "gone", None, None, None, None), fail(6, "old", generation=0))
    q = sink.start(timers.coordinated(feed.stream(), backoff=0.5, parts=4), tmp_path / "cp")
    got = {tuple(r) for r in sink.until(3)}
    assert got == {("bad", "ERR_FILE_TOO_LARGE", 1, 1, "record"), ("a", "ERR_EMBED_FAILED", 2, 1, "retry"), ("old", "ERR_EMBED_FAILED", 2, 0, "retry")}
    feed.add(fail(7, "a", 2), fail(8, "old", 2, generation=0), (9, "reset", None, None, None, 1, None))
    assert tuple(sink.until(4)[3]) == ("a", "ERR_EMBED_FAILED", 3, 1, "retry")
    q.stop()  # the waiting path survives a restart
    feed.add(fail(10, "a", 3), (11, "unpause", None, None, None, None, None))
    q = sink.start(timers.coordinated(feed.stream(), backoff=0.5, parts=4), tmp_path / "cp")
    assert {tuple(r) for r in sink.until(6)[4:]} == {("a", "ERR_EMBED_FAILED", 3, 1, "record"), ("w", "ERR_RATE_LIMITED", 2, 1, "retry")}
    q.stop()
    assert len(sink.rows) == 6  # nothing of the cancelled path, nor of the generation that was reset


def test_registry(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"/p{rng.randrange(30)}", f"C{k % 3}", f"m{k}", k % 4, None) for k in range(400)]
    feed = Feed(spark, tmp_path / "in", "seq long, path string, code string, message string, attempts int, last_failed_at timestamp")
    for a in range(0, 400, 100):
        feed.add(*rows[a : a + 100])
    sink = Sink()
    q = sink.start(timers.registry_changes(feed.stream(), 12), tmp_path / "cp", availableNow=True)
    q.awaitTermination(120)
    kept, dropped, place = {}, 0, 0
    for seq, path, code, message, attempts, _ in rows:  # a plain walk
        if path not in kept and len(kept) == 12:
            kept.pop(min(kept, key=lambda p: kept[p][0]))
            dropped += 1
        if path not in kept:
            kept[path] = [place, None]
            place += 1
        kept[path][1] = (code, message, attempts)
    got = [r for _, r in sink.rows]
    changes = spark.createDataFrame(got, timers.CHANGE)
    assert {r["path"]: (r["place"], (r["code"], r["message"], r["attempts"])) for r in timers.standing(changes).collect()} == {p: tuple(v) for p, v in kept.items()}
    assert max(r["dropped"] for r in got) == dropped > 0


def test_folder_changes(spark, tmp_path):
    root = tmp_path / "watched"
    (root / "sub").mkdir(parents=True)
    (root / "there.txt").write_text("x")
    sink = Sink()

    def run():
        events = watch.file_events(watching.changes(spark, f"file://{root}", f"file://{tmp_path}/snapshots"))
        q = sink.start(events, tmp_path / "cp", availableNow=True)
        q.awaitTermination(60)
        out = sorted((r["path"].removeprefix(f"{root}/"), r["type"]) for _, r in sink.rows)
        sink.rows.clear()
        return out

    assert run() == []  # what is there at the start is no change
    (root / "a.txt").write_text("1")
    (root / "new" / "deep").mkdir(parents=True)
    (root / "new" / "deep" / "b.txt").write_text("2")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "c.txt").write_text("3")
    assert run() == [("a.txt", "created"), ("new/deep/b.txt", "created")]
    assert run() == []
    (root / "a.txt").write_text("longer")
    os.rename(root / "new" / "deep" / "b.txt", root / "sub" / "b2.txt")
    os.remove(root / "there.txt")
    assert run() == [("a.txt", "modified"), ("new/deep/b.txt", "deleted"), ("sub/b2.txt", "created"), ("there.txt", "deleted")]
    assert run() == [] and len([x for x in os.listdir(tmp_path / "snapshots")]) <= 2


def test_existing_files_and_a_null_folder(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "ü x.txt").write_text("x")
    sink = Sink()
    q = sink.start(watching.changes(spark, str(tmp_path / "w"), str(tmp_path / "s"), existing=True), tmp_path / "cp", availableNow=True)
    q.awaitTermination(60)
    assert [(r["path"], r["op"]) for _, r in sink.rows] == [(str(tmp_path / "w" / "ü x.txt"), "create")]
    reader = watching.FolderReader({"path": str(tmp_path / "nowhere"), "snapshots": str(tmp_path / "s2")})
    assert reader.latestOffset() == reader.latestOffset() == {"snapshot": 1}
    with pytest.raises(KeyError):
        watching.FolderReader({"path": "x"})


def test_a_shared_limit_holds_over_all_tasks(spark, tmp_path):
    """A provider that counts: never more than six calls in two seconds, whatever the number of tasks; and none in its own pause."""
    feed = Feed(spark, tmp_path / "in", "provider string, id string, seq long, until timestamp")
    feed.add(*[("p", f"r{k}", k, None) for k in range(20)])
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(frames):
        for rows in frames:
            for name in rows["id"]:
                (calls / f"{time.time():.6f} {name}").touch()
            yield rows

    def send(batch, _):
        batch.repartition(8).mapInPandas(call, "provider string, id string").write.format("noop").mode("overwrite").save()

    q = timers.leased(feed.stream(), 6, 2.0).writeStream.foreachBatch(send).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    end = time.monotonic() + 120
    while len(os.listdir(calls)) < 20 and time.monotonic() < end:
        time.sleep(0.2)
    until = time.time() + 4
    feed.add(("p", None, 100, __import__("datetime").datetime.fromtimestamp(until)), *[("p", f"later{k}", 101 + k, None) for k in range(3)])
    while len(os.listdir(calls)) < 23 and time.monotonic() < end:
        time.sleep(0.2)
    q.stop()
    made = sorted((float(n.partition(" ")[0]), n.partition(" ")[2]) for n in os.listdir(calls))
    assert sorted(n for _, n in made) == sorted([f"r{k}" for k in range(20)] + [f"later{k}" for k in range(3)])
    assert all(sum(t <= u < t + 2 for u, _ in made) <= 6 for t, _ in made)
    assert all(t >= until - 0.01 for t, n in made if n.startswith("later"))
