"""The registry of failures by blocks: every change against a plain walk, whatever the paths."""

import os
import random
import time

import pytest

from tessella import queries_engine
from tessella.streaming import registry, timers

SCHEMA = "seq long, path string, code string, message string, attempts int, last_failed_at timestamp"


def walk(rows, cap, order, place, dropped, out):
    for r in rows:
        seq, path = r[:2]
        at = next((k for k, p in order.items() if p == path and path is not None), None)
        if at is None:
            if len(order) == cap:
                old = min(order)
                dropped += 1
                out.append((order.pop(old), old, True, seq, None, None, None, dropped))
            at, place = place, place + 1
            order[at] = path
        out.append((path, at, False, seq, *r[2:5], dropped))
    return place, dropped


CASES = {
    "many": lambda rng, k: f"/p{rng.randrange(300)}",
    "hardly more than it holds": lambda rng, k: f"/p{rng.randrange(13)}",
    "repeated": lambda rng, k: f"/p{k // 40 % 30}",
    "null": lambda rng, k: None if rng.randrange(4) == 0 else f"/p{rng.randrange(14)}",
}


@pytest.mark.parametrize("case", CASES)
def test_blocks_as_a_walk(spark, tmp_path, case):
    rng = random.Random(case)
    rows = [(k, CASES[case](rng, k), f"C{k % 3}", f"m{k}", k % 4, None) for k in range(300)]
    step, root = registry.keep(f"file://{tmp_path}/r", 12, 60), f"file://{tmp_path}/r"
    order, place, dropped, expected = {}, 0, 0, []
    for batch, (a, b) in enumerate([(0, 240), (240, 240), (240, 300)]):
        own = rows[a:b]
        step(spark.createDataFrame(rng.sample(own, len(own)), SCHEMA), batch)
        place, dropped = walk(own, 12, order, place, dropped, expected)
    step(spark.createDataFrame(rows[240:], SCHEMA), 2)  # a batch that comes again
    got = registry.changes(spark, root)
    shown = [tuple(r[n] for n in ("path", "place", "gone", "seq", "code", "message", "attempts", "dropped")) for r in got.collect()]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)
    assert {r["place"]: r["path"] for r in timers.standing(got).collect()} == order


def test_unnumbered_records_come_last(spark, tmp_path):
    rows = [(None, "/z", "C", "", 1, None), (2, "/b", "C", "", 1, None), (1, "/a", "C", "", 1, None)]
    registry.keep(f"file://{tmp_path}/r", 2)(spark.createDataFrame(rows, SCHEMA), 0)
    assert {(r["path"], r["place"]) for r in timers.standing(registry.changes(spark, f"file://{tmp_path}/r")).collect()} == {("/b", 1), ("/z", 2)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_a_hundred_thousand_events(spark):
    began = time.monotonic()
    got = {(r["path"], r["place"]) for r in queries_engine.failure_registry_stream(spark, "/root/testdata/sf0.1").collect()}
    spent = time.monotonic() - began
    order, place, standing = {}, 0, {}
    for r in spark.read.parquet("/root/testdata/sf0.1/events.parquet").orderBy("event_id").select("user_id").toLocalIterator():
        path = f"/corpus/user_{r[0]}"
        if path not in standing:
            if len(standing) == 20:
                standing.pop(order.pop(place - 20))
            order[place], standing[path], place = path, place, place + 1
    assert got == set(standing.items()) and spent < 60
