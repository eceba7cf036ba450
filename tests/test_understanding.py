"""Queries understood by a model: one call a distinct query, bounded calls at a time, a budget, and a stored cache."""

import json
import os
import threading
import time
from datetime import datetime

from pyspark.sql import functions as F

from tessella.operators.tables import Store
from tessella.plans import parser
from tessella.plans.clauses import Spec
from tessella.plans import understanding as U

NOW = datetime(2024, 1, 20, 12)


def answer(**own):
    return json.dumps({"reasoning": "", "semantic_query": "x", "must": [], "must_not": [], "should": []} | own)


def test_calls_at_a_time_and_budget():
    running, most, seen = [], [0], []
    lock = threading.Lock()

    def model(prompt, schema, temperature, left):
        assert schema is parser.SCHEMA and temperature == 0.0 and 0 < left <= 1.0
        with lock:
            running.append(1)
            most[0] = max(most[0], len(running))
        slow = "slow" in prompt.split("Search: ")[1]
        time.sleep(3 if slow else 0.05)
        with lock:
            running.pop()
            seen.append(prompt)
        if "wrong" in prompt:
            return "no json"
        return answer()

    texts = [f"what are the notes about number {k} please" for k in range(9)] + ["a slow one is what this query here is", "short", "the wrong answer comes to this long query"]
    began = time.monotonic()
    got = list(U.answered(texts, model, NOW, at_once=3, budget=1.0))
    assert [o for _, o in got] == ["OK"] * 9 + ["Timeout", "Grammar", "Failed"] and most[0] <= 4
    assert time.monotonic() - began < 10 and got[10][0].semantic == "short"


def test_each_query_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompt, schema, temperature, left):
        (calls / f"{time.time_ns()}-{os.getpid()}-{threading.get_ident()}").touch()
        return answer(semantic_query=prompt.split("about ")[1].split("\n")[0], must=[{"field": "extension", "op": "eq", "value": ".md"}])

    rows = [(k, f"Where are  all of the papers about n{k % 5}{'?' if k % 2 else ''}") for k in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "id long, q string").withColumn("spec_", F.lit(1)).repartition(5)
    store = Store(spark, f"file://{tmp_path}/s")
    one = U.understand(df, "q", model, store, NOW, budget=30.0)
    got = {r["id"]: r for r in one.collect()}
    assert len(got) == 102 and len(os.listdir(calls)) == 5  # a repeated query is one call, whatever its punctuation
    assert got[7]["source"] == "llm" and Spec.from_json(got[7]["spec"]).must[0].value == ".md" and got[200]["outcome"] == "Grammar"
    again = {r["id"]: r["source"] for r in U.understand(df, "q", model, store, NOW, budget=30.0).collect()}
    assert len(os.listdir(calls)) == 5 and again[7] == "cache" and again[200] == "grammar"
    U.evict(store, datetime(2024, 1, 21))
    assert U.understand(df.filter("id = 7"), "q", model, store, NOW, budget=30.0).first()["source"] == "llm"
    U.evict(store, NOW)
    assert U.understand(df.filter("id = 7"), "q", model, store, NOW, budget=30.0).first()["source"] == "cache" and len(os.listdir(calls)) == 6
