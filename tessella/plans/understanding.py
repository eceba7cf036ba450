"""Understanding a table of queries with a language model: each distinct query is asked once, by tasks that make a bounded number of calls at a time.

A stored cache of specifications is read before and added to after. What it lacks and is worth a call goes to the model, in Arrow batches, with a budget of seconds for
each query; what fails, times out or is refused falls back to the grammar and is not cached. Rows of a repeated query meet its one answer by a join, whose skew Spark splits.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.operators.tables import Store
from tessella.plans import parser
from tessella.plans.clauses import Spec, merge
from tessella.schema import SPEC_VERSION

#: A model: prompt, JSON schema of the answer, temperature and seconds left to the answer's JSON.
Model = Callable[[str, dict, float, float], str]
CACHE = "key string, version int, spec string, made long"
ANSWER = "key string, spec string, outcome string, source string"
#: Calls of a task at a time, seconds a query may take, and tasks.
AT_ONCE, BUDGET, TASKS = 4, 0.5, 16


def cache_key(text: Column) -> Column:
    """Lower case, single spaces, no closing punctuation; null is the empty query."""
    return F.trim(F.rtrim(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), F.lit(".?!")))


def answered(texts: list[str], model: Model, now: datetime, at_once: int = AT_ONCE, budget: float = BUDGET) -> Iterator[tuple[Spec, str]]:
    """Each query's specification and outcome (OK, Failed, Timeout, RateLimited, or Grammar where no call is worth it), at_once calls at a time.

    A query's seconds run from its first call; a call that outlives them is left behind and its query takes the grammar's reading.
    """
    began: dict[int, float] = {}

    def one(k: int, text: str) -> tuple[Spec, str]:
        began[k] = time.monotonic()

        def provider(prompt: str) -> str:
            left = budget - (time.monotonic() - began[k])
            if left <= 0:
                raise TimeoutError
            return model(prompt, parser.SCHEMA, parser.TEMPERATURE, left)

        return parser.model_spec(text, now, provider)

    pool = ThreadPoolExecutor(at_once)
    try:
        for low in range(0, len(texts), at_once):
            group = list(enumerate(texts[low : low + at_once], low))
            jobs: dict[int, Future] = {k: pool.submit(one, k, x) for k, x in group if parser.wants_model(x)}
            wait(jobs.values(), timeout=budget)
            stuck = False
            for k, x in group:
                grammar = parser.parse(x, now)
                if k not in jobs:
                    yield grammar, "Grammar"
                elif not jobs[k].done():
                    stuck = True
                    yield grammar, "Timeout"
                elif jobs[k].exception():
                    yield grammar, "Failed"
                else:
                    spec, outcome = jobs[k].result()
                    yield (merge(grammar, spec) if outcome == "OK" else grammar), outcome
            if stuck:  # its threads are not waited for
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(at_once)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def understand(queries: DataFrame, text: str, model: Model, store: Store, now: datetime, at_once: int = AT_ONCE, budget: float = BUDGET, tasks: int = TASKS) -> DataFrame:
    """queries with spec (tagged JSON), outcome and source (cache, llm or grammar).

    At most tasks * at_once calls run at a time. Answers are stored before they are used, so that no later action calls the model again, and those of outcome OK enter
    the cache under the current version of specifications; entries of other versions are passed by. A null query is the empty one.
    """
    if not store.exists("query_cache"):
        store.write("query_cache", queries.sparkSession.createDataFrame([], CACHE))
    keyed = queries.withColumn("__key", cache_key(F.col(text)))
    asked = keyed.groupBy("__key").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    known = store.appended("query_cache", CACHE).filter(F.col("version") == SPEC_VERSION).groupBy("key").agg(F.max_by("spec", F.struct("made", "batch")).alias("spec"))
    hit = asked.join(known, F.col("__key") == F.col("key")).select("key", "spec", F.lit("OK").alias("outcome"), F.lit("cache").alias("source"))
    missing = asked.join(known, F.col("__key") == F.col("key"), "left_anti").repartition(tasks, "__key")
    arrow = to_arrow_schema(StructType.fromDDL(ANSWER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = list(answered(texts, model, now, at_once, budget))
            specs = [replace(s, source="llm" if o == "OK" else "grammar").to_json() for s, o in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (keys, specs, [o for _, o in out], ["llm" if o == "OK" else "grammar" for _, o in out])], schema=arrow)

    answers = store.write("query_answers", hit.unionByName(missing.mapInArrow(run, ANSWER)))
    made = int(now.replace(tzinfo=UTC).timestamp())
    store.append("query_cache", answers.filter("source = 'llm'").select("key", F.lit(SPEC_VERSION).alias("version"), "spec", F.lit(made).cast("long").alias("made")))
    return keyed.join(answers, F.col("__key") == F.col("key")).drop("__key", "key")


def evict(store: Store, before: datetime) -> None:
    """Writes the cache anew without entries made before a time, of each key the last."""
    kept = store.appended("query_cache", CACHE).filter(F.col("made") >= int(before.replace(tzinfo=UTC).timestamp()))
    last = kept.groupBy("key", "version").agg(F.max_by("spec", F.struct("made", "batch")).alias("spec"), F.max("made").alias("made"))
    rows = store.write("query_cache_kept", last.select("key", "version", "spec", "made"))
    store.write("query_cache", rows.limit(0))
    store.append("query_cache", rows)
