"""Streams: debounced file events, their application, admission by rate, and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.reports import retry_class

KINDS = {"create": "created", "write": "modified", "remove": "deleted", "rename": "deleted"}


def file_events(raw: DataFrame) -> DataFrame:
    """(path, op, ts) of a watcher as (path, type, ts); other operations are ignored."""
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.lower("op")]
    return raw.select("path", kind.alias("type"), "ts").filter("type is not null")


def debounced(events: DataFrame, gap: str = "500 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """The last event of each burst of a path's events: (path, type, ts, n). Works on batches and streams."""
    x = events.withWatermark("ts", lateness) if events.isStreaming else events
    sessions = x.groupBy(F.session_window("ts", gap), "path").agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("ts"), F.count("*").alias("n"))
    return sessions.select("path", "type", "ts", "n")


def apply_events(events: DataFrame, index: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch's last event of a path: created and modified paths go to index, deleted ones to remove. Once over what there is, or every so often until stopped."""

    def step(batch: DataFrame, _: int) -> None:
        if every and batch.isEmpty():
            return
        last = batch.groupBy("path").agg(F.max_by("type", "ts").alias("type"))
        index(last.filter(F.col("type") != "deleted").select("path"))
        remove(last.filter(F.col("type") == "deleted").select("path"))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ticker(spark: SparkSession, every: str, act: Callable[[], None], checkpoint: str) -> StreamingQuery:
    """Calls act every so often ("1 second") until the query is stopped."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rows.writeStream.foreachBatch(lambda _, __: act()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def admit(times: list[float], admitted: list[float], most: int, seconds: float, paused_until: float = 0.0) -> tuple[list[bool], list[float]]:
    """Decisions on requests in order of time, and the admitted times that still count.

    A request is admitted if fewer than most were in the seconds before it; refused ones don't count.
    """
    out = []
    for t in times:
        admitted = [a for a in admitted if a > t - seconds]
        ok = t >= paused_until and len(admitted) < most
        out.append(ok)
        if ok:
            admitted.append(t)
    return out, admitted


def admitted(requests: DataFrame, most: int = 55, seconds: float = 60.0) -> DataFrame:
    """A stream (key, ts) with its decisions: (key, ts, admitted). State holds at most the admitted times of the window.

    A request may carry paused_until (timestamp, null for none): from it on its key admits nothing before that time, of several the latest.
    """
    paused = F.col("paused_until").cast("timestamp") if "paused_until" in requests.columns else F.lit(None).cast("timestamp")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        decisions = []
        for t, p in zip(rows["ts"], rows["paused_until"], strict=True):
            until = max(until, 0.0 if pd.isna(p) else p.timestamp())
            ok, held = admit([t.timestamp()], held, most, seconds, until)
            decisions += ok
        state.update((held, until))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "admitted": decisions})

    given = requests.select("key", "ts", paused.alias("paused_until"))
    return given.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, admitted boolean", "held array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def due_retries(queue: DataFrame, now: str, generation: int | None = None, cancelled: DataFrame | None = None, unpaused: bool = False) -> DataFrame:
    """Rows of a retry table whose time has come.

    Rows of another generation and of cancelled paths (path) never come due; when the rate limit's pause is over, what waited for it
    is due at once.
    """
    due = F.col("next_attempt_at") <= F.lit(now).cast("timestamp")
    if unpaused:
        due = due | (retry_class(F.col("code")) == "TransientWait")
    out = queue.filter(due)
    if generation is not None:
        out = out.filter(F.col("generation") == generation)
    return out if cancelled is None else out.join(cancelled.select("path").distinct(), "path", "left_anti")


def reschedule(failed: DataFrame, most: int = 3) -> DataFrame:
    """(path, code, attempts, failed_at) to the retry table's rows: permanent or spent ones are recorded instead."""
    kind = retry_class(F.col("code"))
    again = (kind != "Permanent") & (F.col("attempts") < most)
    wait = F.when(kind == "TransientRetry", F.pow(F.lit(2.0), F.col("attempts") - 1)).otherwise(F.lit(60.0))
    return failed.withColumns({"recorded": ~again, "next_attempt_at": F.when(again, F.timestamp_micros((F.unix_micros("failed_at") + wait * 1_000_000).cast("long")))})
