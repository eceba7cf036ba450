"""Streams with state and timers: debounced file events, retries of failed files, and the registry of failures.

Each is a stateful processor by key, whose state lies in Spark's state store (RocksDB) and survives restarts with the stream's checkpoint. Timers are of processing time, so a
path's last event or a retry leaves when its time has come, with no later event in the stream.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessella.operators.reports import retry_class

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, with the state store that processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def settled(query: StreamingQuery, seconds: float = 60.0) -> bool:
    """Waits until a stream has read something, finds no more, and holds no state; whether that came in time.

    A stream with timers runs batches without rows all the while, so it is never idle otherwise."""
    until = time.monotonic() + seconds
    while time.monotonic() < until and query.isActive:
        last = query.lastProgress
        if last and last["batchId"] > 0 and not last["numInputRows"] and not any(s["numRowsTotal"] for s in last["stateOperators"]):
            return True
        time.sleep(0.1)
    return False


# --- debounce

class Debounce(StatefulProcessor):
    """Of a path's events, the last one, delay milliseconds after the latest arrived."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "type string, us long, n long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kind, us, n, due = self.last.get() if self.last.exists() else (None, None, 0, 0)
        for r in rows:
            n += 1
            if us is None or (r["us"], r["type"] or "") >= (us, kind or ""):
                kind, us = r["type"], r["us"]
        if due:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay
        self.handle.registerTimer(due)
        self.last.update((kind, us, n, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            kind, us, n, due = self.last.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield Row(path=key[0], type=kind, us=us, n=n)


def debounced(events: DataFrame, delay: float = 0.5) -> DataFrame:
    """A stream (path, type, ts) as (path, type, ts, n): a path's last event (by ts, then type) and how many there were, delay seconds after the last arrived.

    An event that arrives meanwhile starts the delay anew. Null paths are one path; null times count as the earliest.
    """
    with_timers(events.sparkSession)
    given = events.select("path", "type", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))).alias("us"))
    out = given.groupBy("path").transformWithState(Debounce(int(delay * 1000)), "path string, type string, us long, n long", "append", "ProcessingTime")
    return out.select("path", "type", F.timestamp_micros("us").alias("ts"), "n")


# --- retries

#: Fields of an event for the coordinator; kind is failed, cancel, pause, unpause or reset.
RETRY_EVENT = "kind string, path string, code string, attempts int, generation long, until timestamp"
JOB = "path string, code string, attempts int, generation long, action string"


class Retries(StatefulProcessor):
    """The retries of the paths of one part: when each is due, by its class."""

    def __init__(self, most: int, backoff: float):
        self.most, self.backoff = most, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "path string", "code string, attempts int, generation long, due long, waits boolean")
        self.shared = handle.getValueState("shared", "paused long, generation long")

    def _due(self, now: int) -> Iterator[Row]:
        """What is due by now leaves; what is of an older generation goes without a trace."""
        paused, generation = self.shared.get() if self.shared.exists() else (0, 0)
        found = {k[0]: tuple(v)[:3] for k, v in self.jobs.iterator() if v[2] < generation or (paused if v[4] else v[3]) <= now}
        for path in found:
            self.jobs.removeKey((path,))
            code, attempts, own = found[path]
            if own >= generation:
                yield Row(path=path, code=code, attempts=attempts, generation=own, action="retry")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        paused, generation = self.shared.get() if self.shared.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["kind"] == "pause":  # the later end wins
                paused = max(paused, r["until"])
                self.handle.registerTimer(max(paused, now + 1))
            elif r["kind"] == "unpause":
                paused = 0
            elif r["kind"] == "reset":
                generation = max(generation, r["generation"])
            elif r["kind"] == "cancel":
                self.jobs.removeKey((r["path"],))
            elif r["again"] and r["attempts"] < self.most and r["generation"] >= generation:
                due = now + int(1000 * self.backoff * 2 ** (r["attempts"] - 1))
                self.jobs.updateValue((r["path"],), (r["code"], r["attempts"] + 1, r["generation"], due, r["waits"]))
                self.handle.registerTimer(max(due, now + 1))
            elif r["generation"] >= generation:
                self.jobs.removeKey((r["path"],))
                yield Row(path=r["path"], code=r["code"], attempts=r["attempts"], generation=r["generation"], action="record")
        self.shared.update((paused, generation))
        yield from self._due(now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._due(timerValues.getCurrentProcessingTimeInMs())


def coordinated(events: DataFrame, most: int = 3, backoff: float = 1.0, parts: int = 64) -> DataFrame:
    """A stream of RETRY_EVENTs (and seq, their order) as jobs (path, code, attempts, generation, action): retry when a path is to be tried for the attempts-th time, record when it has failed for good.

    A failed path of class TransientRetry comes again after backoff seconds, doubled with each attempt; one of TransientWait when no pause is in force (at once where none is).
    Permanent ones and those that failed most times are recorded. A cancelled path's retry is dropped; a reset drops the retries of all lower
    generations; a pause lasts until its time or an unpause. Paths are dealt over parts groups by hash; pause, unpause and reset go to each group. State is an entry a waiting path.
    """
    with_timers(events.sparkSession)
    kind = retry_class(F.col("code"))
    part = F.when(F.col("kind").isin("failed", "cancel"), F.array(F.pmod(F.xxhash64("path"), F.lit(parts)))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))
    given = events.filter(F.col("kind").isin("failed", "cancel", "pause", "unpause", "reset")).select(
        F.explode(part).alias("part"), "kind", "path", "code", F.coalesce("attempts", F.lit(1)).alias("attempts"), F.coalesce("generation", F.lit(0)).cast("long").alias("generation"), F.coalesce(F.unix_millis("until"), F.lit(0)).alias("until"),
        "seq", (kind != "Permanent").alias("again"), (kind == "TransientWait").alias("waits"),
    )
    return given.groupBy("part").transformWithState(Retries(most, backoff), JOB, "append", "ProcessingTime")


# --- admission

class Leases(StatefulProcessor):
    """The calls that a provider's clients may make: at most most in any window of so many milliseconds, in order of request."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "place long", "id string")
        self.state = handle.getValueState("state", "first long, next long, paused long, loose long, held array<bigint>")

    def _admit(self, provider: str, now: int) -> Iterator[Row]:
        first, next_, paused, loose, held = self.state.get() if self.state.exists() else (0, 0, 0, 0, [])
        # what was let go before was called since; now is the latest that can have been
        held = [t for t in held if t > now - self.window] + [now] * loose
        free = max(0, self.most - len(held)) if now >= paused else 0
        loose = min(free, next_ - first)
        for place in range(first, first + loose):
            yield Row(provider=provider, id=self.queue.getValue((place,))[0])
            self.queue.removeKey((place,))
        first += loose
        if not (first < next_ or loose or held or now < paused):
            self.state.clear()
            return
        self.state.update((first, next_, paused, loose, held))
        self.handle.registerTimer(now + 1 if loose else max(now + 1, paused, min(held, default=now) + self.window if held else now + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first, next_, paused, loose, held = self.state.get() if self.state.exists() else (0, 0, 0, 0, [])
        for r in sorted(rows, key=lambda r: (r["seq"], r["id"] or "")):
            if r["until"] is not None:
                paused = max(paused, r["until"])
            if r["id"] is not None:
                self.queue.updateValue((next_,), (r["id"],))
                next_ += 1
        self.state.update((first, next_, paused, loose, list(held)))
        yield from self._admit(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._admit(key[0], timerValues.getCurrentProcessingTimeInMs())


def leased(requests: DataFrame, most: int = 55, seconds: float = 60.0) -> DataFrame:
    """A stream of requests (provider, id, seq, until) as those that may be sent now (provider, id), in order of seq, each once.

    A provider's requests are one key, as its limit is one; the key holds ids alone, waiting ones in the state store and not in memory. A row with until (timestamp) is the
    provider's own wish: no request leaves before that time, the latest counts; its id may be null. The sink must have sent a batch's requests when it
    returns, as foreachBatch does: a batch's calls count as made when the next one begins, so that in no window of so many seconds more than most are made, by however many tasks.
    """
    with_timers(requests.sparkSession)
    given = requests.select("provider", "id", "seq", F.unix_millis(F.col("until").cast("timestamp")).alias("until"))
    return given.groupBy("provider").transformWithState(Leases(most, int(seconds * 1000)), "provider string, id string", "append", "ProcessingTime")


# --- the registry of failures

class Registry(StatefulProcessor):
    """Failed paths in order of their first failure, at most cap of them: a new one beyond that puts the oldest out."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "path string", "place long")
        self.order = handle.getMapState("order", "place long", "path string")
        self.ends = handle.getValueState("ends", "first long, next long, dropped long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first, next_, dropped = self.ends.get() if self.ends.exists() else (0, 0, 0)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if self.places.containsKey((r["path"],)):
                place = self.places.getValue((r["path"],))[0]
            else:
                if next_ - first >= self.cap:
                    old = self.order.getValue((first,))[0]
                    self.places.removeKey((old,))
                    self.order.removeKey((first,))
                    yield Row(path=old, place=first, gone=True, seq=r["seq"], code=None, message=None, attempts=None, last_failed_at=None, dropped=dropped + 1)
                    first, dropped = first + 1, dropped + 1
                place, next_ = next_, next_ + 1
                self.order.updateValue((place,), (r["path"],))
                self.places.updateValue((r["path"],), (place,))
            yield Row(path=r["path"], place=place, gone=False, dropped=dropped, **{n: r[n] for n in ("seq", "code", "message", "attempts", "last_failed_at")})
        self.ends.update((first, next_, dropped))


CHANGE = "path string, place long, gone boolean, seq long, code string, message string, attempts int, last_failed_at timestamp, dropped long"


def registry_changes(failures: DataFrame, cap: int = 10_000) -> DataFrame:
    """A stream of failures (seq, path, code, message, attempts, last_failed_at) as changes of the registry: each record's entry with its place, and entries that were put out (gone).

    Records count in the order of seq within a batch of the stream, and batches in their order. One key holds the registry: its state is bounded by cap, and
    a batch's rows pass through it one by one. That is for a stream's small batches; registry.keep walks large ones by blocks, in many tasks.
    """
    with_timers(failures.sparkSession)
    given = failures.select(F.lit(0).alias("all"), "seq", "path", "code", "message", "attempts", "last_failed_at")
    return given.groupBy("all").transformWithState(Registry(cap), CHANGE, "append", "None")


def standing(changes: DataFrame) -> DataFrame:
    """The registry after some changes: (path, place, code, message, attempts, last_failed_at) in no order; the number that were put out is max(dropped) of the changes, which is the first place that stands."""
    first = changes.agg(F.coalesce(F.max("dropped"), F.lit(0)).alias("first"))
    live = changes.join(F.broadcast(first), ~F.col("gone") & (F.col("place") >= F.col("first")))
    last = live.groupBy("place").agg(F.max(F.struct("seq", "code", "message", "attempts", "last_failed_at", "path")).alias("l"))
    return last.select("l.path", "place", "l.code", "l.message", "l.attempts", "l.last_failed_at")
