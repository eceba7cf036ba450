"""Failure, status and usage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.schema import LABELS, RETRY


def retry_class(code):
    return F.coalesce(F.create_map(*[F.lit(x) for p in RETRY.items() for x in p])[code], F.lit("Permanent"))


def label(code):
    """What an error code says; unknown codes say themselves."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[code], code)


def registry(failures: DataFrame, cap: int = 10_000) -> DataFrame:
    """The cap newest paths by first place, one row each: seq, and code, message, attempts and last_failed_at of the last failure.

    A path keeps its place while it is registered, and a new one beyond cap puts the oldest out. A path that was put out
    and fails again keeps its first place here, where a registry kept failure by failure would take it as new.
    """
    last = ["code", *[c for c in ("message", "attempts", "last_failed_at") if c in failures.columns]]
    rows = failures.groupBy("path").agg(F.min("seq").alias("first"), F.max(F.struct("seq", *last)).alias("l"), F.count("*").alias("n"))
    kept = [F.col(f"l.{c}").alias(c) for c in last]
    tries = [] if "attempts" in last else [F.col("n").alias("attempts")]
    return rows.select("path", F.col("first").alias("seq"), *kept, *tries).orderBy(F.desc("seq")).limit(cap)


def dropped(failures: DataFrame, cap: int = 10_000) -> DataFrame:
    """One row (dropped): the paths that the registry put out."""
    return failures.agg(F.greatest(F.count_distinct("path") - cap, F.lit(0)).alias("dropped"))


def failure_groups(registry_: DataFrame, samples: int = 3, top: int = 5) -> DataFrame:
    """(code, label, n, sample_files): the largest groups, with their first paths.

    First paths come from a ranking of which only a few rows a code survive each partition's partial limit.
    """
    counts = registry_.groupBy("code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy("seq")
    first = registry_.select("code", "seq", "path").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
    picked = first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"]).alias("sample_files"))
    return counts.join(picked, "code").select("code", label(F.col("code")).alias("label"), "n", "sample_files").orderBy(F.desc("n"), "code").limit(top)


def status(files: DataFrame, registry_: DataFrame) -> DataFrame:
    """One row: total, indexed, failed and pending files."""
    f = files.join(registry_.select("path", F.lit(True).alias("failed")), "path", "left")
    failed = F.coalesce("failed", F.lit(False))
    done = (F.col("content_hash") != "") & ~failed
    return f.agg(F.count("*").alias("total"), F.count_if(done).alias("indexed"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.col("content_hash") == "")).alias("pending"))


def call_stats(calls: DataFrame) -> DataFrame:
    """(ms, hit) to one row: calls, mean whole milliseconds, cache hits and misses."""
    n = F.count_if(~F.col("hit"))
    return calls.agg(n.alias("calls"), F.coalesce(F.expr("try_divide(sum(case when not hit then ms end) - sum(case when not hit then ms end) % count_if(not hit), count_if(not hit))").cast("long"), F.lit(0)).alias("avg_ms"), F.count_if("hit").alias("hits"), n.alias("misses"))


def requests_per_day(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def window_counts(requests: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """requests with in_window: those of the key in the seconds before and with each."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds("ts")).rangeBetween(-seconds + 1, 0)
    return requests.withColumn("in_window", F.count("*").over(w))


def mean_scores(cases: DataFrame) -> DataFrame:
    """(score, tags) to (tag, mean): overall as tag "", and each tag."""
    tags = F.explode(F.concat(F.array(F.lit("")), "tags"))
    return cases.select("score", tags.alias("tag")).groupBy("tag").agg(F.avg("score").alias("mean"))


def retry_schedule(failures: DataFrame, most: int = 3) -> DataFrame:
    """failures (attempts so far, last_failed_at, code) with verdict and next_attempt_at: 1 s after the first, then twice it."""
    kind = retry_class(F.col("code"))
    again = (kind == "TransientRetry") & (F.col("attempts") < most)
    wait = F.pow(F.lit(2.0), F.col("attempts") - 1)
    return failures.withColumns({
        "verdict": F.when(again, "retry").when(kind == "TransientWait", "wait").otherwise("record"),
        "next_attempt_at": F.when(again, F.timestamp_micros((F.unix_micros("last_failed_at") + wait * 1_000_000).cast("long"))),
    })
