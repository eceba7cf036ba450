"""The registry of failures over batches of any size: blocks of records are walked side by side, until each began with what the block before it ended with.

What stands after a record depends on all records before it, but a registry forgets: from different beginnings, the same records soon lead to the same paths in the same order. So each block is first walked
from an empty registry, then those whose beginning was another from the end of the block before, until no beginning changes. Each round settles at least one more block, so the result is that of a walk
record by record whatever the paths; two or three rounds do unless the paths that recur are hardly more than the registry holds, where each block may need its own round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.tables import Store
from tessella.streaming.timers import CHANGE

_RECORD = "seq long, path string, code string, message string, attempts int, last_failed_at timestamp"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def _walked(rows: pa.Table, starts: pa.Table, cap: int) -> tuple[pa.Table, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """A block's records in order, their places, the paths it began with, all that entered (those first), and what stands at its end.

    Places count from the block's first new entry, so those of its beginning are negative. A null path is no other's equal.
    """
    rows = rows.sort_by("at")
    start = pa.concat_arrays(starts["start"].chunks).flatten()
    paths = rows["path"]
    coded = pa.concat_arrays([start.cast(paths.type), *paths.chunks]).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_pylist()
    had = len(start)
    order, first = codes[:had], 0
    place = {c: k - had for k, c in enumerate(order) if c >= 0}
    places = []
    for c in codes[had:]:
        k = place.get(c)
        if k is None:
            if len(order) - first >= cap:
                place.pop(order[first], None)
                first += 1
            k = len(order) - had
            order.append(c)
            if c >= 0:
                place[c] = k
        places.append(k)
    entered = coded.dictionary.take(pa.array([None if c < 0 else c for c in order], "int32"))
    return rows, np.array(places, "int64"), start, entered, entered[first:]


def _ends(rows: DataFrame, starts: DataFrame, cap: int) -> DataFrame:
    """(block, start, end, n) of the blocks of starts: what each begins and ends with, and how many entries are new."""

    def run(key, rows: pa.Table, starts: pa.Table) -> pa.Table:
        _, _, start, entered, end = _walked(rows, starts, cap)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], "int32"), x.cast("string")) for x in (start, end)]
        return pa.table({"block": pa.array([key[0].as_py()], "int32"), "start": lists[0], "end": lists[1], "n": pa.array([len(entered) - len(start)], "int64")})

    return rows.select("block", "at", "path").groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(run, "block int, start array<string>, end array<string>, n long")


def _changes(rows: DataFrame, starts: DataFrame, cap: int) -> DataFrame:
    """The changes of all blocks, with places and entries (entered) counted from each block's beginning."""

    def run(key, rows: pa.Table, starts: pa.Table) -> pa.Table:
        rows, places, start, entered, _ = _walked(rows, starts, cap)
        count = np.maximum.accumulate(np.maximum(places, -1)) + 1
        new = np.flatnonzero(np.diff(count, prepend=0))
        out = new[places[new] - cap >= -len(start)]  # records that put an entry out
        gone = places[out] - cap
        parts = []
        for at, place, is_gone in ((out, gone, True), (np.arange(len(places)), places, False)):
            own = rows.select(["seq"]).take(pa.array(at)) if is_gone else rows
            cols = {"block": pa.repeat(pa.scalar(key[0].as_py(), "int32"), len(at)), "place": pa.array(place), "gone": pa.repeat(is_gone, len(at)), "entered": pa.array(count[at])}
            cols |= {n: own[n] if n == "seq" or not is_gone else pa.nulls(len(at), rows[n].type) for n in _NAMES}
            if is_gone:
                cols["path"] = entered.take(pa.array(gone + len(start))).cast(rows["path"].type)
            parts.append(pa.table(cols))
        return pa.concat_tables(parts)

    return rows.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(run, f"block int, place long, gone boolean, entered long, {_RECORD}")


def keep(root: str, cap: int = 10_000, block: int = 1 << 16) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of failures (seq, path, code, message, attempts, last_failed_at): appends each batch's changes, as of timers.registry_changes, to those under root (see changes).

    At most cap (1 at least) paths stand. Records count in the order of seq within a batch, nulls last, ties by path, and batches in their order; a batch that comes again replaces what it gave. A failure without a path is always
    new. A task holds one block, of about so many records or 16 times cap; of what stands, cap paths a block are stored.
    """
    block = max(block, 16 * cap) if block >= 1 << 16 else block

    def step(failures: DataFrame, batch: int) -> None:
        spark = failures.sparkSession
        store, work = Store(spark, root), Store(spark, f"{root}/work-{batch}")
        begun = spark.read.schema("place long, path string").parquet(f"{root}/kept/{batch - 1}") if batch else spark.createDataFrame([], "place long, path string")
        begun = begun.agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("x"), F.coalesce(F.max("place") + 1, F.lit(0)).alias("next"))
        next_ = begun.first()["next"]

        n = max(1, -(-failures.count() // block))
        order = [F.col("seq").asc_nulls_last(), F.col("path")]
        ranged = failures.select(*_NAMES).repartitionByRange(n, *order).sortWithinPartitions(*order)
        rows = work.write("rows", ranged.withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))

        number = F.col("id").cast("int")
        start = F.when(number == 0, F.transform("x", lambda e: e["path"])).otherwise(F.array().cast("array<string>"))
        ends = work.write("ends", _ends(rows, spark.range(n).crossJoin(begun).select(number.alias("block"), start.alias("start")), cap))
        while True:
            before = ends.select((F.col("block") + 1).alias("block"), F.col("end").alias("is"))
            todo = work.write("todo", ends.join(before, "block").filter(~F.col("start").eqNullSafe(F.col("is"))).select("block", F.col("is").alias("start")))
            if todo.isEmpty():
                break
            again = _ends(rows.join(todo.select("block"), "block", "left_semi"), todo, cap)
            ends = work.write("ends", ends.join(todo.select("block"), "block", "left_anti").unionByName(again))

        # a row a block: what the blocks before it entered
        bases = ends.select("block", "end", "n", (F.sum("n").over(Window.orderBy("block")) - F.col("n") + next_).alias("base"))
        found = _changes(rows, ends.select("block", "start"), cap).join(F.broadcast(bases.select("block", "base")), "block")
        found = found.withColumn("place", F.col("base") + F.col("place")).withColumn("dropped", F.greatest(F.lit(0).cast("long"), F.col("base") + F.col("entered") - cap))
        found.select(*[x.split()[0] for x in CHANGE.split(", ")]).write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
        last = bases.filter(F.col("block") == n - 1).select((F.col("base") + F.col("n") - F.size("end")).alias("first"), F.posexplode("end").alias("k", "path"))
        last.select((F.col("first") + F.col("k")).alias("place"), "path").write.mode("overwrite").parquet(f"{root}/kept/{batch}")
        store.drop(f"work-{batch}")
        store.drop(f"kept/{batch - 2}")

    return step


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The changes that keep has stored under root."""
    return spark.read.schema(f"{CHANGE}, batch long").parquet(f"{root}/changes").drop("batch")
