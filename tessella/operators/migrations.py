"""Ordered, versioned changes of stored tables.

Each step turns a table's stored rows into those of its next version. What was applied is a table of its own (version, applied_at); a
store without that table which holds files counts as one of the last version before steps were recorded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.tables import Store, derived

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """change takes the tables by name and returns those that it changes."""

    version: int
    name: str
    change: Callable[[Tables], Tables]


def _with(df: DataFrame, **columns) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({n: c for n, c in columns.items() if n not in df.columns})


STEPS = (
    Step(1, "tables", lambda t: {}),
    Step(2, "vectors", lambda t: {"chunks": _with(t["chunks"], embedding=F.lit(None).cast("array<float>"))}),
    Step(3, "models", lambda t: {"chunks": _with(t["chunks"], embedding_model=F.lit(""), embedding_dims=F.lit(0))}),
    Step(4, "path parts", lambda t: {"files": derived(t["files"])}),
    Step(5, "thumbnails", lambda t: {"files": _with(t["files"], thumbnail_path=F.lit(""))}),
)
UNRECORDED = 1
APPLIED = "migrations"


class Downgrade(ValueError):
    """The store was written by a later version than this one knows."""


def migrate(store: Store, steps: tuple[Step, ...] = STEPS) -> list[int]:
    """Applies the steps that the store lacks, in order, each recorded when its tables are written; their versions."""
    spark, names = store.spark, ("files", "chunks")
    if store.exists(APPLIED):
        done = {r["version"] for r in store.read(APPLIED).select("version").collect()}
    else:
        done = set(range(1, UNRECORDED + 1)) if store.exists("files") else set()
        if done:
            _record(store, sorted(done))
    known = max(s.version for s in steps)
    if any(v > known for v in done):
        raise Downgrade(f"the store is at version {max(done)}, this engine knows {known}")
    out = []
    for step in sorted(steps, key=lambda s: s.version):
        if step.version in done:
            continue
        tables = {n: store.read(n) for n in names if store.exists(n)}
        if len(tables) == len(names):
            for name, df in step.change(tables).items():
                store.write(name, df)
        _record(store, [step.version])
        done.add(step.version)
        out.append(step.version)
    spark.catalog.clearCache()
    return out


def stamp(store: Store) -> None:
    """Records all steps for a store that was written by this version."""
    if not store.exists(APPLIED):
        _record(store, [s.version for s in STEPS])


def _record(store: Store, versions: list[int]) -> None:
    new = store.spark.createDataFrame([(v,) for v in versions], "version int").withColumn("applied_at", F.current_timestamp())
    store.write(APPLIED, store.read(APPLIED).unionByName(new) if store.exists(APPLIED) else new)
