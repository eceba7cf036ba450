"""A stored vector index: vectors in cells around centroids of two levels, with a log of additions and deletions.

A few coarse centroids are fitted on a bounded sample. A coarse cell of more than CELL_ROWS vectors is split by centroids of its own, fitted on a bounded sample of it, so
that cells grow in number with the vectors, not in size, up to COARSE * FINE cells; then a cell has several files. The table is partitioned by cell: a
search reads the folders of the cells it asks for and no others. A cell knows how far its farthest vector is from its
centroid, so a search can tell when no unread cell holds a nearer one.

Additions and deletions are appended to a log. Its ids are broadcast to the cells' scan while they are few, and its fresh vectors are part of every search, whatever their cell.
save() writes both into a new version.

Defined results: vectors that are null, of another length than the centroids, or zero lie in cell -1, which every search reads; an empty index finds nothing; of
repeated ids one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.functions.scores import cosine_distance_to
from tessella.operators.tables import Store, latest

VECTORS = "vector_id string, file_id long, embedding array<float>"
LOG = f"{VECTORS}, cell int, gone boolean"
#: Vectors that a level's centroids are fitted on, rounds of fitting, most coarse cells, most parts of one, and vectors of a cell that isn't split.
SAMPLE, ROUNDS, COARSE, FINE, CELL_ROWS = 20_000, 10, 128, 128, 50_000
#: Vectors of a file; ids of the log that are broadcast; the log's share of the index beyond which it is written into the cells.
FILE_ROWS, MOST_IDS, LOG_SHARE = 250_000, 1_000_000, 0.1
#: Cells that a search reads at first.
FIRST = 8


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _centers(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n unit centroids of unit vectors."""
    centers = x[: min(n, len(x))].copy()
    for _ in range(rounds if len(centers) else 0):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centers)) > 0
        centers[filled] = sums[filled]
        centers = _unit(centers)
    return centers


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow column have dims numbers and are not zero, and these as unit rows, by their buffer."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    fits = (size == dims) & (dims > 0)
    x = values[at[fits][:, None] + np.arange(dims)] if fits.any() else np.zeros((0, dims))
    good = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, _unit(x[good])


@dataclass
class Cells:
    """Centroids by cell (a row each): those of the coarse level, and those of the parts of split ones."""

    coarse: np.ndarray
    #: coarse cell -> (its parts' centroids, the number of its first part)
    parts: dict[int, tuple[np.ndarray, int]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cells of unit vectors."""
        near = (x @ self.coarse.T).argmax(axis=1) if len(self.coarse) else np.full(len(x), -1)
        out = near.copy()
        for k, (centers, first) in self.parts.items():
            own = near == k
            if own.any():
                out[own] = first + (x[own] @ centers.T).argmax(axis=1)
        return out

    def all(self) -> list[tuple[int, np.ndarray]]:
        """Each cell that vectors can lie in, with its centroid."""
        whole = [(k, c) for k, c in enumerate(self.coarse) if k not in self.parts]
        return whole + [(first + i, c) for centers, first in self.parts.values() for i, c in enumerate(centers)]


def _sampled(vectors: DataFrame, dims: int, most: int) -> np.ndarray:
    """The unit vectors of the most smallest hashes of ids."""
    rows = vectors.filter(F.size("embedding") == dims).select("embedding", F.xxhash64("vector_id").alias("h")).orderBy("h").limit(most)
    x = np.array([r["embedding"] for r in rows.collect()], dtype=np.float64).reshape(-1, max(1, dims))
    return _unit(x[np.abs(x).sum(axis=1) > 0])


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> Cells:
    """Centroids for these vectors; cells: of the coarse level (else the root of the sample's size).

    Only samples come to the driver: at most sample vectors for the coarse level, and as many for all parts together.
    """
    one = vectors.filter(F.size("embedding") > 0)
    dims = one.agg(F.mode(F.size("embedding"))).first()[0] or 0
    x = _sampled(one, dims, sample)
    coarse = _centers(x, min(COARSE, cells or max(1, math.isqrt(len(x)))))
    found = Cells(coarse, {})
    if not len(coarse):
        return found
    counts = {r["cell"]: r["count"] for r in placed(vectors, found).groupBy("cell").count().collect()}
    large = {k: min(FINE, -(-n // cell_rows)) for k, n in counts.items() if k >= 0 and n > cell_rows}
    if large:
        share = max(1, sample // len(large))
        # a part's sample: the smallest hashes below a bound that leaves about its share, each cell by itself
        bound = F.create_map(*[F.lit(v) for k in large for v in (k, min(1.0, 1.5 * share / counts[k]))])[F.col("cell")]
        h = F.shiftrightunsigned(F.xxhash64("vector_id"), 33)
        some = placed(vectors, found).filter(F.col("cell").isin(list(large)) & (h < bound * (1 << 31))).select("cell", "embedding")
        by_cell: dict[int, list] = {}
        for r in some.limit(2 * sample + len(large)).collect():
            by_cell.setdefault(r["cell"], []).append(r["embedding"])
        number = len(coarse)
        for k in sorted(by_cell):
            own = _centers(_unit(np.array([v for v in by_cell[k] if len(v) == dims], dtype=np.float64).reshape(-1, dims)), large[k])
            if len(own) > 1:
                found.parts[k] = own, number
                number += len(own)
    return found


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(vector_id, file_id, embedding, cell, angle): the cell of the nearest centroid and the angle to it."""
    schema = T.StructType.fromDDL(f"{VECTORS}, cell int, angle double")
    arrow, dims = to_arrow_schema(schema), cells.coarse.shape[1] if len(cells.coarse) else 0
    sent = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        centers = dict(own.all())
        for rows in batches:
            cell, angle = np.full(rows.num_rows, -1, np.int32), np.zeros(rows.num_rows)
            fits, x = _matrix(rows.column(2), dims)
            if fits.any():
                cell[fits] = got = own.of(x)
                for k in np.unique(got):
                    these = got == k
                    angle[np.flatnonzero(fits)[these]] = np.arccos(np.clip(x[these] @ centers[int(k)], -1, 1))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], rows.column(2).cast(arrow.field("embedding").type), pa.array(cell), pa.array(angle)], schema=arrow)

    return vectors.select("vector_id", "file_id", "embedding").mapInArrow(run, schema)


class VectorIndex:
    """add, delete, has, search, save (a compacted version) and load, over a store."""

    def __init__(self, spark: SparkSession, root: str, name: str = "vectors", store: Store | None = None):
        self.spark, self.store, self.name = spark, store or Store(spark, root), name
        self.cells, self.figures, self.at = Cells(np.zeros((0, 0)), {}), {}, ("", "")
        self.load()

    def load(self) -> bool:
        """Takes up the stored version; whether there is one. The cells' table is written last and names the versions of the others that it is of."""
        if not self.store.exists(f"{self.name}_cells"):
            return False
        rows = self.store.read(f"{self.name}_cells").collect()  # at most COARSE * (FINE + 1)
        coarse = sorted((r["k"], r["center"]) for r in rows if r["above"] is None and r["k"] >= 0)
        parts: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["k"]):
            if r["above"] is not None:
                parts.setdefault(r["above"], []).append((r["k"], r["center"]))
        self.cells = Cells(np.array([c for _, c in coarse], dtype=np.float64).reshape(len(coarse), -1), {k: (np.array([c for _, c in v], dtype=np.float64), v[0][0]) for k, v in parts.items()})
        #: cell -> (vectors, widest angle)
        self.figures = {r["k"]: (r["n"], r["angle"]) for r in rows if r["n"]}
        self.at = rows[0]["vectors"], rows[0]["log"]
        return True

    def exists(self) -> bool:
        return self.store.exists(f"{self.name}_cells")

    def build(self, vectors: DataFrame, cells: int | None = None, cell_rows: int = CELL_ROWS) -> None:
        """A new index of these vectors (vector_id, file_id, embedding), each id once."""
        self.cells = fit(vectors, cells, cell_rows=cell_rows)
        self._write(vectors)

    def _write(self, vectors: DataFrame) -> None:
        one = placed(vectors.dropDuplicates(["vector_id"]), self.cells)
        # a cell's rows meet in one task, or in several where they are many
        stored = self.store.write(self.name, one.hint("rebalance", "cell"), ["cell"], FILE_ROWS)
        self.figures = {r["cell"]: (r["n"], r["angle"]) for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
        above = {first + i: k for k, (centers, first) in self.cells.parts.items() for i in range(len(centers))}
        known = {**dict(enumerate(self.cells.coarse)), **dict(self.cells.all())}
        rows = [(k, above.get(k), [float(v) for v in c], *self.figures.get(k, (0, 0.0))) for k, c in known.items()]
        rows.append((-1, None, [], *self.figures.get(-1, (0, 0.0))))
        self.store.write(f"{self.name}_log", self.spark.createDataFrame([], LOG))
        self.at = self.store.seen[self.name], self.store.seen[f"{self.name}_log"]
        self.store.write(f"{self.name}_cells", self.spark.createDataFrame([(*r, *self.at) for r in rows], "k int, above int, center array<double>, n long, angle double, vectors string, log string"))

    def _batches(self) -> DataFrame:
        return self.store.appended(f"{self.name}_log", LOG, self.at[1])

    def _log(self) -> DataFrame:
        return latest(self._batches(), "vector_id", "batch")

    def add(self, vectors: DataFrame) -> None:
        """A batch of vectors; a known id takes the new vector."""
        if not self.exists():
            self.build(vectors)
            return
        fresh = placed(vectors.dropDuplicates(["vector_id"]), self.cells).drop("angle").withColumn("gone", F.lit(False))
        self.store.append(f"{self.name}_log", fresh, self.at[1])
        self._fold()

    def delete(self, ids: DataFrame) -> int:
        """Takes ids (vector_id) away; how many there were."""
        there = self.rows().join(ids.select("vector_id").distinct(), "vector_id", "left_semi").select("vector_id", "file_id", F.lit(None).cast("array<float>").alias("embedding"), "cell", F.lit(True).alias("gone"))
        batch = self.store.append(f"{self.name}_log", there, self.at[1])
        n = self._batches().filter(F.col("batch") == batch).count()
        self._fold()
        return n

    def _fold(self) -> None:
        """Writes the log into the cells where it has grown beyond its share."""
        if self._batches().count() > max(MOST_IDS // 10, LOG_SHARE * sum(n for n, _ in self.figures.values())):
            self.save()

    def rows(self, cells: list[int] | None = None, fresh: bool = True, logged: int | None = None) -> DataFrame:
        """What is stored now (vector_id, file_id, embedding, cell): of some cells or all, with the log's fresh vectors or without; logged: the log's rows, where known."""
        # with the schema given, no file is opened to plan a scan
        base = self.spark.read.schema(f"{VECTORS}, cell int").parquet(self.store.folder(self.name, self.at[0]))
        own = base.filter(F.col("cell").isin(cells)) if cells is not None else base
        n = self._batches().count() if logged is None else logged  # of Parquet footers
        if not n:
            return own
        log = self._log()
        ids, few = log.select("vector_id"), n <= MOST_IDS
        own = own.join(F.broadcast(ids) if few else ids, "vector_id", "left_anti").select(*base.columns)
        return own.unionByName(log.filter(~F.col("gone")).select(*base.columns)) if fresh else own

    def has(self, ids: DataFrame) -> DataFrame:
        """ids (vector_id) with has."""
        known = self.rows().select("vector_id", F.lit(True).alias("has"))
        return ids.select("vector_id").distinct().join(known, "vector_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))

    def _order(self, vector: list[float]) -> tuple[list[int], dict[int, float]]:
        """The filled cells, nearest centroid first, and the least distance that a vector of each can have."""
        q = np.array(vector, dtype=np.float64)
        norm = np.linalg.norm(q)
        filled = [(k, c) for k, c in self.cells.all() if self.figures.get(k, (0, 0))[0]]
        if not filled or len(q) != self.cells.coarse.shape[1] or not norm > 0:
            return [k for k, _ in filled], {k: 0.0 for k, _ in filled}
        angle = np.arccos(np.clip(np.array([c for _, c in filled]) @ (q / norm), -1, 1))
        least = {k: 1 - math.cos(max(0.0, a - self.figures[k][1] - 1e-6)) for (k, _), a in zip(filled, angle, strict=True)}
        return [filled[i][0] for i in np.argsort(angle, kind="stable")], least

    def search(self, vector: list[float], k: int = 20, probes: int | None = None) -> DataFrame:
        """The k nearest (vector_id, file_id, distance) in the probes nearest cells; in all, thus exactly, if probes isn't given."""
        cells = [-1, *self._order(vector)[0][:probes]] if probes is not None else None
        near = self.rows(cells).filter(F.col("embedding").isNotNull())
        return near.select("vector_id", "file_id", cosine_distance_to(F.col("embedding"), vector).alias("distance")).orderBy("distance", "vector_id").limit(k)

    def nearest_files(self, vector: list[float], k: int = 20, allowed: DataFrame | None = None, width: int = 500, matching: int | None = None, first: int = FIRST) -> tuple[list[tuple[float, str, int]], dict]:
        """The k nearest files' (distance, vector_id, file_id), each by its best chunk, of those in allowed (file_id); and what was read.

        Cells are read nearest first, in rounds that double, each a job over its own cells alone. The search ends when k files are certain (no unread
        cell can hold a nearer vector), when width vectors of allowed files were compared and k files found, or when no cell is left. allowed's ids go to the scan while they are few
        (matching, or a count), and else meet it by a shuffle. Only k rows a round come to the driver.
        """
        order, least = self._order(vector)
        ids = None
        if allowed is not None:
            ids = allowed.select("file_id")
            n = matching if matching is not None else ids.limit(MOST_IDS + 1).count()
            ids = F.broadcast(ids) if n <= MOST_IDS else ids
        best: dict[int, tuple[float, str]] = {}
        logged = self._batches().count()
        at, compared, certain = 0, 0, False
        while True:
            cells = order[at : at + max(first, at)]
            part = self.rows([*cells, *([] if at else [-1])], not at, logged).filter(F.col("embedding").isNotNull())
            part = part if ids is None else part.join(ids, "file_id", "left_semi")
            counted = Observation()
            scored = part.select("file_id", "vector_id", cosine_distance_to(F.col("embedding"), vector).alias("distance")).observe(counted, F.count(F.lit(1)).alias("n"))
            files = scored.groupBy("file_id").agg(F.min(F.struct("distance", "vector_id")).alias("b"))
            for r in files.select("file_id", "b.distance", "b.vector_id").orderBy("distance", "vector_id").limit(k).collect():
                best[r["file_id"]] = min(best.get(r["file_id"], (math.inf, "")), (r["distance"], r["vector_id"]))
            compared += counted.get["n"]
            at += len(cells)
            worst = sorted(d for d, _ in best.values())[k - 1] if len(best) >= k else math.inf
            certain = at >= len(order) or worst <= min(least[c] for c in order[at:])
            if certain or (len(best) >= k and compared >= width):
                break
        return sorted((d, v, f) for f, (d, v) in best.items())[:k], {"cells": at, "of": len(order), "compared": compared, "certain": certain}

    def save(self) -> None:
        """Writes the log into a new version of the cells, in place of both."""
        self._write(self.rows().select("vector_id", "file_id", "embedding"))
