"""Exact nearest neighbours: filtered chunk scans, the best chunk of each file, batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scores import cosine_distance_to
from tessella.plans.clauses import Spec, where


class ModelMismatch(ValueError):
    """No chunk left by the filters was embedded by the current model."""


def current_model(chunks: DataFrame, model: str | None) -> DataFrame:
    """Chunks of the model, and those of unknown origin; all if no model is named."""
    return chunks if not model else chunks.filter(F.col("embedding_model").isin("", model))


def check_model(before: DataFrame, after: DataFrame) -> None:
    if not before.isEmpty() and after.isEmpty():
        raise ModelMismatch("ERR_MODEL_MISMATCH")


def distances(chunks: DataFrame, vector: list[float]) -> DataFrame:
    """chunks without their vectors, with their distance. Chunks without a vector are left out."""
    kept = [c for c in chunks.columns if c != "embedding"]
    return chunks.filter(F.col("embedding").isNotNull()).select(*kept, cosine_distance_to(F.col("embedding"), vector).alias("distance"))


def best_chunks(scored: DataFrame) -> DataFrame:
    """Each file's nearest chunk; of equally near ones the first by vector_id."""
    rest = [c for c in scored.columns if c not in ("file_id", "distance", "vector_id")]
    best = scored.groupBy("file_id").agg(F.min(F.struct("distance", "vector_id", *rest)).alias("b"))
    return best.select("file_id", "b.*")


#: File ids that are broadcast, and bytes of query vectors that one scan of the chunks serves.
MOST_IDS, QUERY_BYTES = 1_000_000, 64 << 20


def nearest_files(files: DataFrame, chunks: DataFrame, vector: list[float], spec: Spec | None = None, k: int = 20, model: str | None = None, narrow: bool = False) -> DataFrame:
    """The k files nearest to vector among those that the specification lets through, ties by path.

    A scan of two chunk columns finds the k files: where the filter leaves at most MOST_IDS files, their ids go to the scan, and no distance is
    computed for others; else ids and distances meet the files after it. A file's distance is a hash aggregate. Only then are the
    k files' own rows and chunks fetched, by their ids. narrow says that files are a selection already.
    """
    allowed = files.filter(where(spec)) if spec else files
    scan = current_model(chunks, model).filter(F.col("embedding").isNotNull())
    near = scan
    if narrow or (spec and (spec.must or spec.must_not)):
        ids = allowed.select("file_id")
        if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
            near = scan.join(F.broadcast(ids), "file_id", "left_semi")
    best = near.select("file_id", cosine_distance_to(F.col("embedding"), vector).alias("distance")).groupBy("file_id").agg(F.min("distance").alias("distance"))
    top = best.join(allowed.select("file_id", "path"), "file_id").orderBy("distance", "path").limit(k)
    return hydrated(allowed, scan, vector, [r["file_id"] for r in top.collect()], k)  # at most k


def hydrated(allowed: DataFrame, chunks: DataFrame, vector: list[float], found: list[int], k: int) -> DataFrame:
    """The rows of some files, at most k, with their nearest chunks, in order."""
    chosen = best_chunks(distances(chunks.filter(F.col("file_id").isin(found)), vector))
    return chosen.join(allowed.filter(F.col("file_id").isin(found)), "file_id").orderBy("distance", "path").limit(k)


def nearest_batch(queries: DataFrame, chunks: DataFrame, k: int = 10, block: int = 512) -> DataFrame:
    """(query_id, vector_id, file_id, distance, rank) for a table of queries (query_id, vector).

    One scan of the chunks serves all queries (QUERY_BYTES of them; more take a scan each so many bytes). A task compares each batch
    with the queries block by block, keeping its own k best for every query; the tasks' candidates meet in one window
    per query.
    """
    size = queries.agg(F.coalesce(F.sum(8 * F.size("vector") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-size // QUERY_BYTES))
    numbered = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(passes)).alias("__pass"))
    w = Window.partitionBy("query_id").orderBy("distance", "vector_id")
    found = [_scan(numbered.filter(F.col("__pass") == p).drop("__pass").toPandas(), chunks, k, block) for p in range(passes)]
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan(queries: pd.DataFrame, chunks: DataFrame, k: int, block: int) -> DataFrame:
    ids = queries["query_id"].to_numpy()
    matrix = np.array(queries["vector"].tolist(), dtype=np.float64).reshape(len(ids), -1 if len(ids) else 1)
    norms = np.linalg.norm(matrix, axis=1)

    def nearest(rows: pd.DataFrame, vectors: np.ndarray, fit: np.ndarray, own: slice) -> pd.DataFrame:
        distance = np.ones((len(ids[own]), len(rows)))
        if fit.any():
            scale = norms[own, None] * np.linalg.norm(vectors, axis=1)[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 1.0 - np.clip(matrix[own] @ vectors.T / scale, -1.0, 1.0)
            distance[:, fit] = np.where(scale > 0, d, 1.0)
        top = np.argpartition(distance, min(k, len(rows)) - 1, axis=1)[:, : min(k, len(rows))]
        # equally near rows beyond the cut stay candidates, so that ties go by vector_id
        limit = np.take_along_axis(distance, top, 1).max(axis=1)
        q, r = np.nonzero(distance <= limit[:, None])
        return pd.DataFrame({"query_id": ids[own][q], "vector_id": rows["vector_id"].to_numpy()[r], "file_id": rows["file_id"].to_numpy()[r], "distance": distance[q, r]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, pd.DataFrame] = {}
        for rows in batches:
            if not len(rows):
                continue
            given = rows["embedding"].tolist()
            fit = np.array([v is not None and len(v) == matrix.shape[1] for v in given])
            vectors = np.array([v for v, f in zip(given, fit, strict=True) if f], dtype=np.float64).reshape(int(fit.sum()), matrix.shape[1])
            for at in range(0, len(ids), block):
                new = nearest(rows, vectors, fit, slice(at, at + block))
                both = pd.concat([kept[at], new]) if at in kept else new
                kept[at] = both.sort_values(["query_id", "distance", "vector_id"]).groupby("query_id", sort=False).head(k)
        yield from kept.values()

    return chunks.select("vector_id", "file_id", "embedding").mapInPandas(scan, "query_id long, vector_id string, file_id long, distance double")


def strategy(matching: int, threshold: int = 5000) -> str:
    """How to answer: empty, exact over few files, or an index with a filter inside its scan."""
    return "empty" if matching == 0 else "brute_force" if matching < threshold else "post_filter"


def search_width(k: int, multiplier: int, total: int, matching: int, low: int = 64, high: int = 500) -> int:
    """The candidate list of an approximate index, wider the fewer files match."""
    return low if matching <= 0 else min(max(k * multiplier * total // matching, low), high)
