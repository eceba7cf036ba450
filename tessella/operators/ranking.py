"""Rescoring, filter relaxation and the fusion of rankings."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.clauses import Clause, Spec, predicate

RECENT, RRF_K, EXACT_BONUS = 1.2, 60, 0.05
DROP_ORDER = ("modified_at", "size_bytes", "path", "file_type", "extension")
_NAMES = {"modified_at": "date", "size_bytes": "size", "path": "path", "file_type": "type", "extension": "extension"}


def final_score(spec: Spec, distance: Column, recent: float = RECENT) -> Column:
    """Similarity times the boosts of matching should clauses, times recent if all date bounds hold."""
    score = 1.0 - distance / 2.0
    for c in spec.should:
        if c.boost > 0 and c.field in ("file_type", "extension") and isinstance(c.value, str) and (c.op == "eq" or (c.op == "contains" and c.value)):
            hit = F.col(c.field) == c.value if c.op == "eq" else F.col(c.field).contains(c.value)
            score = score * F.when(hit, float(c.boost)).otherwise(1.0)
    dates = [c for c in spec.must if c.field == "modified_at"]
    if dates and all(isinstance(c.value, int | datetime) for c in dates):
        score = score * F.when(reduce(lambda a, b: a & b, [predicate(c) for c in dates]), recent).otherwise(1.0)
    return score


def rerank(results: DataFrame, spec: Spec, recent: float = RECENT) -> DataFrame:
    """results (with distance and the files' columns) by final_score, ties by path."""
    return results.withColumn("final_score", final_score(spec, F.col("distance"), recent)).orderBy(F.desc("final_score"), "path")


def drop_order(names: list[str]) -> tuple[str, ...]:
    """The known fields among names; the usual order if there are none."""
    known = tuple(n for n in names if n in (*DROP_ORDER, "semantic_contains"))
    return known or DROP_ORDER


def ladder(must: tuple[Clause, ...], order: tuple[str, ...] = DROP_ORDER) -> list[Clause]:
    """Clauses in the order in which relaxation drops them; those on fields outside the order go together, last."""
    return [c for f in order for c in must if c.field == f]


def banner(c: Clause) -> str:
    return f"{_NAMES.get(c.field, c.field)} filter"


def relaxation_levels(files: DataFrame, spec: Spec, order: tuple[str, ...] = DROP_ORDER) -> DataFrame:
    """files that no must_not clause bars, with level: how many drops it takes until the file is let through.

    One pass in place of a plan for each step: a file's level is set by the last clause in the ladder that it fails.
    """
    steps = ladder(spec.must, order)
    rest = [c for c in spec.must if c not in steps and c.field != "semantic_contains"]
    barred = [predicate(c, True) for c in spec.must_not if c.field != "semantic_contains"]
    level = F.when(reduce(lambda a, b: a | b, [~F.coalesce(predicate(c), F.lit(False)) for c in rest]), len(steps) + 1) if rest else None
    for k, c in reversed(list(enumerate(steps, 1))):
        fails = ~F.coalesce(predicate(c), F.lit(False))
        level = F.when(fails, k) if level is None else level.when(fails, k)
    kept = reduce(lambda a, b: a & b, barred, F.lit(True))
    return files.filter(kept).withColumn("level", F.lit(0) if level is None else level.otherwise(0))


def relaxed(files: DataFrame, spec: Spec, order: tuple[str, ...] = DROP_ORDER) -> tuple[DataFrame, str]:
    """The files of the lowest level that has any, and a note of what was dropped last ("" if nothing was).

    files are those that could be results at all (with a vector).
    """
    levels = relaxation_levels(files, spec, order)
    least = levels.agg(F.min("level")).first()[0]
    steps = ladder(spec.must, order)
    if least is None:  # no files at all
        return levels.drop("level"), banner(steps[-1]) if steps else "all filters" if spec.must else ""
    kept = levels.filter(F.col("level") <= least).drop("level")
    return kept, "" if least == 0 else banner(steps[min(least, len(steps)) - 1]) if steps else "all filters"


def ranked(df: DataFrame, *order) -> DataFrame:
    """df, already cut to a result list, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(semantic: DataFrame, names: DataFrame, k: int = 0, rrf_k: int = RRF_K, bonus: float = EXACT_BONUS) -> DataFrame:
    """Reciprocal-rank fusion of two result lists (path, rank, ...), by score, then path.

    names also has match_kind; an exact name adds the bonus. Columns of both sides stay, the semantic side's first.
    """
    rrf_k = rrf_k if rrf_k > 0 else RRF_K
    s = semantic.select("path", F.col("rank").alias("semantic_rank"), *[c for c in ("file_id", "distance", "vector_id", "chunk_index", "start_time", "end_time", "embedding_model") if c in semantic.columns])
    n = names.select(F.col("path"), F.col("rank").alias("name_rank"), F.col("match_kind").alias("name_kind"), *[F.col(c) for c in ("highlights",) if c in names.columns], *[F.col(c).alias(f"__{c}") for c in ("file_id",) if c in names.columns])
    x = s.join(n, "path", "full_outer")
    if "__file_id" in x.columns:
        x = (x.withColumn("file_id", F.coalesce("file_id", "__file_id")) if "file_id" in x.columns else x.withColumnRenamed("__file_id", "file_id")).drop("__file_id")
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    extra = F.when(F.col("name_kind") == "exact", bonus).otherwise(0.0)
    kind = F.when(F.col("semantic_rank").isNull(), "filename").when(F.col("name_rank").isNull(), "content").otherwise("both")
    out = x.withColumns({"score": part("semantic_rank") + part("name_rank") + extra, "match_kind": kind}).orderBy(F.desc("score"), "path")
    return out.limit(k) if k > 0 else out


def names_first(names: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Filename hits in their order, then semantic results that they lack, k in all; both have (path, rank)."""
    rest = semantic.join(names.select("path"), "path", "left_anti")
    cols = ["path", "rank", "leg"]
    both = names.withColumn("leg", F.lit(0)).select(*cols).unionByName(rest.withColumn("leg", F.lit(1)).select(*cols))
    return both.orderBy("leg", "rank", "path").limit(k)


def blend(kind: str, semantic: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """Content and filename queries take one list as it is; hybrid ones fuse both. (path, score, match_kind, ...)."""
    if kind == "content":
        out = semantic.withColumnsRenamed({"final_score": "score"}).withColumn("match_kind", F.lit("content")).orderBy("rank")
    elif kind == "filename":
        out = names.withColumn("match_kind", F.lit("filename")).orderBy("rank")
    else:
        return fuse(semantic, names, k)
    return out.limit(k) if k > 0 else out
