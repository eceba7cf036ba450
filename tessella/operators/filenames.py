"""Filename search: exact names, phrases scored by BM25, globs and fuzzy rescoring."""

from __future__ import annotations

import math
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scores import fuzzy_match, ranges
from tessella.functions.text import glob_regex

if TYPE_CHECKING:
    from tessella.operators.postings import NameIndex

#: Column weights, and BM25's saturation and length parameters.
WEIGHTS = {"basename": 10.0, "parent": 3.0, "stem": 5.0, "extension": 2.0}
K1, B = 1.2, 0.75
LEAST, GLOB_SCORE = 3, 0.8


def exact(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Files of that name in any case, score 1."""
    hits = files.filter(F.lower("basename") == query.lower()).orderBy("path").limit(limit)
    return hits.withColumns({"score": F.lit(1.0), "match_kind": F.lit("exact")})


def _times(column: Column, phrase: str) -> Column:
    """Occurrences of a phrase that don't overlap."""
    low = F.lower(F.coalesce(column, F.lit("")))
    return (F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)


def name_length() -> Column:
    """The trigrams of a file's four name columns."""
    return reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in WEIGHTS])


def figures(files: DataFrame) -> DataFrame:
    """One row (n, length): the corpus figures that scores need, to be kept beside the files."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum(name_length()), F.lit(0)).cast("long").alias("length"))


def adjusted(kept: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept figures after files came and went, from those files alone."""
    both = kept.unionByName(figures(added)).unionByName(figures(removed).select((-F.col("n")).alias("n"), (-F.col("length")).alias("length")))
    return both.agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def bm25(files: DataFrame, query: str, index: NameIndex | None = None) -> DataFrame:
    """Files with the query as a phrase in name, folder, stem or extension: raw (lower is better) and score.

    The corpus figures are one row of aggregates, taken first. score keeps the inverted scale
    1 / (1 + max(0, -raw)). Queries under three characters have no trigram and no hits. With an index, figures and occurrences come from its postings, and
    files may be a selection of those that it holds.
    """
    q = query.lower()
    if len(q) < LEAST:
        return files.limit(0).withColumns({"raw": F.lit(0.0), "score": F.lit(0.0)})
    if index is None:
        weighted = reduce(lambda a, b: a + b, [_times(F.col(c), q) * w for c, w in WEIGHTS.items()])
        x = files.withColumns({"__tf": weighted, "__len": name_length()})
        n, found, mean = x.agg(F.count("*"), F.count_if(F.col("__tf") > 0), F.avg("__len")).first()
    else:
        held = index.hits(q).select("file_id", F.col("tf").alias("__tf"), F.col("length").alias("__len"))
        (n, length), found = index.figures(), held.count()
        mean, x = length / n if n else None, files.join(held, "file_id")
    idf = max(math.log((n - found + 0.5) / (found + 0.5)), 1e-6)
    raw = -idf * F.col("__tf") * (K1 + 1) / (F.col("__tf") + K1 * (1 - B + B * F.col("__len") / F.lit(mean or 1.0)))
    hits = x.filter(F.col("__tf") > 0).withColumn("raw", raw)
    return hits.withColumn("score", 1.0 / (1.0 + F.greatest(F.lit(0.0), -F.col("raw")))).drop("__tf", "__len")


def phrase_hits(files: DataFrame, query: str, limit: int = 50, index: NameIndex | None = None) -> DataFrame:
    """Exact names first, then phrase hits by BM25, limit in all; (files' columns, score, match_kind)."""
    first = exact(files, query, limit)
    rest = bm25(files, query, index).select(*files.columns, "raw", "score").join(first.select("file_id"), "file_id", "left_anti").orderBy("raw", "path").limit(limit)
    rest = rest.drop("raw").withColumn("match_kind", F.lit("substring"))
    both = first.withColumn("__leg", F.lit(0)).unionByName(rest.withColumn("__leg", F.lit(1)))
    return both.orderBy("__leg", "score", "path").limit(limit).drop("__leg")


def substring(files: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return files.filter(F.lower("path").contains(text.lower())).orderBy("path").limit(limit)


def glob(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Files whose whole path matches, newest first."""
    hits = files.filter(F.lower("path").rlike(glob_regex(pattern))).orderBy(F.desc("modified_at"), "path").limit(limit)
    return hits.withColumns({"score": F.lit(GLOB_SCORE), "match_kind": F.lit("substring")})


def search(files: DataFrame, query: str, limit: int = 50, candidates: int = 50, index: NameIndex | None = None) -> DataFrame:
    """Filename hits in order: (files' columns, score, match_kind, highlights, fuzzy_score).

    Globs stand as they are. Otherwise phrase hits are ordered by the fuzzy score of their names, those whose name
    holds no such subsequence go, and the better of both scores counts. Highlights are byte ranges of the name.
    """
    query, limit = query.strip(), limit if limit > 0 else 50
    span = "array<struct<start:int,end:int>>"
    if not query:
        return files.limit(0).withColumns({"score": F.lit(0.0), "match_kind": F.lit(""), "highlights": F.array().cast(span), "fuzzy_score": F.lit(0.0)})
    if "*" in query or "?" in query:
        return glob(files, query, limit).withColumns({"highlights": F.array().cast(span), "fuzzy_score": F.lit(0.0)})
    hits = phrase_hits(files, query, max(candidates, limit), index).withColumn("__f", fuzzy_match(F.lit(query), F.col("basename")))
    hits = hits.filter(F.col("__f.score") > 0).orderBy(F.desc("__f.score"), "path").limit(limit)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("basename").alias("end")))
    is_exact = F.col("match_kind") == "exact"
    return hits.select(
        *[c for c in files.columns],
        F.greatest("score", "__f.score").alias("score"),
        F.when(~is_exact & (F.col("__f.score") > F.col("score")), "fuzzy").otherwise(F.col("match_kind")).alias("match_kind"),
        F.when(is_exact, whole).otherwise(ranges(F.col("__f.matched"))).alias("highlights"),
        F.col("__f.score").alias("fuzzy_score"),
    )
