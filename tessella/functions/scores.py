"""Distances and scores: cosine as built-in expressions; fuzzy and edit distance as Arrow functions."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The fuzzy score's weights.
RUN, BOUNDARY, CASE, GAP, MOST_GAP = 0.15, 0.5, 0.05, 0.1, 0.5
SEPARATORS = " /\\._-"


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, in [0, 2]; 1 if a vector is null, empty, zero or holds NaN, or their sizes differ. In double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    similarity = F.greatest(F.least(dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0) & ~F.isnan(norms)
    return F.when(F.coalesce(usable, F.lit(False)), 1.0 - similarity).otherwise(1.0)


def cosine_distance_to(a: Column, vector: list[float]) -> Column:
    """cosine_distance to one vector, whose norm is a constant of the plan."""
    v = [struct.unpack("f", struct.pack("f", x))[0] for x in vector]
    norm = math.sqrt(sum(x * x for x in v))
    if not v or not norm:
        return F.lit(1.0)
    other = F.array(*[F.lit(x) for x in v])
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, other, lambda x, y: x.cast("double") * y), F.lit(0.0), add)
    own = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    similarity = F.greatest(F.least(dot / (own * norm), F.lit(1.0)), F.lit(-1.0))
    return F.when(F.coalesce((F.size(a) == len(v)) & (own > 0) & ~F.isnan(own), F.lit(False)), 1.0 - similarity).otherwise(1.0)


def starts_word(before: str, c: str) -> bool:
    return not before or before in SEPARATORS or (before.islower() and c.isupper())


def fuzzy(pattern: str, candidate: str) -> tuple[float, list[int]]:
    """Score in [0, 1] of pattern as a subsequence of candidate, and the byte offsets of its leftmost match."""
    if not pattern:
        return 1.0, []
    places, k = [], -1
    lower = [c.lower() for c in candidate]
    for want in pattern.lower() if len(pattern.lower()) == len(pattern) else [c.lower() for c in pattern]:
        try:
            k = lower.index(want, k + 1)
        except ValueError:
            return 0.0, []
        places.append(k)
    raw = 1.0
    for n, (p, at) in enumerate(zip(pattern, places, strict=True)):
        skipped = at - places[n - 1] - 1 if n else 0
        raw += RUN * (n > 0 and skipped == 0) + BOUNDARY * starts_word(candidate[at - 1 : at], candidate[at]) + CASE * (candidate[at] == p)
        raw -= min(GAP * skipped, MOST_GAP)
    offsets = [len(candidate[:at].encode()) for at in places]
    return max(0.0, min(1.0, raw / (1.35 + 0.2 * len(pattern)))), offsets


_FUZZY = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("matched", T.ArrayType(T.IntegerType()))])


@pandas_udf(_FUZZY)
def fuzzy_match(pattern: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    rows = [fuzzy(p or "", c or "") for p, c in zip(pattern, candidate, strict=True)]
    return pd.DataFrame({"score": [s for s, _ in rows], "matched": [m for _, m in rows]})


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, none edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


@pandas_udf(T.IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x or "", y or "") for x, y in zip(a, b, strict=True)])


def ranges(offsets: Column) -> Column:
    """Runs of consecutive offsets as an array of (start, end), the end exclusive."""
    pair = "array<struct<start:int,end:int>>"

    def step(acc: Column, o: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), (o + 1).alias("end"))))
        fresh = F.concat(acc, F.array(F.struct(o.alias("start"), (o + 1).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == o), grown).otherwise(fresh)

    return F.aggregate(offsets, F.array().cast(pair), step)


def occurrences(column: Column, phrase: str) -> Column:
    """Byte ranges of a phrase's occurrences in any case, from the left, without overlap."""
    pair = "array<struct<start:int,end:int>>"
    if not phrase:
        return F.array().cast(pair)
    parts = F.split(F.lower(column), "\\Q" + phrase.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    size = len(phrase.lower().encode())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(pair).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.octet_length(part)
        return F.struct((begin + size).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + size).alias("end")))).alias("out"))

    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def merged_ranges(spans: Column, most: Column) -> Column:
    """Overlapping or touching ranges joined, cut to [0, most)."""
    pair = "array<struct<start:int,end:int>>"
    cut = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], most).alias("end")))
    inside = F.array_sort(F.filter(cut, lambda s: s["start"] < s["end"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(inside, F.array().cast(pair), step)


def segments(text: Column, spans: Column) -> Column:
    """A text cut at its highlights: an array of (text, marked) that joins to the text; spans as merged_ranges gives them."""
    piece = lambda a, b, marked: F.struct(F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).alias("text"), F.lit(marked).alias("marked"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.array(piece(acc["at"], s["start"], False))).otherwise(F.slice(acc["out"], 1, 0))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.array(piece(s["start"], s["end"], True))).alias("out"))

    whole = lambda acc: F.when(acc["at"] < F.length(text), F.concat(acc["out"], F.array(piece(acc["at"], F.length(text), False)))).otherwise(acc["out"])
    return F.aggregate(spans, start, step, whole)
