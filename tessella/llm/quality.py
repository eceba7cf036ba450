"""Quality rules with adaptive thresholds.

Each document gets counts and ratios. The ratios of all documents go into mergeable quantile sketches, one per language,
source and ratio: counts over logarithmic buckets, which merge by addition. The sketches give each group its
own fences, and a join brings the fences back to the documents. A group with few documents uses the merged sketch of its
language, and a language with few documents that of the whole corpus.

A ratio has two fences, both from its group's sketch; the lower one counts:

* The valley: of the stretches of the logarithmic scale above the median that hold next to no documents, the widest, if it
  is a factor GAP wide. Its middle is the fence. Next to none are at most DIRT of the group and a quarter of those
  above. So a ratio that is 0 in most documents is fenced by what the others of its group show: where shares run on from
  small to large ones there is no valley and nothing is rejected; where one document stands alone it is.
* The spread, where the median is no floor value: median + SPREADS * narrower half of the middle + NEAR * median. Two-sided ratios are
  also fenced below, by its mirror image.

Both start at the median, so that they hold until half of a group is junk. No ratio has a cutoff of its own; FLOOR, under
which a share counts as FLOOR, is the only value common to all groups (a fence of shares is above
FLOOR * sqrt(GAP), so that smaller shares than that are never rejected).

Defined results: null language and null source are groups of their own; null and empty texts have no words and fail the
base rules; documents that fail those don't enter the sketches; equal rows get equal results; very long texts are
counted whole; a fence's ties are kept; an empty table gives an empty result. Columns other than those named are ignored, also of clashing names.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, extended, map_columns, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Ratio: whether it has a lower fence too.
RATIOS = {"word_length": True, "symbol_share": False, "dup_line_share": False, "repeat_share": False, "stutter_share": False, "upper_share": False}
#: Of the fences: see above.
SPREADS, NEAR, GAP, DIRT, FLOOR = 10.0, 0.05, 4.0, 0.002, 0.02
#: The sketches' relative error, the least value that isn't 0 to them, and the least documents of a group.
ERROR, SMALLEST, LEAST = 0.002, 1e-4, 100
STEP, ZERO = float(np.log((1 + ERROR) / (1 - ERROR))), -(1 << 30)
#: Bytes of fences that are broadcast.
BROADCAST = 8 << 20

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], dtype=np.uint64)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list) -> int:
    """Words in windows of WINDOW words that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) > len(words) - WINDOW:  # too few words occur again
        return 0
    hashes = sum(ids[k : k + n] * _MULTIPLIERS[k] for k in range(WINDOW))
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    windows = [ids[i : i + WINDOW].tobytes() for i in starts]  # equal hashes are checked
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(starts, windows, strict=True):
        if times[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measured(text: str | None) -> tuple:
    """COUNTS; lines with a word; the shares of stuttered words and of upper-case letters."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0.0, 0.0
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at exactly the six separators
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = len(_UPPER.findall(text))
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        stutter / max(1, len(words) - 1), upper / max(1, chars),
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns, COUNTS, base_failed and RATIOS."""
    own = text if text in keep else "__text"
    base = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(own))
    names = (*COUNTS, "__lines", "stutter_share", "upper_share")

    def f(cols):
        rows = [measured(x) for x in (cols[own] if text in keep else cols.pop(own))]
        return cols | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    schema = extended(base if text in keep else base.drop(own), ", ".join(f"{n} {'double' if 'share' in n else 'long'}" for n in names))
    out = map_columns(base, lambda: f, schema)
    some = F.greatest("n_words", F.lit(1))
    return out.select(
        *keep, *COUNTS,
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / some).alias("word_length"),
        (F.col("n_symbols") / some).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("__lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / some).alias("repeat_share"),
        "stutter_share", "upper_share",
    )


def sketches(measures: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., ratio, bucket, n): mergeable, by adding n over any groups."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("value")) for r in RATIOS])).alias("__x")
    bucket = F.when(F.col("__x.value") < SMALLEST, F.lit(ZERO)).otherwise(F.ceil(F.log(F.col("__x.value")) / STEP)).cast("int")
    return measures.select(*groups, pairs).groupBy(*groups, F.col("__x.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str], *more: Column) -> DataFrame:
    """(groups..., ratio, total, q25, q50, q75) within the sketches' relative error, and more aggregates."""
    by = Window.partitionBy(*groups, "ratio")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.exp(F.col("bucket") * STEP) * (1 - ERROR))
    ranked = sketch.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), value))
    return ranked.groupBy(*groups, "ratio").agg(F.max("total").alias("total"), *[at(q / 100).alias(f"q{q}") for q in (25, 50, 75)], *more)


def valley(buckets: list[int], counts: list[int]) -> float | None:
    """The middle of the widest valley above the median; None where none is a factor GAP wide."""
    n = np.asarray(counts, np.int64)
    upto, total = n.cumsum(), int(n.sum())
    b = np.asarray(buckets, np.float64)
    low = np.log(FLOOR)
    tops, bottoms = np.maximum(b * STEP, low), np.maximum((b - 1) * STEP, low)
    best, fence = np.log(GAP), None
    for i in range(int(np.searchsorted(upto, total / 2)), len(b) - 1):
        within = upto[i:-1] - upto[i]  # up to each later bucket
        above = total - upto[i:-1]
        far = np.flatnonzero(within <= np.minimum(DIRT * total, above / 4))
        width = float(bottoms[i + 1 + far[-1]] - tops[i])
        if width > best:
            best, fence = width, float(np.exp((bottoms[i + 1 + far[-1]] + tops[i]) / 2))
    return fence


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., ratio, total, low, high): a group's fences, null where there is none."""
    stats = quartiles(sketch, groups, F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("__b"))

    def f(cols):
        rows = cols.pop("__b")
        return cols | {"__valley": [valley([r["bucket"] for r in x], [r["n"] for r in x]) for x in rows]}

    x = map_columns(stats, lambda: f, extended(stats.drop("__b"), "__valley double"))
    spread = SPREADS * F.least(F.col("q50") - F.col("q25"), F.col("q75") - F.col("q50")) + NEAR * F.col("q50")
    ordinary = F.col("q50") >= FLOOR
    two = F.col("ratio").isin([r for r, both in RATIOS.items() if both])
    high = F.least(F.when(ordinary, F.col("q50") + spread), F.col("__valley"))  # nulls are skipped
    return x.select(*groups, "ratio", "total", F.when(two & ordinary, F.col("q50") - spread).alias("low"), high.alias("high"))


def thresholds(measures: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each language and source, with a struct (low, high) for each ratio.

    Sketches are of bounded size: at most 6 ratios times some 3,000 buckets a group, whatever the documents.
    """
    sketch = checkpoint(sketches(measures.filter(~F.col("base_failed")), [lang, source]))
    levels = [[lang, source], [lang], []]
    x = measures.select(lang, source).distinct().withColumn("ratio", F.explode(F.array(*map(F.lit, RATIOS))))
    for k, g in enumerate(levels):
        s = fences(sketch if len(g) == 2 else merged(sketch, g), g)
        s = s.select(*[F.col(c).alias(f"__{k}{c}") for c in [*g, "ratio"]], F.struct("total", "low", "high").alias(f"__s{k}"))
        x = x.join(s, reduce(lambda a, b: a & b, [x[c].eqNullSafe(s[f"__{k}{c}"]) for c in [*g, "ratio"]]), "left").drop(*[f"__{k}{c}" for c in [*g, "ratio"]])
    enough = lambda k: F.when(F.col(f"__s{k}.total") >= LEAST, F.col(f"__s{k}"))
    x = x.withColumn("s", F.coalesce(enough(0), enough(1), F.col("__s2")))
    pair = F.struct(F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    return x.groupBy(lang, source).agg(*[F.max(F.when(F.col("ratio") == r, pair)).alias(f"__{r}") for r in RATIOS])


def judged(measures: DataFrame, lang: str = "lang", source: str = "source", limits: DataFrame | None = None) -> DataFrame:
    """measures and kept: not base_failed, and every ratio within its group's fences (null fences reject nothing)."""
    limits = checkpoint(thresholds(measures, lang, source)) if limits is None else limits
    held = limits.agg(F.sum(300 + F.coalesce(F.octet_length(lang), F.lit(0)) + F.coalesce(F.octet_length(source), F.lit(0)))).first()[0] or 0
    few = held <= BROADCAST  # else the fences are joined by their keys
    limits = limits.withColumnsRenamed({lang: "__lang", source: "__source"})
    limits = F.broadcast(limits) if few else limits
    x = measures.join(limits, measures[lang].eqNullSafe(F.col("__lang")) & measures[source].eqNullSafe(F.col("__source")), "left")

    def inside(r: str) -> Column:
        low, high = F.col(f"__{r}.low"), F.col(f"__{r}.high")
        return F.coalesce(F.col(r) <= high, F.lit(True)) & F.coalesce(F.col(r) >= low, F.lit(True))

    verdict = ~F.col("base_failed") & reduce(lambda a, b: a & b, [inside(r) for r in RATIOS])
    return x.withColumn("kept", verdict).select(*measures.columns, "kept")


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Rows are measured twice, once for the fences and once to be judged as they pass, so that no text is stored, nor shuffled
    unless the groups' fences take more than BROADCAST bytes.
    """
    limits = checkpoint(thresholds(checkpoint(measure(docs, [lang, source], text)), lang, source))
    own = {c: f"__kept{k}" for k, c in enumerate(docs.columns)}
    x = docs.toDF(*own.values())
    out = judged(measure(x, list(own.values()), own[text]), own[lang], own[source], limits.withColumnsRenamed({lang: own[lang], source: own[source]}))
    return out.filter("kept").select(*[F.col(v).alias(k) for k, v in own.items()])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of documents; null and empty texts fail the base rules, null languages and sources are groups."""
    measures = checkpoint(measure(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]))
    return judged(measures).select("doc_id", *COUNTS, "base_failed", "kept")
