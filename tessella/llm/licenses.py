"""Licence scans: the Dice coefficient of word bigrams against licence templates.

A text is normalised (A-Z lower-cased, other characters than a-z, 0-9 and line breaks made spaces). Its units, the lines,
the paragraphs between blank lines and the whole, are compared as bags of word bigrams: twice the common bigrams over
the bigrams of both. A unit of a bigrams reaches the threshold t against a template of b only if
t / (2 - t) * b <= a <= (2 - t) / t * b; templates outside these bounds are not compared.

A licence that is only a part of a longer text, over lines and paragraphs or within a line, is found by windows over the whole text's words: as many
words as the template has (fewer at the text's end), from each place where the text has one of the template's bigrams. Of the windows that reach
the threshold, those count that no better one (of equal ones: no earlier one) overlaps. A window that opens elsewhere has no more in common than the
next one that opens with a bigram of the template, so none is lost.

A unit that reaches the threshold has at least t / (2 - t) * b of a template's bigrams. A template's anchors are words that touch more
bigrams than it may then lack, so that each such unit has an anchor; templates without one in the text are not compared.

All of it is one projection of built-in functions: no join, no shuffle, no Python on the executors.

Defined results: null and empty texts and units of fewer than two words match nothing; equal units of a text count once;
a unit can match several templates, and counts once for each; very long texts are read whole; an empty table gives an empty
result; repeated rows give repeated rows. Columns other than those named, also of clashing names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.license_texts import TEMPLATES

#: The threshold, in thousandths.
THRESHOLD = 800
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split())


def bigrams(text: str) -> Counter:
    w = normal(text).split()
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))


def bounds(b: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold against b bigrams."""
    low, high = threshold, 2000 - threshold
    return -(-low * b // high), high * b // low


def anchors(text: str, threshold: int = THRESHOLD) -> list[str]:
    """Words, the longest first, that touch more of a template's bigrams than a unit at the threshold can lack."""
    w = normal(text).split()
    lack, out, touched = len(w) - 1 - bounds(len(w) - 1, threshold)[0], [], 0
    for x in sorted(set(w), key=lambda x: (-len(x), x)):
        if touched > lack:
            break
        out.append(x)
        touched = sum(a in out or b in out for a, b in zip(w, w[1:], strict=False))
    return out


def _templates(templates, threshold: int) -> Column:
    rows = []
    for name, text in templates:
        counts = sorted(bigrams(text).items())
        b = sum(c for _, c in counts)
        low, high = bounds(b, threshold)
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(b).alias("b"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, anchors(text, threshold))).alias("anchors"),
            F.array(*[F.lit(g) for g, _ in counts]).alias("grams"), F.array(*[F.lit(c) for _, c in counts]).alias("counts"),
            F.array(*[F.lit(f"{g} #{k}") for g, c in counts for k in range(c)]).alias("bag"),
        ))
    return F.array(*rows)


def _let(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _some(x: Column, f) -> Column:
    """f of an array, an array itself, or an empty one without calling it if the array is empty."""
    return F.flatten(F.transform(F.filter(F.array(x), lambda y: F.size(y) > 0), f))


def _one(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, "[ \n]+", " "))


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9\n]+", " ")


def units(t: Column) -> Column:
    """The distinct normalised units of a text whose other characters are spaces."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.concat(lines, F.transform(F.split(t, "\n ?\n[ \n]*"), _one), F.array(_one(t))))


def pairs(w: Column) -> Column:
    """The bigrams of words, in order."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def numbered(grams: Column) -> Column:
    """A bag as a set: each gram with the number of those equal to it before it."""
    return _let(F.sort_array(grams), lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit(" #"), (i + 1 - F.array_position(s, x)).cast("string"))))


def _match(t: Column, common: Column, a: Column, unit: Column) -> Column:
    score = F.floor(F.lit(2_000_000).cast("long") * common / (a + t["b"]))
    return F.struct(t["name"].alias("license"), score.alias("score"), unit.alias("unit"))


def against(u: Column, some: Column) -> Column:
    """A unit's coefficients with those of some templates whose size bounds it keeps."""
    a = F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    fit = F.filter(some, lambda t: a.between(t["low"], t["high"]))
    compare = lambda ts: _let(numbered(pairs(F.split(u, " "))), lambda g: F.transform(ts, lambda t: _match(t, F.size(F.array_intersect(g, t["bag"])), F.size(g), u)))
    return _some(fit, compare)


def windows(w: Column, grams: Column, t: Column, threshold: int) -> Column:
    """The best windows over words and their bigrams that reach the threshold with a template.

    A bigram that a template has c times counts in a window if its place c occurrences earlier lies before the window. So each
    place carries that earlier one, and a window counts the places with an earlier one before its start."""
    n, b = F.size(grams), t["b"]

    def placed(have: Column) -> Column:
        """(place, place c occurrences earlier or -1) of the bigrams that the template has, in order."""
        c = F.transform(have, lambda g: F.element_at(t["counts"], F.array_position(t["grams"], g).cast("int")))
        kinds = F.transform(grams, lambda g, i: F.struct(F.array_position(have, g).cast("int").alias("k"), i.alias("i")))

        def earlier(c: Column) -> Column:
            def with_earlier(h: Column) -> Column:
                def one(x: Column, r: Column) -> Column:
                    back = F.get(h, r - F.element_at(c, x["k"]))
                    return F.struct(x["i"].alias("i"), F.when(back["k"] == x["k"], back["i"]).otherwise(F.lit(-1)).alias("before"))

                return F.sort_array(F.transform(h, one))

            return _let(F.sort_array(F.filter(kinds, lambda x: x["k"] > 0)), with_earlier)

        has = F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
        return F.flatten(F.transform(F.filter(F.array(c), lambda _: has >= t["low"]), earlier))

    def reaching(h: Column) -> Column:
        """(start, common, bigrams) of the windows at the threshold."""
        need = lambda a: F.ceil((a + b) * F.lit(threshold) / 2000).cast("int")
        starts = F.transform(h, lambda x, j: F.struct(x["i"].alias("i"), j.alias("j"), F.least(b, n - x["i"]).alias("a")))
        dense = F.filter(starts, lambda x: F.get(h, x["j"] + need(x["a"]) - 1)["i"] < x["i"] + x["a"])
        common = lambda x: F.size(F.filter(F.slice(h, x["j"] + 1, x["a"]), lambda y: (y["i"] < x["i"] + x["a"]) & (y["before"] < x["i"])))
        return F.filter(F.transform(dense, lambda x: F.struct(x["i"].alias("i"), common(x).alias("common"), x["a"].alias("a"))), lambda x: x["common"] >= need(x["a"]))

    def best(s: Column) -> Column:
        score = lambda x: F.floor(F.lit(2_000_000).cast("long") * x["common"] / (x["a"] + b))
        scored = F.transform(s, lambda x: F.struct(x["i"].alias("i"), x["common"].alias("common"), x["a"].alias("a"), score(x).alias("score")))

        def over(z: Column) -> Column:
            # no more than b windows start within b words on either side
            near = lambda j: F.slice(z, F.greatest(j - b, F.lit(0)) + 1, 2 * b + 1)
            beats = lambda y, x: (F.abs(y["i"] - x["i"]) <= b) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["i"] < x["i"])))
            top = F.filter(z, lambda x, j: ~F.exists(near(j), lambda y: beats(y, x)))
            return F.transform(top, lambda x: _match(t, x["common"], x["a"], F.concat_ws(" ", F.slice(w, x["i"] + 1, x["a"] + 1))))

        return _let(scored, over)

    return _some(_let(_let(F.array_intersect(grams, t["grams"]), placed), reaching), best)


def matches(text: Column, templates=TEMPLATES, threshold: int = THRESHOLD) -> Column:
    """Array of (license, score, unit): score is the coefficient in millionths, rounded down; in order."""
    every = _templates(templates, threshold)
    words = sorted({x for _, body in templates for x in anchors(body, threshold)})

    def found(t: Column, w: Column, some: Column) -> Column:
        whole = F.flatten(F.transform(units(t), lambda u: against(u, some)))
        return F.concat(whole, _let(pairs(w), lambda g: F.flatten(F.transform(some, lambda x: windows(w, g, x, threshold)))))

    def anchored(t: Column) -> Column:
        def of(w: Column) -> Column:
            present = F.array_intersect(w, F.array(*map(F.lit, words)))
            some = lambda p: F.filter(every, lambda x: F.arrays_overlap(x["anchors"], p))
            return _some(present, lambda p: _some(some(p), lambda ts: found(t, w, ts)))

        return _let(F.split(_one(t), " "), of)

    hits = _let(_flat(text), anchored)
    return F.sort_array(F.array_distinct(F.filter(hits, lambda m: m["score"] >= 1000 * threshold)))


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """keep's columns and matches."""
    return docs.select(*keep, matches(F.col(text), templates, threshold).alias("matches"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every row of documents; null and empty texts have none."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["score"].alias("score"), m["license"].alias("license"))))
    return found.select("doc_id", "matches", best.alias("best")).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", F.transform("matches", lambda m: F.concat(m["license"], F.lit(":"), m["score"].cast("string")))).alias("licenses"),
        F.col("best.license").alias("best_license"),
        F.col("best.score").alias("best_score"),
    )


def _sql() -> str:
    names = ", ".join(f"('{name}', '{normal(text)}')" for name, text in TEMPLATES)
    return f"""
WITH t(name, body) AS (VALUES {names}),
tw AS (SELECT name, string_split(body, ' ') AS w FROM t),
tg AS (SELECT name, len(w) - 1 AS b, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
tc AS (SELECT name, b, g, count(*) AS c FROM tg GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS x FROM documents),
l AS (
  SELECT r, trim(u) AS u FROM (SELECT r, unnest(string_split(x, chr(10))) AS u FROM d)
  UNION SELECT r, trim(regexp_replace(u, '[ \\n]+', ' ', 'g')) FROM (SELECT r, unnest(regexp_split_to_array(x, '\\n ?\\n[ \\n]*')) AS u FROM d)
  UNION SELECT r, trim(regexp_replace(x, '[ \\n]+', ' ', 'g')) FROM d
),
u AS (SELECT r, u, string_split(u, ' ') AS w FROM l WHERE contains(u, ' ')),
ug AS (SELECT r, u, len(w) - 1 AS a, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM u),
uc AS (SELECT r, u, a, g, count(*) AS c FROM ug GROUP BY ALL),
n AS (
  SELECT r, u, name, CAST(floor(2000000 * sum(least(uc.c, tc.c)) / (a + b)) AS BIGINT) AS score
  FROM uc JOIN tc ON uc.g = tc.g GROUP BY r, u, name, a, b HAVING 2000 * sum(least(uc.c, tc.c)) >= {THRESHOLD} * (a + b)
),
x AS (SELECT r, string_split(trim(regexp_replace(x, '[ \\n]+', ' ', 'g')), ' ') AS w FROM d),
xg AS (SELECT r, len(w) - 1 AS n, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM x WHERE len(w) > 1),
h AS (SELECT r, n, i, g, name, b, c, count(*) OVER (PARTITION BY r, name ORDER BY i RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM xg JOIN tc USING (g)),
s AS (SELECT r, name, b, i, least(b, n - i + 1) AS a FROM h WHERE 2000 * rest >= {THRESHOLD} * (least(b, n - i + 1) + b)),
sg AS (SELECT s.r, s.name, s.b, s.i, s.a, h.g, least(count(*), any_value(h.c)) AS common FROM s JOIN h ON s.r = h.r AND s.name = h.name AND h.i >= s.i AND h.i < s.i + s.a GROUP BY ALL),
sw AS (
  SELECT r, name, b, i, a, CAST(floor(2000000 * sum(common) / (a + b)) AS BIGINT) AS score FROM sg GROUP BY r, name, b, i, a HAVING 2000 * sum(common) >= {THRESHOLD} * (a + b)
),
top AS (
  SELECT * FROM sw WHERE NOT EXISTS (
    SELECT 1 FROM sw AS o WHERE o.r = sw.r AND o.name = sw.name AND abs(o.i - sw.i) <= sw.b AND (o.score > sw.score OR (o.score = sw.score AND o.i < sw.i))
  )
),
m AS (SELECT r, u, name, score FROM n UNION SELECT r, array_to_string(x.w[top.i : top.i + top.a], ' '), name, score FROM top JOIN x USING (r)),
k AS (
  SELECT r, count(*) AS n, string_agg(name || ':' || score, ',' ORDER BY name, score, u) AS s, max(struct_pack(score := score, license := name)) AS best FROM m GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(s, '') AS licenses, best.license AS best_license, best.score AS best_score FROM d LEFT JOIN k USING (r)
"""


ORACLE = _sql()
