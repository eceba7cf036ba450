"""Column functions on paths, contents, query strings and sizes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.schema import KINDS, MEDIA_TYPES

WINDOW, STRIDE, SNIFF = 2000, 1800, 8192


# --- paths


def cleaned(path: Column) -> Column:
    """A path without doubled slashes, . segments and a trailing slash; .. takes its parent away."""
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(s)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    plain = ~path.rlike(r"//|(^|/)\.{1,2}(/|$)|.+/$")
    return F.when(plain, path).otherwise(F.when(joined == "", ".").otherwise(joined))


def path_parts(path: Column) -> Column:
    """Struct (basename, parent, stem); the stem ends before the last dot unless that is the first character."""

    def parts(p: Column, base: Column) -> Column:
        above = F.substring(p, F.lit(1), F.length(p) - F.length(base) - 1)
        parent = F.when(~p.contains("/"), "").when(above == "", "/").otherwise(above)
        stem = F.when(base.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(base, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(base)
        empty = lambda c: F.when((p == "") | (p == ".") | (p == "/"), "").otherwise(c)
        return F.struct(empty(base).alias("basename"), empty(parent).alias("parent"), empty(stem).alias("stem"))

    # one-element arrays bind the cleaned path and its last part, so that no expression holds them twice
    clean = F.array(F.when(path == "", "").otherwise(cleaned(path)))
    return F.element_at(F.transform(clean, lambda p: F.element_at(F.transform(F.array(F.substring_index(p, "/", -1)), lambda b: parts(p, b)), 1)), 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; "" if the last segment has none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1))


def inside(path: Column, base: str) -> Column:
    """Whether path is base or below it."""
    base = base.rstrip("/")
    return (path == base) | path.startswith(f"{base}/")


def glob_regex(pattern: str) -> str:
    """Globs match whole lower-cased paths; * and ? cross slashes."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()) + "$"


# --- contents


def is_text(content: Column) -> Column:
    """Non-empty, and the first bytes hold no NUL and valid UTF-8 (a character cut at their end is forgiven)."""
    head = F.substring(content, 1, SNIFF)
    cut = reduce(lambda a, b: a | b, [F.is_valid_utf8(F.substring(content, 1, SNIFF - k)) for k in range(4)])
    valid = F.when(F.octet_length(content) > SNIFF, cut).otherwise(F.is_valid_utf8(head))
    return F.coalesce((F.octet_length(content) > 0) & ~F.hex(head).rlike("^(..)*00") & valid, F.lit(False))


def file_kind(path: Column, content: Column | None = None) -> Column:
    """image, video, audio, document or text; "" if unknown."""
    kinds = F.create_map(*[F.lit(x) for p in sorted(KINDS.items()) for x in p])
    known = kinds[extension(path)]
    return F.coalesce(known, F.when(is_text(content), "text").otherwise("") if content is not None else F.lit(""))


def media_type(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in sorted(MEDIA_TYPES.items()) for x in p])[extension(path)], F.lit(""))


def preview(content: Column) -> Column:
    """The first bytes as text; null if they aren't text."""
    return F.when(is_text(content), F.make_valid_utf8(F.substring(content, 1, SNIFF).cast("string")))


def chunk_starts(length: Column) -> Column:
    """Offsets of the windows over so many bytes; none for no bytes."""
    n = F.ceil(F.greatest(length - WINDOW, F.lit(0)) / STRIDE) + 1
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * STRIDE)).otherwise(F.array().cast("array<bigint>"))


def byte_chunks(content: Column) -> Column:
    """Array of (chunk_index, content): WINDOW bytes every STRIDE bytes."""
    return F.transform(chunk_starts(F.octet_length(content).cast("long")), lambda s, i: F.struct(i.alias("chunk_index"), F.substring(content, (s + 1).cast("int"), F.lit(WINDOW)).alias("content")))


def document_chunks(text: Column, least: int = 100) -> Column:
    """byte_chunks of a document's trimmed text; none if they hold under least bytes together."""
    c = byte_chunks(F.trim(text).cast("binary"))
    total = F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x["content"]))
    return F.when(total >= least, c).otherwise(F.slice(c, 1, 0))


def time_ranges(seconds: Column, window: float = 30.0, step: float = 25.0) -> Column:
    """Array of (start, end); the last is cut at the end."""
    n = F.ceil(F.greatest(seconds - window, F.lit(0.0)) / step)
    spans = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct((i * step).alias("start"), F.least(i * step + window, seconds).alias("end")))
    return F.when(seconds > 0, spans).otherwise(F.slice(spans, 1, 0))


def still(sizes: Column, least: float = 0.995) -> Column:
    """Whether a clip's sampled frames, by their sizes, show no motion: the smallest is nearly as large as the largest."""
    return F.coalesce((F.size(sizes) > 0) & (F.array_min(sizes) >= least * F.array_max(sizes)), F.lit(False))


def page_ranges(pages: Column, size: int = 6, overlap: int = 1, splitter: bool = True) -> Column:
    """Array of (first, last) pages from 1; whole up to size pages, or without a splitter."""
    step = size - overlap
    n = F.ceil(F.greatest(pages - size, F.lit(0)) / step)
    split = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct((i * step + 1).alias("first"), F.least(i * step + size, pages).alias("last")))
    whole = F.array(F.struct(F.lit(1).cast("long").alias("first"), pages.cast("long").alias("last")))
    return F.when((pages > size) & F.lit(splitter), split).otherwise(whole)


# --- query strings

# Words and expressions of the query language.
STOPWORDS = (
    "the a an and or of in on at with about for to from by is are was were be been this that these those what where why when who how"
).split()
KIND_WORDS = {"image": "image", "img": "image", "photo": "image", "picture": "image", "video": "video", "audio": "audio", "document": "document", "doc": "document", "pdf": "document", "text": "text", "code": "text"}
SIGNALS = {
    "extension": r"\.[a-z0-9]{1,6}\b",
    "file_type": rf"(?<![A-Za-z0-9_])({'|'.join(sorted(KIND_WORDS))})s?(?![A-Za-z0-9_])",
    "size_bytes": r"\b\d+\s*(kb|mb|gb|tb)\b|\b(large|small|bigger|smaller|huge|tiny)\b",
    "modified_at": r"\b(today|yesterday|tomorrow|recent|recently|week|month|year|day)\b|\b(last\s+(week|month|year|day)|\d+\s+(days?|weeks?|months?|years?)\s+ago)\b",
    "path": r"\bin\s+([A-Z][a-zA-Z0-9_-]+)|\b(Downloads|Desktop|Documents|Pictures|Music|Videos)\b",
}
TRIGGERS = (
    r"\b(yesterday|today|last|past|recent|older|newer|since|before|after)\b",
    r"\b(not|no|without|except|exclude)\b",
    r"\b(photos?|pictures?|screenshots?|videos?|docs?|documents?|code|scripts?)\b",
)


def fields(query: Column) -> Column:
    return F.filter(F.split(query, r"\s+"), lambda w: w != "")


def route(query: Column) -> Column:
    """Struct (kind, stripped): filename, content or hybrid, and the query without its f: prefix."""
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    w = fields(q)
    n = F.size(w)
    stop = F.arrays_overlap(F.transform(w, F.lower), F.array(*map(F.lit, STOPWORDS)))
    prefixed = F.lower(q).startswith("f:")
    kind = (
        F.when(prefixed | q.rlike(r"[*?]"), "filename")
        .when(n == 0, "content")
        .when((n == 1) & q.rlike(r"\.[a-zA-Z0-9]{1,4}$"), "filename")
        .when((n == 1) & (F.octet_length(q) <= 30) & q.rlike("^[A-Za-z][A-Za-z0-9_-]*$"), "hybrid")
        .when((n >= 2) & stop, "content")
        .when(n >= 4, "content")
        .otherwise("hybrid")
    )
    return F.struct(kind.alias("kind"), F.when(prefixed, F.substring(q, 3, 1 << 30)).otherwise(q).alias("stripped"))


def signals(query: Column) -> Column:
    """Struct of booleans: the fields that a query hints at."""
    return F.struct(*[(query if f == "path" else F.lower(query)).rlike(p).alias(f) for f, p in SIGNALS.items()])


def wants_model(query: Column, tokens: int = 6, most: int = 500) -> Column:
    """Whether a language model should parse the query."""
    hit = reduce(lambda a, b: a | b, [F.lower(query).rlike(p) for p in TRIGGERS])
    s = signals(query)
    some = reduce(lambda a, b: a | b, [s[f] for f in SIGNALS])
    return (F.octet_length(query) <= most) & (hit | (F.size(fields(query)) > tokens) | some)


def normal_key(query: Column) -> Column:
    """The cache key of a parsed query."""
    s = F.lower(F.regexp_replace(query, r"^\s+|\s+$", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"[.?!]+$", "")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def parsed_size(size: Column) -> Column:
    """Struct (op, bytes) of ">10mb" and the like; null if it is none. A bare size means at least."""
    s = F.lower(F.trim(size))
    pattern = r"^(>=|<=|>|<|=)?(\d+(?:\.\d+)?)(b|kb|mb|gb|tb)$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    ops = F.create_map(*[F.lit(x) for p in ((">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt"), ("=", "eq"), ("", "gte")) for x in p])
    unit = F.create_map(*[F.lit(x) for p in (("b", 1.0), ("kb", 2.0**10), ("mb", 2.0**20), ("gb", 2.0**30), ("tb", 2.0**40)) for x in p])
    raw = part(2).try_cast("double") * unit[part(3)]
    most = (1 << 63) - 1
    return F.when(s.rlike(pattern), F.struct(ops[part(1)].alias("op"), F.when(raw >= float(most), F.lit(most)).otherwise(raw.try_cast("long")).alias("bytes")))


def whole_size(n: Column) -> Column:
    """Sizes as filter chips show them, in whole units."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, name in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= 1 << power, F.concat(F.shiftright(n, power).cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


def shown_size(n: Column) -> Column:
    """Sizes as result lists show them: whole KB, tenths of MB and GB, halves to the even digit as C's printf rounds a double; null for null."""
    near = n.cast("double").cast("long")

    def unit(power: int, tens: int, name: str) -> Column:
        rest = near.bitwiseAND((1 << power) - 1) * tens
        down, over, half = F.shiftright(near, power) * tens + F.shiftright(rest, power), rest.bitwiseAND((1 << power) - 1), 1 << (power - 1)
        steps = (down + ((over > half) | ((over == half) & (down % 2 == 1))).cast("long")).cast("string")
        return F.concat(steps if tens == 1 else F.regexp_replace(steps, "(.)$", ".$1"), F.lit(f" {name}"))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(10, 1, "KB")).when(n < 1 << 30, unit(20, 10, "MB")).otherwise(unit(30, 10, "GB"))
