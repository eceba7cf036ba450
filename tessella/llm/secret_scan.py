"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-case trigrams that every match must hold. A
block of documents gets an inverted index (trigram -> documents, for the trigrams that the rules ask for), built in one pass
over its texts' trigrams; a rule's query intersects and unites those postings, and the expression itself verifies the candidates. A rule without a
mandatory trigram scans every document.

Defined results: a null or empty text has no spans; overlapping spans of different kinds are all reported; within a
kind, spans are leftmost and don't overlap; a private key's span covers the whole key. Spans count code points, the end exclusive. Equal rows give equal rows;
very long texts are scanned whole; an empty table gives an empty result. Columns other than those named, also of clashing names, are ignored (redact keeps them).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import extended, map_columns, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern (the given group, at least least code points long) are secrets of this kind."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: A private key from its BEGIN line through the END line; if that is missing, through the lines of base64 (after
#: headers such as Proc-Type), with what may stand between them in quoted or escaped keys.
_GAP = r"""(?:[\s>"'|#*,;]|\\+[nrt]?)"""
_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]++|-(?!----BEGIN |----END ))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_GAP}*+[A-Za-z][A-Za-z-]*+:\x20[^\n\\]*+){{0,8}}+(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:[\"'+ ]*+(?:\\+[nr]|\r?\n){_GAP}*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\r\n\"'\\]|\Z))?+(?:{_GAP}++=[A-Za-z0-9+/]{{4}})?+)?"
)
#: Public formats of credentials, beside the base rules.
MORE = (
    Rule("private_key", _KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # a run that isn't followed by the other parts is passed as a whole, so that no run is read once for each eyJ in it
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+(\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)?", group=1, least=25),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
)
RULES = BASE + MORE

#: A query is a set of alternatives, each a set of trigrams that must all occur; ANY is the query all texts pass.
Query = frozenset
ANY: Query = frozenset({frozenset()})
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64


def _absorbed(q: Query) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(p: Query, q: Query) -> Query:
    if len(p) * len(q) > MOST_ALTERNATIVES:
        return p if len(p) <= len(q) else q  # weaker, still mandatory
    return _absorbed(frozenset(a | b for a, b in product(p, q)))


def _either(p: Query, q: Query) -> Query:
    out = _absorbed(p | q)
    return out if len(out) <= MOST_ALTERNATIVES else ANY


def _of_strings(strings: set[str]) -> Query:
    return _absorbed(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)) if strings else ANY


def _strings(op: str, arg) -> set[str] | None:
    """All lower-case strings that a node can match, or None if they are too many."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 16:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 16 else None
    if op == "AT":
        return {""}
    if op == "SUBPATTERN":
        return _all_strings(arg[3])
    if op == "BRANCH":
        each = [_all_strings(x) for x in arg[1]]
        return None if any(x is None for x in each) or len(out := set().union(*each)) > MOST_STRINGS else out
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = arg
        one = _all_strings(body)
        if one is None or int(most) > 4:
            return None
        out = set()
        for n in range(least, int(most) + 1):
            out |= {"".join(x) for x in product(one, repeat=n)} if len(one) ** n <= MOST_STRINGS else {None}
        return None if None in out or len(out) > MOST_STRINGS else out
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        s = _strings(str(op), arg)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, s)}
    return out


def _query(nodes) -> Query:
    out, run = ANY, {""}
    for op, arg in nodes:
        op = str(op)
        s = _strings(op, arg)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, s)}
            continue
        out, run = _both(out, _of_strings(run)), {""}
        if s is not None:
            run = s
        elif op == "SUBPATTERN":
            out = _both(out, _query(arg[3]))
        elif op == "BRANCH":
            out = _both(out, reduce(_either, (_query(x) for x in arg[1])))
        elif op.endswith("_REPEAT") and arg[0] >= 1:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(rule: Rule) -> Query:
    """Alternatives of mandatory lower-case trigrams; ANY if some match needs none."""
    from re import _parser

    return _query(_parser.parse(rule.pattern, re.ASCII))


class Index:
    """Postings of a block: for each trigram asked for, the numbers of the texts that hold it."""

    def __init__(self, texts: list[str | None], trigrams: set[str]):
        self.all = {i for i, x in enumerate(texts) if x}
        self.postings: dict[str, set[int]] = {t: set() for t in trigrams}
        names = sorted(t for t in trigrams if len(t) == 3)
        number = {c: k + 1 for k, c in enumerate(sorted(set("".join(names))))}  # 0: no character that is asked for
        if not number or not self.all:
            return
        n = len(number) + 1
        of_char = np.zeros(max(map(ord, number)) + 2, np.int64)
        for c, k in number.items():
            of_char[ord(c)] = k
        of_code = np.full(n**3, -1, np.int32)
        for k, (a, b, c) in enumerate(names):
            of_code[(number[a] * n + number[b]) * n + number[c]] = k
        # the texts one after the other, with a character between that no trigram has
        low = [(i, x.lower().encode("utf-32-le", "surrogatepass")) for i, x in enumerate(texts) if x]
        chars = np.frombuffer(b"\xff\xff\xff\x7f".join(x for _, x in low), "<u4")
        starts = np.cumsum([0] + [len(x) // 4 + 1 for _, x in low[:-1]])
        kinds = of_char[np.minimum(chars, len(of_char) - 1)]
        found = of_code[(kinds[:-2] * n + kinds[1:-1]) * n + kinds[2:]] if len(kinds) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(found >= 0)
        pairs = np.unique(found[at].astype(np.int64) * len(low) + np.searchsorted(starts, at, "right") - 1)
        for k, text in zip((pairs // len(low)).tolist(), (pairs % len(low)).tolist(), strict=True):
            self.postings[names[k]].add(low[text][0])

    def candidates(self, query: Query) -> set[int]:
        found: set[int] = set()
        for needed in query:
            lists = sorted((self.postings[t] for t in needed), key=len)
            found |= reduce(set.__and__, lists) if lists else self.all
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, r.compiled(), trigram_query(r)) for k, r in enumerate(rules)]
        self.trigrams = {t for *_, q in self.rules for needed in q for t in needed}

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        index = Index(texts, self.trigrams)
        found: list[list[tuple]] = [[] for _ in texts]
        for k, rule, compiled, query in self.rules:
            for i in index.candidates(query):
                for m in compiled.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [[{"kind": self.rules[k][1].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep's columns and spans, an array of (kind, start, end) by start, then by the rules' order."""
    base = docs.select(*keep, F.col(text).alias("__text"))

    def make():
        scanner = Scanner(rules)
        return lambda cols: cols | {"spans": scanner.spans(cols.pop("__text"))}

    schema = extended(base.drop("__text"), "spans array<struct<kind:string,start:long,end:long>>")
    return map_columns(base, make, schema)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each span (or overlapping spans together) replaced by [SECRET]; other columns stay."""
    at = docs.columns.index(text)

    def make():
        scanner = Scanner(rules)

        def cleaned(x: str, spans: list[dict]) -> str:
            out, end = [], 0
            for s in spans:
                if s["start"] >= end:
                    out += [x[end : s["start"]], "[SECRET]"]
                end = max(end, s["end"])
            return "".join(out) + x[end:]

        def f(cols):
            name = list(cols)[at]
            return cols | {name: [cleaned(x, s) if s else x for x, s in zip(cols[name], scanner.spans(cols[name]), strict=True)]}

        return f

    return map_columns(docs, make, docs.schema)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every row of documents; null and empty texts have none."""
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
