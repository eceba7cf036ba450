"""Query specifications: clauses, their storage, their merging, and their compilation to Spark predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("file_type", "extension", "size_bytes", "modified_at", "path", "semantic_contains")
Value = str | int | datetime | list


@dataclass(frozen=True)
class Clause:
    """value: str, int (bytes, or seconds since 1970), datetime (UTC, without zone) or list of str."""

    field: str
    op: str
    value: Value
    boost: float = 0.0

    def tagged(self) -> dict:
        kinds = {str: "string", int: "int64", datetime: "time", list: "strings"}
        kind = kinds[type(self.value)]
        return {"t": kind, "v": self.value.isoformat() + "Z" if kind == "time" else self.value}

    def key(self) -> str:
        """field|op|value, the value as canonical JSON unless it is a string or number."""
        v = self.value
        if isinstance(v, datetime):
            v = int(v.replace(tzinfo=UTC).timestamp())
        return f"{self.field}|{self.op}|{v if isinstance(v, str | int) else json.dumps(v, separators=(',', ':'))}"


@dataclass(frozen=True)
class Spec:
    semantic: str = ""
    must: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    source: str = "grammar"

    def to_json(self) -> str:
        rows = lambda cs: [{"field": c.field, "op": c.op, "value": c.tagged()} | ({"boost": c.boost} if c.boost else {}) for c in cs]
        out = {"semantic_query": self.semantic, "must": rows(self.must), "must_not": rows(self.must_not), "should": rows(self.should), "source": self.source}
        return json.dumps({k: v for k, v in out.items() if v})

    @staticmethod
    def from_json(text: str) -> Spec:
        def value(tv: dict) -> Value:
            t, v = tv["t"], tv["v"]
            if t == "time":
                return datetime.fromisoformat(v).astimezone(UTC).replace(tzinfo=None)
            wanted = {"string": str, "int64": int, "strings": list}.get(t)
            if wanted and not isinstance(v, wanted):
                raise ValueError(f"expected a {t}: {v!r}")
            return v

        j = json.loads(text)
        rows = lambda k: tuple(Clause(c["field"], c["op"], value(c["value"]), c.get("boost", 0.0)) for c in j.get(k, ()))
        return Spec(j.get("semantic_query", ""), rows("must"), rows("must_not"), rows("should"), j.get("source", ""))


def _direction(c: Clause) -> tuple[str, str]:
    return c.field, {"gt": "lower", "gte": "lower", "lt": "upper", "lte": "upper", "eq": "eq"}.get(c.op, "other")


def merge(grammar: Spec, model: Spec, denied: set[str] | frozenset[str] = frozenset()) -> Spec:
    """The grammar's clauses win by field and direction; exclusions and boosts unite; denied keys go."""
    taken = {_direction(c) for c in grammar.must}
    allowed = lambda cs: [c for c in cs if c.key() not in denied]
    united = lambda a, b: tuple({c.key(): c for c in reversed(allowed([*a, *b]))}.values())[::-1]
    must = allowed([*grammar.must, *(c for c in model.must if _direction(c) not in taken)])
    return Spec(grammar.semantic or model.semantic, tuple(must), united(grammar.must_not, model.must_not), united(grammar.should, model.should), "merged")


# --- predicates


class UnsupportedClause(ValueError):
    pass


def _literal(c: Clause, v: Value) -> Column:
    if c.field == "modified_at":
        return F.timestamp_seconds(F.lit(v)) if isinstance(v, int) else F.timestamp_seconds(F.lit(v.replace(tzinfo=UTC).timestamp()))
    return F.lit(v)


def predicate(c: Clause, negate: bool = False) -> Column:
    """The clause on the files relation. An empty set matches nothing, negated or not."""
    if c.field not in FIELDS:
        raise UnsupportedClause(f"unknown field: {c.field}")
    col = F.col(c.field)
    if c.op == "in_set":
        if not isinstance(c.value, list):
            raise UnsupportedClause("in_set takes a list")
        if not c.value:
            return F.lit(False)
        out = col.isin(c.value)
    elif c.op == "contains":
        out = F.lower(col).contains(str(c.value).lower())
    elif c.op in _COMPARE:
        out = _COMPARE[c.op](col, _literal(c, c.value))
    else:
        raise UnsupportedClause(f"unknown op: {c.op}")
    return ~out if negate else out


_COMPARE = {
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


def where(spec: Spec) -> Column:
    """All must clauses and no must_not clause; those that only the meaning decides are left out."""
    stored = lambda cs: [c for c in cs if c.field != "semantic_contains"]
    parts = [predicate(c) for c in stored(spec.must)] + [predicate(c, True) for c in stored(spec.must_not)]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


# --- filter chips

_FILE_TYPES = {"image": "Images", "video": "Videos", "audio": "Audio", "document": "Documents", "text": "Text"}
_SIGNS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "!="}


def bytes_label(n: int) -> str:
    for power, name in ((30, "GB"), (20, "MB"), (10, "KB")):
        if n >= 1 << power:
            return f"{n >> power} {name}"
    return f"{n} B"


def _shown(c: Clause) -> tuple[str, str] | None:
    """Label and value of a chip, None for a value that the field can't have."""
    v = c.value
    if c.field == "extension" and isinstance(v, list):
        return ", ".join(v), ",".join(v)
    if c.field == "size_bytes":
        return (f"{_SIGNS.get(c.op, c.op)} {bytes_label(v)}", str(v)) if isinstance(v, int) else None
    if c.field == "modified_at":
        if not isinstance(v, int | datetime):
            return None
        t = datetime.fromtimestamp(v, UTC) if isinstance(v, int) else v.replace(tzinfo=UTC)
        day = f"{t:%b} {t.day}"
        word = {"gt": "Since ", "gte": "Since ", "lt": "Before ", "lte": "Before "}.get(c.op, "")
        return word + day, str(int(t.timestamp()))
    if not isinstance(v, str):
        return None
    if c.field == "file_type":
        return _FILE_TYPES.get(v, v[:1].upper() + v[1:]), v
    return (f"Path: {v}" if c.field == "path" else v), v


def chips(spec: Spec) -> list[dict]:
    out = []
    for kind in ("must", "must_not", "should"):
        for c in getattr(spec, kind):
            if shown := _shown(c):
                label = ("Not " if kind == "must_not" else "") + shown[0]
                out.append({"label": label, "field": c.field, "op": c.op, "value": shown[1], "key": c.key(), "kind": kind})
    return out


def deny_list(keys: list[str]) -> frozenset[str]:
    """Chip keys that have their three parts."""
    return frozenset(k for k in keys if k.count("|") >= 2)


def refine(chip_rows: list[dict], denied: frozenset[str] = frozenset()) -> Column:
    """A predicate that applies chips to rows already fetched: boosts, denied chips and unreadable numbers pass all."""
    parts = []
    for c in chip_rows:
        if c["kind"] == "should" or c["key"] in denied:
            continue
        col, op, v = F.col(c["field"]) if c["field"] in FIELDS else None, c["op"], c["value"]
        if c["field"] in ("size_bytes", "modified_at"):
            digits = v.strip()
            if not digits.lstrip("+-").isdigit():
                continue
            number = F.unix_timestamp(col) if c["field"] == "modified_at" else col
            test = _COMPARE[op](number, F.lit(int(digits))) if op in _COMPARE else F.lit(True)
        elif c["field"] in ("file_type", "extension", "path"):
            if c["field"] == "extension" and op == "in_set":
                test = col.isin([x.strip() for x in v.split(",")])
            elif op in ("eq", "neq"):
                test = _COMPARE[op](col, F.lit(v))
            else:
                test = F.lower(col).contains(v.lower()) if op == "contains" else F.lit(True)
        else:
            continue
        parts.append(~test if c["kind"] == "must_not" else test)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def without(spec: Spec, **changes) -> Spec:
    return replace(spec, **changes)


@dataclass
class Cache:
    """Specifications by normalised query; entries of another version miss, unused ones can be dropped."""

    version: int
    rows: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)

    def get(self, key: str, now: int) -> Spec | None:
        text, version, made, _ = self.rows.get(key, ("", -1, 0, 0))
        if version != self.version:
            return None
        self.rows[key] = (text, version, made, now)
        return replace(Spec.from_json(text), source="cache")

    def put(self, key: str, spec: Spec, now: int) -> None:
        self.rows[key] = (spec.to_json(), self.version, now, now)

    def evict(self, before: int) -> None:
        self.rows = {k: r for k, r in self.rows.items() if r[3] >= before}
