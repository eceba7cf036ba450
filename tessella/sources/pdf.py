"""PDF files split into parts that are valid PDF files of their own.

A file's objects are found by their own marks, not by its cross-reference table, so files with broken or compressed tables are read alike; objects in
object streams are unpacked. The page tree gives the pages in order, each with what it inherits. A part holds its pages and all that these refer to, under a
page tree and a table of its own. Later versions of an object, by place in the file, replace earlier ones.

Encrypted files, and those whose page tree can't be read, are one part: the file as it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pages of a part, and pages that it shares with the one before.
PAGES, OVERLAP = 6, 1
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \t\r\n]+(\d{1,5})[ \t\r\n]+obj\b")
_REFERENCE = re.compile(rb"(?<![0-9.])(\d{1,10})[ \t\r\n]+\d{1,5}[ \t\r\n]+R(?![A-Za-z0-9])")
_STREAM = re.compile(rb"stream\r?\n")
_LENGTH = re.compile(rb"/Length[ \t\r\n]+(\d+)(?![ \t\r\n]+\d+[ \t\r\n]+R)")


@dataclass
class Body:
    """An object's dictionary or value, and its stream with its keywords (b"" for none)."""

    head: bytes
    stream: bytes = b""


def entry(head: bytes, name: str) -> bytes | None:
    """The raw value of a dictionary's own entry; nested dictionaries' entries don't count."""
    at, depth, n = head.find(b"<<"), 0, len(head)
    if at < 0:
        return None
    key = b"/" + name.encode()
    while at < n:
        two = head[at : at + 2]
        if two == b"<<":
            depth, at = depth + 1, at + 2
        elif two == b">>":
            depth, at = depth - 1, at + 2
            if not depth:
                return None
        elif head[at : at + 1] == b"(":
            at = _past(head, at)
        elif depth == 1 and head.startswith(key, at) and not head[at + len(key) : at + len(key) + 1].isalnum():
            start = at + len(key)
            return head[start : _past(head, start)].strip()
        elif head[at : at + 1] == b"/":
            at += 1
            while at < n and head[at : at + 1] not in b" \t\r\n\f\0/<>[](){}%":
                at += 1
            if depth == 1:  # the value of another entry
                at = _past(head, at)
        else:
            at += 1
    return None


def _past(head: bytes, at: int) -> int:
    """Where the value that begins at or after a place ends."""
    n = len(head)
    while at < n and head[at : at + 1] in b" \t\r\n\f\0":
        at += 1
    c = head[at : at + 1]
    if c == b"(":
        depth = 0
        while at < n:
            b = head[at]
            at += 2 if b == 92 else 1
            depth += (b == 40) - (b == 41)
            if b == 41 and not depth:
                break
        return min(at, n)
    if head[at : at + 2] == b"<<" or c == b"[":
        opens, depth = (b"<<", b">>") if c == b"<" else (b"[", b"]"), 0
        while at < n:
            if head[at : at + 1] == b"(":
                at = _past(head, at)
            elif head.startswith(opens[0], at):
                depth, at = depth + 1, at + len(opens[0])
            elif head.startswith(opens[1], at):
                depth, at = depth - 1, at + len(opens[1])
                if not depth:
                    break
            else:
                at += 1
        return at
    if c == b"<":
        return head.find(b">", at) + 1 or n
    if m := re.compile(rb"\d+[ \t\r\n]+\d+[ \t\r\n]+R").match(head, at):
        return m.end()
    at += 1
    while at < n and head[at : at + 1] not in b" \t\r\n\f\0/<>[](){}%":
        at += 1
    return at


def objects(content: bytes) -> dict[int, Body]:
    """The file's objects by number."""
    out: dict[int, Body] = {}
    packed: list[Body] = []
    at = 0
    while m := _OBJECT.search(content, at):
        end = content.find(b"endobj", m.end())
        end = len(content) if end < 0 else end
        s = _STREAM.search(content, m.end(), end)
        if s:
            head = content[m.end() : s.start()]
            stop = -1
            if length := _LENGTH.search(head):
                stop = s.end() + int(length[1])
                if not content[stop : stop + 20].lstrip(b"\r\n").startswith(b"endstream"):
                    stop = -1
            stop = content.find(b"endstream", s.end()) if stop < 0 else stop
            stop = len(content) if stop < 0 else stop
            body = Body(head.strip(), content[s.end() : stop])
            end = content.find(b"endobj", stop)
            end = len(content) if end < 0 else end
        else:
            body = Body(content[m.end() : end].strip())
        out[int(m[1])] = body
        if b"/ObjStm" in body.head:
            packed.append(body)
        at = end
    for body in packed:
        for number, head in _unpacked(body):
            out.setdefault(number, Body(head))
    return out


def _unpacked(body: Body) -> Iterator[tuple[int, bytes]]:
    data = body.stream
    if b"/FlateDecode" in body.head:
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            return
    n, first = (int(entry(body.head, k) or 0) for k in ("N", "First"))
    index = [int(x) for x in data[:first].split()[: 2 * n]]
    places = [*index[1::2], len(data) - first]
    for k, number in enumerate(index[::2]):
        yield number, data[first + places[k] : first + places[k + 1]].strip()


def _target(value: bytes | None) -> int | None:
    m = _REFERENCE.match(value) if value else None
    return int(m[1]) if m else None


def pages(found: dict[int, Body], trailers: bytes) -> list[tuple[int, dict[str, bytes]]]:
    """The pages in order: number and inherited entries. Empty where there is no readable page tree."""
    roots = [int(m[1]) for m in re.finditer(rb"/Root[ \t\r\n]+(\d+)[ \t\r\n]+\d+[ \t\r\n]+R", trailers)]
    roots += [k for k, b in found.items() if re.search(rb"/Type[ \t\r\n]*/Catalog\b", b.head)]
    top = next((t for r in reversed(roots) if r in found and (t := _target(entry(found[r].head, "Pages"))) in found), None)
    out: list[tuple[int, dict[str, bytes]]] = []
    todo, seen = [(top, {})] if top is not None else [], set()
    while todo:
        k, above = todo.pop()
        if k in seen or k not in found:
            continue
        seen.add(k)
        head = found[k].head
        own = above | {n: v for n in INHERITED if (v := entry(head, n)) is not None}
        kids = entry(head, "Kids")
        if kids is None:
            out.append((k, own))
            continue
        if (t := _target(kids)) is not None:
            kids = found[t].head if t in found else b""
        todo += [(int(m[1]), own) for m in reversed(list(_REFERENCE.finditer(kids)))]
    return out


def _without(head: bytes, name: str) -> bytes:
    value = entry(head, name)
    if value is None:
        return head
    return re.sub(rb"/" + name.encode() + rb"[ \t\r\n]*" + re.escape(value), b"", head, count=1)


def part(found: dict[int, Body], chosen: list[tuple[int, dict[str, bytes]]]) -> bytes:
    """A file of some pages and what they refer to."""
    top = max(found) + 1
    written: dict[int, Body] = {}
    for k, own in chosen:
        head = _without(found[k].head, "Parent")
        extra = b"".join(b"/" + n.encode() + b" " + v + b" " for n, v in own.items() if entry(head, n) is None)
        close = head.rindex(b">>")
        written[k] = Body(head[:close] + extra + b"/Parent %d 0 R " % top + head[close:], found[k].stream)
    todo = list(written)
    while todo:
        for m in _REFERENCE.finditer(written[todo.pop()].head):
            k = int(m[1])
            if k in found and k not in written and not re.search(rb"/Type[ \t\r\n]*/(?:Pages|Catalog|Page)\b", found[k].head):
                written[k] = found[k]
                todo.append(k)
    written[top] = Body(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(chosen), b" ".join(b"%d 0 R" % k for k, _ in chosen)))
    written[top + 1] = Body(b"<< /Type /Catalog /Pages %d 0 R >>" % top)
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for k in sorted(written):
        places[k] = len(out)
        body = written[k]
        out += b"%d 0 obj\n%s\n" % (k, body.head) + (b"stream\n" + body.stream + b"endstream\n" if body.stream else b"") + b"endobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, places[k]) for k in sorted(places))
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (top + 2, top + 1, start)
    return bytes(out)


def split(content: bytes, size: int = PAGES, overlap: int = OVERLAP) -> list[tuple[int, int, bytes]]:
    """(first page, last page, file) of each part; the whole file up to size pages or where it can't be taken apart."""
    found = objects(content) if b"/Encrypt" not in content else {}
    every = pages(found, content) if found else []
    if len(every) <= size:
        return [(1, max(1, len(every)), content)]
    out = []
    for first in range(0, len(every), size - overlap):
        chosen = every[first : first + size]
        out.append((first + 1, first + len(chosen), part(found, chosen)))
        if first + size >= len(every):
            break
    return out


PART = "chunk_index int, page_start int, page_end int, content binary"


def parts(files: DataFrame, keep: list[str], content: str = "content", size: int = PAGES, overlap: int = OVERLAP) -> DataFrame:
    """keep's columns and a row for each part of each PDF file; null contents have none. A batch's rows are taken apart one by one, so memory is a file's and its parts'."""
    base = files.filter(F.col(content).isNotNull()).select(*keep, F.col(content).alias("__content"))
    schema = StructType(base.drop("__content").schema.fields + StructType.fromDDL(PART).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = split(batch.column(batch.num_columns - 1)[i].as_py(), size, overlap)
                own = [c.take(pa.array([i] * len(made))) for c in batch.columns[:-1]]
                first, last, body = (list(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, f.type) for v, f in zip((list(range(len(made))), first, last, body), list(arrow)[len(own) :], strict=True)]], schema=arrow)

    return base.mapInArrow(run, schema)
