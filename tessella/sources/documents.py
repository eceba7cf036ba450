"""Text of PDF and Office files, Arrow batch by Arrow batch."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes kept of a PDF's or a sheet's text.
MOST = 8000
_PAGE = re.compile(rb"/Type\s*/Page[^s]")
_SHOWN = re.compile(rb"\(([^()]*)\)|<([0-9A-Fa-f\s]+)>")
_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")
_SHEET = re.compile(r"xl/worksheets/sheet(\d+)\.xml")


def pdf_pages(content: bytes) -> int:
    return max(1, len(_PAGE.findall(content)))


def pdf_text(content: bytes) -> str:
    """Printable ASCII of the literal and hexadecimal strings, a line each."""
    out, size = [], 0
    for line in content.split(b"\n"):
        for m in _SHOWN.finditer(line):
            raw = m[1] if m[1] is not None else bytes.fromhex((d := re.sub(rb"\s", b"", m[2]).decode())[: len(d) // 2 * 2])
            text = "".join(map(chr, (b for b in raw if 32 <= b <= 126))).strip()
            if text:
                out.append(text)
                size += len(text) + 1
        if size >= MOST:
            break
    return "\n".join(out)[:MOST]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(data: bytes) -> list[str]:
    """Text runs joined by paragraph."""
    out: list[list[str]] = [[]]
    for _, e in ElementTree.iterparse(io.BytesIO(data), events=("end",)):
        if _local(e.tag) == "t" and e.text:
            out[-1].append(e.text)
        elif _local(e.tag) == "p":
            out.append([])
    return [t for x in out if (t := "".join(x).strip())]


def _numbered(names: list[str], pattern: re.Pattern) -> list[str]:
    return sorted(filter(pattern.fullmatch, names), key=lambda n: int(pattern.fullmatch(n)[1]))


def office_text(content: bytes, extension: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if extension == ".docx":
            return "\n".join(_paragraphs(z.read("word/document.xml")))
        if extension == ".pptx":
            return "\n".join(t for n in _numbered(names, _SLIDE) for t in _paragraphs(z.read(n)))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        lines = []
        for n in _numbered(names, _SHEET):
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if _local(r.tag) == "row"):
                cells = []
                for c in row:
                    v = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                lines.append("\t".join(cells))
        return "\n".join(lines).encode()[:MOST].decode("utf-8", "ignore")


def extracted(content: bytes | None, extension: str) -> tuple[str | None, int | None, str | None]:
    """Text, pages and error code."""
    try:
        if content is None:
            return None, None, "ERR_FILE_UNREADABLE"
        if extension == ".pdf":
            return pdf_text(content), pdf_pages(content), None
        if extension in (".docx", ".pptx", ".xlsx"):
            return office_text(content, extension), None, None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return None, None, "ERR_EXTRACTION_FAILED"
    return None, None, "ERR_EXTRACTION_FAILED"  # other formats need a converter


def extract(files: DataFrame) -> DataFrame:
    """files (file_id, extension, content) of kind document, with text, pages and error."""
    schema = T.StructType.fromDDL("file_id long, text string, pages int, error string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extracted(c, e) for e, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], arrow[k + 1].type) for k in range(3)]], schema=arrow)

    return files.select(F.col("file_id").cast("long"), "extension", "content").mapInArrow(run, schema)


def read_text(extension: str | None, content: bytes | None) -> dict:
    """A document's text or error, as a struct; for values of a column."""
    text, _, error = (None, None, None) if extension is None else extracted(content, extension)
    return {"text": text, "error": error}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def text_of(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Text and error of documents, batch by batch; rows without an extension are passed by."""
    return pd.DataFrame([read_text(e, c) for e, c in zip(extension, content, strict=True)], columns=["text", "error"])
