"""PDF files taken apart: parts reopen with the right pages and all that these need."""

import re
import zlib

import pytest

from tessella.sources import documents, pdf


def made(n, packed=False, kids_of=4, extra=b""):
    """A file of n pages in a tree of two levels; resources and box are inherited; with packed, dictionaries lie in an object stream."""
    objs, streams = {}, {}
    groups = [range(a, min(a + kids_of, n)) for a in range(0, n, kids_of)]
    objs[1] = b"<< /Type /Catalog /Pages 2 0 R /Names << /Kids (no 9 0 R) >> >>"
    objs[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> /MediaBox [0 0 %d 200] >>" % (n, b" ".join(b"%d 0 R" % (10 + g) for g in range(len(groups))), 100)
    objs[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Note (a \\) paren >> 77 0 R) >>"
    for g, own in enumerate(groups):
        objs[10 + g] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] /Rotate %d >>" % (len(own), b" ".join(b"%d 0 R" % (100 + 2 * k) for k in own), 90 * (g % 2))
        for k in own:
            objs[100 + 2 * k] = b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R %s>>" % (10 + g, 101 + 2 * k, b"/MediaBox [0 0 5 5] " if k == 1 else b"")
            streams[101 + 2 * k] = b"BT (page number %d endobj) Tj ET\n" % k
    out = bytearray(b"%PDF-1.5\n")
    if packed:
        index, data = b"", b""
        for k, v in objs.items():
            index += b"%d %d " % (k, len(data))
            data += v + b"\n"
        raw = zlib.compress(index + data)
        out += b"5 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objs), len(index), len(raw)) + raw + b"\nendstream\nendobj\n"
    else:
        for k, v in objs.items():
            out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for k, v in streams.items():
        out += b"%d 0 obj\n<< /Length %d >>\nstream\n" % (k, len(v)) + v + b"endstream\nendobj\n"
    return bytes(out) + b"trailer\n<< /Root 1 0 R %s>>\n%%%%EOF\n" % extra


def shown(content):
    """What each page shows, by the reader itself."""
    found = pdf.objects(content)
    return [re.search(rb"\((.*)\)", found[pdf._target(pdf.entry(found[k].head, "Contents"))].stream)[1] for k, _ in pdf.pages(found, content)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("n", [1, 6, 7, 11, 12, 23])
def test_parts(n, packed):
    whole = made(n, packed)
    assert shown(whole) == [b"page number %d endobj" % k for k in range(n)]
    got = pdf.split(whole)
    want = [(1, n)] if n <= 6 else [(a + 1, min(a + 6, n)) for a in range(0, n, 5) if a == 0 or a + 1 < n]
    assert [(a, b) for a, b, _ in got] == want
    for a, b, body in got:
        assert shown(body) == [b"page number %d endobj" % k for k in range(a - 1, b)]
        found = pdf.objects(body)
        for (k, own), number in zip(pdf.pages(found, body), range(a - 1, b), strict=True):
            head = found[k].head if n > 6 else b""
            assert own["MediaBox"] == (b"[0 0 5 5]" if number == 1 else b"[0 0 100 200]") and own["Rotate"] == b"%d" % (90 * (number // 4 % 2))
            assert n <= 6 or (b"/Resources" in head and b"3 0 R" in head)
        assert 3 in found  # the font came along
        if n > 6:  # the table tells where each object is
            for number, place in re.findall(rb"(\d+) 1\n(\d{10}) 00000 n", body):
                assert body[int(place) :].startswith(b"%d 0 obj" % int(number))
            assert documents.pdf_pages(body) == b - a + 1 and int(body.rpartition(b"startxref\n")[2].split()[0]) == body.rindex(b"xref\n0 1")


def test_odd_files():
    for x in (b"", b"no pdf", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", made(9, extra=b"/Encrypt 8 0 R "), made(9)[:150]):
        assert pdf.split(x) == [(1, 1, x)]
    loop = made(9).replace(b"/Kids [100 0 R", b"/Kids [2 0 R 100 0 R")
    assert len(pdf.split(loop)) == 2
    assert [x[:2] for x in pdf.split(made(9), 3, 0)] == [(1, 3), (4, 6), (7, 9)]


def test_rows(spark):
    df = spark.createDataFrame([(1, made(12), "x"), (2, made(3), "y"), (3, None, "z")], "file_id long, content binary, extra string")
    got = pdf.parts(df, ["file_id", "extra"]).collect()
    assert sorted((r["file_id"], r["chunk_index"], r["page_start"], r["page_end"], r["extra"]) for r in got) == [(1, 0, 1, 6, "x"), (1, 1, 6, 11, "x"), (1, 2, 11, 12, "x"), (2, 0, 1, 3, "y")]
    assert all(len(shown(bytes(r["content"]))) == r["page_end"] - r["page_start"] + 1 for r in got)
