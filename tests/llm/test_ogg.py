import random

import pytest

from tessella.llm import ogg


def slow_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum_is_the_formats():
    for n in (0, 1, 27, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [64, 128, 255 * 64, 8192, 8256, 64 * 5000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    streams, bad = ogg.read(ogg.write_payload(payload))
    assert bad == 0 and len(streams) == 2 and all(s.ended and not s.lost for s in streams)
    assert ogg.read_payload(streams) == payload


@pytest.mark.parametrize("sizes", [[0], [255], [254, 0, 255, 510], [255 * 255], [255 * 255 - 1, 1], [70_000, 3, 200_000]])
def test_lacing(sizes):
    rng = random.Random(sum(sizes))
    packets = [(rng.randbytes(n), k) for k, n in enumerate(sizes)]
    streams, bad = ogg.read(b"".join(ogg.pages_of(7, packets)))
    assert bad == 0 and [s.packets for s in streams] == [[x for x, _ in packets]]
    assert streams[0].ended and streams[0].granules[-1] == len(sizes) - 1


def test_bad_page_is_left_out():
    packets = [(bytes([k]) * 60_000, (k + 1) * 60_000) for k in range(6)]
    pages = ogg.pages_of(1, packets)
    broken = bytearray(pages[2])
    broken[-1] ^= 1
    streams, bad = ogg.read(b"junk" + b"".join([*pages[:2], bytes(broken), *pages[3:]]) + b"OggS")
    assert bad == 2 and streams[0].lost == 1
    assert set(streams[0].packets) < {x for x, _ in packets}
    assert ogg.read(None) == ([], 0) and ogg.read(b"") == ([], 0)


def test_timestamps_count_back_from_the_page():
    header = ogg.PCM.pack(ogg.MAGIC, ogg.RATE, 0, 1)
    pages = ogg.pages_of(1, [(header, 0), (b"a" * 300, 300), (b"b" * 200, 500)])
    assert ogg.timestamps(ogg.read(b"".join(pages))[0][0]) == [(0, 300), (300, 500)]


def test_frames(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (1, "abc", "x"), (None, "é" * 10_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    media = ogg.store(docs, ["doc_id"])
    got = ogg.add_streams(media, ["doc_id", "n_bytes"]).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 0, 3, 3, 20_000]
    assert all(r["bad_pages"] == 0 and [s["serial"] for s in r["streams"]] == [1, 2] for r in got)
    assert ogg.add_streams(media.limit(0), ["doc_id"]).count() == 0


def test_query(spark, tmp_path):
    import hashlib
    import zlib

    rows = [(1, "abc"), (2, None), (3, "ü" * 32), (4, "x" * 70_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in ogg.op6_ogg_media(spark, str(tmp_path)).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])


def test_lost_header():
    header = ogg.PCM.pack(ogg.MAGIC, ogg.RATE, 0, 1)
    pages = ogg.pages_of(1, [(header, 0), (b"a" * 300, 300), (b"b" * 200, 500)])
    broken = bytes([*pages[0][:-1], pages[0][-1] ^ 1])
    (s,), bad = ogg.read(b"".join([broken, *pages[1:]]))
    assert (bad, s.lost, s.headed, s.header) == (1, 1, False, b"") and s.data == [b"a" * 300, b"b" * 200]
    assert ogg.rate_of(s.header) == (0, 0) and "ms=-1" in ogg.feature([s], bad)


def test_chained_streams_of_one_serial():
    header = ogg.PCM.pack(ogg.MAGIC, ogg.RATE, 0, 1)
    first, second = (b"".join(ogg.pages_of(9, [(header, 0), (x, len(x))])) for x in (b"a" * 100, b"b" * 70))
    streams, bad = ogg.read(first + second)
    assert bad == 0 and [s.data for s in streams] == [[b"a" * 100], [b"b" * 70]] and all(s.ended and not s.lost for s in streams)


def test_query_on_odd_tables(spark, tmp_path):
    clash = "doc_id long, text string, media binary, feature string, __text string, n_bytes int"
    spark.createDataFrame([], clash).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ogg.op6_ogg_media(spark, f"{tmp_path}/none").count() == 0
    rows = [(1, "abc", b"m", "f", "t", 7)] * 2 + [(None, "long " * 300_000, None, None, None, None)]
    spark.createDataFrame(rows, clash).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = ogg.op6_ogg_media(spark, f"{tmp_path}/some").collect()
    assert sorted(r["n_bytes"] for r in got) == [3, 3, 1_500_000] and len(set(map(tuple, got))) == 2
