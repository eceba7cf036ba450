"""Ogg bitstreams in a binary column: writing, and reading with every page checked.

The reader verifies each page's checksum, reassembles packets from the lacing values (packets may span pages),
demultiplexes the logical streams by serial number and derives timestamps from granule positions.

Defined results: null or empty media has no streams; a page whose checksum, version or length is wrong counts as bad and
is left out, with the packets it would have carried, and reading goes on at the next capture pattern; a packet that the
end of the data cuts off is left out. A stream whose first page is missing has no header: its rate is unknown, all its packets are data,
and the pages before the first one read count as lost. A page that begins a serial number anew begins a stream of its own (chained
media). Very long media are read whole; repeated rows give repeated rows; an empty table gives an empty result. Equal media gives equal results.
Columns other than those named, also of clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import extended, map_columns, table

HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
UNKNOWN = -1
#: Each byte with its bits reversed: the Ogg checksum is the usual CRC-32 on reversed bits, without inversions.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, initial value and final XOR 0, most significant bit first."""
    c = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets come with the granule position at their end.

    The first packet (the header) gets a page of its own; a page's granule position is that of the last packet
    that ends on it, or -1 if none does.
    """
    out: list[bytes] = []
    lacing, body, granule, carried = bytearray(), [], UNKNOWN, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = (CONTINUED if carried else 0) | (0 if out else FIRST) | (LAST if last else 0)
        out.append(page(serial, len(out), flags, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, carried = bytearray(), [], UNKNOWN, open_packet

    for k, (data, position) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1  # lacing values; the last is under 255
        while left:
            room = 255 - len(lacing)
            n = min(room, left)
            whole = n == left
            size = len(data) - at if whole else n * 255
            lacing += b"\xff" * (n - whole) + (bytes([len(data) % 255]) if whole else b"")
            body.append(data[at : at + size])
            at, left = at + size, left - n
            if whole:
                granule = position
            if len(lacing) == 255 and not (whole and k == len(packets) - 1):
                flush(False, not whole)
        if k == 0 and lacing and len(packets) > 1:
            flush(False, False)
    if lacing or not out:
        flush(True, False)
    return out


@dataclass
class Stream:
    serial: int
    pages: int = 0
    lost: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: granule position at each packet's end, -1 where only a later packet's is given
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    open: bytes | None = None
    next: int = 0
    #: whether the first packet is there, the codec's header
    headed: bool = True

    @property
    def header(self) -> bytes:
        return self.packets[0] if self.headed and self.packets else b""

    @property
    def data(self) -> list[bytes]:
        return self.packets[1:] if self.headed else self.packets

    @property
    def ends(self) -> list[int]:
        return self.granules[1:] if self.headed else self.granules


def read(media: bytes | None) -> tuple[list[Stream], int]:
    """The logical streams in the order of their first pages, and the number of bad pages."""
    streams: list[Stream] = []
    current: dict[int, Stream] = {}
    at, bad, media = 0, 0, media or b""
    while (at := media.find(b"OggS", at)) >= 0:
        if at + 27 > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        raw = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        s = current.get(serial)
        if s is None or flags & FIRST:
            s = current[serial] = Stream(serial, headed=bool(flags & FIRST))
            streams.append(s)
        if number != s.next:
            s.lost, s.open = s.lost + max(0, number - s.next), None
        s.pages, s.next, s.ended = s.pages + 1, number + 1, s.ended or bool(flags & LAST)
        part = s.open if flags & CONTINUED else b""
        skip = part is None  # the rest of a packet whose start is lost
        body, done = media[at + 27 + n : end], []
        s.open, start, size = None, 0, 0
        for k, v in enumerate(lacing):
            size += v
            if v < 255:
                if not skip:
                    done.append(part + body[start : start + size])
                start, size, part, skip = start + size, 0, b"", False
            elif k == n - 1 and not skip:
                s.open = part + body[start : start + size]
        s.packets += done
        s.granules += [UNKNOWN] * (len(done) - 1) + [granule] * bool(done)
        at = end
    return streams, bad


#: The codec of stored payloads: a header packet (magic, sample rate, channel, channels), then packets of unsigned 8-bit samples.
PCM = struct.Struct("<8sIHH")
MAGIC, RATE, CHANNELS, SAMPLES = b"PCM8\0\0\0\1", 8000, 2, 4096


def rate_of(header: bytes) -> tuple[int, int]:
    """Granules a second and the granules to skip at the start, from a codec's header packet; (0, 0) if unknown."""
    if header[:8] == MAGIC and len(header) >= PCM.size:
        return PCM.unpack_from(header)[1], 0
    if header[:8] == b"OpusHead" and len(header) >= 19:
        return 48000, int.from_bytes(header[10:12], "little")
    if header[:7] == b"\x01vorbis" and len(header) >= 30:
        return int.from_bytes(header[12:16], "little"), 0
    if header[:5] == b"\x7fFLAC" and len(header) >= 30:
        return int.from_bytes(header[27:30], "big") >> 4, 0
    return 0, 0


def timestamps(s: Stream) -> list[tuple[int, int]]:
    """Start and end of each data packet in granules.

    The last packet that ends on a page ends at the page's position; those before it on the page end where the next
    one starts. A packet of this module's codec lasts as many granules as it has samples; of other codecs only ends
    are known, and starts are the ends before.
    """
    pcm = s.header[:8] == MAGIC
    out, later = [], 0
    for data, granule in zip(reversed(s.data), reversed(s.ends), strict=True):
        end = later if granule == UNKNOWN else granule
        later = end - len(data) if pcm else end
        out.append((later, end))
    out.reverse()
    return out if pcm else [(out[i - 1][1] if i else 0, end) for i, (_, end) in enumerate(out)]


def write_payload(payload: bytes) -> bytes:
    """Sample i goes to logical stream i % CHANNELS; the streams' pages are interleaved."""
    pages = []
    for c in range(CHANNELS):
        track = payload[c::CHANNELS]
        packets = [(PCM.pack(MAGIC, RATE, c, CHANNELS), 0)]
        packets += [(track[i : i + SAMPLES], min(i + SAMPLES, len(track))) for i in range(0, len(track), SAMPLES)]
        pages.append(pages_of(c + 1, packets))
    # first pages first, as the format asks, then by turns
    return b"".join(own[k] for k in range(max(map(len, pages))) for own in pages if k < len(own))


def read_payload(streams: list[Stream]) -> bytes:
    """The samples that write_payload stored; channels and places come from the headers and timestamps."""
    tracks: dict[int, bytearray] = {}
    for s in streams:
        if s.header[:8] == MAGIC:
            track = tracks.setdefault(PCM.unpack_from(s.header)[2], bytearray(max([0, *s.granules])))
            for (start, end), data in zip(timestamps(s), s.data, strict=True):
                track[start:end] = data
    out = bytearray(sum(map(len, tracks.values())))
    for c, track in tracks.items():
        out[c :: len(tracks)] = track
    return bytes(out)


def feature(streams: list[Stream], bad: int) -> str:
    """Bad pages; then pages, packets, milliseconds and mean sample of each stream."""
    parts = [f"bad={bad}"]
    for s in streams:
        rate, skip = rate_of(s.header)
        ms = max(0, max([0, *s.granules]) - skip) * 1000 // rate if rate else -1
        data = b"".join(s.data)
        mean = int(np.frombuffer(data, np.uint8).sum(dtype=np.int64)) * 1000 // len(data) if data else 0
        parts.append(f"{s.serial}:pages={s.pages},packets={len(s.packets)},ms={ms},mean={mean}")
    return ";".join(parts)


def add_streams(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """keep's columns, bad_pages and streams: for each logical stream its serial, pages, lost pages, whether it ended,
    and its packets with start_ms, end_ms (null if the codec's rate is unknown) and data."""
    base = df.select(*keep, F.col(media).alias("__media"))

    def one(x):
        streams, bad = read(x)
        out = []
        for s in streams:
            rate, skip = rate_of(s.header)
            ms = lambda g: max(0, g - skip) * 1000 // rate if rate else None  # noqa: B023, E731
            packets = [{"start_ms": ms(a), "end_ms": ms(b), "data": d} for (a, b), d in zip(timestamps(s), s.data, strict=True)]
            out.append({"serial": s.serial, "pages": s.pages, "lost": s.lost, "ended": s.ended, "packets": packets})
        return bad, out

    def f(cols):
        found = [one(x) for x in cols.pop("__media")]
        return cols | {"bad_pages": [x for x, _ in found], "streams": [x for _, x in found]}

    schema = extended(base.drop("__media"), "bad_pages long, streams array<struct<serial:long,pages:long,lost:long,ended:boolean,packets:array<struct<start_ms:long,end_ms:long,data:binary>>>>")
    return map_columns(base, lambda: f, schema)


def store(docs: DataFrame, keep: list[str], text: str = "text", block: int = 64) -> DataFrame:
    """keep's columns, n_bytes (of the text as UTF-8; null: 0) and media: those bytes, padded with 0 to a positive
    multiple of block, as an Ogg file."""
    base = docs.select(*keep, F.col(text).alias("__text"))

    def f(cols):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in cols.pop("__text")]
        return cols | {"n_bytes": [len(x) for x in raw], "media": [write_payload(x + bytes(-len(x) % block if x else block)) for x in raw]}

    return map_columns(base, lambda: f, extended(base.drop("__text"), "n_bytes long, media binary"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents stored as Ogg and read back; a null text is empty, and stored as one block of zeros."""
    media = store(table(spark, sf_dir, "documents"), ["doc_id"])

    def f(cols):
        out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in cols.pop("media"):
            streams, bad = read(x)
            payload = read_payload(streams)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature(streams, bad))
            for own, v in zip(out.values(), row, strict=True):
                own.append(v)
        return cols | out

    return map_columns(media, lambda: f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
