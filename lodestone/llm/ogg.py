"""Media columns: Ogg streams as binary columns.

A stream is pages; a page has a header with a checksum, lacing values and a body. The reader
verifies checksums, skips damaged bytes to the next page, reassembles packets from the lacing
values, separates logical streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Fixed values of the format: capture pattern, header layout, flags.
CAPTURE = b"OggS"
HEADER, HEADER_BYTES = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
#: Our codec: an identification packet, then packets of 8-bit samples, a granule being one sample.
CODEC = b"\x7fPCM8"
IDENT, IDENT_BYTES = "<6sBI", 11
RATE = 8000
PACKET = 4 * 576
PAGE_SEGMENTS = 255

REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, high bit first, from 0. zlib has the same polynomial low
    bit first, so bytes and result are reversed bit by bit."""
    reflected = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def logical_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream; packets have the granule position at their end."""
    segments = []  # (lacing value, bytes, granule if a packet ends here)
    for data, granule in packets:
        for at in range(0, len(data) + 1, 255):
            piece = data[at : at + 255]
            segments.append((len(piece), piece, granule if len(piece) < 255 else None))
    pages, fresh = [], True
    # The identification packet has the first page to itself.
    head = next(k for k, s in enumerate(segments) if s[2] is not None) + 1
    groups = [segments[:head], *[segments[k : k + PAGE_SEGMENTS] for k in range(head, len(segments), PAGE_SEGMENTS)]]
    for number, group in enumerate(groups):
        granule = next((g for _, _, g in reversed(group) if g is not None), -1)
        flags = (0 if fresh else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if number == len(groups) - 1 else 0)
        pages.append(page_bytes(flags, granule, serial, number, bytes(s[0] for s in group), b"".join(s[1] for s in group)))
        fresh = group[-1][2] is not None
    return pages


def encode(payload: bytes, streams: int = 2) -> bytes:
    """`payload` as multiplexed logical streams of 8-bit samples; packets go round the streams."""
    base = zlib.crc32(payload)
    packets = [payload[at : at + PACKET] for at in range(0, len(payload), PACKET)] or [b""]
    per = []
    for k in range(streams):
        end, mine = 0, [(struct.pack(IDENT, CODEC, k, RATE), 0)]
        for p in packets[k::streams]:
            end += len(p)
            mine.append((p, end))
        per.append(logical_stream((base + k) & 0xFFFFFFFF, mine))
    out = [p[0] for p in per]  # all first pages come before any other
    for k in range(1, max(map(len, per))):
        out += [p[k] for p in per if k < len(p)]
    return b"".join(out)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, int, bytes, bytes]]:
    """(offset, flags, granule, serial, number, lacing, body) of each page whose checksum holds."""
    at = media.find(CAPTURE)
    while at >= 0 and at + HEADER_BYTES <= len(media):
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEADER, media, at)
        body = at + HEADER_BYTES + n
        lacing = media[at + HEADER_BYTES : body]
        end = body + sum(lacing)
        if version == 0 and len(lacing) == n and end <= len(media) and checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc:
            yield at, flags, granule, serial, number, lacing, media[body:end]
            at = end if media[end : end + 4] == CAPTURE else media.find(CAPTURE, end)
        else:
            at = media.find(CAPTURE, at + 1)


def packets_of(media: bytes) -> list[tuple[int, int, bytes, int]]:
    """(serial, packet number in its stream, data, granule or -1) of whole packets, in the order in
    which they end. A packet with a lost page in it is left out."""
    parts: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    count: dict[int, int] = {}
    found = []
    for _, flags, granule, serial, number, lacing, body in pages_of(media):
        if expected.get(serial, 0) != number or not flags & CONTINUED:
            parts[serial] = None if flags & CONTINUED else bytearray()
        expected[serial] = number + 1
        ends = [k for k, x in enumerate(lacing) if x < 255]
        at = 0
        for k, x in enumerate(lacing):
            if parts.get(serial) is not None:
                parts[serial] += body[at : at + x]
            at += x
            if x < 255:
                if parts.get(serial) is not None:
                    found.append((serial, count.get(serial, 0), bytes(parts[serial]), granule if k == ends[-1] else -1))
                    count[serial] = count.get(serial, 0) + 1
                parts[serial] = bytearray()
    return found


def decode(media: bytes) -> tuple[bytes, list[dict]]:
    """The samples of our codec in their order, and a record per stream."""
    order: dict[int, tuple[int, int]] = {}
    data: dict[int, list[bytes]] = {}
    granules: dict[int, int] = {}
    for serial, number, packet, granule in packets_of(media):
        if number == 0 and len(packet) == IDENT_BYTES and packet.startswith(CODEC):
            _, k, rate = struct.unpack(IDENT, packet)
            order[serial], data[serial], granules[serial] = (k, rate), [], 0
        elif serial in data:
            data[serial].append(packet)
            granules[serial] = max(granules[serial], granule)
    serials = sorted(order, key=lambda s: order[s])
    rows = max((len(data[s]) for s in serials), default=0)
    samples = b"".join(data[s][k] for k in range(rows) for s in serials if k < len(data[s]))
    info = [{"stream": order[s][0], "packets": len(data[s]), "samples": granules[s], "micros": granules[s] * 1_000_000 // order[s][1]} for s in serials]
    return samples, info


def payload_of(text: bytes, unit: int = 576) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def feature_of(samples: bytes, info: list[dict]) -> str:
    """Streams, packets, duration in microseconds, mean and root mean square about 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    mean, rms = (x.mean(), np.sqrt((x * x).mean())) if len(x) else (0.0, 0.0)
    return f"streams={len(info)};packets={sum(i['packets'] for i in info)};micros={max((i['micros'] for i in info), default=0)};mean={mean:.4f};rms={rms:.4f}"


def _mapped(df: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """Rows of `one(*values)` for each row, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, columns[-1]):
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in one(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media): each text's padded bytes as an Ogg stream. Null: as the empty text. Repeated rows give
    repeated streams; an empty table gives none; a very long text is a slice by itself."""
    kind = df.schema[key].dataType.simpleString()

    def one(k, t):
        yield k, encode(payload_of((t or "").encode()))

    return _mapped(df, [key, text], one, f"{key} {kind}, media binary")


def read_pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row per page with a good checksum. Null or foreign bytes: none. Repeated rows repeat their pages;
    an empty table gives none."""
    kind = df.schema[key].dataType.simpleString()

    def one(k, m):
        for at, flags, granule, serial, number, lacing, body in pages_of(m or b""):
            yield k, at, flags, granule, serial, number, len(lacing), len(body)

    return _mapped(df, [key, media], one, f"{key} {kind}, page_offset long, flags int, granule long, serial long, page_number long, n_segments int, body_bytes long")


def read_packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row per whole packet, with the time at which it ends (null unless its page states it). Null or
    foreign bytes: none. Repeated rows repeat their packets; an empty table gives none."""
    kind = df.schema[key].dataType.simpleString()

    def one(k, m):
        rates: dict[int, int] = {}
        for serial, number, data, granule in packets_of(m or b""):
            if number == 0 and len(data) == IDENT_BYTES and data.startswith(CODEC):
                rates[serial] = struct.unpack(IDENT, data)[2]
            known = granule >= 0 and serial in rates
            yield k, serial, number, data, granule, granule * 1_000_000 // rates[serial] if known else None

    return _mapped(df, [key, media], one, f"{key} {kind}, serial long, packet_number long, packet binary, granule long, end_micros long")


def media_digests(df: DataFrame) -> DataFrame:
    """Per row: the text stored as Ogg, read back, with digests of what was read and of the form.

    Null text is the empty text (one unit of padding). Equal texts give equal values; repeated
    rows give repeated rows; an empty table gives none; a very long text is a slice by itself; other
    columns are ignored.
    """

    def one(k, t):
        text = (t or "").encode()
        media = encode(payload_of(text))
        back, info = decode(media)
        yield (
            k, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
            len(media), hashlib.sha256(media).hexdigest(), feature_of(back, info),
        )

    kind = df.schema["doc_id"].dataType.simpleString()
    return _mapped(
        df, ["doc_id", "text"], one,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
