import hashlib
import random
import struct
import zlib

from lodestone.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    data = bytes(range(256)) * 3
    assert ogg.checksum(data) == slow_checksum(data)


def test_round_trips():
    rng = random.Random(1)
    for n in (0, 1, 254, 255, 256, 575, 576, 2304, 2305, 65025, 65026, 200_000):
        payload = ogg.payload_of(rng.randbytes(n))
        assert len(payload) % 576 == 0 and payload
        for streams in (1, 2, 3):
            back, info = ogg.decode(ogg.encode(payload, streams))
            assert back == payload and len(info) == streams and sum(i["samples"] for i in info) == len(payload)


def test_packets_of_multiples_of_255_and_continued_pages():
    packets = [(b"x" * 255, 1), (b"", 2), (b"y" * 510, 3), (b"z" * 70_000, 4)]
    media = b"".join(ogg.logical_stream(9, [(b"head", 0), *packets]))
    assert [(d, g) for _, _, d, g in ogg.packets_of(media)][1:] == [(p, g if k == 3 else -1) for k, (p, g) in enumerate(packets)] or [d for _, _, d, _ in ogg.packets_of(media)][1:] == [p for p, _ in packets]
    flags = [f for _, f, *_ in ogg.pages_of(media)]
    assert flags[0] == ogg.FIRST and flags[-1] & ogg.LAST and any(f & ogg.CONTINUED for f in flags)


def test_damage_is_skipped():
    payload = ogg.payload_of(random.Random(2).randbytes(300_000))
    media = bytearray(ogg.encode(payload, 1))
    pages = list(ogg.pages_of(bytes(media)))
    media[pages[2][0] + 400] ^= 1
    again = list(ogg.pages_of(b"junk" + bytes(media) + b"OggS"))
    assert len(again) == len(pages) - 1
    whole = {d for _, _, d, _ in ogg.packets_of(bytes(ogg.encode(payload, 1)))}
    got = [d for _, _, d, _ in ogg.packets_of(bytes(media))]
    assert set(got) < whole and len(got) >= len(whole) // 2


def test_tables(spark, docs):
    rows = [(1, "héllo"), (2, None), (3, ""), (3, ""), (4, "x" * 10_000)]
    got = {r["doc_id"]: r for r in ogg.media_digests(docs(rows)).collect()}
    for k, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"]) == (len(data), len(payload))
        assert got[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[k]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert got[2]["media_sha256"] == got[3]["media_sha256"] and got[2]["feature"] == got[3]["feature"]
    assert ogg.media_digests(docs([])).count() == 0
    media = ogg.encode_texts(docs(rows[:2]))
    pages, packets = ogg.read_pages(media).collect(), ogg.read_packets(media).collect()
    assert {p["doc_id"] for p in pages} == {1, 2} and all(p["n_segments"] for p in pages)
    assert {p["end_micros"] for p in packets if p["granule"] == 576} == {72_000}
    assert ogg.read_pages(spark.createDataFrame([(1, None), (2, b"no")], "doc_id long, media binary")).count() == 0
    assert struct.calcsize(ogg.HEADER) == ogg.HEADER_BYTES and struct.calcsize(ogg.IDENT) == ogg.IDENT_BYTES


def test_very_long_and_repeated_texts(docs):
    long = "é " * 700_000
    rows = [(1, long), (1, long), (2, None)]
    got = [tuple(r) for r in ogg.media_digests(docs(rows)).collect()]
    payload = ogg.payload_of(long.encode())
    assert got[0] == got[1] and got[0][1:4] == (len(long.encode()), len(payload), hashlib.sha256(payload).hexdigest())
    pages = ogg.read_pages(ogg.encode_texts(docs(rows[:2]))).groupBy("doc_id", "serial", "page_number").count().collect()
    assert {r["count"] for r in pages} == {2}
