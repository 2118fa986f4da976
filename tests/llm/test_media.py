import hashlib
import random
import struct
import zlib

import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from versara.llm import media
from versara.llm.common import table


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1 & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert media.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [64, 255, 510, 4096, 65025, 65025 * 2 + 7, 400_000])
@pytest.mark.parametrize("packet", [255, 4096, 100_000])
def test_round_trip_and_page_sizes(size, packet):
    payload = random.Random(size).randbytes(size)
    data = media.write_payload(payload, packet_bytes=packet)
    back, feature = media.read_payload(data)
    assert back == payload and f"seconds={size / 8000:.6f}" in feature and "streams=2" in feature
    streams = media.demultiplex(data)
    assert [len(p) for p in streams[1].packets[1:]] == [min(packet, size - i) for i in range(0, size, packet)]
    times = media.timestamps(streams[1], 8000)
    assert times == sorted(times) and times[-1] == (size / 8000, len(streams[1].packets))


def test_every_damage_is_found():
    data = media.write_payload(random.Random(2).randbytes(3000))
    for i in range(0, len(data), 7):
        with pytest.raises(media.BadMedia):
            media.demultiplex(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    for i in (1, 100, len(data) - 1):
        with pytest.raises(media.BadMedia):
            media.demultiplex(data[:i])
    pages = data.split(b"OggS")[1:]
    with pytest.raises(media.BadMedia):  # a page is missing
        media.demultiplex(b"".join(b"OggS" + p for p in pages[:2] + pages[3:]))


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = media.op4_media(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64)
        payload = payload or b"\0" * 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.write_payload(payload)).hexdigest() and r.media_bytes == len(media.write_payload(payload)) and r.error is None


def test_awkward_rows(spark):
    docs = awkward(spark)
    stored = media.to_media(docs)
    rows = media.from_media(stored).collect()
    assert len(rows) == docs.count() and all(r.error is None for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[3].payload_bytes == 64 and by[3].media_sha256 == by[4].media_sha256
    assert by[1].feature == by[2].feature
    broken = stored.withColumn("media", F.when(F.col("doc_id") == 8, F.expr("cast('nothing' as binary)")).when(F.col("doc_id") == 1, None).otherwise(F.col("media")))
    bad = {r.doc_id: r for r in media.from_media(broken).collect()}
    assert bad[8].error and bad[8].payload_sha256 is None and bad[1].error and bad[6].error is None
    assert media.from_media(media.to_media(empty(spark))).collect() == []
    assert struct.calcsize("<4sBBqIIIB") == 27
