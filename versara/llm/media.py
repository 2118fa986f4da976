"""Ogg media columns: writing payloads as pages, and reading pages back with every check."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table

#: Fixed values of the container (RFC 3533) and of the raw PCM mapping.
CAPTURE, VERSION = b"OggS", 0
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
PCM_MAGIC, PCM_UNSIGNED_8 = b"PCM     ", 1
NOTE_MAGIC = b"NOTES   "
HEADER = struct.Struct("<4sBBqIIIB")

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and final value 0. zlib computes
    the same polynomial from the other end, so bytes go in and the result comes out with bits reversed."""
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, VERSION, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def paginate(serial: int, packets: list[tuple[bytes, int]], segments: int = 255):
    """The pages of one logical stream from (packet, granule position at its end). The first packet has a
    page of its own; a packet that crosses pages is continued; a page's granule position is that of the
    last packet that ends on it, -1 if none does."""
    number, flags = 0, FIRST
    lacing, body, granule = bytearray(), bytearray(), NO_GRANULE
    pages = []

    def flush(next_flags: int) -> None:
        nonlocal number, flags, granule
        pages.append((serial, number, flags, granule, bytes(lacing), bytes(body)))
        number, flags, granule = number + 1, next_flags, NO_GRANULE
        lacing.clear()
        body.clear()

    for i, (packet, position) in enumerate(packets):
        at = 0
        while True:
            if len(lacing) == segments:
                flush(CONTINUED if at else 0)
            size = min(255, len(packet) - at)
            # whole segments of 255 at once
            run = min((len(packet) - at) // 255, segments - len(lacing))
            if run:
                lacing += b"\xff" * run
                body += packet[at : at + 255 * run]
                at += 255 * run
                continue
            lacing.append(size)
            body += packet[at:]
            granule = position
            break
        if i == 0:
            flush(0)
    if lacing or number == 1:
        flush(0)
    last = pages[-1]
    pages[-1] = (*last[:2], last[2] | LAST, *last[3:])
    return [make_page(*p) for p in pages]


def write_payload(payload: bytes, *, rate: int = 8000, packet_bytes: int = 4096, serial: int = 1) -> bytes:
    """Two logical streams, interleaved: the payload as 8-bit mono samples, and a stream of notes that holds
    the payload's length, so that readers have to demultiplex."""
    head = PCM_MAGIC + struct.pack(">HHIIBBII", 0, 0, PCM_UNSIGNED_8, rate, 8, 1, packet_bytes, 0)
    sound = [(head, 0)]
    for at in range(0, len(payload), packet_bytes):
        part = payload[at : at + packet_bytes]
        sound.append((part, at + len(part)))
    notes = [(NOTE_MAGIC, 0), (struct.pack("<Q", len(payload)), len(payload))]
    a, b = paginate(serial, sound), paginate(serial + 1, notes)
    return b"".join([a[0], b[0], *(p for pair in zip(a[1:], [*b[1:], *[b""] * len(a)]) for p in pair), *b[len(a) :]])


class BadMedia(ValueError):
    """What the bytes break: capture pattern, version, checksum, page order, continuation or length."""


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets that ended by then), one for each page that ends a packet.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] | None = None


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams of a physical one, by serial number, with packets put together from the lacing
    values. Raises BadMedia if a page's checksum, number, flags or length is wrong."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise BadMedia("the last page has no whole header")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version != VERSION:
            raise BadMedia(f"no page at byte {at}")
        start = at + 27 + count
        lacing = data[at + 27 : start]
        end = start + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise BadMedia("the last page is cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise BadMedia(f"checksum of page {number} of stream {serial}")
        if bool(flags & FIRST) == (serial in streams):
            raise BadMedia(f"stream {serial} begins at page {number}")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended:
            raise BadMedia(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise BadMedia(f"continuation at page {number} of stream {serial}")
        s.pages, s.ended = number + 1, bool(flags & LAST)
        place, before = start, len(s.packets)
        i = 0
        while i < count:
            j = lacing.find(b"\xff", i)
            if j != i:  # a packet that ends in this segment
                size, i, done = lacing[i], i + 1, True
            else:
                run = len(lacing[i:]) - len(lacing[i:].lstrip(b"\xff"))
                done = i + run < count
                size = 255 * run + (lacing[i + run] if done else 0)
                i += run + done
            s.partial = [*(s.partial or []), data[place : place + size]]
            place += size
            if done:
                s.packets.append(b"".join(s.partial))
                s.partial = None
        if (granule == NO_GRANULE) != (len(s.packets) == before):
            raise BadMedia(f"granule position of page {number} of stream {serial}")
        if granule != NO_GRANULE:
            if s.marks and granule < s.marks[-1][0]:
                raise BadMedia(f"granule positions of stream {serial} fall")
            s.marks.append((granule, len(s.packets)))
        at = end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise BadMedia("a stream has no end")
    return streams


def timestamps(s: Stream, rate: int) -> list[tuple[float, int]]:
    """(seconds at its end, packets so far) of each page on which a packet ends."""
    return [(granule / rate, packets) for granule, packets in s.marks]


def read_payload(data: bytes) -> tuple[bytes, str]:
    """The samples, and features: streams, pages, packets, sample rate, duration in seconds, and mean and
    mean step of the samples."""
    streams = demultiplex(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)), None)
    if sound is None:
        raise BadMedia("no stream of samples")
    _, _, kind, rate, bits, channels, _, _ = struct.unpack(">HHIIBBII", sound.packets[0][8:30])
    if (kind, bits, channels) != (PCM_UNSIGNED_8, 8, 1):
        raise BadMedia("samples are not 8-bit mono")
    payload = b"".join(sound.packets[1:])
    times = timestamps(sound, rate)
    if sound.marks[-1][0] != len(payload):
        raise BadMedia("the last granule position is not the number of samples")
    notes = next((s for s in streams.values() if s.packets and s.packets[0].startswith(NOTE_MAGIC)), None)
    if notes is not None and struct.unpack("<Q", notes.packets[1])[0] != len(payload):
        raise BadMedia("the notes name another length")
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / max(1, len(x))
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / max(1, len(x) - 1)
    return payload, f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(sound.packets) - 1};rate={rate};seconds={times[-1][0]:.6f};mean={mean:.4f};step={step:.4f}"


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with zeros up to a positive multiple of 64, and how many bytes it had."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)


def _written(batches, options: dict):
    for batch in small_batches(batches):
        rows = [(write_payload((p := padded(t))[0], **options), p[1]) for t in batch.column(1).to_pylist()]
        media, sizes = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in small_batches(batches):
        rows = []
        for doc, size, data in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                payload, feature = read_payload(data or b"")
                got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                error = None
            except BadMedia as e:
                got, feature, error = (None, None, None), None, str(e)
            rows.append((doc, size, *got, len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature, error))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text as a physical stream. Null text is taken as empty, and empty
    text as 64 zeros; very long texts span many pages of the stream. Null ids stay null. Repeated rows come back as
    often; other columns are ignored, whatever their names; an empty table gives no rows. ``options`` are those of
    write_payload."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _written(it, options), "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads ``(doc_id, n_bytes, media)`` back: digests and features of the payload. Bytes that break a
    check give null values and the reason in ``error``; no row is lost."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(table(spark, sf_dir, "documents")))
