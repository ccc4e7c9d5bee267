"""Media columns in the Ogg container: pages with checksums, lacing, multiplexed streams, granule times."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import read_table, small_batches

UNIT, PACKET, RATE, STREAMS = 192, 3840, 8000, 2
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIBBq")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(data: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, no initial or final inversion.

    It is the bit-reversed form of zlib's CRC, which runs in C; bytes are reversed by a table.
    """
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _raw_page(lacing: bytes, body: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    page = bytearray(_HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    struct.pack_into("<I", page, 22, page_checksum(page))
    return bytes(page)


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream from (packet, granule at its end); packets may span pages.

    Returns (granule by which the page is ordered among streams, page). The first packet, the
    stream's identification, has a page of its own.
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, flags, done, last = bytearray(), bytearray(), 2, -1, 0

    def close(next_flags: int, end: bool = False) -> None:
        nonlocal lacing, body, flags, done
        out.append((last, _raw_page(bytes(lacing), bytes(body), flags | (4 if end else 0), done, serial, len(out))))
        lacing, body, flags, done = bytearray(), bytearray(), next_flags, -1

    for k, (packet, granule) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = used = 0
        while used < len(values):
            if len(lacing) == 255:
                close(1 if used else 0)
            take = values[used : used + 255 - len(lacing)]
            size = sum(take)
            lacing += take
            body += packet[at : at + size]
            at, used = at + size, used + len(take)
        done = last = granule
        if k == 0 and len(packets) > 1:
            close(0)
    close(0, True)
    return out


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    """8-bit samples as an Ogg file: packets of samples dealt in turn to ``streams`` logical streams.

    Serial numbers come from the content, so equal payloads give equal files. A stream's granule is
    the number of its own samples up to the end of the last packet that ends on the page.
    """
    base = zlib.crc32(payload)
    pages = []
    for s in range(streams):
        serial, at, granule = (base + s * 0x9E3779B1) & 0xFFFFFFFF, s * packet, 0
        own = [(_IDENT.pack(b"\x01samples", rate, s, streams, len(payload)), 0)]
        while at < len(payload):
            part = payload[at : at + packet]
            granule += len(part)
            own.append((part, granule))
            at += packet * streams
        pages += [(0 if n == 0 else 1, granule, s, n, page) for n, (granule, page) in enumerate(paginate(own, serial))]
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:-1]))


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; ValueError if a page is damaged."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise ValueError(f"page at byte {at} is cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at}: wrong checksum")
        yield flags, granule, serial, number, lacing, data[at + 27 + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Per logical stream its packets, each with the granule of the page on which it ends, or -1.

    Only the last packet that ends on a page owns the page's granule.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, lacing, body in pages(data):
        if bool(flags & 2) == (serial in streams) or serial in ended or number != numbers.get(serial, 0):
            raise ValueError(f"stream {serial}: page {number} is out of order")
        if bool(flags & 1) != (serial in open_):
            raise ValueError(f"stream {serial}: page {number} breaks a packet")
        numbers[serial] = number + 1
        packets, part, at = streams.setdefault(serial, []), open_.pop(serial, None), 0
        first, size = len(packets), 0
        for value in lacing:
            size += value
            if value < 255:
                whole = body[at : at + size]
                packets.append((bytes(part) + whole if part is not None else whole, -1))
                part, at, size = None, at + size, 0
        if lacing and lacing[-1] == 255:
            open_[serial] = (part if part is not None else bytearray()) + body[at : at + size]
        if len(packets) > first:
            packets[-1] = (packets[-1][0], granule)
        if flags & 4:
            ended.add(serial)
    if open_ or ended != set(streams):
        raise ValueError("a stream has no end")
    return streams


def decode(data: bytes) -> tuple[bytes, float, list[tuple[int, int, float, float]]]:
    """The samples, their duration in seconds, and (stream, packet, start, end) times of all packets in order.

    Times go back from each page's granule over the packets that end before it on the page, and are those
    of the packet's own stream; the duration is the sum of the streams' last granules over the rate.
    """
    parts: list[tuple[int, int, bytes]] = []
    times: list[tuple[int, int, float, float]] = []
    total = rate = 0
    for packets in demultiplex(data).values():
        magic, rate, s, n, total = _IDENT.unpack(packets[0][0])
        if magic != b"\x01samples":
            raise ValueError("unknown codec")
        ends = [g for _, g in packets]
        for k in range(len(packets) - 2, 0, -1):
            if ends[k] < 0:
                ends[k] = ends[k + 1] - len(packets[k + 1][0])
        for k, (p, _) in enumerate(packets[1:]):
            start = ends[k + 1] - len(p)
            if start != (ends[k] if k else 0):
                raise ValueError(f"stream {s}: granules have a gap")
            parts.append((k, s, p))
            times.append((s, k, start / rate, ends[k + 1] / rate))
    payload = b"".join(p for _, _, p in sorted(parts, key=lambda x: x[:2]))
    if len(payload) != total:
        raise ValueError(f"{len(payload)} of {total} samples")
    last: dict[int, float] = {}
    for s, _, _, end in times:
        last[s] = max(last.get(s, 0.0), end)
    return payload, sum(last[s] for s in sorted(last)), sorted(times)


def features(payload: bytes, duration: float) -> str:
    """Duration, mean, root mean square about 128, and entropy in bits, from the samples' histogram."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    x, n = np.arange(256) - 128, max(1, len(payload))
    p = counts[counts > 0] / n
    return f"s={duration:.6f} mean={int(counts @ x) / n:.6f} rms={(int(counts @ (x * x)) / n) ** 0.5:.6f} bits={float(-(p * np.log2(p)).sum()):.6f}"


def to_payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded by spaces to a positive multiple of 192, as Ogg.

    Null and empty texts give one unit of spaces. Rows are kept one to one, repeated and null ids too.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            rows = [(t.as_py() or b"") if t.is_valid else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in rows], pa.int64()), pa.array([encode(to_payload(t)) for t in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """Read Ogg bytes back: (doc_id, n_bytes, payload digests, media digests, feature, packets).

    Every page's checksum is verified; a damaged file fails the task. ``packets`` has the stream, number
    and times, in seconds, of each packet, as its granules say; the feature's duration comes from them too.
    """
    packets = pa.list_(pa.struct([("stream", pa.int32()), ("packet", pa.int32()), ("start", pa.float64()), ("stop", pa.float64())]))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets array<struct<stream:int,packet:int,start:double,stop:double>>"

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for m in b.column(2):
                data = m.as_py()
                payload, duration, times = decode(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, duration), [dict(zip(("stream", "packet", "start", "stop"), t)) for t in times]))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), packets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(encode_column(read_table(spark, sf_dir, "documents")))
