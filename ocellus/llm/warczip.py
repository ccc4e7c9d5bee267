"""WARC records in ZIP-packaged archives: written as stored members with an index, read by ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import read_table, stored

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdx"
REVISIT_LEAST = 1000
ARCHIVE_BYTES = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Range = Callable[[int, int], bytes]


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + "".join((url or "").splitlines()),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(rows: list[tuple[int | None, str | None, bytes, str, int | None]]) -> bytes:
    """A ZIP with one WARC member, stored with ZIP64 fields, and an index of its records' ranges."""
    out, index, at = io.BytesIO(), [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as f:
            for row in rows:
                record = _record(*row)
                f.write(record)
                index.append(f"{at} {len(record)} {row[3]}\n")
                at += len(record)
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(index))
    return out.getvalue()


def members(read: Range, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, size) of each stored member, from the central directory alone.

    Follows the ZIP64 locator where the end record's fields are full, and ZIP64 extra fields where an
    entry's are. Compressed or encrypted members raise ValueError, as they have no ranges to read.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6", 0, len(tail) - 18)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name]
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                k1 = k + 4
                if full == 0xFFFFFFFF:
                    full, k1 = struct.unpack_from("<Q", extra, k1)[0], k1 + 8
                if packed == 0xFFFFFFFF:
                    packed, k1 = struct.unpack_from("<Q", extra, k1)[0], k1 + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, k1)[0]
            k += 4 + n
        if method or flags & 1 or packed != full:
            raise ValueError(f"{name!r} is not stored")
        header = read(local, 30)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"{name!r}: no local header")
        found[name.decode("utf-8" if flags & 0x800 else "cp437")] = (local + 30 + sum(struct.unpack_from("<HH", header, 26)), full)
        at += 46 + n_name + n_extra + n_comment
    return found


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return fields, block


def _page(urn: str) -> int | None:
    urn = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(urn) if urn else None


def read_records(read: Range, size: int) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each indexed record.

    The index member gives each record's range in the WARC member; nothing else is read. A
    response's payload must have the digest in its header.
    """
    found = members(read, size)
    base, length = found[WARC_MEMBER]
    at, n = found[INDEX_MEMBER]
    for line in read(at, n).decode().splitlines():
        offset, n, sha1 = line.split(" ")
        if int(offset) + int(n) > length:
            raise ValueError("index points outside the member")
        fields, block = parse_record(read(base + int(offset), int(n)))
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size_ = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if fields["warc-type"] == "response":
            if (hashlib.sha1(payload).hexdigest(), len(payload), sha1) != (digest, size_, digest):
                raise ValueError("wrong payload digest")
        yield _page(fields["warc-record-id"]), size_, digest, fields["warc-type"], _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, fields["warc-target-uri"]


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pack pages (page_id, url, html) into archives: a stored table with one ZIP in each row.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes the largest page_id is the
    response and others revisit it; rows that repeat that id are responses too, and so is a row
    without id unless another row has its payload. The digests decide this in a table of their own,
    aggregated map-side, of which only payloads that occur again take part in the join; a hot payload
    is one row there, and its pages are split by the adaptive skew join.
    Archives have about ``archive_bytes`` each and are cut from the pages' partitions as they stream by.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    kept = own.filter(F.col("n") >= REVISIT_LEAST).groupBy("sha1", "n").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("sha1", "n", "kept")
    typed = own.join(kept, ["sha1", "n"], "left")
    typed = typed.select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for page_id, url, html, sha1, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), b.column(3).to_pylist(), b.column(4).to_pylist()):
                html = html.as_py()
                rows.append((page_id, url, html, sha1, refers_to))
                size += 600 + (len(html) if refers_to is None else 0)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([write_archive(rows)], pa.binary())], ["n_records", "archive"])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([write_archive(rows)], pa.binary())], ["n_records", "archive"])

    return stored(typed.mapInArrow(run, "n_records long, archive binary"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of ZIP archives (column ``archive``), each read by its range."""

    def run(batches):
        for b in batches:
            for a in b.column(0):
                view = memoryview(a.as_buffer())
                rows = list(zip(*read_records(lambda at, n, v=view: bytes(v[at : at + n]), len(view)))) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"))).drop("url")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""
