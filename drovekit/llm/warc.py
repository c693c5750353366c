"""WARC records in ZIP packages: written by tasks, then range-read without extraction.

A package holds stored (not deflated) members: ``archive/N.warc.gz``, WARC/1.1 records in one gzip
member each, and ``indexes/N.cdxj``, a line for each record with its place in that archive member.
The reader finds the central directory from the file's end, by the ZIP64 records if there are any,
takes each member's place from it and the local header, and fetches single records by range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, measured, new_path
from .files import Ranges, put

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive member; a larger record is alone in one.
MEMBER = 16 << 20
_BIG = 0xFFFFFFFF


def digest(payload: bytes) -> str:
    """Bare base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page_id (64 bits), and whether there is one."""
    x = (page_id or 0) & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(page_id is None) << 80 | 8 << 76 | (x >> 62) << 64 | 2 << 62 | x & (1 << 62) - 1)}>"


def page_of(record: str) -> int | None:
    i = uuid.UUID(record.strip("<>")).int
    x = (i >> 64 & 3) << 62 | i & (1 << 62) - 1
    return None if i >> 80 else x - (1 << 64) * (x >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP headers of its payload, without the payload."""
    def uri(u, p):
        return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u) if u else f"urn:page:{p}"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", uri(refers_url, refers_to)), ("WARC-Refers-To-Date", DATE)]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record, names in lower case; checks lengths and digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(warc["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or f"sha1:{digest(block)}" != warc["warc-block-digest"]:
        raise ValueError(f"record {warc['warc-record-id']} is damaged")
    status, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in status.decode().split("\r\n")[1:])}
    if warc["warc-type"] == "response" and f"sha1:{digest(payload)}" != warc["warc-payload-digest"]:
        raise ValueError(f"record {warc['warc-record-id']} has another payload than its digest says")
    return warc, http, payload


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class ZipWriter:
    """Stored members and a central directory; ZIP64 fields where a number needs them, or always."""

    def __init__(self, zip64: bool = False):
        self.at, self.entries, self.always = 0, [], zip64

    def member(self, name: str, data: bytes) -> Iterator[bytes]:
        crc, n, raw = zlib.crc32(data), len(data), name.encode()
        large = self.always or n >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, n, n) if large else b""
        shown = _BIG if large else n
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra
        self.entries.append((raw, crc, n, self.at))
        self.at += len(head) + n
        yield head
        yield data

    def finish(self) -> Iterator[bytes]:
        start, size = self.at, 0
        for raw, crc, n, at in self.entries:
            large = [self.always or x >= _BIG for x in (n, n, at)]
            fields = [x for x, big in zip((n, n, at), large, strict=True) if big]
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            shown = [_BIG if big else x for x, big in zip((n, n, at), large, strict=True)]
            entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, shown[0], shown[1], len(raw), len(extra), 0, 0, 0, 0, shown[2]) + raw + extra
            size += len(entry)
            yield entry
        count = len(self.entries)
        if self.always or count >= 0xFFFF or size >= _BIG or start >= _BIG:
            yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start)
            yield struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
            yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0)
        else:
            yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(ranges: Ranges, file: str) -> list[Member]:
    """Members of a ZIP file, from its central directory."""
    total = ranges.size(file)
    tail = ranges.read(file, max(0, total - 65557), min(total, 65557))
    k = len(tail) - 22
    while k >= 0 and not (tail[k : k + 4] == b"PK\5\6" and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
        k = tail.rfind(b"PK\5\6", 0, k + 3)
    if k < 0:
        raise ValueError(f"{file} has no end of a central directory")
    _, _, _, _, count, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, k)
    if count == 0xFFFF or size == _BIG or start == _BIG:
        end = total - len(tail) + k
        if end >= 20 and (locator := ranges.read(file, end - 20, 20))[:4] == b"PK\6\7":
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = ranges.read(file, where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError(f"{file} has a damaged ZIP64 directory")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = ranges.read(file, start, size), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError(f"{file} has a damaged central directory")
        method, stored, n, name, extra, comment, header = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20), *struct.unpack_from("<I", raw, at + 42)
        more, k = raw[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(more):
            kind, length = struct.unpack_from("<HH", more, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{length // 8}Q", more, k + 4))
                n = next(values) if n == _BIG else n
                stored = next(values) if stored == _BIG else stored
                header = next(values) if header == _BIG else header
            k += 4 + length
        out.append(Member(raw[at + 46 : at + 46 + name].decode(), method, stored, header))
        at += 46 + name + extra + comment
    return out


def data_start(ranges: Ranges, file: str, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} in {file} isn't stored")
    head = ranges.read(file, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} in {file} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def write_packages(pages: DataFrame, path: str, *, least_bytes: int = 0, member: int = MEMBER, zip64: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) as packages under ``path``; (file, records) of each.

    Payloads of at least ``least_bytes`` bytes that are equal (by SHA-256) have one response, the
    smallest page_id; rows that repeat that page_id are each a response. A file's name has the
    attempt in it and only a finished attempt's name is returned.
    """
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha2("html", 256)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    several = cut(pages.filter(F.octet_length("html") >= least_bytes).groupBy(key.alias("sha")).agg(first, F.count("*").alias("n")).filter("n > 1").select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "payloads")

    def run(batches):
        where, out = TaskContext.get(), ZipWriter(zip64)
        name, count, held, lines = f"{path}/pages-{where.partitionId():06d}-{where.taskAttemptId()}.zip", 0, bytearray(), []

        def flush():
            n = len(out.entries) // 2
            yield from out.member(f"archive/{n:06d}.warc.gz", bytes(held))
            yield from out.member(f"indexes/{n:06d}.cdxj", "".join(lines).encode())
            held.clear()
            lines.clear()

        def parts():
            nonlocal count
            for batch in batches:
                for page_id, url, html, sha, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "refers_to", "refers_url")), strict=True):
                    revisit = sha is not None and page_id != refers_to
                    payload = html.encode("utf-8", "surrogatepass")
                    raw = packed(record(page_id, url, payload, refers_to, refers_url, revisit))
                    if held and len(held) + len(raw) > member:
                        yield from flush()
                    lines.append(f"{page_id} 20240101000000 " + json.dumps({"url": url, "digest": digest(payload), "offset": len(held), "length": len(raw), "mime": "warc/revisit" if revisit else "text/html"}) + "\n")
                    held.extend(raw)
                    count += 1
            if held:
                yield from flush()
            yield from out.finish()

        put(name, parts())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], schema=schema)

    marked = pages.withColumn("_sha", key).join(measured(several), F.col("_sha") == F.col("sha"), "left").drop("_sha")
    return cut(marked.mapInArrow(run, "file string, records long").filter("records > 0"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the packages."""
    spark = packages.sparkSession
    listed = pa.schema([("file", pa.string()), ("archive", pa.int64()), ("index", pa.int64()), ("index_bytes", pa.int64())])
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def members(batches):
        for batch in batches:
            ranges, rows = Ranges(1 << 16), []
            for file in batch.column("file").to_pylist():
                found = {m.name: m for m in directory(ranges, file)}
                for name, m in found.items():
                    if name.startswith("archive/"):
                        index = found[f"indexes/{name[8:-8]}.cdxj"]
                        rows.append((file, data_start(ranges, file, m), data_start(ranges, file, index), index.size))
            ranges.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), listed, strict=True)], schema=listed)

    def records(batches):
        ranges, indexes = Ranges(), Ranges(0)
        for batch in batches:
            for file, archive, index, n in zip(*(batch.column(c).to_pylist() for c in listed.names), strict=True):
                rows = []
                for line in indexes.read(file, index, n).decode().splitlines():
                    entry = json.loads(line.split(" ", 2)[2])
                    warc, http, payload = parse(zlib.decompress(ranges.read(file, archive + entry["offset"], entry["length"]), 31))
                    revisit = warc["warc-type"] == "revisit"
                    rows.append((page_of(warc["warc-record-id"]), int(http["content-length"]) if revisit else len(payload), warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], page_of(warc["warc-refers-to"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        ranges.close()
        indexes.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = packages.select("file").repartition(n).mapInArrow(members, "file string, archive long, index long, index_bytes long")
    return found.repartition(n).mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, and read all records back.

    A null html is an empty payload, a null url is written as the page's URN, and a null page_id is
    read back as null (it comes after all others as the response of a payload). Repeated rows are
    records of their own. Other columns don't matter; an empty table gives an empty result.
    """
    return read_packages(write_packages(pages, new_path(pages.sparkSession, "warc"), least_bytes=least_bytes))
