"""WARC records in ZIP archives: written by tasks, read back by ranges without extraction.

An archive holds one stored member of WARC records, each a gzip member of its own, and one stored
member with an index line per record.  The reader finds the central directory from the end of the
file, by the ZIP64 records where there are any, takes the place of each stored member from its
local header and reads single records by their ranges.

Records of equal payload share it: that of the smallest page is a response, the others revisit it.

Defined cases: null html is an empty payload; a null url gives a record without target; a page
without id is always a response and never revisited; rows that repeat a page and its payload are
responses each; columns but ``page_id``, ``url`` and ``html`` are not archived; an empty table gives
no archive and no records; a member that is compressed inside the archive is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of the ranges that a reading task fetches at once, at most about.
RANGE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record, so that a run can be repeated.
DATE = "2024-01-01T00:00:00Z"

ARCHIVES = "path string, bytes long, records long"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, payload binary")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: the whole payload, or a revisit of the page that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
           f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:  # a field's value has no line ends
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record as the query returns them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(field: str) -> int | None:
        name = fields.get(field, "<urn:page:none>")[len("<urn:page:"):-1]
        return None if name == "none" else int(name)

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
            "record_type": kind, "payload_bytes": declared, "payload_digest": digest,
            "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


@dataclass
class Member:
    """A member of an archive: where its local header lies, its size and whether it is stored."""

    name: str
    header: int
    size: int
    stored: bool


def _extra64(extra: bytes, wanted: list[bool]) -> list[int]:
    """Values of the ZIP64 field, in the order of the fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("the ZIP64 field is missing")


def central_directory(file, size: int) -> list[Member]:
    """Members of the archive from its central directory.

    ``file`` needs ``seek`` and ``read``; only the end of the archive is read.
    """
    tail_at = max(0, size - 65_557)  # the record and the longest comment
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        file.seek(tail_at + at - 20)
        locator = file.read(20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        file.seek(struct.unpack_from("<Q", locator, 8)[0])
        end = file.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of the central directory is missing")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    file.seek(start)
    raw, at, members = file.read(length), 0, []
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, whole, name, extra, note = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        name_at = at + 46
        full = [x == 0xFFFFFFFF for x in (whole, packed, header)]
        if any(full):
            values = iter(_extra64(raw[name_at + name:name_at + name + extra], full))
            whole, packed, header = (
                next(values) if f else x for f, x in zip(full, (whole, packed, header), strict=True)
            )
        members.append(Member(
            raw[name_at:name_at + name].decode("utf-8" if flags & 0x800 else "cp437"),
            header, packed, method == 0 and packed == whole and not flags & 1,
        ))
        at = name_at + name + extra + note
    return members


def data_offset(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if not member.stored:
        raise ValueError(f"{member.name} is not stored")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


class _Archive:
    """One archive in the making; the name is new, so an attempt never writes into another's."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, name = _file_system(self.path)
        self._out = system.open_output_stream(name)
        # as a plain stream, so that sizes follow the data
        self._zip = zipfile.ZipFile(io.BufferedWriter(_Unseekable(self._out), 1 << 20), "w")
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._index: list[str] = []
        self.size = 0

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        raw = gzip.compress(warc_record(page_id, url, payload, refers_to), 6, mtime=0)
        self._index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(raw)}))
        self._data.write(raw)
        self.size += len(raw)

    def close(self) -> tuple[str, int, int]:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self._index))
        buffered = self._zip.fp
        self._zip.close()
        buffered.flush()
        total = self._out.tell()
        self._out.close()
        return self.path, total, len(self._index)


class _Unseekable(io.RawIOBase):
    def __init__(self, out):
        self._out = out

    def writable(self):
        return True

    def write(self, data):
        return self._out.write(bytes(data)) or len(data)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and the page that a revisit refers to."""
    payload = F.to_binary(F.coalesce("html", F.lit("")), F.lit("utf-8"))
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # only digests that repeat, and only ids and digests are counted
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    return joined.select(
        "page_id", "url", "payload",
        F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages below ``folder``; the result is the stored list of them.

    Only what the list names counts: archives of attempts that failed are not in it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = _file_system(folder)
        system.create_dir(name, recursive=True)
        archive, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(folder)
                archive.add(*row)
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done, strict=True)], names=["path", "bytes", "records"]
            )

    return written(with_revisits(pages, min_bytes).mapInArrow(write, ARCHIVES), "archives")


def record_places(archives: DataFrame) -> DataFrame:
    """Place and length of every record, from directory and index of each archive."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _file_system(path)
                with system.open_input_file(name) as file:
                    members = {m.name: m for m in central_directory(file, file.size())}
                    start, index = data_offset(file, members[DATA]), members[INDEX]
                    file.seek(data_offset(file, index))
                    lines = [json.loads(x) for x in file.read(index.size).splitlines()]
                if any(x["offset"] + x["length"] > members[DATA].size for x in lines):
                    raise ValueError(f"the index of {path} points beyond its data")
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(lines), pa.string()),
                    pa.array([start + x["offset"] for x in lines], pa.int64()),
                    pa.array([x["length"] for x in lines], pa.int64()),
                ], names=["path", "at", "length"])

    return archives.select("path").mapInArrow(places, "path string, at long, length long")


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that a table names by ``path``.

    Records are dealt to tasks by stretches of ``RANGE_BYTES``, so one large archive is read by many.
    """
    types = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    names = [x.split()[0] for x in types.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(),
             "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, file, opened = [], 0, None, None
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if file:
                        file.close()
                    system, name = _file_system(path)
                    file, opened = system.open_input_file(name), path
                record = parse_record(zlib.decompress(file.read_at(length, at), 31))
                found.append([record[n] for n in names])
                size += length
                if size >= RANGE_BYTES:
                    yield _batch(found, names, kinds)
                    found, size = [], 0
            if file:
                file.close()
            if found:
                yield _batch(found, names, kinds)

    # with a number, since adaptive execution would put these few bytes into one task
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = record_places(archives).repartition(
        tasks, F.col("path"), F.floor(F.col("at") / RANGE_BYTES)
    ).sortWithinPartitions("path", "at")
    return places.mapInArrow(read, types)


def _batch(rows: list, names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names, strict=True)],
        names=names,
    )


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every page through the archives in the shared folder and back, without payloads."""
    spark: SparkSession = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), min_bytes)
    return read_records(archives, with_payload=False)
