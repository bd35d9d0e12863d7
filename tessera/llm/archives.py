"""Web archives: a converter from the legacy ARC format to WARC.

Pages are written as ARC files of both versions, as crawlers left them.  The
converter reads an archive's version block, takes the fields of each header line
from the definition there, bodies by their declared lengths, and synthesises the WARC
record that says the same: identifier, timestamp, type, target, digests.  Payloads that an
earlier page already has become ``revisit`` records that refer to it.

* ``write_arc``: rows to archives (gzip, one member a record).
* ``scan_arc``: archives to a narrow index, one row a record.
* ``repeated``: which records say again what a page with a smaller id has said.
* ``convert``: each ARC file to one WARC file, record by record.
* ``read_warc``: WARC files to rows; block and payload digests are recomputed and compared.

Archives lie in the shared work folder under names that each task attempt makes
up; only what a finished attempt has listed is read, so lost executors and
repeated tasks leave nothing behind that counts.  A file ends after ``ROLL_BYTES``
or ``ROLL_RECORDS``; a task holds one record and the file's repeated records,
never a file.  Files are opened through pyarrow's file systems, so the folder
may be any that these reach (local, hdfs, s3, gs).

Results for odd input: null html is an empty payload; a null or empty url is
written as ``-``, spaces and control characters in one as percent codes; null ids
come last, so they refer to others first; rows with equal ids and payloads are
records of their own, of which one is the response; texts of any length are
kept whole; an empty table gives no rows; other columns are ignored, whatever their names.  A cut archive gives
its last record as far as it goes (``WARC-Truncated``), a broken header line raises with its place.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, released, shared_folder, written

ROLL_BYTES, ROLL_RECORDS = 64 << 20, 20_000
#: Time of capture of pages that carry none.
CAPTURED = "20240101000000"
#: Fixed values of the formats: field names of header lines by version, and the profile of records that repeat a payload.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Member(io.BytesIO):
    """One record's bytes, compressed as a gzip member of its own when it is taken."""

    def packed(self) -> bytes:
        return gzip.compress(self.getvalue(), compresslevel=1, mtime=0)


@contextlib.contextmanager
def _opened(path: str, mode: str) -> Iterator[BinaryIO]:
    system, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at, compression=None) as out:
            yield out
    else:
        with system.open_input_stream(at, compression=None) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
        with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
            yield io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else io.BufferedReader(raw, 1 << 20)


# --- ARC, written ------------------------------------------------------------------------------


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def arc_line(version: str, url: str, kind: str, offset: int, name: str, length: int) -> bytes:
    """A header line with the fields of its version."""
    told = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
    return " ".join(told[f] for f in FIELDS[version].split()).encode() + b"\n"


class _ArcFile:
    """An archive that a task is writing."""

    def __init__(self, folder: str, version: str):
        self.version, self.name = version, f"{uuid.uuid4().hex}.arc.gz"
        self.path = f"{folder}/{self.name}"
        self.records = self.raw = self.at = 0
        self.open = contextlib.ExitStack()
        self.out = self.open.enter_context(_opened(self.path, "w"))
        self.add(f"filedesc://{self.name}", "text/plain", f"{version} 0 tessera\n{FIELDS[version]}\n\n".encode())
        self.records = 0

    def add(self, url: str, kind: str, body: bytes) -> None:
        record = _Member()
        record.write(arc_line(self.version, url, kind, self.at, self.name, len(body)))
        record.write(body)
        record.write(b"\n")
        packed = record.packed()
        self.out.write(packed)
        self.at, self.raw, self.records = self.at + len(packed), self.raw + len(body), self.records + 1

    def full(self) -> bool:
        return self.raw >= ROLL_BYTES or self.records >= ROLL_RECORDS

    def close(self) -> tuple[str, int]:
        self.open.close()
        return self.path, self.records


def write_arc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of both versions with one record a row; the list (archive, records) of what was written."""
    folder, types = shared_folder(pages.sparkSession, "arc"), [pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, _ArcFile] = {}
        closed: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = "12"[zlib.crc32(str(page_id).encode()) % 2]
                if version not in files:
                    files[version] = _ArcFile(folder, version)
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += "" if page_id is None else f"{PAGE_FIELD}: {page_id}\r\n"
                files[version].add(_url(url), "text/html", head.encode() + b"\r\n" + payload)
                if files[version].full():
                    closed.append(files.pop(version).close())
        closed += [f.close() for f in files.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed, strict=True) if closed else ([], []), types, strict=True)], names=["archive", "records"])

    out = written(pages.select(id_col, url_col, html_col).mapInArrow(run, "archive string, records long"), "arc-list")
    out.folder = folder
    return out


# --- ARC, read ---------------------------------------------------------------------------------


def arc_records(stream: BinaryIO, archive: str) -> Iterator[dict]:
    """Records of a legacy archive: fields as the version block names them, ``number``, ``body``, ``whole``."""
    fields, version, number = FIELDS["1"].split(), None, 0
    while line := stream.readline():
        text = line.decode("utf-8", "replace").strip("\r\n")
        if not text:
            continue
        if version is None and number == 0:  # the version block's own line already has its version's fields
            fields = FIELDS["2" if len(text.split(" ")) >= len(FIELDS["2"].split()) else "1"].split()
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"{archive}: record {number} has no header line of {len(fields)} fields: {text[:200]!r}")
        record = dict(zip(fields, values, strict=True)) | {"number": number}
        length = int(record["Archive-length"])
        body = stream.read(length)
        if record["URL"].startswith("filedesc:") and number == 0:
            lines = body.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else "1"
            if len(lines) > 1 and lines[1].startswith("URL"):
                fields = lines[1].split()
        yield record | {"body": body, "whole": len(body) == length}
        number += 1


def http_parts(body: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (lower case) and the payload's start, where the body is an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None
    ends = [m.end() for m in [re.search(rb"\r?\n\r?\n", body)] if m]
    start = ends[0] if ends else len(body)
    pairs = (line.partition(":") for line in body[:start].decode("utf-8", "replace").splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}, start


def record_id(archive: str, number: int) -> str:
    """The identifier that a legacy record gets: the same whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def warc_date(date: str) -> str | None:
    """``20240131235959`` or its first parts as a WARC timestamp."""
    digits = date + "00000101000000"[len(date) :]
    try:
        return datetime.strptime(digits[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def _spread(files: DataFrame, count: int) -> DataFrame:
    """One archive a task, as far as 10,000 tasks go."""
    return files.repartition(max(1, min(count, 10_000)))


def scan_arc(files: DataFrame) -> DataFrame:
    """(archive, number, page_id, url, date, payload_bytes, payload_digest) of every HTTP record."""

    def rows(archives: list[str]) -> Iterator[tuple]:
        for archive in archives:
            with _opened(archive, "r") as stream:
                for r in arc_records(stream, archive):
                    if parts := http_parts(r["body"]):
                        payload, page = memoryview(r["body"])[parts[1] :], parts[0].get(PAGE_FIELD.lower())
                        yield archive, r["number"], int(page) if page else None, r["URL"], r["Archive-date"], len(payload), base32_sha1(payload)

    names = ["archive", "number", "page_id", "url", "date", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "archive string, number long, page_id long, url string, date string, payload_bytes long, payload_digest string"
    return map_rows(_spread(files, files.count()), ["archive"], rows, schema, names, types)


# --- conversion --------------------------------------------------------------------------------


def repeated(index: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Records whose payload another record with a smaller page id has, with that record.

    The first records are written, so both sides of the join are exchanges that Spark can split where
    a payload holds many rows; their minimum is taken before the shuffle.
    """
    asked = index.filter(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "number", "url", "date")
    firsts = written(asked.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "firsts")
    again = asked.select("archive", "number", "payload_digest").join(firsts, "payload_digest")
    other = (F.col("archive") != F.col("first.archive")) | (F.col("number") != F.col("first.number"))
    return again.filter(other).select("archive", "number", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("archive", "number", "page_id", "url", "date")))


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    record = _Member()
    record.write("\r\n".join(lines).encode() + b"\r\n\r\n")
    record.write(block)
    record.write(b"\r\n\r\n")
    return record.packed()


def synthesised(record: dict, archive: str, first: tuple | None, info_id: str | None, fallback: str | None) -> bytes:
    """The WARC record that says what a legacy record says; ``first`` is the record whose payload it repeats."""
    body, url, number = record["body"], record["URL"], record["number"]
    date = warc_date(record["Archive-date"]) or fallback or warc_date(CAPTURED)
    common = [("WARC-Record-ID", record_id(archive, number)), ("WARC-Date", date), ("WARC-Truncated", None if record["whole"] else "length")]
    if url.startswith("filedesc:"):
        told = f"software: tessera\r\nformat: WARC File Format 1.1\r\ndescription: from {url.removeprefix('filedesc://')}\r\n"
        return warc_record([("WARC-Type", "warcinfo"), *common, ("Content-Type", "application/warc-fields")], told.encode())
    common += [("WARC-Warcinfo-ID", info_id), ("WARC-Target-URI", None if url == "-" else url), ("WARC-IP-Address", None if record["IP-address"] == "0.0.0.0" else record["IP-address"])]
    parts = http_parts(body)
    if parts is None:
        return warc_record([("WARC-Type", "resource"), *common, ("Content-Type", record["Content-type"]), ("WARC-Payload-Digest", f"sha1:{base32_sha1(body)}")], body)
    kind = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(memoryview(body)[parts[1] :])}")]
    if first is None:
        return warc_record([("WARC-Type", "response"), *common, *kind], body)
    at, place, page, target, day = first
    refers = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(at, place)), ("WARC-Refers-To-Target-URI", None if target == "-" else target), ("WARC-Refers-To-Date", warc_date(day)), (REFERS_FIELD, None if page is None else str(page))]
    return warc_record([("WARC-Type", "revisit"), *common, *kind, *refers], body[: parts[1]])


def convert(files: DataFrame, again: DataFrame) -> DataFrame:
    """One WARC file for each ARC file; the list (archive, records)."""
    folder = shared_folder(files.sparkSession, "warc")
    columns = ["first_archive", "first_number", "first_page_id", "first_url", "first_date"]

    def run(key: tuple, source: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        if source.empty:
            return pd.DataFrame({"archive": pd.Series(dtype=str), "records": pd.Series(dtype="int64")})
        archive, path = key[0], f"{folder}/{uuid.uuid4().hex}.warc.gz"
        values = repeats[columns].astype(object).where(repeats[columns].notna(), None).itertuples(index=False, name=None)
        firsts = {n: (at, int(place), None if page is None else int(page), url, day) for n, (at, place, page, url, day) in zip(repeats["number"], values, strict=True)}
        count, info, fallback = 0, None, None
        with _opened(archive, "r") as stream, _opened(path, "w") as out:
            for record in arc_records(stream, archive):
                if record["URL"].startswith("filedesc:"):
                    info, fallback = record_id(archive, record["number"]), warc_date(record["Archive-date"])
                else:
                    count += 1
                out.write(synthesised(record, archive, firsts.get(record["number"]), info, fallback))
        return pd.DataFrame({"archive": [path], "records": [count]})

    again = again.withColumn("first_page_id", F.col("first_page_id").cast("string"))  # a missing id leaves the others whole numbers
    return files.groupBy("archive").cogroup(again.groupBy("archive")).applyInPandas(run, "archive string, records long")


# --- WARC, read --------------------------------------------------------------------------------


def warc_records(stream: BinaryIO, archive: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record; blocks are compared with their digests."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record begins with {line[:200]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
            raise ValueError(f"{archive}: {headers.get('warc-record-id')} isn't what its digest says")
        yield headers, block


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of responses and revisits."""

    def rows(archives: list[str]) -> Iterator[tuple]:
        for archive in archives:
            with _opened(archive, "r") as stream:
                for headers, block in warc_records(stream, archive):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    told, start = http_parts(block)
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(told["content-length"])
                    if headers["warc-type"] == "response" and (base32_sha1(memoryview(block)[start:]) != digest or (len(block) - start != size and "warc-truncated" not in headers)):
                        raise ValueError(f"{archive}: {headers['warc-record-id']} has another payload than its digest says")
                    page, first = told.get(PAGE_FIELD.lower()), headers.get(REFERS_FIELD.lower())
                    yield page and int(page), headers.get("warc-target-uri"), size, digest, headers["warc-type"], first and int(first)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_rows(_spread(files, files.count()), ["archive"], rows, schema, names, types)


def converted(pages: DataFrame) -> DataFrame:
    """Pages through ARC files, the converter and WARC files, as they are read back."""
    arcs = write_arc(pages)
    index = written(scan_arc(arcs), "arc-index")
    warcs = written(convert(arcs, repeated(index)), "warc-list")
    released(arcs, index, arcs.folder)
    return read_warc(warcs)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to
FROM r
"""
