"""Signature sniffing of media columns.

One Aho-Corasick pass finds the magic bytes of all known formats anywhere in a
blob.  Each hit goes to the validator of its format, which walks the real
structure (chunks, segments, boxes, pages) and gives the length the format
itself states, or nothing when the structure is wrong.  A valid hit at offset 0
decides the type, whatever was declared; valid hits further in, outside what
was already claimed, are carved as embedded media.

``store_samples`` writes bytes as 8-bit mono PCM in a WAVE container, one byte
per sample, and ``read_samples`` gets them back from the container's chunks.

Defined results: null or empty blobs have the type ``empty``; blobs without a
valid signature at 0 keep the declared type's ``unknown`` verdict and may still
carry embedded media; of valid hits that overlap the first one claims its bytes, of equal starts the longer one;
blobs of any length are scanned whole; repeated rows are stored once each and give equal values; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

Found = tuple[str, int, int]  # type, start, length

_U32LE, _U32BE, _U16BE = struct.Struct("<I"), struct.Struct(">I"), struct.Struct(">H")
RATE = 8000
PIECE = 1 << 16  # bytes that are inflated at a time


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = _U32BE.unpack_from(b, p)[0], b[p + 4 : p + 8]
        if p + 12 + size > len(b) or first and (kind, size) != (b"IHDR", 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != _U32BE.unpack_from(b, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 - at if images else None
        if mark == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
            images += 1
        elif mark == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark = b[p + 1]
        size = _U16BE.unpack_from(b, p + 2)[0]
        if mark in (0xD8, 0xD9) or size < 2:
            return None
        frame |= mark in (0xC0, 0xC1, 0xC2)
        p += 2 + size
        if mark == 0xDA:
            if not frame:
                return None
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
            if p < 0:
                return None
    return None


def _riff(form: bytes, needed: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + _U32LE.unpack_from(b, at + 4)[0]
        if end > len(b):
            return None
        p, seen = at + 12, set()
        while p + 8 <= end:
            size = _U32LE.unpack_from(b, p + 4)[0]
            if p + 8 + size > end:
                return None
            seen.add(b[p : p + 4])
            p += 8 + size + (size & 1)
        return end - at if p >= end and any(n in seen for n in needed) else None

    return check


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    ok = not zero and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b)
    return size if ok and b[at + 26 : at + 28] == b"\x01\x00" and b[at + 28] in (1, 4, 8, 16, 24, 32) else None


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        table = b[p + 27 : p + 27 + b[p + 26]]
        size = 27 + b[p + 26] + sum(table)
        if len(table) < b[p + 26] or p + size > len(b):
            return None
        last = b[p + 5] & 4
        p += size
        if last:
            return p - at
    return None


def _mp4(b: bytes, at: int) -> int | None:
    at -= 4  # the magic stands behind the box's length
    p, kinds = at, []
    while 0 <= p and p + 8 <= len(b):
        size, kind = _U32BE.unpack_from(b, p)[0], b[p + 4 : p + 8]
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += size
    return p - at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


class Blob(bytes):
    """Bytes that remember where the next occurrence of a mark is, so that a search per hit stays linear over all hits."""

    def ahead(self, mark: bytes, at: int) -> int:
        """First place of the mark at or behind ``at``; the blob's size where there is none."""
        known = self.__dict__.setdefault("known", {})
        asked, found = known.get(mark, (0, -1))
        if not asked <= at <= found:
            found = self.find(mark, at)
            found = len(self) if found < 0 else found
            known[mark] = (at, found)
        return found


def _pdf(b: Blob, at: int) -> int | None:
    end = b.ahead(b"%%EOF", at)
    return end + 5 - at if end < len(b) and b.ahead(b"startxref", at) < end and b.ahead(b" obj", at) < end else None


def _gzip(b: bytes, at: int) -> int | None:
    """Inflates piece by piece and keeps nothing, so that memory doesn't follow what a blob expands to."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d, p, rest = zlib.decompressobj(31), at, b""
    view = memoryview(b)
    try:
        while not d.eof:
            if not rest:
                if p >= len(b):
                    if d.decompress(b"", PIECE) or d.eof:
                        continue
                    return None
                rest, p = view[p : p + PIECE], p + PIECE
            d.decompress(rest, PIECE)
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) - at


#: Magic bytes, media type, where the magic stands in the format.
FORMATS: list[tuple[bytes, str, int, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"RIFF", "audio/wav", 0, _riff(b"WAVE", (b"data",))),
    (b"RIFF", "image/webp", 0, _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", "video/avi", 0, _riff(b"AVI ", (b"LIST",))),
    (b"BM", "image/bmp", 0, _bmp),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"ftyp", "video/mp4", 4, _mp4),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
]
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        found: dict[str, list[int]] = {}
        for i, f in enumerate(FORMATS):
            found.setdefault(f[0].decode("latin-1"), []).append(i)
        auto = ahocorasick.Automaton()
        for magic, which in found.items():
            auto.add_word(magic, (len(magic), which))
        auto.make_automaton()
        _AUTOMATON.append(auto)
    return _AUTOMATON[0]


def sniff(blob: bytes) -> list[Found]:
    """Valid media in a blob by start, none inside another."""
    blob = Blob(blob)
    hits: list[tuple[int, int]] = []
    for end, (size, which) in _automaton().iter(blob.decode("latin-1")):
        hits += [(end + 1 - size, i) for i in which]
    out: list[Found] = []
    covered = 0
    for at, i in sorted((at - FORMATS[i][2], i) for at, i in hits):
        if at >= covered and (length := FORMATS[i][3](blob, at + FORMATS[i][2])):
            out.append((FORMATS[i][1], at, length))
            covered = at + length
    return out


def true_type(blob: bytes | None, declared: str | None) -> tuple[str, bool, list[Found]]:
    """Corrected type, whether the declared one was wrong, and what is embedded."""
    if not blob:
        return "empty", declared not in (None, "empty"), []
    found = sniff(blob)
    if found and found[0][1] == 0:
        return found[0][0], declared != found[0][0], found[1:]
    return "unknown", declared not in (None, "unknown"), found


def sniff_media(df: DataFrame, *, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, media_type, corrected, embedded array<struct<type,start,length,content>>)."""

    def run(ids: list, blobs: list, declared: list) -> Iterator[tuple]:
        for key, blob, said in zip(ids, blobs, declared, strict=True):
            kind, wrong, inner = true_type(blob, said)
            yield key, kind, wrong, [{"type": t, "start": s, "length": n, "content": blob[s : s + n]} for t, s, n in inner]

    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
    said = F.col(declared_col) if declared_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(blob_col).cast("binary").alias("blob"), said.cast("string").alias("declared"))
    return map_rows(rows, ["id", "blob", "declared"], run,
                    "id string, media_type string, corrected boolean, embedded array<struct<type:string,start:long,length:long,content:binary>>",
                    ["id", "media_type", "corrected", "embedded"], [pa.string(), pa.string(), pa.bool_(), pa.list_(item)])


def store_samples(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM samples in a WAVE container."""
    odd = len(payload) & 1
    return b"".join((
        b"RIFF", _U32LE.pack(36 + len(payload) + odd), b"WAVE",
        b"fmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8),
        b"data", _U32LE.pack(len(payload)), payload, b"\0" * odd,
    ))


def read_samples(media: bytes, at: int = 0) -> bytes:
    """The samples of a WAVE container, from its data chunks."""
    end, p, out = at + 8 + _U32LE.unpack_from(media, at + 4)[0], at + 12, []
    while p + 8 <= end:
        size = _U32LE.unpack_from(media, p + 4)[0]
        if media[p : p + 4] == b"data":
            out.append(media[p + 8 : p + 8 + size])
        p += 8 + size + (size & 1)
    return b"".join(out)


def media_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """Store each text as samples, sniff the stored bytes, read them back.

    The stored blob is declared ``application/octet-stream``; the sniffer must
    find the container by itself, and what it carves is what is read.
    """

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            raw = (text or "").encode("utf-8", "replace")
            media = store_samples(raw + bytes(-len(raw) % unit or (0 if raw else unit)))
            kind, wrong, inner = true_type(media, "application/octet-stream")
            if kind != "audio/wav":
                raise ValueError(f"stored media of {doc_id} isn't recognised")
            back = read_samples(media)
            inside = sum(1 for _ in sniff(back))
            feature = f"{kind};corrected={int(wrong)};rate={RATE};samples={len(back)};after={len(inner)};inside={inside}"
            yield (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
                   len(media), hashlib.sha256(media).hexdigest(), feature)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return map_rows(rows, ["doc_id", "text"], run,
                    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
                    names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])
