"""Secret scan with linking of credentials that come in parts.

Base kinds are found by fixed patterns (assignments, access identifiers, long
hex runs).  Beyond them there are weak candidates that mean nothing alone:
identifiers (``client_id: x``, user names), secret-looking tokens (mixed case
and digits, high entropy) and endpoints (URLs, hosts with a port).  Every part
opens a scope around itself; two parts whose scopes overlap within the same
paragraph are joined (an interval join by a sweep over starts).  Parts that overlap
are no complements of each other: a path of mixed letters isn't the key of its own
URL.  A weak candidate is reported only if a secret-like part and an identifier or endpoint
are linked; base matches act as parts too, but are always reported.

Defined results: null or empty text has no spans; all positions are code
points; repeated rows are scanned once each; an empty table gives no rows; other columns are
ignored, whatever their names; texts, identifiers and host names may be of any length; of parts that start at one
place all are kept, in the order of their kinds; parts that overlap base spans are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sliced

SCOPE = 120  # code points on either side of a part
BASE_KINDS = ("assign", "access", "hex")
PART_KINDS = ("ident", "token", "endpoint")
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + PART_KINDS)}

#: The patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINT = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")

_IDENT = re.compile(r"(?:client|account|access|user|tenant|project|key)[_ -]?(?:id|name|key_id)\b[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})|\b(?:user|login|username)\x20*[:=]\x20*([A-Za-z0-9_.@-]{3,})", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|(?<![A-Za-z0-9-])(?<![A-Za-z0-9-]\.)(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+:\d{2,5}\b", re.ASCII)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; too short ones are dropped after matching."""
    out = []
    if _HINT.search(text):
        out += [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, _ORDER[s.kind]))


def _mixed(token: str) -> bool:
    """Looks like key material: digits with letters of both cases and spread out."""
    kinds = any(c.isdigit() for c in token) + any(c.isupper() for c in token) + any(c.islower() for c in token)
    if kinds < 3:
        return False
    n = len(token)
    return -sum(v / n * math.log2(v / n) for v in Counter(token).values()) >= 3.5


def weak_parts(text: str, taken: list[Span]) -> list[Span]:
    """Identifiers, tokens and endpoints outside the base spans."""
    parts = []
    if ":" in text or "=" in text:
        for m in _IDENT.finditer(text):
            g = 1 if m.group(1) else 2
            parts.append(Span("ident", m.start(g), m.end(g)))
        parts += [Span("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    parts += [Span("token", *m.span()) for m in _TOKEN.finditer(text) if _mixed(m.group())]
    parts.sort(key=lambda s: (s.start, _ORDER[s.kind]))
    free, at = [], 0
    for p in parts:
        while at < len(taken) and taken[at].end <= p.start:
            at += 1
        if at == len(taken) or taken[at].start >= p.end:
            free.append(p)
    return free


def linked_parts(text: str, base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts with a complement in scope and in the same paragraph."""
    if not weak:
        return []
    every = sorted([*base, *weak], key=lambda s: (s.start, _ORDER[s.kind]))
    secretive = {"assign", "hex", "token"}
    good: set[Span] = set()
    live: list[Span] = []
    for s in every:
        live = [p for p in live if p.end + scope >= s.start - scope]  # whose scope reaches this one's
        for p in live:
            if p.end <= s.start and (p.kind in secretive) != (s.kind in secretive) and "\n\n" not in text[p.end : s.start]:
                good.update((p, s))
        live.append(s)
    return [s for s in weak if s in good]


def find_spans(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start with the linked weak ones."""
    if not text:
        return [], []
    base = base_spans(text)
    weak = weak_parts(text, base)
    more = linked_parts(text, base, weak, scope)
    return base, sorted([*base, *more], key=lambda s: (s.start, _ORDER[s.kind]))


def as_text(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def redact(text: str | None, spans: list[Span], mask: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by the mask."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>, redacted) of every document."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            _, spans = find_spans(text, scope)
            yield doc_id, [s._asdict() for s in spans], redact(text, spans)

    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string",
                    ["doc_id", "spans", "redacted"], [pa.int64(), pa.list_(item), pa.string()])


def scan_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            base, spans = find_spans(text, scope)
            n = Counter(s.kind for s in base)
            yield doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                    [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def masked(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span masked; ``size_col``, where there is one, follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            at, size_at = batch.schema.get_field_index(text_col), batch.schema.get_field_index(size_col)
            old = batch.column(at).to_pylist()
            new = [redact(t, find_spans(t, scope)[1]) for t in old]
            if size_at >= 0:
                sizes = [len(n) if n is not None and n is not o else s for o, n, s in zip(old, new, batch.column(size_at).to_pylist(), strict=True)]
                batch = batch.set_column(size_at, batch.schema.field(size_at), pa.array(sizes, batch.schema.field(size_at).type))
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
