"""Exact merge-type (BPE) encoding by backtracking, and decoding.

Per text: white space becomes the marker, a marker is put in front, and the
text is cut before each run of markers.  No piece of such a vocabulary has a
marker behind another character (checked when the model is read), so no
merge crosses a cut and each segment is encoded alone and remembered.

Per segment: an Aho-Corasick automaton over reversed pieces gives, for every
position, all pieces that start there, longest first.  The longest one is
taken if it may stand behind the piece before it, that is if merging the
two pieces' characters again ends in just these two pieces; otherwise the next
shorter one is tried, and a position where none is left is marked in a
bitfield as failed, and the search steps back.  Characters in no piece cut the segment
and fall back to their UTF-8 bytes; only a stretch with characters that are in
longer pieces but in none of their own is merged plainly.

Defined results: null text counts as empty; the empty text has no ids and
decodes to the empty text; texts of any length are encoded whole, segment by segment; repeated rows
are encoded once each, null ids carried along; an empty table gives no rows; other columns are ignored, whatever
their names; of pieces of equal length at a place there is one, so no ties arise.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
CACHE_SEGMENTS = 350_000
CACHE_CHARS = 24_000_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """A merge-type SentencePiece vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_of: dict[int, int] = {i: int(p[3:5], 16) for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        skip = {i for i in range(len(self.text)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.id_of = {p: i for i, p in enumerate(self.text) if i not in skip}
        self.rank = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        self.single = {p for p in self.id_of if len(p) == 1}
        self.covered = {c for p in self.id_of for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds the marker behind another character")
        self.control = {i for i in skip if i not in self.byte_of}
        self.matches = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.matches.add_word(p[::-1], (len(p), i))
        self.matches.make_automaton()
        self.longest = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.longest.add_word(p, i)
        self.longest.make_automaton()
        self.inside = {a + b for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        self.pair_ok: dict[int, bool] = {}
        self.known: dict[str, str] = {}  # segment: its ids, each behind a comma
        self.held = 0
        self.odd: dict[str, str] = {}  # segments that decode to another text

    def merge(self, chars: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, leftmost on ties."""
        if len(chars) > 64:
            return self._merge_long(chars)
        part, get, none = list(chars), self.rank.get, math.inf
        ranks = [get(a + b, none) for a, b in zip(part, part[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] + part[i], none)
            if i < len(ranks):
                ranks[i] = get(part[i] + part[i + 1], none)
        return part

    def _merge_long(self, chars: str) -> list[str]:
        """The same with a heap, for segments of any length."""
        part: list[str | None] = list(chars)
        size = len(part)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < size:
                both = part[a] + part[b]
                rank = self.rank.get(both)
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, both))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[b] < size:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p is not None]

    def _compatible(self, a: int, b: int) -> bool:
        """May piece b stand behind piece a; a is -1 at the front."""
        if len(self.pair_ok) > 1_500_000:
            self.pair_ok.clear()
        left, right = self.text[a] if a >= 0 else "", self.text[b]
        ok = self.pair_ok[a << 20 | b] = self.merge(left + right) == ([left, right] if left else [right])
        return ok

    def _bytes(self, chars: str) -> list[int]:
        return [self.byte_id[b] for b in chars.encode("utf-8", "replace")]

    def segment_ids(self, segment: str) -> list[int]:
        id_of = self.id_of
        if not self.single.issuperset(segment):
            if self.covered.issuperset(segment):  # characters that have a piece only together with others
                return [x for p in self.merge(segment) for x in ([id_of[p]] if p in id_of else self._bytes(p))]
            ids: list[int] = []
            for covered, run in itertools.groupby(segment, self.covered.__contains__):  # nothing merges across other characters
                ids += self.segment_ids("".join(run)) if covered else self._bytes("".join(run))
            return ids
        pair_ok, compatible = self.pair_ok, self._compatible
        greedy, before = [i for _, i in self.longest.iter_long(segment)], -1
        for i in greedy:
            ok = pair_ok.get(before << 20 | i)
            if not (ok or ok is None and compatible(before, i)):
                break
            before = i
        else:
            if "".join([self.text[i] for i in greedy]) == segment:
                return greedy  # the longest matches stand as they are
        last = len(segment) - 1
        starting: list[list[tuple[int, int]]] = [[] for _ in segment]
        for end, match in self.matches.iter(segment[::-1]):  # at each place the longest one comes first
            starting[last - end].append(match)
        failed = bytearray(last + 2)  # positions that lead nowhere
        ids, ranks, starts = [], [], []
        at = rank = 0
        before = -1
        while at <= last:
            found = starting[at]
            for r in range(rank, len(found)):
                length, i = found[r]
                if not failed[at + length]:
                    ok = pair_ok.get(before << 20 | i)
                    if ok or ok is None and compatible(before, i):
                        ids.append(i)
                        ranks.append(r)
                        starts.append(at)
                        at, rank, before = at + length, 0, i
                        break
            else:
                failed[at] = 1
                if not ids:
                    return [id_of[p] for p in self.merge(segment)]
                ids.pop()
                at, rank = starts.pop(), ranks.pop() + 1
                before = ids[-1] if ids else -1
        return ids

    def _cut(self, segment: str) -> int:
        """A place behind the last letter where no piece can span the cut; 0 if there is none."""
        if segment.isalnum() or len(segment) > 64:
            return 0
        for k in range(len(segment) - 1, 0, -1):
            if segment[k - 1].isalnum():
                return k if k < len(segment) and segment[k - 1 : k + 1] not in self.inside else 0
        return 0

    def segment(self, segment: str) -> str:
        """The ids of a segment as text, each behind a comma."""
        got = self.known.get(segment)
        if got is None:
            cut = self._cut(segment)
            if cut:
                got = self.segment(segment[:cut]) + self.segment(segment[cut:])
                ids = [int(i) for i in got[1:].split(",")] if self.odd else None
            else:
                ids = self.segment_ids(segment)
                got = "".join([f",{i}" for i in ids])
            self.held += len(segment) + len(got)
            if len(self.known) >= CACHE_SEGMENTS or self.held > CACHE_CHARS:
                self.known.clear()
                self.odd.clear()
                self.held = len(segment) + len(got)
            self.known[segment] = got
            if ids and "".join([self.text[i] for i in ids]) != segment:
                if (surface := self.surface(ids)) != segment.replace(MARK, " "):
                    self.odd[segment] = surface
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and their decoded text."""
        segments = self.segments(text)
        try:
            joined = "".join(map(self.known.__getitem__, segments))
        except KeyError:
            joined = "".join([self.segment(s) for s in segments])
            if not all(map(self.known.__contains__, segments)):  # cleared meanwhile: say what each one decodes to
                surfaces = [self.surface(self.segment_ids(s)) for s in segments]
                return joined.count(","), joined[1:], "".join(surfaces).removeprefix(" ")
        if self.odd and not self.odd.keys().isdisjoint(segments):
            whole = "".join([self.odd.get(s) or s.replace(MARK, " ") for s in segments])
        else:
            whole = "".join(segments).replace(MARK, " ")
        return joined.count(","), joined[1:], whole.removeprefix(" ")

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _SEGMENT.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", f" {MARK}")).split(" ")  # the same cut, for single spaces

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def surface(self, ids: list[int]) -> str:
        """Text of ids: markers are spaces, runs of byte pieces are UTF-8."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.text[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Inverse of encode: the front marker goes."""
        return self.surface(ids).removeprefix(" ")


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_ids(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every document."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        m = model(model_path)
        for doc_id, text in zip(ids, texts, strict=True):
            out = m.encode(text or "")
            yield doc_id, out, m.decode(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, ids array<int>, decoded string",
                    ["doc_id", "ids", "decoded"], [pa.int64(), pa.list_(pa.int32()), pa.string()])


def encode_digest(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        m = model(model_path)
        for doc_id, text in zip(ids, texts, strict=True):
            count, joined, decoded = m.digest(text or "")
            yield doc_id, count, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])
