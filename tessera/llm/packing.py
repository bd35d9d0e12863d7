"""Best-two-fit packing of documents into token sequences.

Documents become ids of a public tokenizer plus one end id; only documents
longer than a sequence are cut.  Pieces are dealt at random to shards of
about ``SHARD_PIECES`` rows (their number follows the input), and each shard is
packed on its own: a bin is filled greedily with the longest piece that still
fits, then its smallest piece is exchanged for two unpacked ones that fit
its expanded gap more tightly.  A shard wastes at most its last bin, so the
number of sequences stays within one per shard of packing all at once.

Defined results: null or empty text is the end id alone; repeated rows are
packed once each; null ids are carried along; an empty table gives no rows; pieces
of equal length are taken in the order of their numbers; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 8192
CACHE_WORDS = 400_000

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|()-]*)")
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SPELT = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_TOKENIZERS: dict[str, object] = {}
_WORDS: dict[str, dict[bytes, bytes]] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _WORDS[path] = {}
    return _TOKENIZERS[path], _WORDS[path]


def _short_way(word: bytes, known: dict[bytes, bytes], bpe) -> bool:
    """Latin letters with punctuation behind: the tokenizer's own merges, without the steps that leave such words alone."""
    m = _PLAIN.fullmatch(word.decode("utf-8"))
    if not m:
        return False
    out = b""
    for part in m.groups():
        if part:
            raw = part.lower().encode()
            ids = known.get(raw)
            if ids is None:
                spelt = raw.decode() if raw.isascii() else "".join([_SPELT[b] for b in raw])
                ids = known[raw] = b"".join([t.id.to_bytes(4, "little") for t in bpe.tokenize(spelt)])
            out += ids
    known[word] = out
    return True


def encode_texts(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit words.

    The tokenizer's pieces never span white space, so ASCII white space is a
    safe cut and the ids of a chunk between two cuts can be remembered.
    """
    tokenizer, known = _tokenizer(path)
    look = known.__getitem__
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        # ASCII capitals fold before the look-up; a special token's string keeps its case
        words = (raw.lower() if raw.isascii() and b"<|" not in raw else raw).split()
        try:
            yield b"".join(map(look, words))
            continue
        except KeyError:
            pass
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        rest = []
        for w in set(words):
            if w not in known and not _short_way(w, known, tokenizer.model):
                rest.append(w)
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            got = tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            for word, enc in zip(part, got, strict=True):
                known[word] = b"".join([i.to_bytes(4, "little") for i in enc.ids])
        yield b"".join(map(look, words))


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    tail = end_id.to_bytes(4, "little")
    step = capacity * 4

    def cut(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, raw in zip(ids, encode_texts(texts, tokenizer_path), strict=True):
            raw += tail
            for piece, start in enumerate(range(0, len(raw), step)):
                part = raw[start : start + step]
                yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(
        rows, ["doc_id", "text"], cut, "doc_id long, piece int, start long, length long, ids_crc32 long",
        ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()],
    )


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths are 1..capacity."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    present = 0  # bit l: some unpacked piece has length l
    for size, rows in enumerate(waiting):
        if rows:
            present |= 1 << size
    upto = [(2 << size) - 1 for size in range(capacity + 1)]
    bin_of, offset_of = [0] * len(lengths), [0] * len(lengths)

    def take(size: int) -> int:
        nonlocal present
        row = waiting[size].pop()
        if not waiting[size]:
            present &= ~(1 << size)
        return row

    number = 0
    while present:
        held = [take(present.bit_length() - 1)]
        gap = capacity - lengths[held[0]]
        while gap and (fit := present & upto[gap]):
            held.append(take(fit.bit_length() - 1))
            gap -= lengths[held[-1]]
        if gap and present:
            small = lengths[held[-1]]  # the last one taken is the smallest
            room, best, pair = gap + small, small, (0, 0)
            left = present & upto[min(small, room - 1)]
            while left:
                first = left.bit_length() - 1
                if 2 * first <= best:
                    break
                second = present & upto[min(first, room - first)]
                if len(waiting[first]) < 2:
                    second &= ~(1 << first)
                other = second.bit_length() - 1
                if other > 0 and first + other > best:
                    best, pair = first + other, (first, other)
                    if best == room:
                        break
                left &= ~(1 << first)
            if pair[0]:
                back = held.pop()
                held += [take(pair[0]), take(pair[1])]
                waiting[small].append(back)
                present |= 1 << small
        at = 0
        for row in held:
            bin_of[row], offset_of[row] = number, at
            at += lengths[row]
        number += 1
    return bin_of, offset_of


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = written(token_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable")
        bins, offsets = best_two_fit(rows["length"].tolist(), capacity)
        out = rows.drop(columns="shard")
        out["sequence_id"] = [(int(key[0]) << 32) + b for b in bins]
        out["offset"] = offsets
        return out

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
