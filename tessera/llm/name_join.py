"""Edit-distance name join by partitioned neighbourhoods.

Two names qualify at an optimal-string-alignment distance of at most 2.  A name
is cut into three pieces: head, middle, tail.  Two edits can't bring all three
beyond one plain edit (insertion, deletion, substitution): an exchange inside a
piece counts as two plain edits there, one across a border as one on each side.
So one piece is within one plain edit of the substring it is aligned with, and
the two share a one-deletion variant.  Which substrings can be aligned follows
from the difference of the lengths (the shift).

The tail is asked first, by all its variants, against suffixes.  Only names
whose tail has two plain edits need the others, and then more is known:

* both edits touch the tail: the name up to the middle's last character is as it was;
* one edit exchanges two characters inside the tail, whose characters are the
  same: the head's variants, joined by these characters, cover every other edit
  but an exchange inside the head; there the middle is exact.

Keys are 64-bit hashes of (kind, length, place, variant); a collision only adds a
candidate.  A plain distance over 4 drops a candidate inside the join, whole
names are verified on distinct pairs.  Copies of a name are one name until the
figures are added up, so a name that a third of the rows bears travels once.  A key that too many
names share is split by the keys of what it leaves open of them (see ``near_names``).

Results for odd input: null and empty names take no part; rows count as often as
they stand, on both sides; a null id counts in ``n_clients`` and in no minimum
or sum; a null vendor_id isn't misspelt and forms a group; ties of the smallest
id don't arise, as it is a value; names of any length work (variants come from
pieces of at most nine characters); empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, id_crc, map_rows, written

#: Distances up to this one qualify; pieces and cases above are made for it.
FARTHEST = 2
#: What the characters beside a key say where the key doesn't leave one out: always different.
ASKING, KNOWN = -1, -2
#: Pairs that meet under one key before it is split.
HOT_PAIRS = 1 << 22
#: Cells that one verified block holds at most.
BLOCK_CELLS = 1_000_000


def pieces(length: int) -> tuple[int, int]:
    """Lengths of head and tail of a name; the middle is the rest."""
    tail = 8 if length >= 12 else 4 if length >= 6 else 2 if length >= 3 else 1
    return min((length - tail) // 2, 4), tail


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _less(text: str) -> set[str]:
    """The text with one character left out."""
    return {text[:k] + text[k + 1 :] for k in range(len(text))}


def _bag(text: str) -> str:
    return "".join(sorted(text))


Keys = Iterator[tuple[int, int, int, int]]


def asking_keys(name: str) -> Keys:
    """(key, character left out, begin and end of what the key leaves open) of a name that is cut into pieces."""
    n = len(name)
    head, tail = pieces(n)
    p, m, s, cut = name[:head], name[head : n - tail], name[n - tail :], n - tail
    yield _key("tail", tail, s), ASKING, 0, cut
    for k, c in enumerate(s):
        yield _key("tail for", tail, k, s[:k] + s[k + 1 :]), ord(c), 0, cut
    for x in _less(s):
        yield _key("tail less", tail, x), ASKING, 0, cut
    yield _key("tail more", tail, s), ASKING, 0, cut
    start = max(cut - 1, 0)
    yield _key("start", start, name[:start]), ASKING, start, n
    bag = _bag(s)
    yield _key("head", n, p, bag), ASKING, head, cut
    for k, c in enumerate(p):
        yield _key("head for", n, k, p[:k] + p[k + 1 :], bag), ord(c), head, cut
    for x in _less(p):
        yield _key("head less", n, x, bag), ASKING, head, cut
    yield _key("head more", n, p, bag), ASKING, head, cut
    yield _key("middle", n, m, _bag(p), bag), ASKING, 0, head


def known_keys(name: str) -> Keys:
    """The same of the substrings that pieces of another name can be aligned with."""
    n = len(name)
    lengths = range(max(1, n - FARTHEST), n + FARTHEST + 1)  # of the other name
    for tail in {pieces(k)[1] for k in lengths}:
        if tail <= n:
            s = name[n - tail :]
            yield _key("tail", tail, s), KNOWN, 0, n - tail
            for k, c in enumerate(s):
                yield _key("tail for", tail, k, s[:k] + s[k + 1 :]), ord(c), 0, n - tail
        if tail - 1 <= n:
            yield _key("tail less", tail, name[n - tail + 1 :]), KNOWN, 0, n - tail + 1
        if tail + 1 <= n:
            for x in _less(name[n - tail - 1 :]):
                yield _key("tail more", tail, x), KNOWN, 0, n - tail - 1
    for start in {max(k - pieces(k)[1] - 1, 0) for k in lengths}:
        if start <= n:
            yield _key("start", start, name[:start]), KNOWN, start, n
    for k in range(max(1, n - 1), n + 2):
        head, tail = pieces(k)
        if tail > n or head > n:
            continue
        bag, cut = _bag(name[n - tail :]), n - tail
        yield _key("head", k, name[:head], bag), KNOWN, head, cut
        if k == n:
            p = name[:head]
            for at, c in enumerate(p):
                yield _key("head for", k, at, p[:at] + p[at + 1 :], bag), ord(c), head, cut
            yield _key("middle", k, name[head:cut], _bag(p), bag), KNOWN, 0, head
        elif k == n + 1 and head:
            yield _key("head less", k, name[: head - 1], bag), KNOWN, head - 1, cut
        elif k == n - 1:
            for x in _less(name[: head + 1]):
                yield _key("head more", k, x, bag), KNOWN, head + 1, cut


def inner_keys(name: str, key: int, keys: Callable[[str], Keys], own: int) -> set[tuple[int, int]]:
    """Keys of what one key leaves open of a name: those parts are within the same distance, so they share one as well."""
    out = set()
    for found, _, begin, end in keys(name):
        if found == key:
            rest = name[begin:end]
            out |= {(_key(key, inner), left) for inner, left, _, _ in keys(rest)} if rest else set()
            if len(rest) <= FARTHEST:
                out.add((_key(key, "short"), own))
    return out


def _keyed(names: DataFrame, column: str, keys: Callable[[str], Keys]) -> DataFrame:
    def rows(texts: list[str]) -> Iterator[tuple[int, int, str]]:
        for text in texts:
            for key, left, _, _ in keys(text):
                yield key, left, text

    return map_rows(names, [column], rows, f"key long, left_out int, {column} string", ["key", "left_out", column], [pa.int64(), pa.int32(), pa.string()])


def _split(rows: DataFrame, column: str, keys: Callable[[str], Keys], own: int) -> DataFrame:
    """Rows of hot keys under the keys of what these leave open."""

    def inner(texts: list[str], hot: list[int]) -> Iterator[tuple[int, int, str]]:
        for text, key in zip(texts, hot, strict=True):
            for more, left in inner_keys(text, key, keys, own):
                yield more, left, text

    return map_rows(rows.select(column, "key").distinct(), [column, "key"], inner, f"key long, left_out int, {column} string", ["key", "left_out", column], [pa.int64(), pa.int32(), pa.string()])


def _distances(left: list[str], right: list[str]) -> np.ndarray:
    """Optimal-string-alignment distances of pairs in one block; beyond ``FARTHEST`` any larger number.

    Row by row over the five diagonals that such a distance can't leave.
    """
    n, far, width = len(left), FARTHEST + 1, 2 * FARTHEST + 1
    la, lb = (np.array([len(x) for x in side]) for side in (left, right))
    most = int(max(la.max(), lb.max())) + FARTHEST + 1
    a, b = (np.frombuffer("".join(x.ljust(most, "\0") for x in side).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, most) for side in (left, right))
    out = np.where(np.abs(la - lb) > FARTHEST, far, -1)
    before = last = np.full((n, width), far)
    for i in range(int(la.max()) + 1):
        row = np.full((n, width), far)
        for d in range(width):
            j = i + d - FARTHEST
            if j < 0 or j >= most:
                continue
            best = np.full(n, j if i == 0 else i if j == 0 else far)
            if i and d + 1 < width:
                best = np.minimum(best, last[:, d + 1] + 1)
            if j and d:
                best = np.minimum(best, row[:, d - 1] + 1)
            if i and j:
                best = np.minimum(best, last[:, d] + (a[:, i - 1] != b[:, j - 1]))
            if i > 1 and j > 1:
                crossed = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(crossed, np.minimum(best, before[:, d] + 1), best)
            row[:, d] = best
        ends = (out < 0) & (la == i)
        out[ends] = row[ends, (lb - la + FARTHEST)[ends]]
        before, last = last, row
    return out


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (asking, known) with their exact distance, where it qualifies."""

    def rows(left: list[str], right: list[str]) -> Iterator[tuple[str, str, int]]:
        order = sorted(range(len(left)), key=lambda k: len(left[k]))
        while order:
            size = max(1, BLOCK_CELLS // (len(left[order[-1]]) + FARTHEST))
            block, order = order[-size:], order[:-size]
            found = _distances([left[k] for k in block], [right[k] for k in block])
            for k, distance in zip(block, found.tolist(), strict=True):
                if distance <= FARTHEST:
                    yield left[k], right[k], distance

    return map_rows(pairs, ["asking", "known"], rows, "asking string, known string, distance int", ["asking", "known", "distance"], [pa.string(), pa.string(), pa.int32()])


def _met(a: DataFrame, k: DataFrame) -> DataFrame:
    near = (a["key"] == k["key"]) & (a["left_out"] != k["left_out"]) & (F.levenshtein("asking", "known", 2 * FARTHEST) >= 0)
    return a.join(k.hint("merge"), near).select("asking", "known")


def near_names(asking: DataFrame, known: DataFrame) -> DataFrame:
    """All pairs (asking, known, distance) of two columns of different, non-empty names.

    A key under which more than ``HOT_PAIRS`` pairs meet (names that end in the same company form) is split: its names meet under
    keys of what it leaves open of them.  Which keys are hot is counted by key, and only if there are any is anything split.
    """
    a, k = written(_keyed(asking, "asking", asking_keys), "asking-keys"), written(_keyed(known, "known", known_keys), "known-keys")
    counts = a.groupBy("key").agg(F.count("*").alias("askers")).join(k.groupBy("key").agg(F.count("*").alias("holders")).hint("merge"), "key")
    hot = written(counts.filter(F.col("askers") * F.col("holders") > HOT_PAIRS).select("key"), "hot-keys")
    if hot.isEmpty():
        return verified(_met(a, k).distinct())
    only = lambda df, how: df.join(hot.hint("merge"), "key", how)
    split = _met(_split(only(a, "left_semi"), "asking", asking_keys, ASKING), _split(only(k, "left_semi"), "known", known_keys, KNOWN))
    return verified(_met(only(a, "left_anti"), only(k, "left_anti")).unionByName(split).distinct())


def misspelt(vendor_id: str, name: str) -> Column:
    """The name with two adjacent characters exchanged where the id's checksum is even."""
    n, h, c = F.length(name), id_crc(vendor_id), F.col(name)
    at = F.pmod(h, F.greatest(n - 1, F.lit(1))).cast("int")
    one = lambda p: F.substring(c, p, F.lit(1))
    swapped = F.concat(F.substring(c, F.lit(1), at), one(at + 2), one(at + 1), F.substring(c, at + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(c)


def join_vendors(clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor and distance: how many clients bear such a name, the smallest id and a checksum."""
    known = (
        clients.filter(F.col("name") != "").groupBy(F.col("name").alias("known"))
        .agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(id_crc("client_id")).alias("crc"))
    )
    asked = vendors.filter(F.col("name") != "").groupBy(misspelt("vendor_id", "name").alias("asking"), "vendor_id").agg(F.count("*").alias("times"))
    pairs = near_names(asked.select("asking").distinct(), known.select("known"))
    figures = pairs.join(known.hint("merge"), "known").groupBy("asking", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    return (
        asked.join(figures.hint("merge"), "asking").groupBy("vendor_id", "distance")
        .agg(F.sum(F.col("n") * F.col("times")).alias("n_clients"), F.min("first").alias("first_client_id"), F.sum(F.col("crc") * F.col("times")).alias("clients_crc"))
    )


#: Row by row over the whole table of distances: a row's cells follow from the last two rows and a running minimum.
ORACLE_SQL = f"""
WITH RECURSIVE v0 AS (
  SELECT vendor_id, name, length(name) AS n, {CRC_SQL.format("CAST(vendor_id AS VARCHAR)")} AS h FROM vendors WHERE name <> ''
), v AS (
  SELECT vendor_id, CASE WHEN h % 2 = 0 AND n >= 2 THEN substr(name, 1, h % greatest(n - 1, 1)) || substr(name, h % greatest(n - 1, 1) + 2, 1)
    || substr(name, h % greatest(n - 1, 1) + 1, 1) || substr(name, h % greatest(n - 1, 1) + 3) ELSE name END AS a FROM v0
), start AS (
  SELECT DISTINCT a, name AS b FROM v, clients WHERE name <> '' AND abs(length(a) - length(name)) <= 2
), grid(a, b, i, before, last) AS (
  SELECT a, b, 0::BIGINT, range(0, length(b) + 1), range(0, length(b) + 1) FROM start
  UNION ALL
  SELECT a, b, i, last, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(base[1:j + 1], lambda x, k: x - (k - 1)))) FROM (
    SELECT a, b, i + 1 AS i, last, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(
      last[j + 1] + 1, last[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 0 ELSE 1 END,
      CASE WHEN i > 0 AND j > 1 AND substr(a, i + 1, 1) = substr(b, j - 1, 1) AND substr(a, i, 1) = substr(b, j, 1) THEN before[j - 1] + 1 END) END) AS base
    FROM grid WHERE i < length(a) AND list_min(last) <= 2)
), found AS (SELECT a, b, last[length(b) + 1] AS distance FROM grid WHERE i = length(a) AND last[length(b) + 1] <= 2)
SELECT vendor_id, CAST(distance AS INTEGER) AS distance, count(*) AS n_clients, min(client_id) AS first_client_id,
  CAST(sum({CRC_SQL.format("CAST(client_id AS VARCHAR)")}) AS BIGINT) AS clients_crc
FROM v JOIN found USING (a) JOIN clients ON name = b GROUP BY ALL
"""
