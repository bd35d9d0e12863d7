"""A small reader over Columns: a text as words, numbers, spaces and marks, and what stands between places.

``pieces`` put together again are the text; ``words`` are those that aren't spaces, in lower case and with their
places.  Readers are conditions on the words around a place, so what they look for is said
in plain words and not in one expression for each spelling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Body = Callable[[Column], Column]


def let(value: Column, body: Body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]"), 0)


def amounts_and_words(text: Column) -> Column:
    """Pieces, but grouped and decimal numbers are one."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?|[A-Za-z]+|\s+|[^A-Za-z0-9\s]"), 0)


def words(ps: Column) -> Column:
    """(t, i) of the pieces that aren't spaces: lower case, and their place among the pieces."""
    return F.filter(F.transform(ps, lambda p, i: F.struct(F.lower(p).alias("t"), i.alias("i"))), lambda w: F.trim(F.regexp_replace(w["t"], r"\s", "")) != "")


def places(ws: Column) -> Column:
    return F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))


def at(ws: Column, k: Column) -> Column:
    """The word at a place; null outside."""
    return F.get(ws, k)["t"]


def said(ws: Column, k: Column, *any_of: str) -> Column:
    return F.coalesce(at(ws, k).isin(*any_of), F.lit(False))


def behind(ws: Column, k: Column, *optional: str) -> Column:
    """The place behind an optional word."""
    return k + F.when(said(ws, k, *optional), 1).otherwise(0)


def before(ws: Column, k: Column, *optional: str) -> Column:
    return k - F.when(said(ws, k, *optional), 1).otherwise(0)


def digits(ws: Column, k: Column, least: int, most: int) -> Column:
    w = at(ws, k)
    return F.coalesce(w.try_cast("bigint").isNotNull() & F.length(w).between(least, most) & (F.left(w, F.lit(1)) != "-"), F.lit(False))


def letters(word: Column) -> Column:
    return F.coalesce(F.upper(word) != F.lower(word), F.lit(False))


def is_month(ws: Column, k: Column, months: list[str]) -> Column:
    w = at(ws, k)
    return F.coalesce(F.left(w, F.lit(3)).isin(*months), F.lit(False)) & letters(w)


def day_end(ws: Column, k: Column, months: list[str]) -> Column:
    """Where a day's date that begins at k ends: by numbers, or with a month's name; null where none does."""
    name = behind(ws, k + 1, "st", "nd", "rd", "th")
    first = behind(ws, name + 1, ",", ".")
    american = behind(ws, behind(ws, k + 2, "st", "nd", "rd", "th"), ",")
    same = F.coalesce(at(ws, k + 1) == at(ws, k + 3), F.lit(False))
    return (
        F.when(digits(ws, k, 4, 4) & said(ws, k + 1, "-") & same & digits(ws, k + 2, 2, 2) & digits(ws, k + 4, 2, 2), k + 5)
        .when(digits(ws, k, 1, 2) & said(ws, k + 1, "/", "-", ".") & same & digits(ws, k + 2, 1, 2) & digits(ws, k + 4, 4, 4), k + 5)
        .when(digits(ws, k, 1, 2) & is_month(ws, name, months) & digits(ws, first, 4, 4), first + 1)
        .when(is_month(ws, k, months) & digits(ws, k + 1, 1, 2) & digits(ws, american, 4, 4), american + 1)
    )


def spans(ws: Column, begin: Callable[[Column], Column], end: Callable[[Column], Column], value: Callable[[Column], Column] | None = None) -> Column:
    """(a, b, v) in pieces for every place at which a reader finds something: from where, up to behind what, and what is made of it."""

    def one(k: Column) -> Column:
        e = end(k)
        return F.struct(F.get(ws, begin(k))["i"].alias("a"), (F.get(ws, e - 1)["i"] + 1).alias("b"), (value(k) if value else F.lit(None).cast("string")).alias("v"))

    return F.filter(F.transform(places(ws), one), lambda s: s["a"].isNotNull() & s["b"].isNotNull())


def rewritten(text: Column, find: Callable[[Column, Column], Column], put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with every piece inside a span replaced by ``put(piece, place, span)``; ``find(pieces, words)`` gives the spans."""

    def built(ps: Column, ss: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            inside = F.filter(ss, lambda s: (s["a"] <= i) & (i < s["b"]))
            return F.when(F.size(inside) > 0, put(p, i, F.get(inside, F.lit(0)))).otherwise(p)

        return F.array_join(F.transform(ps, piece), "")

    return let(pieces(text), lambda ps: let(words(ps), lambda ws: let(find(ps, ws), lambda ss: built(ps, ss))))


def blanked(text: Column, find: Callable[[Column, Column], Column]) -> Column:
    """Spans blanked, every other character at its place."""
    return rewritten(text, find, lambda p, i, s: F.repeat(F.lit(" "), F.length(p)))
