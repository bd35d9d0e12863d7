"""Printed forms as columns and rows, read by declaration.

Three readers cover what office documents print.  A *sentence* is a template with typed holes
(``"valid from {date} until {=date}"``) that is looked for in the text with white space
collapsed, or on one line.  A value *below* stands on the line under its label.  A *run* is a table
that was printed one cell a line: consecutive lines whose types are those of the columns.  All are
native expressions over the text, inside one row: nothing is shuffled, no line is lost to a
pattern's greed, and a template says what is looked for without saying how.

A hole is ``{kind}``, or ``{=kind}`` where its value is wanted; a kind that ends with a dash
is a number behind that prefix (``{=RFP-}``).  ``[a|b|]`` are alternatives, ``~`` is white
space that may be missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import norm

_UNITS = "|".join(sorted(norm.UNITS, key=len, reverse=True))
_DIGITS = r"\d[\d,]*(?:\.\d+)?"
_MONTH_DAY_YEAR = r"\p{L}{3,9}\.? \d{1,2},? \d{4}"
_DAY_MONTH_YEAR = r"\d{1,2} \p{L}{3,9}\.?,? \d{4}"
#: How a value of each kind is printed.
SHAPES = {
    "money": rf"(?:inr|rs\.?|₹)\s*-?{_DIGITS}(?:\s*(?:{_UNITS})\b)?",
    "date": rf"(?:\d{{4}}-\d\d-\d\d|\d\d?[/.]\d\d?[/.]\d{{4}}|{_DAY_MONTH_YEAR}|{_MONTH_DAY_YEAR})",
    "spelt date": _DAY_MONTH_YEAR,
    "int": r"\d[\d,]*",
    "year": r"\d{4}",
    "double": _DIGITS,
    "figure": r"\(?-?\d[\d,]*\)?",
    "code": r"[\p{L}\d](?:[\w/:.&-]*[\w])?",
    "word": r"\p{L}+",
    "words": r"\p{L}[\p{L}& ]*?",
    "person": r"(?-i:\p{Lu}[\p{L}.]*(?: \p{Lu}[\p{L}.]*)? \p{Lu}[\p{L}.]*\p{L})",
    "text": r"\S.*?",
}
_TOKEN = re.compile(r"\{(=?)([^}]+)\}|\[([^\]]*)\]|(\s+)|(~)|([^\s{\[~]+)")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used: as the only element of an array."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _alternatives(inside: str) -> str:
    return "(?:" + "|".join(r"\s+".join(_literal(w) for w in part.split()) for part in inside.split("|")) + ")"


def pattern(template: str, kinds: dict[str, str] | None = None) -> str:
    """Regular expression of a template; its one wanted hole is the only group."""
    shapes, out, tokens = SHAPES | (kinds or {}), [], list(_TOKEN.finditer(template))
    hole = lambda m: m is not None and m.group(2) is not None
    for i, m in enumerate(tokens):
        wanted, kind, options, space, maybe, word = m.groups()
        if kind:
            shape = _literal(kind) + r"\d+" if kind.endswith("-") else shapes[kind]
            out.append(f"({shape})" if wanted else f"(?:{shape})")
        elif options is not None:
            out.append(_alternatives(options))
        elif maybe:
            out.append(r"\s*")
        elif space:
            before, behind = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
            if hole(behind):
                out.append(r"\s*:?\s*" if before and before.group(6) else r"\s+" if hole(before) else r"\s*")
            else:
                out.append(r"\s+" if before and before.group(6) else r"\s*")
        else:
            out.append(_literal(word))
    start = r"(?<![\p{L}\d])" if tokens and not tokens[0].group(6) or template[:1].isalnum() else ""
    end = r"(?![\p{L}\d])" if template[-1:].isalnum() or hole(tokens[-1]) else ""
    return f"(?iu){start}{''.join(out)}{end}"


class Page:
    """What the readers of one document share: columns that ``paged`` has made."""

    text = property(lambda self: F.col("text"))
    flat = property(lambda self: F.col("flat"))
    lines = property(lambda self: F.col("lines"))  # trimmed
    bare = property(lambda self: F.col("bare"))  # in lower case and without a colon behind


Reader = Callable[[Page], Column]
PAGE = Page()


def paged(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that the readers share, made once per document: they stand in projections of their own."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    bare = F.transform("lines", lambda x: F.lower(F.rtrim(F.regexp_replace(x, ":$", ""))))
    return docs.withColumns({"flat": norm.flat(F.col("text")), "lines": lines}).withColumn("bare", bare)


def _stated(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def says(*templates: str, kinds: dict[str, str] | None = None) -> Reader:
    """The wanted hole of the first template that is found in the running text."""
    patterns = [pattern(t, kinds) for t in templates]
    return lambda p: F.coalesce(*[_stated(F.regexp_extract(p.flat, x, 1)) for x in patterns])


def every(template: str) -> Reader:
    """All values of the wanted hole."""
    return lambda p: F.regexp_extract_all(p.flat, F.lit(pattern(template)), 1)


def on_line(*templates: str) -> Reader:
    """The same on a line of its own."""
    patterns = [pattern(t) for t in templates]

    def read(p: Page) -> Column:
        def found(q: str) -> Column:
            hits = F.transform(p.lines, lambda x: _stated(F.regexp_extract(x, f"^{q}$", 1)))
            return F.get(F.filter(hits, lambda v: v.isNotNull()), F.lit(0))

        return F.coalesce(*[found(q) for q in patterns])

    return read


def below(*labels: str, within: int = 2) -> Reader:
    """The first line with something on it, of the ``within`` lines under the first of the labels that stands on a line of its own."""

    def read(p: Page) -> Column:
        def under(at: Column) -> Column:
            return F.when(at > 0, F.get(F.filter(F.slice(p.lines, F.greatest(at, F.lit(0)) + 1, F.lit(within)), lambda x: x != ""), F.lit(0)))

        return F.coalesce(*[bound(F.array_position(p.bare, label.rstrip(":").lower()).cast("int"), under) for label in labels])

    return read


def first_line(until: str = "·") -> Reader:
    return lambda p: _stated(F.substring_index(F.get(F.filter(p.lines, lambda x: x != ""), F.lit(0)), until, 1))


def line_with(word: str, longest: int = 60) -> Reader:
    """The first short line of words alone that holds the word."""
    of_words = r"^\p{Lu}[\p{L} &.]*$"

    def read(p: Page) -> Column:
        return F.get(F.filter(p.lines, lambda x: F.contains(x, F.lit(word)) & (F.length(x) <= longest) & F.regexp_like(x, F.lit(of_words))), F.lit(0))

    return read


def first(*readers: Reader) -> Reader:
    return lambda p: F.coalesce(*[r(p) for r in readers])


# ---------------------------------------------------------------- values


def typed(value: Column, kind: str) -> Column:
    """Text of a value as its type; unreadable text is null.  The value is found once, however often its type looks at it."""
    plain = lambda v: F.regexp_replace(v, ",", "")
    read: dict[str, Callable[[Column], Column]] = {
        "text": norm.flat, "int": lambda v: plain(v).try_cast("int"), "double": lambda v: plain(v).try_cast("double"),
        "leading int": lambda v: F.regexp_extract(v, r"^\D*(\d+)", 1).try_cast("int"), "money": norm.money, "number": norm.number,
        "magnitude": lambda v: F.abs(norm.number(v)), "unbracketed": lambda v: norm.number(F.translate(v, "()", "")), "date": norm.parse_date,
    }
    return bound(_stated(value), read[kind])


# ---------------------------------------------------------------- runs of lines

_FITS: dict[str, Callable[[Column], Column]] = {
    "serial": lambda x: F.regexp_like(x, F.lit(r"^\d{1,4}$")),
    "figure": lambda x: F.regexp_like(x, F.lit(r"^\(?-?\d[\d,]*\)?$")),
    "quantity": lambda x: F.regexp_like(x, F.lit(rf"^-?{_DIGITS}$")),
    "percent": lambda x: F.regexp_like(x, F.lit(rf"^-?{_DIGITS}\s*%$")),
    "money": lambda x: F.regexp_like(x, F.lit(rf"(?i)^(?:inr|rs\.?|₹)?\s*-?{_DIGITS}\s*(?:{_UNITS})?$")) & F.regexp_like(x, F.lit(r"\p{L}|₹")),
    "date": lambda x: (F.length(x) <= 20) & norm.parse_date(x).isNotNull(),
    "fiscal": lambda x: F.regexp_like(x, F.lit(r"^\d{4}\s*[–-]\s*\d\d$")),
    "any": lambda x: x != "",
    "contract": lambda x: F.regexp_like(x, F.lit(r"^#\d+$")),
    "share": lambda x: F.regexp_like(x, F.lit(r"^\d+/\d+$")),
    "quarter": lambda x: F.regexp_like(x, F.lit(r"^Q[1-4]\s*FY\s*\d{4}")),
    "side": lambda x: F.lower(x).isin("dr", "cr"),
}
_READS = {
    "serial": "int", "figure": "number", "magnitude": "magnitude", "unbracketed": "unbracketed", "quantity": "double", "percent": "leading double", "money": "money", "date": "date",
    "fiscal": "leading int", "contract": "leading int",
}


def _is_text(x: Column) -> Column:
    """A line of words: it has a letter and is no figure, date or amount."""
    return F.regexp_like(x, F.lit(r"\p{L}")) & ~_FITS["money"](x) & ~_FITS["date"](x)


@dataclass(frozen=True)
class Cell:
    """One column of a run: its name and what its line must be; ``one of`` and ``prefix`` narrow texts."""

    name: str
    kind: str
    one_of: tuple[str, ...] = ()
    prefix: str = ""

    def fits(self, x: Column) -> Column:
        if self.one_of:
            return F.lower(x).isin(*[v.lower() for v in self.one_of])
        if self.prefix:
            return F.startswith(x, F.lit(self.prefix)) & F.regexp_like(x, F.lit(r"\d"))
        return {"text": _is_text, "magnitude": _FITS["figure"], "unbracketed": _FITS["figure"]}.get(self.kind, _FITS.get(self.kind, _is_text))(x)

    def read(self, x: Column) -> Column:
        kind = _READS.get(self.kind, "text")
        if kind == "leading double":
            return F.regexp_extract(x, rf"(-?{_DIGITS})", 1).try_cast("double").alias(self.name)
        return typed(x, kind).alias(self.name)


def cells(**kinds: str | tuple[str, ...]) -> tuple[Cell, ...]:
    """Cells by name: a kind, a tuple of the only texts, or ``prefix:X``."""
    made = []
    for name, kind in kinds.items():
        if isinstance(kind, tuple):
            made.append(Cell(name, "text", one_of=kind))
        elif kind.startswith("prefix:"):
            made.append(Cell(name, "text", prefix=kind.removeprefix("prefix:")))
        else:
            made.append(Cell(name, kind))
    return tuple(made)


def between(lines: Column, start: str, end: str | None) -> Column:
    """The lines behind the first one that holds ``start``, up to the next that holds ``end``; a mark behind = is the whole line."""
    holds = lambda mark: lambda x: x == mark[1:] if mark[0] == "=" else F.contains(x, F.lit(mark))
    place = lambda rows, mark: F.array_position(F.transform(rows, holds(mark)), True).cast("int")
    rest = bound(place(lines, start), lambda at: F.when(at > 0, F.slice(lines, at + 1, F.size(lines))))
    if end is None:
        return rest
    return bound(rest, lambda r: bound(place(r, end), lambda stop: F.when(stop > 0, F.slice(r, F.lit(1), stop - 1)).otherwise(r)))


def run_starts(lines: Column, columns: tuple[Cell, ...], not_then: str | None = None) -> Column:
    """Where consecutive lines fit all columns; ``not_then``: the line behind them must not be of that kind."""
    last = F.size(lines) - len(columns)
    tests = [lambda i, k=k, c=c: F.coalesce(c.fits(F.get(lines, i + k)), F.lit(False)) for k, c in enumerate(columns)]
    if not_then:
        tests.append(lambda i: ~F.coalesce(_FITS[not_then](F.get(lines, i + len(columns))), F.lit(False)))
    every_start = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(every_start, lambda i: reduce(lambda a, b: a & b, [t(i) for t in tests]))


def runs(lines: Column, columns: tuple[Cell, ...], not_then: str | None = None) -> Column:
    """array<struct<pos, columns...>> of all runs, in order."""
    return F.transform(run_starts(lines, columns, not_then), lambda i: F.struct(i.alias("pos"), *[c.read(F.get(lines, i + k)) for k, c in enumerate(columns)]))


def parts(lines: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """array<array<string>>: from each line that opens a part up to the next one; opens: of a line and its place."""
    size = F.size(lines)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.coalesce(opens(F.get(lines, i), i), F.lit(False)))
    return bound(found, lambda at: F.transform(at, lambda i, k: F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), size) - i)))


def serial_parts(lines: Column) -> Column:
    """array<array<string>>: a line that is the next expected number, from 1, opens a part.  Only the places are folded up."""
    start = F.struct(F.lit(1).alias("n"), F.array().cast("array<int>").alias("at"))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def step(acc: Column, line: Column) -> Column:
        opens = line["x"] == acc["n"].cast("string")
        return F.struct(F.when(opens, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(opens, F.array_append(acc["at"], line["i"])).otherwise(acc["at"]).alias("at"))

    found = F.aggregate(numbered, start, step, lambda acc: acc["at"])
    return bound(found, lambda at: F.transform(at, lambda i, k: F.slice(lines, i + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - i - 1)))


def labelled(part: Column, label: str, within: int = 2) -> Column:
    """The value under a label within a part; a value whose parenthesis is open goes on over the next lines."""
    opened = lambda x: F.length(F.translate(x, "(", "")) < F.length(F.translate(x, ")", ""))
    place = lambda rows, test: F.array_position(F.transform(rows, test), True).cast("int")

    def value(behind: Column) -> Column:
        return bound(place(F.slice(behind, 1, within), lambda x: x != ""), lambda at: F.when(at > 0, F.aggregate(
            F.slice(behind, at + 1, F.size(behind)), F.get(behind, at - 1), lambda acc, x: F.when(opened(acc) & (x != ""), F.concat(acc, F.lit(" "), x)).otherwise(acc))))

    return bound(place(part, lambda x: F.lower(x) == label.lower()), lambda at: F.when(at > 0, bound(F.slice(part, at + 1, F.size(part)), value)))
