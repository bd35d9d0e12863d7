"""From text to rows: lines, blocks, labels, sections and runs of lines.

All state is per document: windows are partitioned by the document's id, and
folds run inside one row's array, so nothing is ordered across documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ahead: int = 0) -> DataFrame:
    """(doc, pos, line, next_1 ... next_ahead): positions from 0; the lines ahead come from the same row, so nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc"), F.split(text_col, "\n").alias("__l"))
    if not ahead:
        return rows.select("doc", F.posexplode("__l").alias("pos", "line"))
    near = lambda x, i: F.struct(x.alias("line"), *[F.get("__l", i + k).alias(f"next_{k}") for k in range(1, ahead + 1)])
    return rows.select("doc", F.posexplode(F.transform("__l", near)).alias("pos", "x")).select("doc", "pos", "x.*")


def sections(docs: DataFrame, header: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, line, section, block): the last header at or above each line, and how many there are.

    The places of the headers part each text into slices within its own row: no shuffle, no sort, and
    time in proportion to the text.
    """
    heads = lambda x: F.coalesce(header(x), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc"), F.split(text_col, "\n").alias("__l")).filter("__l is not null")
    places = F.filter(F.transform("__l", lambda x, i: F.when(heads(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__h", places).withColumn("__at", F.array_union(F.array(F.lit(0)), "__h"))
    slices = F.transform("__at", lambda i, k: F.struct(i.alias("start"), F.slice("__l", i + 1, F.coalesce(F.get("__at", k + 1), F.size("__l")) - i).alias("part")))
    first = F.coalesce(F.get("__h", F.lit(0)) == 0, F.lit(False)).cast("long")
    parts = rows.select("doc", first.alias("first"), F.posexplode(slices).alias("k", "s")).select("doc", (F.col("k") + F.col("first")).alias("block"), "s.start", "s.part")
    section = F.when(F.col("block") > 0, F.trim(F.get("part", F.lit(0))))
    out = parts.select("doc", "block", section.alias("section"), "start", F.posexplode("part").alias("p", "line"))
    return out.select("doc", (F.col("start") + F.col("p")).alias("pos"), "line", "section", "block")


def _order() -> Window:
    return Window.partitionBy("doc").orderBy("pos")


def next_lines(rows: DataFrame, *steps: int) -> DataFrame:
    return rows.withColumns({f"next_{k}": F.lead("line", k).over(_order()) for k in steps})


def label_values(rows: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(doc, field, value): the next non-empty line within two, first occurrence wins.  Synonyms are a fixed list."""
    names = F.create_map(*[F.lit(v) for kv in synonyms.items() for v in kv])
    key = F.regexp_replace(F.lower(F.trim("line")), r"\s*:\s*$", "")
    near = F.array(F.trim("next_1"), F.trim("next_2"))
    near_by = rows if {"next_1", "next_2"} <= set(rows.columns) else next_lines(rows, 1, 2)
    found = near_by.select("doc", "pos", F.try_element_at(names, key).alias("field"), F.get(F.filter(near, lambda x: F.length(x) > 0), F.lit(0)).alias("value"))
    return found.filter("field is not null and value is not null").groupBy("doc", "field").agg(F.min_by("value", "pos").alias("value"))


def blocks(rows: DataFrame, heading: Column) -> DataFrame:
    """Block number per line: how many headings stand at or above it; 0 before the first."""
    return rows.withColumn("block", F.sum(F.coalesce(heading, F.lit(False)).cast("long")).over(_order()))


def asof_section(rows: DataFrame, header: Column) -> DataFrame:
    """The last header at or above each line."""
    return rows.withColumn("section", F.last(F.when(header, F.trim("line")), ignorenulls=True).over(_order()))


def run_of_lines(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows where consecutive lines match the patterns, one column per line."""
    out = next_lines(rows, *range(1, len(patterns))).withColumnRenamed("line", "next_0")
    for k, p in enumerate(patterns):
        out = out.filter(F.regexp_like(F.col(f"next_{k}"), F.lit(p)))
    return out.select("doc", "pos", *[F.trim(f"next_{k}").alias(f"field_{k}") for k in range(len(patterns))])


def serial_rows(docs: DataFrame, statuses: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, status): a line equal to the next expected number opens a row, the next status closes it.  A fold over each document's lines."""
    known = F.array(*[F.lit(s.lower()) for s in statuses])
    empty = F.array().cast("array<struct<n:int,status:string>>")
    start = F.struct(F.lit(1).alias("n"), F.lit(False).alias("open"), empty.alias("rows"))

    def step(acc: Column, line: Column) -> Column:
        text = F.lower(F.trim(line))
        opens = ~acc["open"] & (text == acc["n"].cast("string"))
        closes = acc["open"] & F.array_contains(known, text)
        row = F.struct(acc["n"].alias("n"), F.trim(line).alias("status"))
        return F.struct(
            F.when(closes, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(acc["open"]).alias("open"),
            F.when(closes, F.array_append(acc["rows"], row)).otherwise(acc["rows"]).alias("rows"),
        )

    folded = F.aggregate(F.split(text_col, "\n"), start, step, lambda acc: acc["rows"])
    return docs.select(F.col(id_col).alias("doc"), F.explode(folded).alias("r")).select("doc", "r.n", "r.status")


def statement_rows(rows: DataFrame, key: str, order: str, amount: str, balance: str, opening: str) -> DataFrame:
    """Deposits and withdrawals told apart by which way the running balance went."""
    before = F.coalesce(F.lag(balance).over(Window.partitionBy(key).orderBy(order)), F.col(opening))
    up = F.col(balance) >= before
    return rows.withColumn("deposit", F.when(up, F.col(amount)).otherwise(0)).withColumn("withdrawal", F.when(up, 0).otherwise(F.col(amount)))


def without_totals(df: DataFrame, column: str) -> DataFrame:
    """Summary rows go: their number column holds no number."""
    return df.filter(F.col(column).try_cast("int").isNotNull())


def doc_type(doc_id: Column, prefixes: dict[str, str]) -> Column:
    """Type by id prefix, the longest prefix first."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(doc_id, F.lit(p)), prefixes[p]).otherwise(out)
    return out


def token_weights(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, df, weight): in how many documents a token stands, and 1 / df."""
    tokens = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.split(F.lower(text_col), r"[^a-z0-9]+"))).alias("token")).filter("token <> ''")
    return tokens.groupBy("token").agg(F.countDistinct("doc").alias("df")).withColumn("weight", 1 / F.col("df"))
