"""An index of what tables say: from words to the values that hold them.

Every string column of every table is looked through by Spark, however many values it has and
however long they are.  Three tables result:

* ``whole``: a value's words in order, to the value;
* ``parts``: runs of two to six words that stand in one value of a column alone;
* ``held``: single words, to the values that hold them, with the number of values that do.

Questions are looked up by joins on their own runs and words, so what the driver gets is bounded by
what is asked, not by the store: values that are said, and the ``CANDIDATES`` names a question that share most with it.
An index that isn't written isn't built for ``said`` either: one pass over the tables leaves the values that share two
words in a row with a question (or are its word), and only these are told apart.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import settled

RUN_WORDS = 6  # a longer run holds runs of this length
CANDIDATES = 50  # names of one column that a question is compared with: those that share most of its words
SMALL = ("of", "the", "and", "in", "for", "at", "to", "a", "an", "our", "us", "we", "on", "by", "with")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "&", " and "), F.lit("[a-z0-9]+"), 0)


def runs(words: Column, least: int, most: Column | int) -> Column:
    """All unbroken runs of a list of words with these lengths, joined by spaces."""
    size = F.size(words)
    lengths = F.sequence(F.lit(least), F.least(size, F.lit(most) if isinstance(most, int) else most))
    of_length = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size >= least, F.array_distinct(F.flatten(F.transform(lengths, of_length)))).otherwise(F.array().cast("array<string>"))


def openings(words: Column) -> Column:
    """What every run of a list of words begins with: two neighbours; a single word is its own."""
    pairs = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))
    return F.when(F.size(words) > 1, pairs(words)).otherwise(words)


@dataclass(frozen=True)
class ValueIndex:
    whole: DataFrame
    parts: DataFrame
    held: DataFrame
    every: DataFrame | None = None  # (table, column, value) of all rows, where the index isn't written

    @classmethod
    def of(cls, tables: dict[str, DataFrame], path: str | None = None) -> ValueIndex:
        """The index of these tables; written to ``path`` (a shared folder) and read back where one is given."""
        columns = {name: [c for c, t in df.dtypes if t == "string" and c != "doc"] for name, df in sorted(tables.items())}
        stacked = [
            tables[name].select(F.explode(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).alias("value")) for c in cs])).alias("x")).select("x.*")
            for name, cs in columns.items() if cs
        ]
        if not stacked:
            raise ValueError("no table has a column of strings")
        every = stacked[0]
        for more in stacked[1:]:
            every = every.unionByName(more)
        every = every.filter(F.length("value") >= 2)
        values = _worded(every.distinct())
        if path is None:
            return cls(*cls._told_apart(values), every)
        whole, parts, held = cls._told_apart(_kept(values, f"{path}/values"))
        return cls(*(_kept(df, f"{path}/{n}") for df, n in ((whole, "whole"), (parts, "parts"), (held, "held"))))

    @staticmethod
    def _told_apart(values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``whole``, ``parts`` and ``held`` of distinct values (table, column, value, words)."""
        whole = values.select("table", "column", F.array_join("words", " ").alias("run"), "value")
        told = values.select("table", "column", "value", F.explode(runs(F.col("words"), 2, RUN_WORDS)).alias("run"))
        small = F.array(*map(F.lit, SMALL))
        one = told.groupBy("table", "column", "run").agg(F.count("*").alias("n"), F.min("value").alias("value")).filter((F.col("n") == 1) & (F.size(F.array_except(F.split("run", " "), small)) > 0)).drop("n")
        parts = one.join(whole.select("table", "column", "run").distinct(), ["table", "column", "run"], "left_anti")
        word = values.select("table", "column", "value", F.explode(F.array_distinct("words")).alias("word"))
        counts = word.groupBy("table", "column", "word").agg(F.count("*").alias("n"))
        return whole, parts, word.join(counts, ["table", "column", "word"])

    def _of_openings(self, asked: DataFrame) -> ValueIndex:
        """The index of the values that share an opening with a question (q, words): a run that a question says has one, so
        all values that hold the run are there and what is said of it is the same as in the whole index."""
        if self.every is None:
            return self
        opened = asked.select(F.explode(runs(F.col("words"), 1, 2)).alias("opening")).distinct()
        rows = _worded(self.every.distinct()).select("table", "column", "value", F.explode(openings(F.col("words"))).alias("opening"))
        values = rows.join(F.broadcast(opened), "opening", "left_semi").select("table", "column", "value").distinct()  # openings: of what is asked alone
        return ValueIndex(*self._told_apart(settled(_worded(values))))

    def _asked(self, questions: Iterable[str]) -> DataFrame:
        spark = self.whole.sparkSession
        return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "q int, question string").withColumn("words", word_list(F.col("question")))

    def hits(self, questions: DataFrame) -> DataFrame:
        """(q, table, column, run, value, whole) of every value, or part of one alone, that a question (q, words) says."""
        asked = questions.select("q", F.explode(runs(F.col("words"), 1, F.size("words"))).alias("run"))
        known = self.whole.withColumn("whole", F.lit(True)).unionByName(self.parts.withColumn("whole", F.lit(False)))
        return asked.join(known, "run").select("q", "table", "column", "run", "value", "whole")

    def said(self, questions: Iterable[str]) -> tuple[dict[str, dict[str, dict[str, str]]], dict[str, list[tuple[str, str, str]]]]:
        """What the questions say: table to column to lower-case value to spelling; and (run, column, value) of telling parts by table."""
        values: dict[str, dict[str, dict[str, str]]] = {}
        parts: dict[str, list[tuple[str, str, str]]] = {}
        asked = self._asked(questions)
        for r in sorted(self._of_openings(asked).hits(asked).select("table", "column", "value", "run", "whole").distinct().collect()):
            if r["whole"]:
                values.setdefault(r["table"], {}).setdefault(r["column"], {})[r["value"].lower()] = r["value"]
            else:
                parts.setdefault(r["table"], []).append((r["run"], r["column"], r["value"]))
        return values, parts

    def alike(self, questions: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
        """(q, table, column, value, weight): the names of these columns that share most words with a question (q, words), rare words weighing more."""
        small = F.array(*map(F.lit, SMALL))
        asked = questions.select("q", F.explode(F.array_except(F.array_distinct("words"), small)).alias("word"))
        wanted = F.lit(False)
        for t, c in columns:
            wanted = wanted | ((F.col("table") == t) & (F.col("column") == c))
        weights = asked.join(self.held.filter(wanted), "word").groupBy("q", "table", "column", "value").agg(F.sum(1 / F.col("n")).alias("weight"))
        best = F.row_number().over(Window.partitionBy("q", "table", "column").orderBy(F.desc("weight"), "value"))
        return weights.withColumn("r", best).filter(F.col("r") <= CANDIDATES).drop("r")

    def names(self, questions: Iterable[str], columns: list[tuple[str, str]]) -> tuple[dict[tuple[str, str], tuple[str, ...]], dict[tuple[str, str], dict[str, int]]]:
        """Candidates of these columns for all questions, and in how many values of the column each of their words stands."""
        found = self.alike(self._asked(questions), columns).select("table", "column", "value").distinct()
        rows = found.join(self.held, ["table", "column", "value"]).select("table", "column", "value", "word", "n").collect()
        names: dict[tuple[str, str], set[str]] = {}
        counts: dict[tuple[str, str], dict[str, int]] = {}
        for r in rows:
            key = (r["table"], r["column"])
            names.setdefault(key, set()).add(r["value"])
            counts.setdefault(key, {})[r["word"]] = r["n"]
        return {k: tuple(sorted(v)) for k, v in names.items()}, counts


def _worded(values: DataFrame) -> DataFrame:
    return values.withColumn("words", word_list(F.col("value"))).filter(F.size("words") > 0)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
