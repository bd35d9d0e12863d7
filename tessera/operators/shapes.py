"""Named analytic shapes, answered for all clients (or people) in one job.

Each takes entity views and gives (key, answer).  A portfolio without works
has no row, which stands for an unknown answer, not for 0; within a portfolio an
empty conditional sum is 0 where the shape says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .algebra import percent


def _sum_where(condition: Column, field: str = "value") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(field))), F.lit(0))


def _same(name: str, value: str) -> Column:
    return F.lower(F.trim(F.col(name))) == value.strip().lower()


def absence(work: DataFrame, category: str | None = None) -> DataFrame:
    rows = work if category is None else work.filter(loose_category("category", category))
    return rows.groupBy("client").agg(F.count_if(~F.col("has_ref")).alias("answer"))


def loose_category(name: str, value: str) -> Column:
    """Either contains the other, without a final s."""
    have, want = F.regexp_replace(F.lower(F.trim(F.col(name))), "s$", ""), F.lit(value.strip().lower().removesuffix("s"))
    return F.contains(have, want) | F.contains(want, have)


def referenced_share(work: DataFrame, category: str | None = None) -> DataFrame:
    rows = work if category is None else work.filter(loose_category("category", category))
    return rows.groupBy("client").agg(percent(F.count_if("has_ref"), F.count("*")).alias("answer"))


def rank_value(work: DataFrame) -> DataFrame:
    """Largest minus second largest; ties give 0, a single work null."""
    rank = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("value"), "work_id"))
    top = work.select("client", "value", "work_id").withColumn("rank", rank).filter("rank <= 2")
    return top.groupBy("client").agg((F.max(F.when(F.col("rank") == 1, F.col("value"))) - F.max(F.when(F.col("rank") == 2, F.col("value")))).alias("answer"))


def threshold_aggregate(work: DataFrame, bar: int) -> DataFrame:
    return work.groupBy("client").agg(_sum_where(F.col("value") >= bar).alias("answer"))


def gap_to_threshold(work: DataFrame, bar: int) -> DataFrame:
    return work.groupBy("client").agg(F.greatest(F.lit(0).cast("bigint"), F.lit(bar).cast("bigint") - F.sum("value")).alias("answer"))


def exclusion_aggregate(work: DataFrame, categories: list[str]) -> DataFrame:
    """Everything but the categories; works without a category are kept."""
    named = F.lower(F.trim("category")).isin([c.strip().lower() for c in categories])
    return work.groupBy("client").agg(_sum_where(~F.coalesce(named, F.lit(False))).alias("answer"))


def doc_filtered_aggregate(work: DataFrame, column: str, value: str) -> DataFrame:
    return work.groupBy("client").agg(_sum_where(_same(column, value)).alias("answer"))


def role_split(work: DataFrame, role: str) -> DataFrame:
    return doc_filtered_aggregate(work, "role", role)


def avg_work_size(work: DataFrame) -> DataFrame:
    return work.groupBy("client").agg(F.bround(F.sum("value").cast("double") / F.count("value"), 0).cast("bigint").alias("answer"))


def client_total(work: DataFrame) -> DataFrame:
    return work.groupBy("client").agg(F.sum("value").alias("answer"))


def hop_aggregate(work: DataFrame, portfolio: DataFrame | None = None) -> DataFrame:
    """Person, client of their first led work, that client's whole portfolio; ``portfolio``: the same works without who led them, where that is cheaper."""
    first = work.filter("lead is not null").groupBy("lead").agg(F.min_by("client", "work_id").alias("client"))
    return first.join(client_total(work if portfolio is None else portfolio), "client").select("lead", "answer")


def ledger_total(invoice: DataFrame, column: str) -> DataFrame:
    return invoice.groupBy("client").agg(F.sum(column).alias("answer"))


def outstanding_balance(invoice: DataFrame) -> DataFrame:
    return invoice.groupBy("client").agg((F.sum("invoiced") - F.sum("received")).alias("answer"))


def collection_pct(invoice: DataFrame) -> DataFrame:
    return invoice.groupBy("client").agg(percent(F.sum("received"), F.sum("invoiced")).alias("answer"))


def year_delta(work: DataFrame, first: int, second: int) -> DataFrame:
    """Absolute change; a year without works counts 0."""
    answer = F.abs(_sum_where(F.col("year") == second) - _sum_where(F.col("year") == first))
    return work.groupBy("client").agg(answer.alias("answer"))


def year_total(work: DataFrame, year: int) -> DataFrame:
    """Total of a year; 0 means unknown."""
    return work.groupBy("client").agg(F.nullif(_sum_where(F.col("year") == year), F.lit(0).cast("bigint")).alias("answer"))


def unbilled_gap(work: DataFrame, invoice: DataFrame) -> DataFrame:
    awarded, billed = work.groupBy("client").agg(F.sum("value").alias("a")), invoice.groupBy("client").agg(F.sum("invoiced").alias("b"))
    return awarded.join(billed, "client", "left").select("client", F.when(F.col("a") != 0, F.abs(F.col("a") - F.coalesce("b", F.lit(0)))).alias("answer"))


def mean_median_gap(work: DataFrame, absolute: bool = False) -> DataFrame:
    gap = F.bround(F.sum("value").cast("double") / F.count("value") - F.median("value"), 0).cast("bigint")
    gap = F.abs(gap) if absolute else gap
    return work.groupBy("client").agg(F.when(F.count("value") >= 2, gap).alias("answer"))


def category_delta(work: DataFrame, one: str, other: str) -> DataFrame:
    return work.groupBy("client").agg(F.abs(_sum_where(_same("category", one)) - _sum_where(_same("category", other))).alias("answer"))


def temporal_chain(work: DataFrame, credential: DataFrame) -> DataFrame:
    """Value of the works a person led that were completed after their credential."""
    issued = credential.groupBy("name").agg(F.min("issued").alias("issued"))
    led = work.join(issued, F.col("lead") == F.col("name"))
    return led.groupBy("lead").agg(_sum_where(F.col("completed") > F.col("issued")).alias("answer"))


def distinct_count(work: DataFrame) -> DataFrame:
    return work.groupBy("client").agg(F.countDistinct(F.lower(F.trim("category"))).alias("answer"))


def work_total(work: DataFrame) -> DataFrame:
    """Work, its client, that client's whole portfolio."""
    return work.select("work_id", "client").join(client_total(work), "client").select("work_id", "answer")


def date_span(work: DataFrame, credential: DataFrame, title: str | None = None) -> DataFrame:
    """Days between a person's credential and the named work, else the last work they led."""
    issued = credential.groupBy("name").agg(F.min("issued").alias("issued"))
    work = work if title is None else work.filter(F.col("work") == title)
    last = work.filter("lead is not null").groupBy("lead").agg(F.max("completed").alias("done"))
    return last.join(issued, F.col("lead") == F.col("name")).select("lead", F.abs(F.datediff("done", "issued")).cast("bigint").alias("answer"))


SHAPES = {
    f.__name__: f
    for f in (
        absence, referenced_share, rank_value, threshold_aggregate, gap_to_threshold, exclusion_aggregate, doc_filtered_aggregate, avg_work_size,
        role_split, hop_aggregate, client_total, outstanding_balance, collection_pct, year_delta, year_total, unbilled_gap, mean_median_gap,
        category_delta, temporal_chain, distinct_count, date_span,
    )
} | {"invoiced_total": lambda invoice: ledger_total(invoice, "invoiced"), "received_total": lambda invoice: ledger_total(invoice, "received")}
