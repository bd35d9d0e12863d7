"""Checks of results against themselves and against second sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(a: DataFrame, b: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, field, left, right) of every disagreement beyond the field's tolerance, and of keys that one side lacks.

    A field that is null on either side isn't compared.
    """
    left = a.select(F.col(key), F.lit(True).alias("__a"), *[F.col(f).alias(f"{f}__a") for f in fields])
    right = b.select(F.col(key), F.lit(True).alias("__b"), *[F.col(f).alias(f"{f}__b") for f in fields])
    both = left.join(right, key, "full")
    tests = [F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.struct(F.lit("(row)").alias("field"), F.col("__a").cast("string").alias("left"), F.col("__b").cast("string").alias("right")))]
    for f, tolerance in fields.items():
        x, y = F.col(f"{f}__a"), F.col(f"{f}__b")
        differs = F.abs(x.cast("double") - y.cast("double")) > tolerance if tolerance else x.cast("string") != y.cast("string")
        tests.append(F.when(differs, F.struct(F.lit(f).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    return both.select(key, F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("d")).select(key, "d.*")


def violations(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """(constraint, checked, violated): null isn't checked.  One pass for all constraints."""
    sums = []
    for name, holds in constraints.items():
        sums.append(F.struct(F.lit(name).alias("constraint"), F.count(holds).alias("checked"), F.count_if(~holds).alias("violated")))
    return df.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, stated) in one pass."""
    sums = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("stated")) for c in columns]
    return df.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def score(got: Column, gold: Column) -> Column:
    """1 minus the relative error, at least 0; a gold of 0 must be met exactly, no answer scores 0."""
    relative = F.greatest(F.lit(0.0), 1 - F.abs(got - gold) / F.nullif(F.abs(gold), F.lit(0.0)))
    return F.when(got.isNull() | gold.isNull(), 0.0).when(gold == 0, (got == 0).cast("double")).otherwise(relative)


def census(df: DataFrame, column: str, pinned: dict[str, int]) -> DataFrame:
    """Groups whose size isn't the pinned one."""
    counts = df.groupBy(column).agg(F.count("*").alias("found"))
    want = df.sparkSession.createDataFrame(list(pinned.items()), f"{column} string, pinned long")
    both = counts.join(F.broadcast(want), column, "full")  # as many rows as are pinned
    return both.filter(~F.col("found").eqNullSafe(F.col("pinned")))


def agreement(a: DataFrame, b: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """(field, both, agree): over keys that both sources have, how often they say the same, letters' case aside; one job."""
    left = a.select(key, *[F.col(x).alias(f"{x}__a") for x in pairs])
    right = b.select(key, *[F.col(y).alias(f"{x}__b") for x, y in pairs.items()])
    both = left.join(right, key)
    bare = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    sums = [F.struct(F.lit(x).alias("field"), F.count(F.lit(1)).alias("both"), F.count_if(bare(f"{x}__a") == bare(f"{x}__b")).alias("agree")) for x in pairs]
    return both.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: What must hold within the estate's tables: table, constraint, condition (null isn't checked).
IDENTITIES: list[tuple[str, str, str]] = [
    ("ra_bill", "net = work + gst - retention", "abs(net_claimed - (value_of_work + gst - retention)) <= 2"),
    ("final_bill", "revised = awarded + variations", "abs(revised - (awarded + variations)) <= 2"),
    ("boq_line", "amount = rate * quantity", "abs(amount - rate * quantity) <= 1"),
    ("bank_year", "closing = opening + in - out", "closing = opening + deposits - withdrawals"),
    ("order_line", "current = awarded + variations", "current_value = awarded + variations"),
    ("ageing", "total = its three parts", "total = lt6 + m6_12 + gt12"),
    ("compliance", "complied + not = all", "complied + not_complied = requirements"),
    ("bond", "ends after it begins", "validity_days >= 0"),
]


def estate_identities(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, checked, violated) of the identities of all tables that are there."""
    out = None
    for name, constraint, condition in IDENTITIES:
        if name in tables:
            one = violations(tables[name], {constraint: F.expr(condition)}).select(F.lit(name).alias("table"), "*")
            out = one if out is None else out.unionByName(one)
    return out
