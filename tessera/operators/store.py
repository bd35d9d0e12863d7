"""Fusing sources by key, ordered rows and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fused(first: DataFrame, second: DataFrame, key: str, *, overrides: tuple[str, ...] = ()) -> DataFrame:
    """Full outer upsert: the first source's fields win, gaps are filled; ``overrides`` come from the second where it has them."""
    shared = [c for c in first.columns if c in second.columns and c != key]
    right = second.select(key, *[F.col(c).alias(f"{c}__2") for c in shared], *[c for c in second.columns if c not in first.columns])
    out = first.join(right, key, "full")
    for c in shared:
        a, b = (F.col(f"{c}__2"), F.col(c)) if c in overrides else (F.col(c), F.col(f"{c}__2"))
        out = out.withColumn(c, F.coalesce(a, b)).drop(f"{c}__2")
    return out


def flagged(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with a flag whether the key occurs in ``right``, however often."""
    keys = right.select(key).distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, key, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def first_stated(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the first value that isn't null; where the order repeats, the smallest of its values."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def singletons(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).filter("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, by an explicit order."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", row).filter("__row = 1").drop("__row")


def latest_only(df: DataFrame, column: str) -> DataFrame:
    """Rows of the latest period; the period is one aggregated row, joined back."""
    latest = df.agg(F.max(column).alias("__latest"))
    return df.join(F.broadcast(latest), F.col(column) == F.col("__latest")).drop("__latest")  # one row


def prioritised(df: DataFrame, keys: list[str], priority: str, ties: list[str]) -> DataFrame:
    """Merge by priority: the smallest number wins, among equal ones the first by ``ties``, which must tell rows of one priority apart."""
    if not ties:
        raise ValueError("rows of one priority need an order")
    return keep_first(df, keys, [priority, *ties])


def running(df: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(amount).over(window))


def previous(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(key).orderBy(*order)))


def canonical(df: DataFrame, name: str, names: DataFrame, canon: str) -> DataFrame:
    """Names replaced by their canonical spelling where lower-cased, trimmed text is the same."""
    norm = names.select(F.lower(F.trim(canon)).alias("__k"), F.col(canon).alias("__c")).groupBy("__k").agg(F.min("__c").alias("__c"))
    return df.join(norm, F.lower(F.trim(name)) == F.col("__k"), "left").withColumn(name, F.coalesce("__c", name)).drop("__k", "__c")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def guarded_spelling(df: DataFrame, key: str, name: str, known: DataFrame) -> DataFrame:
    """``name`` as ``known`` spells it for the same key, only where both agree in letters and digits."""
    spelt = known.filter(F.col(name).isNotNull()).groupBy(key).agg(F.max(name).alias("__c"))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    same = F.coalesce(bare(F.col("__c")) == bare(F.col(name)), F.lit(False))
    return df.join(spelt, key, "left").withColumn(name, F.when(same, F.col("__c")).otherwise(F.col(name))).drop("__c")


def children(df: DataFrame, key: str, columns: list[str], name: str, order: list[str]) -> DataFrame:
    """Per key its rows as one ordered list; as long as a key has rows, so for keys of bounded size."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return df.groupBy(key).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))


def people(credentials: DataFrame, cvs: DataFrame) -> DataFrame:
    """All names of both sources: designation and CV from one, the list of credentials from the other, employee id from whichever states it."""
    columns = ["credential", "credential_id", "issued", "doc"]
    held = children(credentials.filter("name is not null"), "name", columns, "credentials", ["doc", "credential_id"])
    ids = credentials.filter("name is not null").groupBy("name").agg(F.max_by("employee_id", "doc").alias("held_id"))
    stated = cvs.filter("name is not null").groupBy("name").agg(F.max_by("doc", "doc").alias("cv_id"), F.max_by("employee_id", "doc").alias("employee_id"), F.max_by("designation", "doc").alias("designation"))
    both = held.join(ids, "name").join(stated, "name", "full")
    none = F.array().cast(held.schema["credentials"].dataType)
    return both.select("name", F.coalesce("employee_id", "held_id").alias("employee_id"), "designation", "cv_id", F.coalesce("credentials", none).alias("credentials"))


def not_included(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Distinct rows of ``part`` that ``whole`` lacks; empty where it is included."""
    return part.distinct().subtract(whole.select(part.columns))


def works_of(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per key its distinct values, sorted."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))
