"""Order statistics, running values and leaders where one key may hold a third of all rows.

A window or a sort over such a key is one task.  Here medians come from counts: a histogram of value
ranges per key, narrowed until a range is small, so only that range is ever ordered.  Running
sums and previous values come from blocks: rows are dealt out by (key, order) ranges, each block is
scanned for itself, and what lies before it follows from one row a block.  Leaders are bounded: every task
hands on at most k rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import settled

SMALL = 100_000  # rows of a key, or of a range of its values, that one task may order
BUCKETS = 4_096  # ranges that a key's values are split into at a time


def median(df: DataFrame, key: str, value: str, *, small: int = SMALL) -> DataFrame:
    """(key, median) of whole numbers, exactly, as a double; null values don't count, a key without any gives null.

    Keys of at most ``small`` rows are ordered by themselves; there are at most rows / ``small`` others.
    """
    seen = settled(df.groupBy(key).agg(F.count(value).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    rows = df.select(key, value).filter(F.col(value).isNotNull())
    few = rows.join(seen.filter(F.col("__n") <= small).select(key), key, "left_semi").groupBy(key).agg(F.median(value).alias("median"))
    none = seen.filter("__n = 0").select(key, F.lit(None).cast("double").alias("median"))
    many = seen.filter(F.col("__n") > small)
    if many.isEmpty():
        return few.unionByName(none)
    # one row for each of the two middle ranks; ``__rank`` counts from the first row of the range
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("__side"), F.floor((F.col("__n") - 1 + i) / 2).cast("bigint").alias("__rank")) for i in (0, 1)]))
    wanted = many.select(key, "__lo", "__hi", "__n", ranks.alias("x")).select(key, "__lo", "__hi", "__n", "x.*")
    while (most := wanted.filter((F.col("__n") > small) & (F.col("__hi") > F.col("__lo"))).count()) > 0:
        wanted = settled(_narrowed(rows, wanted, key, value, small, most))
    inside = rows.join(wanted, key).filter(F.col(value).between(F.col("__lo"), F.col("__hi")))
    values = inside.groupBy(key, "__side", "__rank", value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(key, "__side").orderBy(value))
    found = values.withColumn("__upto", upto).filter((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
    return few.unionByName(none).unionByName(found.groupBy(key).agg(F.avg(value).alias("median")))


def _narrowed(rows: DataFrame, wanted: DataFrame, key: str, value: str, small: int, most: int) -> DataFrame:
    """Every wanted rank's range replaced by the bucket of it that holds the rank."""
    width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / BUCKETS).cast("bigint"), F.lit(1).cast("bigint"))
    wide = wanted.withColumn("__width", width)
    inside = rows.join(wide, key).filter(F.col(value).between(F.col("__lo"), F.col("__hi")))
    bucket = F.floor((F.col(value) - F.col("__lo")) / F.col("__width")).cast("bigint")
    counts = inside.groupBy(key, "__side", "__rank", "__lo", "__hi", "__width", bucket.alias("__b")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(key, "__side").orderBy("__b"))  # at most BUCKETS rows
    hit = counts.withColumn("__upto", upto).filter((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
    low = F.col("__lo") + F.col("__b") * F.col("__width")
    return hit.select(
        key, low.alias("__lo"), F.least(low + F.col("__width") - 1, F.col("__hi")).alias("__hi"), F.col("__c").alias("__n"), "__side", (F.col("__rank") - (F.col("__upto") - F.col("__c"))).alias("__rank")
    )


def _blocks(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows dealt out by ranges of (key, order); the block's number is fixed by writing it once."""
    return settled(df.repartitionByRange(F.asc(key), *[F.asc(c) for c in order]).withColumn("__block", F.spark_partition_id()))


def running(df: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` up to each row in the order within its key; ``order`` must tell rows apart."""
    rows = _blocks(df.withColumn("__amount", amount), key, order)
    totals = rows.groupBy(key, "__block").agg(F.sum("__amount").alias("__total"))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    ahead = totals.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.sum("__total").over(before).alias("__before"))
    own = F.sum("__amount").over(Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("__own", own).join(ahead, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")), "left")
    both = F.when(F.col("__before").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("__before")).otherwise(F.col("__own") + F.col("__before"))
    return out.withColumn(name, both).drop("__amount", "__block", "__own", "__before", "__k", "__b")


def previous(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """The value of the row before in the order within its key; null for the first one."""
    rows = _blocks(df, key, order)
    last = rows.groupBy(key, "__block").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__last"))
    ahead = last.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.lag("__last").over(Window.partitionBy(key).orderBy("__block")).alias("__before"))
    own = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(key, "__block").orderBy(*order))
    out = rows.withColumn("__own", own).join(ahead, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")), "left")
    return out.withColumn(name, F.coalesce("__own", "__before")["v"]).drop("__block", "__own", "__before", "__k", "__b")


def leaders(df: DataFrame, k: int, by: str, tie: str, group: str | None = None) -> DataFrame:
    """The k rows with the largest ``by`` (nulls last), of each group where one is given; ties go to the smallest ``tie``.

    Overall every task keeps k rows; within groups Spark limits the groups before the shuffle as well.
    """
    order = [F.desc_nulls_last(by), F.asc(tie)]
    if group is None:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")
