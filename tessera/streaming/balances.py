"""Extension beyond the batch operators: account movements as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.bind import cents


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_balances(events: DataFrame, *, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, amount): repeated events within the watermark count once."""
    once = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    sums = once.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("amount"))
    return sums.select(F.col("window.start").alias("window_start"), "event_type", "n", "amount")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n): activity without a longer gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), "n")
