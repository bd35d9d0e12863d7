"""Entity views over the star-schema tables.

Every view is a lazy DataFrame; nothing is read before a query runs.  Money is
BIGINT cents, dates are DATE, and the aggregated line columns are joined only
where a query asks for them, so that other queries never scan the lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = {"lead", "has_ref"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def work(spark: SparkSession, sf_dir: str, *, lines: bool = False) -> DataFrame:
    """Completed works: one per order; ``lines`` adds who led it and whether it is referenced."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    if lines:
        per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("lead_key"), F.bool_or(F.col("l_returnflag") == "R").alias("ref")
        )
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("lead"))
        orders = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(supplier, F.col("lead_key") == F.col("s_suppkey"), "left")
    extra = ["lead", F.coalesce("ref", F.lit(False)).alias("has_ref")] if lines else []
    done = F.to_date("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("work_id"), F.col("c_name").alias("client"), F.col("o_orderpriority").alias("category"),
        cents(F.col("o_totalprice")).alias("value"), done.alias("completed"), F.year(done).alias("year"),
        F.col("n_name").alias("state"), F.col("o_orderstatus").alias("role"), F.col("c_mktsegment").alias("client_type"), *extra,
    )


def invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices: one per line, billed to the client of its order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    clients = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(clients, F.col("o_custkey") == F.col("c_custkey"))
    invoiced, received = cents(F.col("l_extendedprice")), cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice_no"), F.col("c_name").alias("client"), F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"), invoiced.alias("invoiced"), received.alias("received"), (invoiced - received).alias("outstanding"),
        F.col("l_linestatus").alias("status"),
    )


def credential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credential per person: issued at the first shipment."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("issued"))
    return supplier.join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("name", "issued")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with what they led."""
    led = work(spark, sf_dir, lines=True).groupBy("lead").agg(
        F.count("*").alias("works_led"), F.sum("value").alias("value_led"), F.countDistinct("category").alias("categories_led"),
        F.countDistinct("client").alias("clients_served"),
    )
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return names.join(led, F.col("name") == F.col("lead"), "left").select(
        "name", F.coalesce("works_led", F.lit(0)).alias("works_led"), F.coalesce("value_led", F.lit(0)).alias("value_led"),
        F.coalesce("categories_led", F.lit(0)).alias("categories_led"), F.coalesce("clients_served", F.lit(0)).alias("clients_served"),
    )


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("make"), cents(F.col("p_retailprice")).alias("cost"),
        F.when(size < 15, "good").when(size < 35, "fair").otherwise("worn").alias("condition"),
    )


def boq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("contract"), F.col("l_linenumber").alias("item"), F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"),
        cents(F.col("p_retailprice")).alias("rate"), cents(F.col("l_extendedprice")).alias("amount"),
    )


def bank_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account movements: purchases and sign-ups come in, the rest goes out."""
    e = table(spark, sf_dir, "events")
    amount, into = cents(F.col("value")), F.col("event_type").isin("purchase", "signup")
    return e.select(
        "event_id", "user_id", F.to_date("ts").alias("date"), "ts", F.when(into, amount).otherwise(0).alias("deposit"),
        F.when(into, 0).otherwise(amount).alias("withdrawal"),
    )


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of works and invoices by client.

    An invoice belongs to the client of its order, so lines are summed per order once, flags and
    money together, before anything is joined: one scan of the lines, one shuffle on the order's key.
    """
    invoiced, received = cents(F.col("l_extendedprice")), cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("ref"), F.sum(invoiced).alias("invoiced"), F.sum(received).alias("received")
    )
    orders = table(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("client"))
    value, ref = cents(F.col("o_totalprice")), F.coalesce("ref", F.lit(False))
    return orders.join(names, F.col("o_custkey") == F.col("c_custkey")).groupBy("client").agg(
        F.count("*").alias("works"), F.sum(value).alias("value"), F.max(value).alias("largest"), F.min(value).alias("smallest"),
        F.countDistinct("o_orderpriority").alias("categories"), F.count_if(ref).alias("referenced"), F.count_if(~ref).alias("unreferenced"),
        F.sum("invoiced").alias("invoiced"), F.sum("received").alias("received"), F.sum(F.col("invoiced") - F.col("received")).alias("outstanding"),
    )


def client_universe(work: DataFrame, invoice: DataFrame) -> DataFrame:
    """The same over a universe that both sources make: clients of works, clients of invoices, or both."""
    works = work.groupBy("client").agg(F.count("*").alias("works"), F.sum("value").alias("value"))
    return works.join(invoice.groupBy("client").agg(F.sum("invoiced").alias("invoiced"), F.sum("received").alias("received")), "client", "full")


ENTITIES: dict[str, Callable[..., DataFrame]] = {
    "work": work, "invoice": invoice, "credential": credential, "person": person, "asset": asset,
    "boq_line": boq_line, "bank_txn": bank_txn, "client": client,
}


def entity(spark: SparkSession, sf_dir: str, name: str, columns: set[str] | None = None) -> DataFrame:
    """An entity view; for works the line columns only if they are asked for."""
    if name == "work":
        return work(spark, sf_dir, lines=columns is None or bool(columns & LINE_COLUMNS))
    return ENTITIES[name](spark, sf_dir)
