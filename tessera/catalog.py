"""All registered queries of the engine's own operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import norm
from tessera.operators import algebra, extract, shapes, store, verify
from tessera.plans import bind
from tessera.plans.ir import QueryPlan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WORK = """work AS (
  SELECT o_orderkey AS work_id, c_name AS client, o_orderpriority AS category, CAST(round(o_totalprice * 100) AS BIGINT) AS value,
         CAST(o_orderdate AS DATE) AS completed, CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS state, o_orderstatus AS role, c_mktsegment AS client_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_LED = """led AS (
  SELECT work.*, s_name AS lead, coalesce(ref, false) AS has_ref FROM work
  LEFT JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS k, bool_or(l_returnflag = 'R') AS ref FROM lineitem GROUP BY 1) ON work_id = l_orderkey
  LEFT JOIN supplier ON k = s_suppkey)"""
_INVOICE = """invoice AS (
  SELECT *, invoiced - received AS outstanding FROM (
    SELECT c_name AS client, CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(round(l_extendedprice * 100) AS BIGINT) AS invoiced,
           CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS received, l_linestatus AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""
_CREDENTIAL = """credential AS (
  SELECT s_name AS name, issued FROM supplier LEFT JOIN (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS issued FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""
_BANK = """bank AS (
  SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date,
         CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS deposit,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS withdrawal FROM events)"""
URGENT, HIGH = "1-URGENT", "2-HIGH"


def register(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return fn

    return keep


def planned(name: str, plan: QueryPlan, sql: str, *ctes: str) -> None:
    """A query that is nothing but a plan."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return algebra.run(plan, bind.entity(spark, sf_dir, plan.entity, plan.columns()))

    register(name, sql, *(ctes or (_WORK,)))(fn)


def shaped(name: str, fn: Callable[..., DataFrame], sql: str, *ctes: str, needs: tuple[str, ...] = ("work",), lines: bool = False) -> None:
    """A named shape over its entity views."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*[bind.work(spark, sf_dir, lines=lines) if n == "work" else bind.work(spark, sf_dir) if n == "portfolio" else bind.ENTITIES[n](spark, sf_dir) for n in needs])

    register(name, sql, *ctes)(query)


# ------------------------------------------------------------------ roll-up and shapes

@register("client_rollup", """
SELECT coalesce(w.client, i.client) AS client, works, value, largest, smallest, categories, referenced, unreferenced, invoiced, received, outstanding
FROM (SELECT client, count(*) AS works, CAST(sum(value) AS BIGINT) AS value, max(value) AS largest, min(value) AS smallest, count(DISTINCT category) AS categories,
             count(*) FILTER (has_ref) AS referenced, count(*) FILTER (NOT has_ref) AS unreferenced FROM led GROUP BY 1) w
FULL JOIN (SELECT client, CAST(sum(invoiced) AS BIGINT) AS invoiced, CAST(sum(received) AS BIGINT) AS received, CAST(sum(outstanding) AS BIGINT) AS outstanding FROM invoice GROUP BY 1) i
ON w.client = i.client""", _WORK, _LED, _INVOICE)
def client_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.client(spark, sf_dir)


def _per_client(expr: str, table: str = "work", key: str = "client") -> str:
    return f"SELECT {key}, {expr} AS answer FROM {table} GROUP BY 1"


def _sum(condition: str, field: str = "value") -> str:
    return f"CAST(coalesce(sum({field}) FILTER ({condition}), 0) AS BIGINT)"


_PCT = "round_even({} * 10000.0::DOUBLE / nullif({}, 0), 0) / 100"
shaped("client_total", shapes.client_total, _per_client("CAST(sum(value) AS BIGINT)"), _WORK)
shaped("absence_by_client", shapes.absence, _per_client("count(*) FILTER (NOT has_ref)", "led"), _WORK, _LED, lines=True)
shaped("referenced_share", shapes.referenced_share, _per_client(_PCT.format("count(*) FILTER (has_ref)", "count(*)"), "led"), _WORK, _LED, lines=True)
shaped("rank_gap", shapes.rank_value, """SELECT client, max(value) FILTER (r = 1) - max(value) FILTER (r = 2) AS answer
FROM (SELECT client, value, row_number() OVER (PARTITION BY client ORDER BY value DESC, work_id) AS r FROM work) GROUP BY 1""", _WORK)
shaped("threshold_total", lambda w: shapes.threshold_aggregate(w, 15_000_000), _per_client(_sum("value >= 15000000")), _WORK)
shaped("threshold_gap", lambda w: shapes.gap_to_threshold(w, 200_000_000), _per_client("greatest(0, 200000000 - CAST(sum(value) AS BIGINT))::BIGINT"), _WORK)
shaped("exclusion_total_one", lambda w: shapes.exclusion_aggregate(w, [URGENT]), _per_client(_sum("coalesce(lower(trim(category)) NOT IN ('1-urgent'), true)")), _WORK)
shaped("exclusion_total_many", lambda w: shapes.exclusion_aggregate(w, [URGENT, HIGH]), _per_client(_sum("coalesce(lower(trim(category)) NOT IN ('1-urgent', '2-high'), true)")), _WORK)
shaped("grading_total", lambda w: shapes.doc_filtered_aggregate(w, "client_type", "building"), _per_client(_sum("lower(trim(client_type)) = 'building'")), _WORK)
shaped("role_split", lambda w: shapes.role_split(w, "F"), _per_client(_sum("lower(trim(role)) = 'f'")), _WORK)
shaped("avg_size", shapes.avg_work_size, _per_client("CAST(round_even(sum(value)::DOUBLE / count(value), 0) AS BIGINT)"), _WORK)
shaped("mean_median_gap", shapes.mean_median_gap, _per_client("CASE WHEN count(value) >= 2 THEN CAST(round_even(sum(value)::DOUBLE / count(value) - median(value), 0) AS BIGINT) END"), _WORK)
shaped("hop_aggregate", shapes.hop_aggregate, """SELECT lead, answer FROM (SELECT lead, arg_min(client, work_id) AS client FROM led WHERE lead IS NOT NULL GROUP BY 1)
JOIN (SELECT client, CAST(sum(value) AS BIGINT) AS answer FROM work GROUP BY 1) USING (client)""", _WORK, _LED, needs=("work", "portfolio"), lines=True)
shaped("outstanding", shapes.outstanding_balance, _per_client("CAST(sum(invoiced) - sum(received) AS BIGINT)", "invoice"), _INVOICE, needs=("invoice",))
shaped("invoiced", shapes.SHAPES["invoiced_total"], _per_client("CAST(sum(invoiced) AS BIGINT)", "invoice"), _INVOICE, needs=("invoice",))
shaped("received", shapes.SHAPES["received_total"], _per_client("CAST(sum(received) AS BIGINT)", "invoice"), _INVOICE, needs=("invoice",))
shaped("collection_pct", shapes.collection_pct, _per_client(_PCT.format("sum(received)", "sum(invoiced)"), "invoice"), _INVOICE, needs=("invoice",))
shaped("unbilled_gap", shapes.unbilled_gap, """SELECT client, CASE WHEN a <> 0 THEN abs(a - coalesce(b, 0)) END AS answer
FROM (SELECT client, CAST(sum(value) AS BIGINT) AS a FROM work GROUP BY 1) LEFT JOIN (SELECT client, CAST(sum(invoiced) AS BIGINT) AS b FROM invoice GROUP BY 1) USING (client)""", _WORK, _INVOICE, needs=("work", "invoice"))
shaped("year_total", lambda w: shapes.year_total(w, 1997), _per_client(f"nullif({_sum('year = 1997')}, 0)"), _WORK)
shaped("year_delta_missing0", lambda w: shapes.year_delta(w, 1996, 1998), _per_client(f"abs({_sum('year = 1998')} - {_sum('year = 1996')})"), _WORK)
shaped("category_delta", lambda w: shapes.category_delta(w, URGENT, HIGH), _per_client(f"abs({_sum(chr(39).join(['lower(trim(category)) = ', '1-urgent', '']))} - {_sum(chr(39).join(['lower(trim(category)) = ', '2-high', '']))})"), _WORK)
shaped("temporal_chain", shapes.temporal_chain, "SELECT lead, CAST(coalesce(sum(value) FILTER (completed > issued), 0) AS BIGINT) AS answer FROM led JOIN credential ON lead = name GROUP BY 1",
       _WORK, _LED, _CREDENTIAL, needs=("work", "credential"), lines=True)
shaped("date_span", shapes.date_span, "SELECT lead, CAST(abs(date_diff('day', issued, max(completed))) AS BIGINT) AS answer FROM led JOIN credential ON lead = name GROUP BY lead, issued",
       _WORK, _LED, _CREDENTIAL, needs=("work", "credential"), lines=True)
shaped("distinct_categories", shapes.distinct_count, _per_client("count(DISTINCT lower(trim(category)))"), _WORK)

# ------------------------------------------------------------------ predicates, reductions, compositions

_FILTERS = {
    "eq": (("category", "eq", URGENT), "category = '1-URGENT'"), "ne": (("category", "ne", URGENT), "category <> '1-URGENT'"),
    "gt": (("value", "gt", 15_000_000), "value > 15000000"), "gte": (("year", "gte", 1998), "year >= 1998"),
    "lt": (("value", "lt", 9_000_000), "value < 9000000"), "lte": (("completed", "lte", date(1997, 6, 30)), "completed <= DATE '1997-06-30'"),
    "contains": (("category", "contains", "high"), "contains(lower(category), 'high')"), "exists": (("state", "exists", True), "state IS NOT NULL"),
    "between": (("year", "between", (1996, 1998)), "year BETWEEN 1996 AND 1998"),
}
for _name, (_filter, _where) in _FILTERS.items():
    planned(f"filter_{_name}", QueryPlan("work", (_filter,), "sum", "value", group_keys=("client",)),
            f"SELECT client, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM work WHERE {_where} GROUP BY 1")

_REDUCTIONS = {
    "count": "count(*)", "distinct": "count(DISTINCT category)", "sum": "CAST(sum(value) AS BIGINT)", "mean": "CAST(round_even(sum(value)::DOUBLE / count(value), 0) AS BIGINT)",
    "median": "CAST(round_even(median(value), 0) AS BIGINT)", "min": "min(value)", "max": "max(value)",
}
for _name, _expr in _REDUCTIONS.items():
    planned(f"reduce_{_name}", QueryPlan("work", (("role", "eq", "F"),), _name, {"count": None, "distinct": "category"}.get(_name, "value"), group_keys=("state",)),
            f"SELECT state, {_expr} AS answer, count(*) AS n_rows FROM work WHERE role = 'F' GROUP BY 1")

_BY_CLIENT = {"group_keys": ("client",)}
planned("comp_delta", QueryPlan("work", (), "sum", "value", "delta", years=(1996, 1998), **_BY_CLIENT),
        "SELECT client, abs(CAST(sum(value) FILTER (year = 1998) AS BIGINT) - CAST(sum(value) FILTER (year = 1996) AS BIGINT)) AS answer, count(*) AS n_rows FROM work WHERE year IN (1996, 1998) GROUP BY 1")
planned("comp_diff_rows", QueryPlan("work", (("category", "eq", URGENT),), "sum", "value", "diff", subtrahend=(("category", "eq", HIGH),), **_BY_CLIENT),
        "SELECT client, CAST(sum(value) FILTER (category = '1-URGENT') - sum(value) FILTER (category = '2-HIGH') AS BIGINT) AS answer, count(*) FILTER (category = '1-URGENT') AS n_rows FROM work WHERE category IN ('1-URGENT', '2-HIGH') GROUP BY 1")
planned("comp_diff_cols", QueryPlan("invoice", (), "sum", "invoiced", "diff", field_b="received", **_BY_CLIENT),
        "SELECT client, CAST(sum(invoiced) - sum(received) AS BIGINT) AS answer, count(*) AS n_rows FROM invoice GROUP BY 1", _INVOICE)
planned("comp_argsel_max", QueryPlan("work", (), "max", "value", "argsel", by="completed", tiebreak="work_id", **_BY_CLIENT),
        "SELECT client, arg_max(value, (completed, -work_id)) AS answer, count(*) AS n_rows FROM work GROUP BY 1")
planned("comp_argsel_min", QueryPlan("work", (), "max", "value", "argsel", by="completed", dir="min", tiebreak="work_id", **_BY_CLIENT),
        "SELECT client, arg_min(value, (completed, work_id)) AS answer, count(*) AS n_rows FROM work GROUP BY 1")
for _dir in ("max", "min"):
    planned(f"comp_groupby_{_dir}", QueryPlan("work", (), "sum", "value", "groupby", by="category", dir=_dir, **_BY_CLIENT),
            f"SELECT client, {_dir}(g) AS answer, CAST(sum(c) AS BIGINT) AS n_rows FROM (SELECT client, category, CAST(sum(value) AS BIGINT) AS g, count(*) AS c FROM work WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
planned("comp_spread", QueryPlan("work", (), "max", "completed", "spread", **_BY_CLIENT),
        "SELECT client, CASE WHEN count(completed) >= 2 THEN date_diff('day', min(completed), max(completed)) END AS answer, count(*) AS n_rows FROM work GROUP BY 1")
planned("comp_epoch", QueryPlan("work", (), "max", "completed", "epoch", origin=date(1998, 1, 1), **_BY_CLIENT),
        "SELECT client, date_diff('day', DATE '1998-01-01', max(completed)) AS answer, count(*) AS n_rows FROM work GROUP BY 1")
planned("comp_ratio", QueryPlan("work", (("category", "eq", URGENT),), "sum", "value", "ratio", denominator=(), **_BY_CLIENT),
        f"SELECT client, {_PCT.format('sum(value) FILTER (category = ' + chr(39) + URGENT + chr(39) + ')', 'sum(value)')} AS answer, count(*) FILTER (category = '1-URGENT') AS n_rows FROM work GROUP BY 1")
planned("comp_datespan", QueryPlan("work", (), "min", "completed", "datespan", subjects=("F", "O"), key="role", tiebreak="work_id", **_BY_CLIENT),
        "SELECT client, abs(date_diff('day', arg_min(completed, work_id) FILTER (role = 'F'), arg_min(completed, work_id) FILTER (role = 'O'))) AS answer, count(*) AS n_rows FROM work WHERE role IN ('F', 'O') GROUP BY 1")

# ------------------------------------------------------------------ joins, windows, sets


@register("absence_anti", "SELECT o_orderkey AS work_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def absence_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = bind.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("work_id"))
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id")).join(refs, "work_id", "left_anti")


@register("has_ref_semi", "SELECT o_orderkey AS work_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def has_ref_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = bind.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("work_id"))
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id")).join(refs, "work_id", "left_semi")


@register("upsert_full", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(b.balance, a.balance) AS balance
FROM (SELECT o_custkey AS k, 'client ' || o_custkey AS name, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS balance FROM orders GROUP BY 1, 2) a
FULL JOIN (SELECT c_custkey AS k, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer) b ON a.k = b.k""")
def upsert_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders are on the right alone."""
    orders, key = bind.table(spark, sf_dir, "orders"), F.col("o_custkey")
    a = orders.groupBy(key.alias("k"), F.concat(F.lit("client "), key.cast("string")).alias("name")).agg(F.max(bind.cents(F.col("o_totalprice"))).alias("balance"))
    b = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), bind.cents(F.col("c_acctbal")).alias("balance"))
    return store.fused(a, b, "k", overrides=("balance",))


@register("upsert_whole", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(b.balance, a.balance) AS balance
FROM (SELECT c_custkey AS k, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer) a
FULL JOIN (SELECT s_suppkey AS k, s_name AS name, CAST(round(s_acctbal * 100) AS BIGINT) AS balance FROM supplier) b ON a.k = b.k""")
def upsert_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), bind.cents(F.col("c_acctbal")).alias("balance"))
    b = bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), bind.cents(F.col("s_acctbal")).alias("balance"))
    return store.fused(a, b, "k", overrides=("balance",))


@register("sector_first", "SELECT state, arg_min(client_type, work_id) AS client_type FROM work WHERE client_type IS NOT NULL GROUP BY 1", _WORK)
def sector_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_stated(bind.work(spark, sf_dir), "state", "client_type", "work_id")


@register("singleton_cohort", "SELECT client, min(year) AS year FROM work GROUP BY 1 HAVING count(DISTINCT year) = 1", _WORK)
def singleton_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.singletons(bind.work(spark, sf_dir), "client", "year")


@register("lag_balance", "SELECT event_id, deposit - withdrawal AS amount, lag(deposit - withdrawal) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM bank", _BANK)
def lag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bank_txn(spark, sf_dir).withColumn("amount", F.col("deposit") - F.col("withdrawal"))
    return store.previous(rows, "user_id", ["ts", "event_id"], "amount", "before").select("event_id", "amount", "before")


_RUN = "run AS (SELECT event_id, user_id, ts, CAST(sum(deposit - withdrawal) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM bank)"


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.running(bind.bank_txn(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("deposit") - F.col("withdrawal"), "balance")


@register("running_balance", "SELECT event_id, user_id, balance FROM run", _BANK, _RUN)
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir).select("event_id", "user_id", "balance")


@register("closing_by_user", "SELECT user_id, arg_max(balance, (ts, event_id)) AS closing FROM run GROUP BY 1", _BANK, _RUN)
def closing_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir).groupBy("user_id").agg(F.max_by("balance", F.struct("ts", "event_id")).alias("closing"))


@register("keep_first", "SELECT client, work_id, value FROM work QUALIFY row_number() OVER (PARTITION BY client ORDER BY completed, work_id) = 1", _WORK)
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(bind.work(spark, sf_dir), ["client"], ["completed", "work_id"]).select("client", "work_id", "value")


@register("latest_only", "SELECT work_id, client, value FROM work WHERE year = (SELECT max(year) FROM work)", _WORK)
def latest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_only(bind.work(spark, sf_dir), "year").select("work_id", "client", "value")


@register("priority_merge", """SELECT category, year, value FROM (
  SELECT category, year, value, row_number() OVER (PARTITION BY category, year ORDER BY p) AS r FROM (
    SELECT category, year, CAST(sum(value) AS BIGINT) AS value, 0 AS p FROM work GROUP BY 1, 2
    UNION ALL SELECT category, CAST(year + 1 AS INTEGER), CAST(sum(value) AS BIGINT), 1 FROM work GROUP BY 1, 2)) WHERE r = 1""", _WORK)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own-year figures beat the next year's comparative, which only fills gaps."""
    own = bind.work(spark, sf_dir).groupBy("category", "year").agg(F.sum("value").alias("value"))
    both = own.withColumn("p", F.lit(0)).unionByName(own.select("category", (F.col("year") + 1).cast("int").alias("year"), "value", F.lit(1).alias("p")))
    return store.prioritised(both, ["category", "year"], "p", ["value"]).select("category", "year", "value")


_NAMES = {"a": ("customer", "c_nationkey"), "b": ("supplier", "s_nationkey")}
for _name, _op in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect": "INTERSECT", "except": "EXCEPT"}.items():
    def _sets(spark: SparkSession, sf_dir: str, kind: str = _name) -> DataFrame:
        a, b = (bind.table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in _NAMES.values())
        return {"union_all": lambda: store.union_all(a, b), "union_distinct": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[kind]()

    register(_name, f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")(_sets)


@register("reconcile_diff", """SELECT k, d.field, d.l AS left, d.r AS right FROM (
  SELECT a.o_orderkey AS k, unnest([{'field': 'value', 'l': CAST(a.v AS VARCHAR), 'r': CAST(b.v AS VARCHAR)}]) AS d
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders) a
  JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey WHERE abs(a.v - b.v) > 2
  UNION ALL SELECT o_orderkey, {'field': '(row)', 'l': 'true', 'r': CAST(NULL AS VARCHAR)} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT DISTINCT l_orderkey, {'field': '(row)', 'l': CAST(NULL AS VARCHAR), 'r': 'true'} FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), bind.cents(F.col("o_totalprice")).alias("value"))
    b = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(bind.cents(F.col("l_extendedprice"))).alias("value"))
    return verify.reconcile(a, b, "k", {"value": 2})


@register("identity_violations", """SELECT 'net' AS "constraint", count(*) AS checked, count(*) FILTER (outstanding <> invoiced - received) AS violated FROM invoice
UNION ALL SELECT 'received_at_most_invoiced', count(*), count(*) FILTER (received > invoiced) FROM invoice
UNION ALL SELECT 'dated', count(*), count(*) FILTER (year < 1996) FROM invoice""", _INVOICE)
def identity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.violations(bind.invoice(spark, sf_dir), {
        "net": F.col("outstanding") == F.col("invoiced") - F.col("received"), "received_at_most_invoiced": F.col("received") <= F.col("invoiced"), "dated": F.col("year") >= 1996,
    })


@register("completeness", """SELECT 'text' AS "column", count(*) AS rows, count(text) AS stated FROM documents UNION ALL SELECT 'lang', count(*), count(lang) FROM documents UNION ALL SELECT 'source', count(*), count(source) FROM documents""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.completeness(bind.table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@register("score_by_group", """SELECT state, count(*) AS n, round_even(avg(CASE WHEN gold = 0 THEN CASE WHEN got = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - abs(got - gold) / abs(gold)) END) * 10000, 0) / 10000 AS score
FROM (SELECT state, client, avg(value) AS gold, median(value) AS got FROM work GROUP BY 1, 2) GROUP BY 1""", _WORK)
def score_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = bind.work(spark, sf_dir).groupBy("state", "client").agg(F.avg("value").alias("gold"), F.median("value").alias("got"))
    return per.groupBy("state").agg(F.count("*").alias("n"), (F.bround(F.avg(verify.score(F.col("got"), F.col("gold"))) * 10000, 0) / 10000).alias("score"))


# ------------------------------------------------------------------ text to rows

_LINES = "lines AS (SELECT doc_id AS doc, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sections(bind.table(spark, sf_dir, "documents"), lambda line: F.length(line) < 40)


@register("asof_section", "SELECT doc, pos, last_value(CASE WHEN length(line) < 40 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM lines", _LINES)
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc", "pos", "section")


@register("block_islands", "SELECT doc, block, count(*) AS n FROM (SELECT doc, CAST(sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM lines) GROUP BY 1, 2", _LINES)
def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).groupBy("doc", "block").agg(F.count("*").alias("n"))


@register("next_line", "SELECT doc, pos, lead(line, 1) OVER (PARTITION BY doc ORDER BY pos) AS next_1 FROM lines", _LINES)
def next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lines(bind.table(spark, sf_dir, "documents"), ahead=1).select("doc", "pos", "next_1")


@register("regex_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return bind.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<p>"), 0)).cast("bigint").alias("paragraphs"))


@register("url_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return bind.table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/]+)").alias("host"), part("^[a-z]+://[^/]+(/[^?#]*)").alias("path"))


@register("token_df_weight", """SELECT token, count(*) AS df, 1 / count(*)::DOUBLE AS weight FROM (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token FROM benchmark) WHERE token <> '' GROUP BY 1""")
def token_df_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.token_weights(bind.table(spark, sf_dir, "benchmark"), "item_id", "text")


@register("norm_text_variants", "SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name, '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM part")
def norm_text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "part").select("p_partkey", norm.norm_work(F.col("p_name")).alias("key"))


@register("json_prop_sum", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_prop_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"), F.count("*").alias("n"))


@register("person_rollup", """SELECT s_name AS name, count(work_id) AS works_led, CAST(coalesce(sum(value), 0) AS BIGINT) AS value_led, count(DISTINCT category) AS categories_led, count(DISTINCT client) AS clients_served
FROM supplier LEFT JOIN led ON s_name = lead GROUP BY 1""", _WORK, _LED)
def person_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.person(spark, sf_dir)


@register("asset_by_type", "SELECT p_type AS type, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM part GROUP BY 1")
def asset_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.asset(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@register("boq_by_item", "SELECT p_name AS description, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def boq_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.boq_line(spark, sf_dir).groupBy("description").agg(F.sum("amount").alias("amount"))


@register("segment_unpivot", """SELECT category, year, kind, amount FROM (
  SELECT category, year, value AS current, lag(value) OVER (PARTITION BY category ORDER BY year) AS previous FROM (SELECT category, year, CAST(sum(value) AS BIGINT) AS value FROM work GROUP BY 1, 2))
UNPIVOT INCLUDE NULLS (amount FOR kind IN (current, previous))""", _WORK)
def segment_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = bind.work(spark, sf_dir).groupBy("category", "year").agg(F.sum("value").alias("current"))
    per = per.withColumn("previous", F.lag("current").over(Window.partitionBy("category").orderBy("year")))
    return per.unpivot(["category", "year"], ["current", "previous"], "kind", "amount")


@register("doc_type_counts", "SELECT CASE WHEN source LIKE 'src1%' THEN 'ones' WHEN source LIKE 'src%' THEN 'others' END AS type, count(*) AS n FROM documents GROUP BY 1")
def doc_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = extract.doc_type(F.col("source"), {"src": "others", "src1": "ones"})
    return bind.table(spark, sf_dir, "documents").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    from tessera import catalog_text  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
