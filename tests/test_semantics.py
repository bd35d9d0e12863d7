"""Nulls, empty selections, ties and rounding."""

import datetime as dt

import pytest

from tessera.operators import algebra, shapes, store, verify
from tessera.plans import rewrite
from tessera.plans.ir import PlanError, QueryPlan

COLS = "work_id long, client string, category string, value long, year int, completed date, role string"


@pytest.fixture(scope="module")
def work(spark):
    d = dt.date
    return spark.createDataFrame([
        (1, "a", "road", 10, 2001, d(2001, 1, 1), "Prime"), (2, "a", None, 10, 2002, d(2002, 1, 1), "Sub"), (3, "a", "dam", None, 2002, None, None),
        (4, "b", "road", 5, 2001, d(2001, 5, 1), "Prime"), (5, "c", "dam", 2, 2003, d(2003, 1, 1), "Prime"), (6, "c", "dam", 3, 2003, d(2003, 3, 1), "Prime"),
    ], COLS)


def answer(plan, df):
    return algebra.run(plan, df).first()["answer"]


def test_sum_of_nothing_is_unknown_and_count_zero(work):
    none = (("client", "eq", "nobody"),)
    assert answer(QueryPlan("work", none, "sum", "value"), work) is None
    assert answer(QueryPlan("work", none), work) == 0


def test_ne_drops_nulls_but_exclusion_keeps_them(work):
    assert answer(QueryPlan("work", (("category", "ne", "road"), ("client", "eq", "a")), "sum", "value"), work) is None
    kept = {r["client"]: r["answer"] for r in shapes.exclusion_aggregate(work, ["Road "]).collect()}
    assert kept == {"a": 10, "b": 0, "c": 5}


def test_half_to_even(work):
    assert answer(QueryPlan("work", (("client", "eq", "c"),), "mean", "value"), work) == 2
    assert answer(QueryPlan("work", (("client", "eq", "c"),), "median", "value"), work) == 2


def test_ties_and_single_works(work):
    got = {r["client"]: r["answer"] for r in shapes.rank_value(work.filter("value is not null")).collect()}
    assert got == {"a": 0, "b": None, "c": 1}
    assert {r["client"]: r["answer"] for r in shapes.mean_median_gap(work).collect()}["b"] is None


def test_missing_year_is_zero_in_the_shape_and_unknown_in_the_composition(work):
    assert {r["client"]: r["answer"] for r in shapes.year_delta(work, 2001, 2002).collect()}["b"] == 5
    assert answer(QueryPlan("work", (("client", "eq", "b"),), "sum", "value", "delta", years=(2001, 2002)), work) is None
    assert {r["client"]: r["answer"] for r in shapes.year_total(work, 2001).collect()}["c"] is None


def test_ratio_without_a_whole(work):
    assert answer(QueryPlan("work", (("client", "eq", "nobody"),), "sum", "value", "ratio", denominator=(("client", "eq", "nobody"),)), work) is None
    assert answer(QueryPlan("work", (("client", "eq", "c"),), "sum", "value", "ratio", denominator=()), work) == 16.67


def test_compositions(work):
    a = (("client", "eq", "a"),)
    assert answer(QueryPlan("work", a, "max", "completed", "spread"), work) == 365
    assert answer(QueryPlan("work", (("client", "eq", "b"),), "max", "completed", "spread"), work) is None
    assert answer(QueryPlan("work", a, "min", "completed", "epoch", origin=dt.date(2001, 1, 3)), work) == -2
    assert answer(QueryPlan("work", a, "max", "work_id", "argsel", by="value", tiebreak="work_id"), work) == 1
    assert answer(QueryPlan("work", (), "sum", "value", "diff", subtrahend=a), work) == 10
    assert answer(QueryPlan("work", a, "sum", "value", "diff", subtrahend=()), work) == -10
    assert answer(QueryPlan("work", a, "sum", "value", "diff", subtrahend=(), absolute=True), work) == 10
    assert answer(QueryPlan("work", (), "sum", "value", "groupby", by="category", dir="min"), work) == 5


def test_unknown_names_raise(work):
    with pytest.raises(PlanError):
        QueryPlan("work", (("a", "like", 1),))
    with pytest.raises(PlanError):
        answer(QueryPlan("work", (("nope", "eq", 1),)), work)
    with pytest.raises(PlanError):
        QueryPlan("work", (), "sum")


def test_relaxing_drops_only_filters_on_missing_values(spark, work):
    plan = QueryPlan("work", (("work_id", "eq", 3), ("role", "eq", "Prime")))
    assert algebra.relaxed(plan, work).filters == (("work_id", "eq", 3),)
    stated = QueryPlan("work", (("work_id", "eq", 2), ("role", "eq", "Prime")))
    assert algebra.relaxed(stated, work) == stated


def test_rewrites(work):
    fixed = QueryPlan("work", (("value", "eq", 5),), "sum", "value")
    assert rewrite.measure_is_not_filter(fixed, "year").field == "year"
    bars = QueryPlan("work", (("value", "gte", 1), ("value", "gte", 5)), "sum", "value")
    assert rewrite.separating_bars(bars, work.filter("value is not null")).filters == (("value", "gte", 5),)
    assert rewrite.latest_by_default(QueryPlan("work"), work).filters == (("year", "eq", 2003),)
    with pytest.raises(PlanError):
        rewrite.guard_whole_table(QueryPlan("work", (), "sum", "value"), work, limit=3)
    assert rewrite.within_unit(120.0, "percent") is None


def test_upsert_and_flags(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "p")], "k int, name string, role string")
    b = spark.createDataFrame([(2, "y", "q"), (3, "z", "r"), (3, "z", "r")], "k int, name string, role string").distinct()
    got = {r["k"]: (r["name"], r["role"]) for r in store.fused(a, b, "k", overrides=("role",)).collect()}
    assert got == {1: ("x", None), 2: ("y", "q"), 3: ("z", "r")}
    assert {r["k"]: r["has"] for r in store.flagged(a, b, "k", "has").collect()} == {1: False, 2: True}


def test_reconcile_finds_exactly_the_planted_faults(spark):
    rows = [(f"w{i}", i * 100, "c") for i in range(20)]
    bad = [*rows]
    bad[3], bad[7] = ("w3", 999, "c"), ("w7", 700, "d")
    del bad[11]
    cols = "work string, value long, client string"
    found = verify.reconcile(spark.createDataFrame(rows, cols), spark.createDataFrame(bad, cols), "work", {"value": 2, "client": 0}).collect()
    assert {(r["work"], r["field"]) for r in found} == {("w3", "value"), ("w7", "client"), ("w11", "(row)")}


def test_score(spark):
    df = spark.createDataFrame([(90.0, 100.0), (0.0, 0.0), (1.0, 0.0), (None, 5.0), (300.0, 100.0)], "got double, gold double")
    from pyspark.sql import functions as F

    assert [round(r[0], 6) for r in df.select(verify.score(F.col("got"), F.col("gold"))).collect()] == [0.9, 1.0, 0.0, 0.0, 0.0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLS)
    assert shapes.client_total(empty).count() == 0
    assert shapes.exclusion_aggregate(empty, ["x"]).count() == 0
    assert answer(QueryPlan("work", (), "max", "value"), empty) is None
