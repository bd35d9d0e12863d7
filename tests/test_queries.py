"""Every registered query beside its SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from tessera import catalog

DIR = "/root/testdata/sf0.001"
catalog.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name, tmp_path):
    catalog.QUERIES[name](spark, DIR).write.parquet(f"{tmp_path}/out")
    duck.sql(f"create or replace temp table want as {catalog.SQL[name]}")
    duck.sql(f"create or replace temp table got as select * from '{tmp_path}/out/*.parquet'")
    want, got = ({r[0]: r[1] for r in duck.sql(f"describe {t}").fetchall()} for t in ("want", "got"))
    assert want == got
    cols = ",".join(f'"{c}"' for c in sorted(want))
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


def test_upsert_over_all_customers(spark):
    keys = {r["k"] for r in catalog.QUERIES["upsert_whole"](spark, DIR).collect()}
    whole = {r[0] for r in spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey").collect()}
    assert whole <= keys


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_plans_neither_cross_join_nor_run_python(spark):
    for name in ("client_rollup", "threshold_gap", "comp_ratio", "temporal_chain", "unbilled_gap", "reconcile_diff"):
        plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_eq"](spark, DIR)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "lineitem" not in plan


@pytest.mark.parametrize("name", ["rank_gap", "comp_argsel_max", "priority_merge", "closing_by_user", "resolve_names", "works_led", "reduce_median", "estate_segment"])
def test_same_answers_with_other_partitions(spark, name):
    first = sorted(map(str, catalog.QUERIES[name](spark, DIR).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, catalog.QUERIES[name](spark, DIR).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
