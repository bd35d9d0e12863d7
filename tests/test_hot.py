"""Order statistics, running values and leaders on keys that hold most rows."""

import random
from statistics import median as plain_median

import pytest
from pyspark.sql import functions as F

from tessera.operators import hot, store


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    out = [("hot", pick.choice([pick.randint(-5, 5), pick.randint(-(10**12), 10**12), int(pick.expovariate(1e-4))]), k) for k in range(4001)]
    out += [(f"k{pick.randint(0, 40)}", pick.randint(0, 9), 5000 + k) for k in range(800)]
    out += [("same", 7, 6000 + k) for k in range(700)] + [("none", None, 7000), ("hot", None, 7001), (None, 3, 7002), (None, 4, 7003)]
    pick.shuffle(out)
    return out


def test_median_by_narrowing(spark, rows):
    df = spark.createDataFrame(rows, "key string, v long, id long").repartition(5)
    want = {}
    for k, v, _ in rows:
        want.setdefault(k, []).extend([] if v is None else [v])
    want = {k: plain_median(vs) if vs else None for k, vs in want.items()}
    got = {r["key"]: r["median"] for r in hot.median(df, "key", "v", small=100).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    assert {r["key"]: r["median"] for r in hot.median(df.filter("key = 'same'"), "key", "v", small=10).collect()} == {"same": 7.0}
    assert hot.median(df.filter("false"), "key", "v").count() == 0


def test_running_and_previous_by_blocks(spark, rows):
    df = spark.createDataFrame(rows, "key string, v long, id long").repartition(5)
    for blocked, plain in ((hot.running(df, "key", ["id"], F.col("v"), "x"), store.running(df, "key", ["id"], F.col("v"), "x")), (hot.previous(df, "key", ["id"], "v", "x"), store.previous(df, "key", ["id"], "v", "x"))):
        assert sorted(map(str, blocked.select("key", "v", "id", "x").collect())) == sorted(map(str, plain.select("key", "v", "id", "x").collect()))
    blocks = hot._blocks(df.repartition(8), "key", ["id"]).filter("key = 'hot'").select("__block").distinct().count()
    assert blocks >= 1


def test_a_hot_key_is_many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert hot._blocks(spark.range(10_000).select(F.lit("one").alias("key"), "id"), "key", ["id"]).select("__block").distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_leaders(spark, rows):
    df = spark.createDataFrame(rows, "key string, v long, id long")
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    assert [tuple(r) for r in hot.leaders(df, 7, "v", "id").collect()] == sorted(rows, key=order)[:7]
    want = [r for k in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == k), key=order)[:3]]
    per = hot.leaders(df, 3, "v", "id", "key")
    assert sorted(map(str, map(tuple, per.collect()))) == sorted(map(str, want))
    assert "WindowGroupLimit" in per._jdf.queryExecution().executedPlan().toString()


def test_priority_needs_a_tie_breaker(spark):
    rows = [("a", 1, k, f"x{k}") for k in range(50)] + [("b", 2, 1, "y"), ("b", 1, 9, "z")]
    found = {n: store.prioritised(spark.createDataFrame(rows, "k string, p int, id int, v string").repartition(n), ["k"], "p", ["id"]) for n in (1, 7)}
    assert [sorted(map(tuple, df.collect())) for df in found.values()] == [[("a", 1, 0, "x0"), ("b", 1, 9, "z")]] * 2
    with pytest.raises(TypeError):
        store.prioritised(spark.createDataFrame(rows, "k string, p int, id int, v string"), ["k"], "p")
