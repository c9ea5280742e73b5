"""Sliced windows must equal plain windows, for any slice width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    data = []
    for key, n in (("hot", 400), ("cold", 7), (None, 5), ("one", 1)):
        for i in range(n):
            data.append((key, rnd.randrange(1000) if n > 1 else 4, i, rnd.randrange(50), rnd.choice(["x", None, "y"])))
    return spark.createDataFrame(data, "k string, t int, i int, v int, s string").cache()


@pytest.mark.parametrize("width", [1, 37, 5000])
def test_previous_row(series, rows, width):
    got = ordered.previous_row(series, ["k"], ["t", "i"], ["v", "s"], ordered.number_slice("t", width))
    w = Window.partitionBy("k").orderBy("t", "i")
    want = series.withColumn("prev", F.lag(F.struct("v", "s")).over(w))
    assert rows(got, "k", "t", "i", "prev") == rows(want, "k", "t", "i", "prev")


@pytest.mark.parametrize("width", [1, 37, 5000])
def test_running_totals(series, rows, width):
    got = ordered.running_totals(series, ["k"], ["t", "i"], {"c": F.col("v")}, ordered.number_slice("t", width))
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "k", "t", "i", "c") == rows(series.withColumn("c", F.sum("v").over(w)), "k", "t", "i", "c")


@pytest.mark.parametrize("width", [1, 37, 5000])
def test_running_last(series, rows, width):
    got = ordered.running_last(series, ["k"], ["t", "i"], {"l": F.col("s")}, ordered.number_slice("t", width))
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = series.withColumn("l", F.last("s", ignorenulls=True).over(w))
    assert rows(got, "k", "t", "i", "l") == rows(want, "k", "t", "i", "l")


@pytest.mark.parametrize("accuracy", [5, 10_000])
def test_order_statistics(series, accuracy):
    known = series.filter(F.col("k").isNotNull())
    picks = {
        "median": ordered.median_position(),
        "upper": ordered.upper_median_position(),
        "p95": ordered.quantile_position(0.95),
    }
    got = {r["k"]: r for r in ordered.order_statistics(known, ["k"], "v", picks, accuracy).collect()}
    groups = {}
    for r in known.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    for k, values in groups.items():
        values.sort()
        n = len(values)
        assert got[k]["n"] == n
        assert got[k]["median"] == (values[(n - 1) // 2] + values[n // 2]) / 2
        assert got[k]["upper"] == values[n // 2]
        assert got[k]["p95"] == values[int(n * 0.95)]


def test_first_and_last_per_key(series, rows):
    first = ordered.first_per_key(series, ["k"], ["t", "i"])
    last = ordered.last_per_key(series, ["k"], ["t", "i"])
    w = Window.partitionBy("k")
    numbered = series.withColumn("a", F.row_number().over(w.orderBy("t", "i"))).withColumn(
        "z", F.row_number().over(w.orderBy(F.desc("t"), F.desc("i")))
    )
    assert rows(first) == rows(numbered.filter("a = 1").drop("a", "z"))
    assert rows(last) == rows(numbered.filter("z = 1").drop("a", "z"))


def test_top_per_group_limits_before_shuffle(series):
    plan = ordered.top_per_group(series, ["k"], [F.col("v").desc(), F.col("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_order_statistics_narrows_one_hot_group(spark):
    n = 1_000_000
    hot = spark.range(n).select(F.lit(None).cast("string").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    picks = {"median": ordered.median_position(), "p95": ordered.quantile_position(0.95)}
    near = ordered.brackets(hot, ["k"], "v", picks, accuracy=100, sorted_rows=500).cache()
    sizes = near.groupBy("_k", "_before").count().agg(F.max("count"), F.count(F.lit(1))).head()
    assert 0 < sizes[0] <= 500 and sizes[1] <= 3
    got = ordered.order_statistics(hot, ["k"], "v", picks, accuracy=100, sorted_rows=500).collect()
    assert [tuple(r) for r in got] == [(None, n, 499_999.5, 950_000.0)]


@pytest.mark.parametrize("sorted_rows", [1, 3])
def test_order_statistics_with_small_brackets(series, sorted_rows):
    picks = {"median": ordered.median_position(), "p95": ordered.quantile_position(0.95)}
    want = {r["k"]: tuple(r) for r in ordered.order_statistics(series, ["k"], "v", picks).collect()}
    got = {r["k"]: tuple(r) for r in ordered.order_statistics(series, ["k"], "v", picks, 5, sorted_rows).collect()}
    assert got == want and set(got) == {"hot", "cold", "one", None}


def test_order_statistics_of_no_rows(series):
    picks = {"median": ordered.median_position()}
    assert ordered.order_statistics(series.filter("false"), ["k"], "v", picks).collect() == []


def test_equal_depth_cuts_one_key_of_all_rows(spark):
    n = 200_000
    one = spark.range(n).select(F.lit("a").alias("k"), F.lit(5).alias("t"), ((F.col("id") * 7919) % n).alias("i"))
    with_conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(with_conf, "false")
    try:
        cut = ordered.equal_depth(one, ["k"], ["t", "i"], "part", "at")
    finally:
        spark.conf.unset(with_conf)
    parts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.max("at").alias("at")).orderBy("part").collect()
    assert len(parts) == 8 and max(p["n"] for p in parts) < 2 * n / len(parts)
    assert all(a["high"] + 1 == b["low"] for a, b in zip(parts, parts[1:])) and all(p["at"] == p["n"] - 1 for p in parts)
    paired = ordered.previous_row(cut, ["k"], ["t", "i"], ["i"], F.col("part"))
    assert paired.filter("prev is null").count() == 1
    assert paired.filter("prev.i + 1 = i").count() == n - 1


def test_positions_of_all_rows(series, rows):
    w = Window.orderBy("t", "i", "k")
    want = series.withColumn("pos", F.row_number().over(w).cast("long"))
    assert rows(ordered.positions(series, ["t", "i", "k"])) == rows(want)
    assert ordered.positions(series.filter("false"), ["t"]).collect() == []
