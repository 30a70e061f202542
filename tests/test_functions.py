from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import scalar
from measurelake.functions import quantiles
from measurelake.functions.quantiles import exact_quantiles


def evaluate(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_rounding_uses_the_binary_value(spark):
    values = [1.005, 0.285, 2.5, -2.5, 0.125, -0.001, None, 1e300, float("inf")]
    got = evaluate(spark, values, lambda v: scalar.round_half_up(v, 2))
    assert got == [1.0, 0.28, 2.5, -2.5, 0.13, 0.0, None, 1e300, float("inf")]
    assert str(got[5]) == "0.0"
    nan = evaluate(spark, [float("nan")], lambda v: scalar.round_half_up(v, 2))[0]
    assert nan != nan


@pytest.mark.parametrize(
    "pm25, aqi",
    [(0.0, 0.0), (8.0, 33.3333), (12.0, 50.0), (12.01, 50.0209), (25.0, 77.2222), (35.4, 99.0),
     (35.41, 100.0245), (55.4, 149.0), (55.41, 150.0052), (150.4, 199.0), (150.41, 200.0099),
     (250.4, 299.0), (250.41, 300.008), (500.4, 499.0), (833.84, 764.4182), (-1.0, -4.1667)],
)
def test_aqi_scale(spark, pm25, aqi):
    assert evaluate(spark, [pm25], scalar.aqi_from_pm25)[0] == pytest.approx(aqi, abs=1e-4)


def test_bands_and_levels(spark):
    bands = evaluate(spark, [0.0, 50.0, 50.5, 100.0, 150.0, 200.0, 300.0, 301.0, None], scalar.aqi_band)
    assert [b[0] for b in bands] == list("112234566")
    assert evaluate(spark, [None], lambda v: scalar.aqi_band(v, "none")) == ["none"]
    levels = evaluate(spark, [12.0, 12.1, 35.4, 55.4, 150.4, 250.4, 251.0, None], scalar.pm25_level)
    assert levels == ["safe", "moderate", "moderate", "unhealthy", "very_unhealthy", "hazardous",
                      "beyond_hazardous", None]


def test_calendar(spark):
    days = [date(2024, 1, 7), date(2024, 2, 29), date(2024, 9, 7), date(2024, 12, 31)]
    assert evaluate(spark, days, scalar.weekday_number, "date") == [0, 4, 6, 2]
    names = evaluate(spark, days, lambda d: scalar.weekday_name(scalar.weekday_number(d)), "date")
    assert names == ["Sonntag", "Donnerstag", "Samstag", "Dienstag"]
    assert evaluate(spark, days, scalar.quarter_label, "date") == ["Q1", "Q1", "Q3", "Q4"]
    assert evaluate(spark, days, scalar.season, "date") == ["Winter", "Winter", "Fall", "Winter"]
    assert evaluate(spark, days, scalar.year_month, "date")[1] == "2024-02"


def test_division_by_zero_is_null(spark):
    assert evaluate(spark, [0.0, 2.0], lambda v: scalar.divide(F.lit(1.0), v)) == [None, 0.5]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select(F.col("id"))
    first = df.select("id", scalar.stable_normal(F.lit(3), F.col("id")).alias("z"))
    second = df.repartition(7).select("id", scalar.stable_normal(F.lit(3), F.col("id")).alias("z"))
    a, b = ({r.id: r.z for r in d.collect()} for d in (first, second))
    assert a == b
    assert abs(np.mean(list(a.values()))) < 0.3 and 0.7 < np.std(list(a.values())) < 1.3


PROBABILITIES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def samples():
    rng = random.Random(5)
    return {
        "hot": [rng.gauss(0, 50) for _ in range(3000)],  # most of all rows
        "ties": [1.0] * 500 + [2.0] * 500,
        "narrow": [1013.0 + rng.random() * 1e-6 for _ in range(400)],
        "negative": [-float(i) for i in range(101)],
        "wide": [10.0**i for i in range(-5, 16)],
        "one": [4.25],
        "two": [1.0, 2.0],
        None: [float(i) for i in range(10)],
    }


def test_quantiles_equal_numpy(spark):
    groups = samples()
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = exact_quantiles(df, ["k"], "v", PROBABILITIES).collect()
    assert {r.k for r in got} == set(groups)
    for r in got:
        for name, p in PROBABILITIES.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.k], p), rel=1e-12, abs=1e-12)


def test_quantiles_order_special_values_last(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, [], "v", {"lo": 0.0, "m": 0.5, "q3": 0.75}).collect()[0]
    assert (row.lo, row.m, row.q3) == (float("-inf"), 2.0, float("inf"))


def test_quantiles_without_keys_and_without_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(7)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0].m == 3.0
    empty = exact_quantiles(df.where("v < 0"), [], "v", {"m": 0.5}).collect()
    assert [r.m for r in empty] == [None]
    assert exact_quantiles(df.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("low, width", [(1e6, 500.0), (0.0, 0.0006), (-1e6, 1.0)])
def test_close_values_do_not_crowd_a_cell(spark, low, width):
    n = 20_000
    df = spark.range(n).select((F.lit(low) + F.col("id") * F.lit(width / n)).alias("v"))
    bounds = df.agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    cells = df.withColumn("c", quantiles._cell(F.col("v")))
    most = cells.crossJoin(bounds).groupBy("c", quantiles._part(F.col("v"))).count().agg(F.max("count"))
    assert most.first()[0] <= 4
    values = np.array([r.v for r in df.collect()])
    got = exact_quantiles(df, [], "v", PROBABILITIES).first()
    for name, p in PROBABILITIES.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


def test_cells_follow_the_order_of_values(spark):
    values = [float("-inf"), -1e300, -2.0, -1e-9, -5e-324, 0.0, 5e-324, 1e-300, 0.5, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r.c for r in df.select("i", quantiles._cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells) and len(set(cells)) == len(cells)
