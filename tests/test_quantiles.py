"""Quantiles from sketch brackets."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import quantiles
from measurelake.functions.quantiles import bracketed_quantiles

PROBABILITIES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def samples():
    rng = random.Random(7)
    return {
        "hot": [rng.gauss(0, 50) for _ in range(30_000)],
        "ties": [1.0] * 5000 + [2.0] * 5000,
        "rounded": [round(rng.expovariate(0.1), 1) for _ in range(9000)],
        "narrow": [1013.0 + rng.random() * 1e-6 for _ in range(4000)],
        "wide": [10.0**i for i in range(-5, 16)],
        "one": [4.25],
        "two": [1.0, 2.0],
        None: [float(i) for i in range(3000)],
    }


def test_equal_numpy(spark):
    groups = samples()
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = bracketed_quantiles(df, ["k"], "v", PROBABILITIES).collect()
    assert {r.k for r in got} == set(groups)
    for r in got:
        for name, p in PROBABILITIES.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.k], p), rel=1e-12, abs=1e-12)


def test_special_values_come_last(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = bracketed_quantiles(df, [], "v", {"lo": 0.0, "m": 0.5, "q3": 0.75, "top": 1.0}).first()
    assert (row.lo, row.m, row.q3) == (float("-inf"), 2.0, float("inf")) and math.isnan(row.top)
    many = spark.range(20_000).select(F.when(F.col("id") < 100, float("nan")).otherwise(F.col("id")).alias("v"))
    assert bracketed_quantiles(many, [], "v", {"m": 0.5}).first().m == 10_099.5
    only = spark.createDataFrame([(float("nan"),)] * 3, "v double")
    assert math.isnan(bracketed_quantiles(only, [], "v", {"m": 0.5}).first().m)


def test_without_values(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert bracketed_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0
    assert [r.m for r in bracketed_quantiles(df, [], "v", {"m": 0.5}).collect()] == [None]


def test_only_values_inside_brackets_are_shuffled(spark, tmp_path):
    spark.range(200_000).select((F.rand(3) * 1000).alias("v")).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    found = bracketed_quantiles(df, [], "v", {"m": 0.5})
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall("FileScan parquet", text)) <= 2 + text.count("ReusedExchange")
    counted = found._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        metrics = node.metrics()
        if "shuffleRecordsWritten" in str(metrics.keySet().toString()):
            written.append(metrics.apply("shuffleRecordsWritten").value())
        for child in range(node.children().size()):
            walk(node.children().apply(child))
        if "finalPhysicalPlan" in dir(node):
            walk(node.finalPhysicalPlan())
        if "plan" in dir(node) and "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(counted)
    assert written and max(written) < 200_000 * 2 * quantiles._MARGIN * 1.5


def test_a_bracket_that_misses_is_an_error(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    wrong = spark.range(1).select(
        F.lit(4000.0).alias("x")).agg(F.kll_sketch_agg_double("x", quantiles.SKETCH).alias("_sketch")).select(
        "_sketch", F.lit(5000).cast("long").alias("_total"), F.lit(0.0).alias("_min"), F.lit(4999.0).alias("_max"),
        F.lit(5000).cast("long").alias("_numbers"))
    with pytest.raises(Exception, match="outside of its bracket"):
        bracketed_quantiles(df, [], "v", {"m": 0.5}, wrong).collect()
