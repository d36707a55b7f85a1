"""Exact quantiles, medians and modes against Spark's aggregates and against plain code."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from millwright.functions.quantiles import median_mad, modes, quantiles, value_counts

POINTS = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def cells(spark):
    draw = random.Random(7)
    rows = [("ties", float(draw.randrange(5))) for _ in range(900)] + [("spread", draw.uniform(-9, 9)) for _ in range(301)]
    rows += [("one", 4.0), ("same", 2.0), ("same", 2.0), ("nulls", None), ("two", 1.0), ("two", None), ("two", 4.0)]
    return spark.createDataFrame(rows, "column string, value double").repartition(7)


def test_quantiles_are_those_of_percentile(cells):
    wanted = cells.filter("value is not null").groupBy("column").agg(F.count("*").alias("total"), F.percentile("value", F.array(*map(F.lit, POINTS))).alias("q"))
    found = {r["column"]: (r["total"], r["q"]) for r in quantiles(value_counts(cells), POINTS).collect()}
    assert found == {r["column"]: (r["total"], r["q"]) for r in wanted.collect()}


def test_median_and_mad(cells):
    values = {}
    for r in cells.filter("value is not null").collect():
        values.setdefault(r["column"], []).append(r["value"])
    found = {r["column"]: (r["median"], r["mad"]) for r in median_mad(value_counts(cells)).collect()}
    assert set(found) == set(values)
    for name, own in values.items():
        middle = statistics.median(own)
        assert found[name] == pytest.approx((middle, statistics.median(abs(x - middle) for x in own)))


def test_modes_take_the_least_of_equals(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("a", "x"), ("a", None), ("b", None)], "column string, value string")
    assert [tuple(r) for r in modes(df).collect()] == [("a", "x")]


def test_empty_table(spark):
    empty = value_counts(spark.createDataFrame([], "column string, value double"))
    assert quantiles(empty, POINTS).count() == 0
    assert median_mad(empty).count() == 0
