"""Exact quantiles of groups of any size: counts of different values, one global order of them, and the values at the ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.prefix import running_within, written


def value_counts(rows: DataFrame, key: str = "column", value: str = "value") -> DataFrame:
    """key, value, n: how often each present value occurs. Write it if several passes follow."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, points: Sequence[float], key: str = "column", value: str = "value") -> DataFrame:
    """key, total (sum of n), q (array, in the order of points): quantiles, linear between ranks, of values that occur n times.

    counts has key, value and n, with each value of a key once. No group is held by one task, and a key's row is all
    that its group leaves. A key without a value has no row.
    """
    return at_ranks(ordered_values(counts, key, value), points, key, value)


def at_ranks(ordered: DataFrame, points: Sequence[float], key: str = "column", value: str = "value", n: str = "n", upto: str = "upto") -> DataFrame:
    """The same from counts n that have their running sums, as running_within adds them; a value with n = 0 counts for nothing."""
    total = F.col(f"{upto}_all")
    ranks = [(total - 1) * F.lit(float(p)) for p in points]
    at = lambda rank: F.max(F.when((F.col(upto) - F.col(n) <= rank) & (rank < F.col(upto)), F.col(value)))
    found = [x for i, r in enumerate(ranks) for x in (at(F.floor(r)).alias(f"low{i}"), at(F.ceil(r)).alias(f"high{i}"))]
    out = ordered.filter(F.col(n) > 0).groupBy(key).agg(F.max(total).alias(f"{upto}_all"), *found)
    low, high = ([F.col(f"{side}{i}").cast("double") for i in range(len(ranks))] for side in ("low", "high"))
    between = [F.when(a == b, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b) for a, b, r in zip(low, high, ranks, strict=True)]
    return out.select(key, total.alias("total"), F.array(*between).alias("q"))


def ordered_values(counts: DataFrame, key: str = "column", value: str = "value") -> DataFrame:
    """key, value, n, upto, upto_all: values that occur n times in their order, with running sums. Written, so several passes may read it."""
    return running_within(counts.select(key, value, "n"), key, [value], {"upto": "n"})


def median_mad(ordered: DataFrame, key: str = "column", value: str = "value") -> DataFrame:
    """key, total, median, mad (median absolute deviation from the median) of ordered_values, or of counts, which are ordered first. One row for each key."""
    ordered = ordered if "upto" in ordered.columns else ordered_values(ordered, key, value)
    middle = at_ranks(ordered, [0.5], key, value).select(key, "total", F.col("q")[0].alias("median"))
    middle = written(middle, "medians")  # read twice
    away = ordered.join(F.broadcast(middle), key).withColumn(value, F.abs(F.col(value) - F.col("median")))  # one row for each key
    away = away.groupBy(key, value).agg(F.sum("n").alias("n"))
    return middle.join(F.broadcast(quantiles(away, [0.5], key, value).select(key, F.col("q")[0].alias("mad"))), key)


def modes(rows: DataFrame, key: str = "column", value: str = "value") -> DataFrame:
    """key, mode: the most frequent present value, the least one of equals."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("mode")))["mode"].alias("mode"))
