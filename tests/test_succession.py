"""Runs and gaps of assets that span partitions and batches, against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millwright.operators import quality, succession
from millwright.operators.quality import Roles


def readings(n, assets, seed):
    rng = random.Random(seed)
    at, rows = 1_700_000_000, []
    for k in range(n):
        at += rng.choice([0, 1, 1, 2, 60])
        asset = rng.choice(assets)
        rows.append((k, asset, at + rng.random(), rng.choice([1.0, 1.0, 1.0, 2.0, None, float("nan")]), rng.choice(["on", "on", "off", None])))
    rng.shuffle(rows)
    return rows


def plain(rows, column):
    longest, gaps, groups = {}, defaultdict(int), defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups[r[1]].append(r)
    for asset, own in groups.items():
        own.sort(key=lambda r: (round(r[2] * 1e6), r[0]))
        best = run = 1
        for a, b in zip(own, own[1:], strict=False):
            gaps[(round(b[2] * 1e6) - round(a[2] * 1e6)) // 1_000_000] += 1
            run = run + 1 if b[column] is not None and b[column] == a[column] else 1
            best = max(best, run)
        longest[asset] = (best, len(own))
    return longest, dict(gaps)


@pytest.mark.parametrize(("assets", "batch", "partitions"), [(["a"], 7, 5), (["a"] * 30 + ["b", "c", None], 3, 9), (list(range(40)), 1, 3), (["a", "b"], 10000, 1)])
def test_borders_are_stitched(spark, assets, batch, partitions):
    rows = readings(400, assets, len(assets))
    kind = "long" if isinstance(assets[0], int) else "string"
    df = spark.createDataFrame(rows, f"k long, asset {kind}, at double, x double, s string").withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")))
    before = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, (batch, partitions, "false"), strict=True):
            spark.conf.set(c, v)
        clean = [(*r[:3], None if r[3] is None or r[3] != r[3] else r[3], r[4]) for r in rows]
        for column, place, values in (("x", 3, "double"), ("s", 4, "string")):
            found = quality.successive(df, Roles("k", asset="asset", ts="ts"), [column], values)
            longest, gaps = plain(clean, place)
            assert {r["asset"]: (r["longest"], r["n_rows"]) for r in succession.runs_by_asset(found).collect()} == longest
            assert {r["gap"]: r["n"] for r in succession.gap_counts(found).collect()} == gaps
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_without_assets_dates_and_rows(spark):
    df = spark.createDataFrame([(k, f"2024-01-{1 + k:02}", 1.0) for k in range(9)], "k long, d string, x double").withColumn("d", F.to_date("d"))
    roles = Roles("k", ts="d")
    assert quality.flatline_runs(df, roles, ["x"]).first()["longest"] == 9
    assert quality.sampling_gaps(df, roles).first()["median_gap"] == 86400
    assert quality.flatline_runs(df.limit(0), roles, ["x"]).count() == 0
    assert quality.sampling_gaps(df.limit(0), roles).first()["n_gaps"] == 0
