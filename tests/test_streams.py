"""Streams: events in the order of time whatever arrives when, and a keyed state that writes in proportion to its batches."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millwright.streaming import streams

START = dt.datetime(2024, 1, 1)
HOUR, DAY = 3600, 86400


def plain(rows, least, gap, silence):
    """What stream_watch tells of readings (asset, seconds, key, state), once all time has passed."""
    found = set()
    for asset in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == asset), key=lambda r: (r[1], r[2]))
        run = []
        for i, (_, at, _, state) in enumerate(own):
            if i and at - own[i - 1][1] > gap:
                found.add((asset, "gap", own[i - 1][1], at, at - own[i - 1][1], None))
            if i and at - own[i - 1][1] > silence:
                found.add((asset, "silent", own[i - 1][1], own[i - 1][1] + silence, None, None))
            if run and (state is None or state != run[-1][1]):
                found |= {(asset, "flatline", run[0][0], run[-1][0], len(run), run[0][1])} if len(run) >= least else set()
                run = []
            run += [(at, state)] if state is not None else []
        found |= {(asset, "flatline", run[0][0], run[-1][0], len(run), run[0][1])} if len(run) >= least else set()
        found.add((asset, "silent", own[-1][1], own[-1][1] + silence, None, None))
    return found


@pytest.mark.parametrize("batches", [1, 4])
def test_late_readings_ties_nulls_and_silent_assets(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows, at = [], 0
    for k in range(150):
        at += rng.choice([0, 60, HOUR, 9 * HOUR, 30 * HOUR])
        rows.append((rng.choice("ab") if k < 100 else "b", at, k, rng.choice(["on", "on", "on", "off", None])))
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 2 * HOUR - 1))  # up to two hours late
    parts = [late[i * len(late) // batches : (i + 1) * len(late) // batches] for i in range(batches)] + [[("end", at + 400 * DAY, -1, None)]]
    schema = "asset string, s long, key long, state string"
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.lit(int(START.replace(tzinfo=dt.UTC).timestamp())) + F.col("s"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    readings = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = streams.drain(streams.stream_watch(readings, "asset", "ts", "key", "state", "2 hours", 3, "1 day", "2 days", "300 days"), "watch", rocksdb=True).collect()
    told = [(r.asset, r.kind, *[int((t - START).total_seconds()) for t in (r.started, r.ended)], r.n, r.state) for r in out]
    assert len(told) == len(set(told))
    assert set(told) == plain(rows, 3, DAY, 2 * DAY)
    assert {"flatline", "gap", "silent"} == {r[1] for r in told}


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_keyed_state_writes_in_proportion_and_bears_retries(spark, tmp_path):
    store, rng, seen, grown = str(tmp_path / "state"), random.Random(3), {}, []
    sink = streams.keyed_state(store, "name", "at", "key", fan=3)
    names = [f"name{i}" for i in range(20000)]
    for epoch in range(10):
        rows = [(n, 0, i) for i, n in enumerate(names)] if not epoch else [(rng.choice(names), rng.randint(1, 5), 10**6 * epoch + i) for i in range(50)]
        for name, at, key in rows:
            seen[name] = max(seen.get(name, (-1, -1)), (at, key))
        batch = spark.createDataFrame(rows, "name string, at int, key long").coalesce(1)
        before = size(store)
        sink(batch, epoch)
        grown.append(size(store) - before)
        if epoch in (3, 5):
            sink(batch, epoch)  # the micro-batch was tried again
        if epoch in (0, 5, 9):
            rows = streams.latest_state(spark, store).collect()
            assert {r["name"]: (r["at"], r["key"]) for r in rows} == seen and len(rows) == len(seen)
    small = sorted(g for g in grown[1:])
    assert small[len(small) // 2] < grown[0] / 5  # most batches write what they bring
    assert len(list((tmp_path / "state").glob("level=*/run=*"))) < 10
