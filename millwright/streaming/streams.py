"""The batch operators on streams of readings."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from millwright.functions.prefix import shared_dir
from millwright.operators.anomaly import RobustStats, robust_scores
from millwright.operators.ledger import current_state


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """A folder of files as a stream, `files` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


#: State on the executors' disks instead of their heaps; operators with timers need it.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, name: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, rocksdb: bool = False) -> DataFrame | None:
    """Run a stream over what is there and stop: the rows that it wrote as Parquet, or None with a sink for each micro-batch."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/millwright/{name}-{uuid.uuid4().hex[:12]}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    before = spark.conf.get(ROCKSDB[0])
    if rocksdb:
        spark.conf.set(*ROCKSDB)
    try:
        query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(f"{path}/rows")
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(ROCKSDB[0], before)
    return None if sink else spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_scores(readings: DataFrame, stats: RobustStats, columns: Sequence[str], key: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """The key, robust_score and flagged of each reading: a projection without state."""
    out = robust_scores(readings, stats, columns, key)
    return out.select(*key, "robust_score", (F.col("robust_score") > threshold).alias("flagged"))


def stream_dedup(readings: DataFrame, asset: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first reading of each asset and time; state is kept as long as the watermark may bring a copy."""
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([asset, ts])


def stream_window_counts(readings: DataFrame, ts: str, value: str, edges: Sequence[float], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, bin, n: readings by tumbling window and by baseline bin, to be joined to the baseline's counts."""
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value)))
    place = F.when(F.col(value) == float(edges[-1]), len(edges) - 1).otherwise(place)
    rows = readings.filter(F.col(value).isNotNull()).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, width).alias("w"), place.alias("bin")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "bin", "n")


def window_psi(counts: DataFrame, baseline: DataFrame, n_bins: int, epsilon: float = 1e-6) -> DataFrame:
    """window_start, n, psi of each window's bin counts against the baseline's (bin, b)."""
    windows = counts.groupBy("window_start").agg(F.sum("n").alias("all_n"))
    base = baseline.withColumn("all_b", F.lit(baseline.agg(F.sum("b")).first()[0]))  # a row for each bin
    grid = windows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).join(F.broadcast(base), "bin", "left")
    full = grid.join(counts, ["window_start", "bin"], "left").fillna(0, ["n", "b"])
    total = base.agg(F.max("all_b")).first()[0]
    p = (F.col("n") + epsilon) / (F.col("all_n") + epsilon * n_bins)
    q = (F.col("b") + epsilon) / (F.lit(total) + epsilon * n_bins)
    return full.groupBy("window_start", "all_n").agg(F.sum((p - q) * F.ln(p / q)).alias("psi")).select("window_start", F.col("all_n").alias("n"), "psi")


def stream_flatline(readings: DataFrame, asset: str, ts: str, state: str, rows: int = 3) -> DataFrame:
    """asset, run: each time a run of equal successive readings of an asset reaches `rows`. Readings are taken in the order of time within a micro-batch.

    The state of an asset is its last reading and the length of its run.
    """
    kinds = f"asset {readings.schema[asset].dataType.simpleString()}, state string, run long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last, run = held.get if held.exists else (None, 0)
        found = []
        for value in pd.concat(parts).sort_values("ts")["state"].tolist():
            run = run + 1 if value is not None and value == last else int(value is not None)
            last = value
            if run == rows:
                found.append((key[0], value, run))
        held.update((last, run))
        yield pd.DataFrame(found, columns=["asset", "state", "run"])

    rows_ = readings.select(F.col(asset).alias("asset"), F.col(ts).alias("ts"), F.col(state).cast("string").alias("state"))
    return rows_.groupBy("asset").applyInPandasWithState(step, kinds, "last string, run long", "append", "NoTimeout")


#: Readings in one item of a buffer.
CHUNK = 10_000


class _Watch(StatefulProcessor):
    """An asset's readings in the order of time. State: readings that the watermark has not passed (buffer), and the last one that was judged, with its run.

    Each call for state costs Python and the JVM far more than a reading does. So a buffer's item holds the readings of a micro-batch, readings
    that are not due are left unread, and the one timer is known from the last reading's row.
    """

    def __init__(self, key: T.DataType, rows: int, gap: int, silence: int, forget: int):
        self.kind, self.rows, self.gap, self.silence, self.forget = key, rows, gap, silence, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        many = [T.StructField(c, T.ArrayType(kind)) for c, kind in (("at", T.LongType()), ("key", self.kind), ("state", T.StringType()))]
        last = {"at": T.LongType(), "state": T.StringType(), "run": T.LongType(), "since": T.LongType(), "told": T.BooleanType(), "wake": T.LongType()}
        self.handle = handle
        self.buffer = handle.getListState("buffer", T.StructType(many))
        self.last = handle.getValueState("last", T.StructType([T.StructField(c, kind) for c, kind in last.items()]))

    def _last(self) -> tuple:
        """The last reading that was judged (time None: none yet), its run, and the time of the asset's timer."""
        return self.last.get() or (None, None, 0, 0, False, None)

    def _judge(self, asset: object, now: int, timer: bool) -> Iterator[pd.DataFrame]:
        """What is known up to the watermark (milliseconds); later readings stay in the buffer, and a timer wakes the asset for the next of them.

        timer: the asset's timer has called, and Spark deletes it.
        """
        found: list[tuple] = []
        at, state, run, since, told, wake = self._last()
        wake = None if timer else wake
        held = sorted((r for chunk in self.buffer.get() for r in zip(*chunk, strict=True)), key=lambda r: r[:2])
        due = bisect_right(held, now, key=lambda r: r[0] // 1000)

        def ended() -> None:
            if run >= self.rows:
                found.append((asset, "flatline", since, at, run, state))

        def silent() -> None:
            found.append((asset, "silent", at, at + self.silence, None, None))

        def forgotten(until: int) -> bool:
            return at is not None and until > at + self.forget

        for t, _, x in held[:due]:
            if forgotten(t):
                if not told:
                    silent()
                ended()
                at, state, run, told = None, None, 0, False
            if at is not None:
                if t - at > self.silence and not told:
                    silent()
                if t - at > self.gap:
                    found.append((asset, "gap", at, t, (t - at) // 1_000_000, None))
            if x is not None and x == state:
                run += 1
            else:
                ended()
                run, since = int(x is not None), t
            at, state, told = t, x, False
        rest = held[due:]
        clock = now * 1000
        if at is not None and not rest and clock > at + self.silence and not told:
            silent()
            told = True
        if due:
            self.buffer.put([tuple(map(list, zip(*rest[i : i + CHUNK], strict=True))) for i in range(0, len(rest), CHUNK)]) if rest else self.buffer.clear()
        if not rest and forgotten(clock):
            ended()
            self.last.clear()
            self._wake(wake, None)
        else:
            wake = self._wake(wake, max(now + 1, -(-(rest[0][0] if rest else at + (self.forget if told else self.silence) + 1000) // 1000)))
            self.last.update((at, state, run, since, told, wake))
        if found:
            asset_, kind, *times, n, state_ = zip(*found, strict=True)
            started, ended_ = (pd.DatetimeIndex(np.array(t, "datetime64[us]")).tz_localize("UTC") for t in times)
            yield pd.DataFrame({"asset": asset_, "kind": kind, "started": started, "ended": ended_, "n": pd.array(n, "Int64"), "state": state_})

    def _wake(self, there: int | None, when: int | None) -> int | None:
        """One timer, at `when` instead of `there`: a reading's time, or when silence or the time to forget has passed."""
        if there != when:
            if there is not None:
                self.handle.deleteTimer(there)
            if when is not None:
                self.handle.registerTimer(when)
        return when

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for part in rows:
            at, states = part["at"].tolist(), [x if isinstance(x, str) else None for x in part["state"].tolist()]
            self.buffer.appendValue((at, part["key"].tolist(), states))
            firsts.append(min(at))
        first, now = min(firsts), max(timerValues.getCurrentWatermarkInMs(), 0)
        if first // 1000 <= now:
            yield from self._judge(key[0], now, False)
            return
        *last, wake = self._last()  # what else is due has a timer
        if wake is None or wake > -(-first // 1000):
            self.last.update((*last, self._wake(wake, -(-first // 1000))))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key[0], max(timerValues.getCurrentWatermarkInMs(), 0), True)

    def close(self) -> None:
        pass


def stream_watch(
    readings: DataFrame, asset: str, ts: str, key: str, state: str, delay: str = "1 hour", rows: int = 3, gap: str = "1 day", silence: str = "2 days", forget: str = "60 days"
) -> DataFrame:
    """asset, kind, started, ended, n, state: what happens to assets, in the order of their readings' time, whatever the order of arrival within delay.

    flatline: a run of at least `rows` equal successive states, told when it has ended (n readings; a null ends it and is none). gap:
    successive readings more than `gap` apart (n seconds). silent: no reading for `silence` after one at `started`, told once, by a
    timer when the watermark passes, so an asset needs no further reading to be missed. After `forget` without a reading an asset's
    open run is told and its state dropped. Readings later than delay are dropped. State holds an asset's readings of the last delay and one row.
    Ties of time are judged by key. Needs the RocksDB state store: drain(rocksdb=True).
    """
    micros = [int(pd.Timedelta(x).value // 1000) for x in (gap, silence, forget)]
    columns = [F.col(asset).alias("asset"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).alias("key"), F.col(state).cast("string").alias("state")]
    rows_ = readings.filter(F.col(asset).isNotNull() & F.col(ts).isNotNull()).select(columns)
    schema = T.StructType([rows_.schema["asset"], T.StructField("kind", T.StringType()), *[T.StructField(c, T.TimestampType()) for c in ("started", "ended")], T.StructField("n", T.LongType()), T.StructField("state", T.StringType())])
    watch = _Watch(rows_.schema["key"].dataType, rows, *micros)
    return rows_.withWatermark("ts", delay).groupBy("asset").transformWithStateInPandas(watch, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def keyed_state(store: str, by: str, at: str, key: str, fan: int = 4) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest event of each name, and writes in proportion to the micro-batch.

    A micro-batch becomes a run: its latest event of each name, at level 0. As soon as a level has `fan` runs they are merged into one of the
    next level, so an event is written again once for each level: log(events) times. A version lists the runs that
    count; it is written last, so a micro-batch that is tried again starts from the version before it and leaves the same state. Runs that neither of
    the last two versions lists are deleted. A table that is read while it is written stays whole for one more micro-batch.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        runs = _version(spark, store, epoch - 1)
        keep, level = set(runs), 0
        current_state(batch, by, at, key).write.mode("overwrite").parquet(f"{store}/level=0/run={epoch}")
        runs = [*runs, (0, epoch)]
        while len(own := [r for r in runs if r[0] == level]) >= fan:
            merged = (level + 1, epoch)
            current_state(_runs(spark, store, own), by, at, key).write.mode("overwrite").parquet(f"{store}/level={level + 1}/run={epoch}")
            runs, level = [*[r for r in runs if r[0] != level], merged], level + 1
        spark.createDataFrame([(*r, by, at, key) for r in runs], "level int, run long, by string, at string, key string").coalesce(1).write.mode("overwrite").parquet(f"{store}/versions/{epoch}")
        for old in set(_version(spark, store, epoch - 2)) - keep - set(runs):
            _delete(spark, f"{store}/level={old[0]}/run={old[1]}")
        _delete(spark, f"{store}/versions/{epoch - 2}")

    return sink


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _version(spark: SparkSession, store: str, epoch: int) -> list[tuple[int, int]]:
    """The runs of a version, few of each level; none before the first one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions/{epoch}")
    if epoch < 0 or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted(tuple(r) for r in spark.read.parquet(f"{store}/versions/{epoch}").select("level", "run").collect())


def _runs(spark: SparkSession, store: str, runs: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{store}/level={level}/run={run}" for level, run in runs])


def latest_state(spark: SparkSession, store: str) -> DataFrame:
    """What keyed_state holds: the latest event of each name over the runs of the last version, so a name is met once for each of few runs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    last = max(int(f.getPath().getName()) for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    names = spark.read.parquet(f"{store}/versions/{last}").select("by", "at", "key").first()
    return current_state(_runs(spark, store, _version(spark, store, last)), *names)
