"""Successive readings of assets of any size: runs of equal values and gaps between times.

Readings are range-partitioned by asset, time and key, so an asset that holds most rows is spread over many tasks. A pass over
the sorted rows leaves a summary of each asset for each batch of them: its first and last run, its longest run between them,
and its first and last time. Summaries of neighbours are stitched, first those of a partition, then those of an asset, so a
run or gap that crosses borders is whole again. No window by asset, and no unpivot: all columns are read in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import normalise_missing
from millwright.functions.prefix import written

#: A stretch of an asset's readings: rows, its first run (first_n readings of first_value), its last one, whether both are one, the longest between; first and last time.
_STRETCH = "rows long, first_n long, first_value {kind}, last_n long, last_value {kind}, whole boolean, longest long, first_us long, last_us long"


def _runs(column: pa.Array, starts: np.ndarray) -> dict[str, pa.Array]:
    """first_n, first_value, last_n, last_value, whole and longest of each stretch that begins at starts."""
    n = len(column)
    same = np.zeros(n, bool)
    same[1:] = pc.fill_null(pc.equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
    same[starts] = False
    at = np.flatnonzero(~same)
    length = np.diff(np.append(at, n))
    length[column.take(pa.array(at)).is_null().to_numpy(zero_copy_only=False)] = 0  # a null is no reading and a run of its own
    first = np.searchsorted(at, starts)
    last = np.append(first[1:], len(at)) - 1
    inner = length.copy()
    inner[first], inner[last] = 0, 0
    values = column.take(pa.array(at))
    return {
        "first_n": pa.array(length[first]), "first_value": values.take(pa.array(first)), "last_n": pa.array(length[last]), "last_value": values.take(pa.array(last)),
        "whole": pa.array(first == last), "longest": pa.array(np.maximum.reduceat(inner, first)),
    }


def succession(df: DataFrame, asset: str | None, ts: str, key: str, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """The written summaries that flatline_runs and gap_counts read. Rows without a time, or without an asset where there is one, are left out.

    item is "run" (a stretch of a column) or "gap" (n times gap whole seconds within a batch, and the stretch of times with column null).
    """
    rows = normalise_missing(df).filter(F.col(ts).isNotNull())
    rows = rows.filter(F.col(asset).isNotNull()) if asset else rows
    name = (F.col(asset) if asset else F.lit(None).cast("string")).alias("asset")
    time = F.col(ts).cast("timestamp_ntz") if dict(df.dtypes)[ts] == "date" else F.col(ts)
    rows = rows.select(name, time.alias("ts"), F.col(key).alias("key"), *[F.col(c).cast(kind).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.repartitionByRange("asset", "ts", "key").sortWithinPartitions("asset", "ts", "key").drop("key")
    fields = "part int, place long, item string, column string, asset {asset}, gap long, n long, " + _STRETCH
    schema = rows.limit(0).select("asset").schema["asset"].dataType.simpleString()
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(b for b in batches if b.num_rows):
            n, owner = batch.num_rows, batch.column(0)
            new = np.ones(n, bool)
            new[1:] = pc.fill_null(pc.not_equal(owner.slice(1), owner.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            ends, assets = np.append(starts[1:], n), owner.take(pa.array(starts))
            us = batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            stretch = {"rows": pa.array(ends - starts), "first_us": pa.array(us[starts]), "last_us": pa.array(us[ends - 1])}
            for i, c in enumerate(names):
                yield _record(stretch | _runs(batch.column(2 + i), starts), len(starts), part, place, "run", c, assets)
            yield _record(stretch, len(starts), part, place, "gap", None, assets)
            gap, times = np.unique((us[1:] - us[:-1])[~new[1:]] // 1_000_000, return_counts=True)
            yield _record({"gap": pa.array(gap), "n": pa.array(times)}, len(gap), part, place, "gap", None, pa.nulls(len(gap), owner.type))

    def _record(known: dict[str, pa.Array], n: int, part: int, place: int, item: str, column: str | None, assets: pa.Array) -> pa.RecordBatch:
        known |= {"part": pa.array(np.full(n, part, np.int32)), "place": pa.array(np.full(n, place)), "item": pa.array([item] * n, pa.string()), "column": pa.array([column] * n, pa.string()), "asset": assets}
        value = pa.string() if kind == "string" else pa.float64()
        kinds = {"part": pa.int32(), "item": pa.string(), "column": pa.string(), "asset": assets.type, "first_value": value, "last_value": value, "whole": pa.bool_()}
        order = ("part", "place", "item", "column", "asset", "gap", "n", "rows", "first_n", "first_value", "last_n", "last_value", "whole", "longest", "first_us", "last_us")
        return pa.RecordBatch.from_arrays([known.get(c, pa.nulls(n, kinds.get(c, pa.int64()))).cast(kinds.get(c, pa.int64())) for c in order], list(order))

    return written(rows.mapInArrow(run, fields.format(asset=schema, kind=kind)), "succession")


def _stitched(stretches: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One stretch for each group of `by`, of those that follow each other in `order`; borders has the gaps in whole seconds between them.

    A group has a stretch for each batch of a partition, or for each partition, that an asset spans.
    """
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    own = F.array_sort(F.collect_list(F.struct(order, *names)))
    rows = stretches.groupBy(*by).agg(own.alias("s"))

    def joined(a: Column, b: Column) -> Column:
        meet = F.coalesce(a["last_value"] == b["first_value"], F.lit(False))
        across = b["first_n"] + F.when(meet, a["last_n"]).otherwise(0)
        longest = F.greatest(a["longest"], b["longest"], F.when(a["whole"] & meet, 0).when(meet, across).otherwise(F.when(a["whole"], 0).otherwise(a["last_n"])), F.when(b["whole"] | (a["whole"] & meet), 0).otherwise(across))
        return F.struct(
            b[order].alias(order), (a["rows"] + b["rows"]).alias("rows"), F.when(a["whole"] & meet, across).otherwise(a["first_n"]).alias("first_n"), a["first_value"].alias("first_value"),
            F.when(b["whole"], across).otherwise(b["last_n"]).alias("last_n"), b["last_value"].alias("last_value"), (a["whole"] & b["whole"] & meet).alias("whole"), longest.alias("longest"), a["first_us"].alias("first_us"), b["last_us"].alias("last_us"),
        )

    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    one = F.aggregate(rest, F.col("s")[0], joined)
    borders = F.zip_with(F.transform("s", lambda x: x["last_us"]), F.transform(rest, lambda x: x["first_us"]), lambda a, b: F.floor((b - a) / 1_000_000))
    return rows.select(*by, one.alias("s"), F.filter(borders, lambda g: g.isNotNull()).alias("borders")).select(*by, *[F.col(f"s.{c}").alias(c) for c in names], "borders")


def runs_by_asset(summaries: DataFrame) -> DataFrame:
    """column, asset, longest, n_rows: the longest run of equal successive readings of each asset; a null ends a run, and an asset has a run of one at least."""
    stretches = summaries.filter("item = 'run'")
    whole = _stitched(_stitched(stretches, ["column", "asset", "part"], "place"), ["column", "asset"], "part")
    return whole.select("column", "asset", F.greatest("longest", "first_n", "last_n", F.lit(1)).alias("longest"), F.col("rows").alias("n_rows"))


def gap_counts(summaries: DataFrame) -> DataFrame:
    """gap, n: how often each number of whole seconds lies between successive readings of an asset."""
    times = summaries.filter("item = 'gap'")
    parts = _stitched(times.filter("rows is not null"), ["asset", "part"], "place")
    whole = _stitched(parts, ["asset"], "part")
    borders = parts.select(F.explode("borders").alias("gap")).unionByName(whole.select(F.explode("borders").alias("gap"))).withColumn("n", F.lit(1).cast("long"))
    return times.filter("rows is null").select("gap", "n").unionByName(borders).groupBy("gap").agg(F.sum("n").alias("n"))
