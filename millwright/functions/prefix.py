"""Global running sums and ranks without a window that holds all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local session that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millwright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its rows and their partitions are fixed from then on."""
    path = f"{shared_dir(df.sparkSession)}/millwright/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_order(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `rank` (from 1, in the given total order), `total` (rows) and, for name -> numeric column in sums, running sums (a null adds nothing).

    Rows are range-partitioned and sorted once. While a task still has its sorted rows it adds up the sums, so what is written needs no
    further shuffle or sort: a row's place in its partition is in the low bits of the generated id, and the offsets
    of partitions come from one row for each of them, the only rows that a global window sees.
    """
    sums = sums or {}
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    if sums:
        kinds = {n: "long" if isinstance(df.schema[c].dataType, T.IntegralType) else "double" for n, c in sums.items()}
        schema = T.StructType([*ordered.schema, *[T.StructField(f"__sum_{n}", T.LongType() if k == "long" else T.DoubleType()) for n, k in kinds.items()]])
        ordered = ordered.mapInArrow(_running([(sums[n], k) for n, k in kinds.items()], schema.names), schema)
    ordered = written(ordered, "ordered").withColumn("__part", F.shiftright("__place", 33))
    parts = ordered.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__all_{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"),
        *[F.coalesce(F.sum(f"__all_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums],
    )
    out = ordered.join(F.broadcast(offsets), "__part")  # one row for each partition
    out = out.withColumn("rank", F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1)
    out = out.withColumns({n: F.col(f"__before_{n}") + F.col(f"__sum_{n}") for n in sums}) if sums else out
    return out.drop("__place", "__part", "__before", *[f"__{x}_{n}" for n in sums for x in ("before", "sum")])


def _running(columns: list[tuple[str, str]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the running sum of each (column, kind) within the partition, whose rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = [0] * len(columns)
        for b in batches:
            if not b.num_rows:
                continue
            new = []
            for i, (c, kind) in enumerate(columns):
                values = pc.fill_null(b.column(b.schema.get_field_index(c)), 0).to_numpy(zero_copy_only=False)
                sums = np.cumsum(values, dtype=np.int64 if kind == "long" else np.float64) + so_far[i]
                so_far[i] = sums[-1]
                new.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names)

    return run


def running_within(df: DataFrame, key: str, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with, for name -> column in sums, the running sum within key (`name`, inclusive) and the key's sum (`name_all`).

    One global order serves all keys, so a key that has most rows is spread over tasks as well. key has few values, such as
    models or columns of a table: one row for each of them is broadcast.
    """
    ordered = global_order(df, [key, *order], {f"__run_{n}": c for n, c in sums.items()}).drop("rank", "total")
    totals = ordered.groupBy(F.col(key).alias("__key")).agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])  # of the written rows
    before = Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("*", *[F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums])
    out = ordered.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__key")))
    out = out.withColumns({n: F.col(f"__run_{n}") - F.col(f"__off_{n}") for n in sums})
    return out.drop("__key", *[f"__run_{n}" for n in sums], *[f"__off_{n}" for n in sums])
