"""Sharding along a Hilbert curve over metadata, so that files can be pruned by any of several columns.

Each metadata column is quantised to 2**BITS cells: numbers by their quantiles, names by frequency (the
most frequent ones have cells of their own, which bounds the broadcast table; all others share the rest by
hash). Rows are sorted by the Hilbert index of their cell and the sorted sequence is cut into shards whose
row counts differ by at most one (law `rows`). Ranks come from the sorted partitions' row counts, so no
task or driver sees all rows.

Cases: a null text has no bytes; null metadata has a cell of its own, before all others; ties are ordered
by size, checksum and id; rows that repeat all of these are ordered arbitrarily; with fewer rows than
shards, some shards are empty; an empty table gives an empty result; columns of the input that are not
named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import materialise

BITS, SHARDS = 6, 24


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (one row for each dimension) of a grid with 2**bits cells a side."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> level) & 1)
    return out


def _number_cells(df: DataFrame, column: str, bits: int) -> Column:
    """Cell of a numeric column by at most 2**bits - 2 approximate quantiles; null is cell 0."""
    parts = (1 << bits) - 1
    edges = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.002)))
    cell = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col(column) > e)) if edges else F.lit(0)
    return F.when(F.col(column).isNull(), 0).otherwise(cell + 1)


def _name_cells(df: DataFrame, column: str, bits: int) -> Column:
    """Cell of a text column: its rank among the most frequent names, else a hash; null is cell 0."""
    own = (1 << bits) - 1 - (1 << (bits - 2))
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    top = [r[0] for r in counts.orderBy(F.desc("count"), column).limit(own).collect()]
    hashed = F.pmod(F.xxhash64(column), F.lit(1 << (bits - 2))) + own + 1
    cell = F.array_position(F.array(*[F.lit(x) for x in sorted(top)]), F.col(column)) if top else F.lit(0)
    return F.when(F.col(column).isNull(), 0).when(cell > 0, cell).otherwise(hashed)


def hilbert_shards(
    df: DataFrame, dimensions: Sequence[str], shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, law, shard, slot: one row for each row of df.

    dimensions: metadata columns of df, or `size`; size: UTF-8 bytes of the text and 8.
    """
    text = F.col(text_col).cast("string").cast("binary")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    rows = df.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        *[F.col(c).alias(f"dim_{c}") for c in dimensions if c != "size"],
    )
    rows = materialise(rows, "metadata")
    cells = []
    for c in dimensions:
        name = "size" if c == "size" else f"dim_{c}"
        numeric = isinstance(rows.schema[name].dataType, T.NumericType)
        cells.append((_number_cells if numeric else _name_cells)(rows, name, bits).cast("int"))

    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy().T, bits))

    keys = ["hilbert", "size", "text_crc32", "doc_id"]
    placed = rows.select("doc_id", "size", "text_crc32", index(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])).alias("hilbert"))
    # a row's number within its sorted partition is in the low 33 bits of this id; writing fixes both
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ordered").withColumn("part", F.shiftright("place", 33))
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ranked = ordered.join(F.broadcast(counts), "part")  # one row for each partition
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    base, rest = F.expr("total div " + str(shards)), F.col("total") % shards
    long_rows = rest * (base + 1)  # the first `rest` shards have one row more
    ranked = ranked.withColumn("rank", rank).withColumn("base", base).withColumn("long_rows", long_rows).withColumn("rest", rest)
    return ranked.select(
        "doc_id", "size", "text_crc32", "hilbert", F.lit("rows").alias("law"),
        F.expr("cast(if(rank < long_rows, rank div (base + 1), rest + (rank - long_rows) div base) as int)").alias("shard"),
        F.expr("if(rank < long_rows, rank % (base + 1), (rank - long_rows) % base)").alias("slot"),
    )


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(docs, ["lang", "size", "source"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op9_hilbert": op9_hilbert}
ORACLE_SQL: dict[str, str] = {}
