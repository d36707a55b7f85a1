"""Helpers that the corpus operators share: scratch tables, text blocks, skew-safe group values."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "__salt"
#: A-Z to a-z, every other byte as it is; no byte of a longer UTF-8 character is in that range.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millwright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, which cuts its lineage.

    A lost executor then costs no more than the tasks that it ran. The files stay until clean_scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millwright/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> bool:
    """Delete the tables that materialise() wrote; call it once results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millwright")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose id is not in gone; rows with a null id go only if gone has a null."""
    gone = gone.select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


def attach_group(
    rows: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, tuple[Column, Callable]],
    spread_by: Sequence[str],
    salts: int = 64,
    extend: Callable[[DataFrame], DataFrame] = lambda groups: groups,
) -> DataFrame:
    """rows with columns that hold aggregates of the row's group, safe for a group of any size.

    aggs: name -> (aggregate over rows, function that merges such values). A group is spread over
    salts by spread_by, so that neither the aggregation nor the join back puts it into one task;
    the list of salts that a group collects has at most `salts` items. extend may add columns to the
    table of groups, which has one row for each of them.
    """
    salt = SALT
    while salt in rows.columns:  # groups that extend gets have such a column
        salt += "_"
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    parts = rows.groupBy(*keys, salt).agg(*[first.alias(n) for n, (first, _) in aggs.items()])
    whole = parts.groupBy(*keys).agg(
        *[merge(F.col(n)).alias(n) for n, (_, merge) in aggs.items()], F.collect_list(salt).alias(salt)
    )
    return rows.join(extend(whole).withColumn(salt, F.explode(salt)), [*keys, salt]).drop(salt)


def bloom_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of `bits` bits, a power of two of at most 2**32."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def bloom_filter(hashes: DataFrame, bits: int = 1 << 25, block: int = 1 << 16) -> Broadcast:
    """A broadcast Bloom filter of the long column h, a good hash. Its size is fixed: it spares work and decides nothing.

    Executors set the bits, each those of some blocks; the driver reads the blocks, bits / 8 bytes at most.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.unique(np.concatenate(bloom_places(longs(b.column(0)).view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found // block), pa.array(found % block)], ["block", "place"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            number, place = longs(b.column(0)), longs(b.column(1))
            for k in np.unique(number).tolist():
                held.setdefault(k, np.zeros(block, bool))[place[number == k]] = True
        made = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(made, pa.binary())], ["block", "bits"])

    spread = hashes.select("h").mapInArrow(places, "block long, place long").distinct().repartition(min(64, bits // block), "block")
    out = np.zeros(bits // 8, np.uint8)
    for row in spread.mapInArrow(fill, "block long, bits binary").collect():
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def in_bloom(h: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the filter."""
    may = np.ones(len(h), bool)
    for place in bloom_places(h, 8 * len(filled)):
        may &= (filled[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return may


def may_be_in(df: DataFrame, column: str, bloom: Broadcast, inside: bool = True) -> DataFrame:
    """The rows of df whose hash in a long column may be in the filter, or (inside=False) cannot be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = in_bloom(longs(b.column(b.schema.get_field_index(column))).view(np.uint64), bloom.value)
            yield b.filter(pa.array(may if inside else ~may))

    return df.mapInArrow(run, df.schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, null as empty, and the offsets of its values."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[tuple]:
    """(rows, bytes, offsets) for slices of the batches that hold about limit bytes of text, or one row."""
    for batch in batches:
        data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def longs(column: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    """An integer column as int64; null becomes the smallest value."""
    return (pc.fill_null(column, null) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that agree in all columns, and the number of rows at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """From batches sorted by integer keys: (batch of whole groups, False), or (rows of a group of over most rows, True).

    A group of over most rows comes in pieces, as they are read; no more than most rows of it are held.
    """
    held: list[pa.RecordBatch] = []
    n, large, name = 0, False, None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [longs(batch.column(k)) for k in keys]
        starts = runs(*columns)
        end = int(starts[1]) if name == tuple(c[0] for c in columns) else 0
        if end:
            held.append(batch.slice(0, end))
            n += end
        over = bool(most) and n > most
        if held and (end < batch.num_rows or over):
            yield joined(), large or over
            held, large = [], large or over
        if end == batch.num_rows:
            continue
        batch, starts = batch.slice(end), starts[int(end > 0) :] - end
        sizes = np.diff(starts)
        last, wide = int(starts[-2]), sizes[:-1] > most if most else np.zeros(len(sizes) - 1, bool)
        if wide.any():
            rows = np.repeat(wide, sizes[:-1])
            yield batch.slice(0, last).filter(pa.array(rows)), True
            if not rows.all():
                yield batch.slice(0, last).filter(pa.array(~rows)), False
        elif last:
            yield batch.slice(0, last), False
        held, n, large, name = [batch.slice(last)], int(sizes[-1]), False, tuple(c[-1] for c in columns)
        if most and n > most:
            yield joined(), True
            held, large = [], True
    if held:
        yield joined(), large


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd. Kept by the worker for the next block."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        up, down = (np.ones(n + 1, np.uint64) for _ in range(2))
        np.cumprod(np.full(n, base, np.uint64), out=up[1:])
        np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64), out=down[1:])
        _POWERS[base] = up, down
    return _POWERS[base]


def prefix_hash(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """P and D for which (P[j] - P[i]) * D[i], modulo 2**64, is a hash of data[i:j] that depends on those bytes only."""
    up, down = powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    own = sums[1:]
    np.add(data, 1, out=own, dtype=np.uint64)
    own *= up[: len(data)]
    np.cumsum(own, out=own)
    return sums, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
