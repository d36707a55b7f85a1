"""Exact duplicate documents by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, which moves with the content. Each
chunk gets an identifier, the identifiers are verified against the chunks' bytes in one shuffle of
distinct chunks, and documents are then compared by their ordered lists of identifiers: a long
document moves once as chunks, copies of which are merged before the shuffle, and never again.

Cases: a null text counts as empty, and all empty texts are equal; a null id is the smallest one; of
rows that repeat an id and a text, one is kept. An empty table gives an empty result. Other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.llm.common import LOWER, attach_group, blocks, materialise, without

#: A cut falls where the top CUT_BITS bits of the rolling hash are zero, once in 1024 bytes on average.
CUT_BITS, SHORTEST, LONGEST = 10, 64, 1 << 14
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the documents that start at starts in data, document ends included."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    bounds = np.append(starts, len(data))
    own = bounds[np.searchsorted(bounds, ends, side="left") - 1]
    cuts = np.union1d(ends[ends - own >= SHORTEST], bounds)
    gaps = np.diff(cuts, prepend=0)
    for end, gap in zip(cuts[gaps > LONGEST].tolist(), gaps[gaps > LONGEST].tolist(), strict=True):
        cuts = np.union1d(cuts, np.arange(end - gap + LONGEST, end, LONGEST))
    return cuts


def _chunked(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """(rows, normalised bytes, offsets of the documents, offsets of the chunks, first chunk of each document)."""
    for rows, data, at in blocks(batches, text):
        data = LOWER[data]
        cuts = np.union1d(cut_points(data, at[:-1]), [0])
        yield rows, data.tobytes(), at, cuts, np.searchsorted(cuts, at)


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """id, text -> id, row, text_sha256 and recipe, the chunks' identifiers one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at, cuts, first in _chunked(batches, "text"):
            ids = [blake2b(data[a:b], digest_size=digest_bytes).digest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            lists = [b"".join(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            whole = [sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(whole, pa.string()), pa.array(lists, pa.binary())], ["id", "text_sha256", "recipe"]
            )

    out = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text_sha256 string, recipe binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def _chunks(docs: DataFrame, digest_bytes: int, places: bool) -> DataFrame:
    """chunk_id and chunk, with places also text_sha256 and pos."""
    names = ["chunk_id", "chunk"] + ["text_sha256", "pos"] * places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at, cuts, first in _chunked(batches, "text"):
            parts = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            columns = [pa.array([blake2b(x, digest_size=digest_bytes).digest() for x in parts], pa.binary()), pa.array(parts, pa.binary())]
            if places:
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                whole = pa.array([sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
                columns += [whole.take(pa.array(owner)), pa.array(np.arange(len(owner)) - first[:-1][owner], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "chunk_id binary, chunk binary" + ", text_sha256 string, pos int" * places)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of df.

    Texts are equal if they are identical after lower-casing A-Z; of equal texts the row with the
    largest id stays. digest_bytes: length of a chunk's identifier; chunks with the same identifier
    and other bytes, if there are any, get a number after it.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    distinct = _chunks(docs, digest_bytes, places=False).distinct()
    clashes = materialise(distinct.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id"), "clashes")
    rows = materialise(recipes(docs, digest_bytes), "recipes")
    if not clashes.isEmpty():
        rows = materialise(_verified(docs, rows, clashes, digest_bytes), "recipes")
    groups = attach_group(
        rows,
        ["recipe"],
        {"last": (F.max(F.struct("id", "row")), F.max), "group_size": (F.count("*"), F.sum)},
        spread_by=["id", "row"],
    )
    return groups.select(
        F.col("id").alias("doc_id"),
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
    )


def _verified(docs: DataFrame, rows: DataFrame, clashes: DataFrame, digest_bytes: int) -> DataFrame:
    """Recipes in which chunks that share an identifier have the rank of their bytes behind it."""
    numbers = _chunks(docs, digest_bytes, places=False).distinct().join(clashes, "chunk_id", "left_semi")
    numbers = numbers.withColumn("number", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk")).cast("string"))
    numbers = materialise(numbers, "numbers")
    placed = _chunks(docs, digest_bytes, places=True).join(numbers, ["chunk_id", "chunk"], "left")
    name = F.concat(F.hex("chunk_id"), F.lit("#"), F.coalesce("number", F.lit("0")))
    # rows with the same text give the same list, which is as long as the text
    lists = placed.groupBy("text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", name.alias("name")))).alias("parts"))
    lists = lists.select("text_sha256", F.array_join(F.col("parts.name"), ",").cast("binary").alias("list"))
    joined = rows.join(lists, "text_sha256", "left")
    return joined.select("id", "text_sha256", F.coalesce("list", F.lit(b"")).alias("recipe"), "row")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those whose text a row with a larger id also has.

    The id tells rows apart: rows that repeat it stay or go together.
    """
    gone = duplicate_groups(df, id_col, text_col).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return without(df, id_col, gone.select(F.col("doc_id").alias(id_col)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE_SQL = {
    "op3_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
}
