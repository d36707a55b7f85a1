"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A covering family for radius r has 2**(r+1) - 1 bit masks. Bit i has a vector m(i) of r + 1 bits, and
mask v, for every non-zero v, keeps the bits for which m(i) and v have an odd scalar product. Any r
positions leave a v that is orthogonal to all their vectors, so two fingerprints that differ in at most
r positions agree on all the bits of some mask: every such pair meets in a bucket, none is lost.

Equal fingerprints are merged before anything else. A bucket that holds more than `most` different
fingerprints is dealt out once more by another family over the same bits, which keeps the guarantee.
Within a bucket only links that connect its members are returned, not all pairs.

Cases: a null or blank text has the fingerprint zero and is linked like any other; a null id counts as
the smallest one; repeated rows are linked to each other; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millwright.llm.common import LOWER_BYTES, attach_group, blocks, longs, materialise, runs, whole_groups, without
from millwright.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42


def fingerprint(text: bytes) -> int:
    """Bit k is one if it is set in over half of the XXH64 values of the text's word shingles."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(whole, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begin, end = (ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    n = len(begin)
    hashes = np.fromiter((xxh64_intdigest(whole[i:j], SEED) for i, j in zip(begin, end, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            data, at = data.tobytes(), at.tolist()
            found = np.array([fingerprint(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def masks(radius: int, level: int) -> list[int]:
    """The masks of a covering family, as signed 64-bit numbers; each level has another one."""
    top = (1 << (radius + 1)) - 1
    order = np.random.default_rng(level).permutation(64)
    vectors = [int(order[i]) % top + 1 for i in range(64)]
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def connect(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a bucket's different values: members of each component, and its first member, by breadth-first search."""
    left = values
    while len(left) > 1:
        seed, left, frontier, members = left[0], left[1:], left[:1], []
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                near |= (np.bitwise_count(frontier[at : at + 64, None] ^ left[None, :]) <= radius).any(axis=0)
            frontier, left = left[near], left[~near]
            members.append(frontier)
        if members and len(members[0]):
            found = np.concatenate(members)
            yield found, np.full(len(found), seed, np.uint64)


def _bucket_links(keys: list[str], radius: int, most: int | None):
    """Over rows sorted by keys and fp: links (a, b) in each bucket; a is null for rows of buckets of over most rows."""
    names = ["a", "b", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, large in whole_groups(batches, keys, most):
            fps = longs(batch.column("fp"))
            if large:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fps), pa.int64()), pa.array(fps), *[batch.column(k) for k in keys]], names)
                continue
            u, starts = fps.view(np.uint64), runs(*[longs(batch.column(k)) for k in keys])
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
            found = [(u[two + 1], u[two])]
            for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found += connect(u[s : s + n], radius)
            a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([a, b, *[pa.nulls(len(a), pa.int64()) for _ in keys]], names)

    return run


def links(fps: DataFrame, radius: int = RADIUS, most: int = 4096, levels: int = 3) -> DataFrame:
    """a, b: links between different fingerprints (column fp) at radius or fewer differing bits.

    They connect whatever is connected by such pairs. At the last level a bucket's members share all but
    a few bits, so it needs no limit.
    """
    found, rest, keys = None, fps.select("fp").distinct(), []
    for level in range(levels):
        family = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius, level))])
        dealt = rest.withColumn("x", F.explode(family)).withColumns({f"t{level}": F.col("x.t"), f"k{level}": F.col("x.k")}).drop("x")
        keys = [*keys, f"t{level}", f"k{level}"]
        last = level == levels - 1
        out = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
        out = materialise(out.mapInArrow(_bucket_links(keys, radius, None if last else most), ", ".join(f"{c} long" for c in ("a", "b", *keys))), "links")
        pairs = out.filter("a is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rest = out.filter("a is null").select(F.col("b").alias("fp"), *keys)
        if last or rest.isEmpty():
            break
    return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest id that is reachable): one row for each row of df."""
    docs = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    # a fingerprint of most documents is spread over salts before it meets itself
    parts = docs.groupBy("fp", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.min("id").alias("least"))
    distinct = parts.groupBy("fp").agg(F.min("least").alias("least"))
    roots = components(links(distinct, radius, most))
    named = roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    out = attach_group(docs, ["fp"], {"least": (F.min("id"), F.min)}, ["id"], extend=lambda groups: groups.join(named, "fp", "left"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select(F.col("id").alias("doc_id"), hexed, F.coalesce("component_id", "least").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df without those that are linked to a row with a smaller id. A null id is the largest; rows that share one stay or go together."""
    gone = near_duplicates(df, id_col, text_col, radius).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(df, id_col, gone.select(F.col("doc_id").alias(id_col)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
