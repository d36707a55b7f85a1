"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells
the languages with a one from those with a zero: naive Bayes, whose weights are log ratios of smoothed
n-gram shares. Decoding weighs the losses of all bits: the language whose codeword has the least sum of
logistic losses, given the text's margins, is predicted, and the two least sums tell how ambiguous the text is.

The classifiers are fitted on at most SAMPLE documents of each language, those with the least hash of
the id; their n-grams are counted on the executors and only one number for each language and n-gram
(at most BUCKETS numbers for a language) reaches the driver. Every text is predicted whole.

Cases: a null text or one without a letter is `und` with score 0 and not ambiguous; rows with a null
language are never learnt from; with no labelled row at all every text is `und`; ties go to the language
that sorts first; repeated rows are judged alike; an empty table gives an empty result; columns of the
input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import LOWER, blocks

BUCKETS, SAMPLE, BITS, SMOOTH = 1 << 16, 1000, 15, 0.5
#: A text is ambiguous if the best language's share of the posterior is below this.
SURE = 0.7
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 2 to 4: the buckets of the n-grams of lower-cased bytes, and where those of each text start and end.

    White space counts as one kind of byte; n-grams do not cross texts.
    """
    low = LOWER[data].astype(np.uint32)
    low[(data >= 9) & (data <= 13)] = 32
    code = low
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(256) + low[n - 1 :] if len(code) else code
        h = (code * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        h = (h * np.uint32(2246822519)) >> np.uint32(16)
        begin = np.minimum(at[:-1], len(h))
        yield h, np.stack([begin, np.minimum(np.maximum(at[1:] - n + 1, begin), len(h))])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text the mean weight of its n-grams, by bit."""
        total, count = np.zeros((len(at) - 1, self.codes.shape[1])), np.zeros(len(at) - 1)
        for h, (begin, end) in grams(data, at):
            if not len(h):
                continue
            for bit in range(self.codes.shape[1]):
                w = np.zeros(len(h) + 1)
                np.cumsum(self.weights[bit][h], out=w[1:])
                total[:, bit] += w[end] - w[begin]
            count += end - begin
        return total / np.maximum(count, 1)[:, None], count

    def decode(self, margins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the least loss, and its share of the posterior."""
        size = np.sqrt(np.maximum(count, 1))[:, None]  # n-grams overlap, so that evidence grows more slowly than their number
        loss = np.stack([np.logaddexp(0, -margins * size * code).sum(axis=1) for code in self.codes], axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), 1 / share.sum(axis=1)


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n codewords of -1 and 1: a bit for each language, then up to bits of them in all that split the languages in halves.

    From four languages on any two codewords differ in three bits at least, so a wrong bit can be corrected: where that takes more
    bits, halves that split most of the closest pairs are added, about 2 log2(n) of them.
    """
    columns = list(2 * np.eye(n, dtype=int) - 1)
    seen = {tuple(c * c[0]) for c in columns}  # a split and its complement ask the same question
    rng, half = np.random.default_rng(n), np.where(np.arange(n) < n // 2, 1, -1)
    for _ in range(50 * bits if n > 2 else 0):
        c = rng.permutation(half)
        if len(columns) < bits and tuple(c * c[0]) not in seen:
            seen.add(tuple(c * c[0]))
            columns.append(c)
    while n > 4:
        codes = np.array(columns).T
        apart = np.triu((codes[:, None, :] != codes[None, :, :]).sum(axis=2) >= 3) | np.tri(n, dtype=bool)
        if apart.all():
            break
        drawn = [rng.permutation(half) for _ in range(16)]
        columns.append(max(drawn, key=lambda c: int((~apart & (c[:, None] != c[None, :])).sum())))
    return np.array(columns).T.reshape(n, len(columns))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on up to sample rows of docs for each non-null language."""
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy("hash")
    named = rows.select("lang", "hash")  # of id and text, so that rows without an id, or with the same one, are told apart
    # about four times the sample of each language reaches the window, so that a large one is not sorted in one task
    share = named.groupBy("lang").agg((F.lit(4.0 * sample) / F.count("*")).alias("share"))
    named = named.join(F.broadcast(share), "lang").filter(F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20))  # share: one row a language
    named = named.select("lang", "hash").distinct()
    chosen = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("hash", F.col("lang").alias("of"))
    # chosen has at most sample rows for each language
    rows = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (rows["hash"] == chosen["hash"]), "left_semi").dropDuplicates(["lang", "hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part, data, at in blocks(batches, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for h, (begin, end) in grams(data, at):
                for lang in dict.fromkeys(langs):
                    own = [h[a:b] for a, b in zip(begin[langs == lang], end[langs == lang], strict=True)]
                    found[lang] = found.get(lang, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
        for lang, counts in found.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    for i, lang in enumerate(languages):
        counts[i, bucket[names == lang]] = n[names == lang]
    codes = codewords(len(languages), bits)
    share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)  # languages weigh alike, however many documents they have
    weights = [np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) if (c > 0).any() and (c < 0).any() else np.zeros(BUCKETS) for c in codes.T]
    return Model(languages, codes, np.array(weights, np.float32).reshape(len(codes.T), BUCKETS))


def predict(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """df with lang_pred, lang_score (0 to 1) and lang_ambiguous, by its text column only."""
    added = [prefix + x for x in ("pred", "score", "ambiguous")]
    df = df.drop(*added)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by BUCKETS, bits and the number of languages
    schema = T.StructType([*df.schema, *[T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, at in blocks(batches, text_col):
            raw, ends = data.tobytes(), at.tolist()
            letters = np.array([bool(_LETTER.search(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(ends[:-1], ends[1:], strict=True)], bool)
            if m.languages:
                best, score = m.decode(*m.margins(data, at))
                names = np.array(m.languages, object)[best]
            else:
                names, score, letters = np.full(len(rows), None), np.zeros(len(rows)), np.zeros(len(letters), bool)
            names, score = np.where(letters, names, "und"), np.where(letters, score, 0.0)
            new = [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(letters & (score < SURE))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, *added])

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learnt from: crc32 of the id's text leaves 2 when divided by 4. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


QUERIES = {"op7_langid": op7_langid}
ORACLE_SQL: dict[str, str] = {}
