"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage but the last takes and returns the columns of documents, and drops the rows that it decides
against; the last one returns the pieces of the packed sequences. Empty tables give empty tables, texts of any length are
read whole, further columns are passed on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import decontaminate, exact_dedup, langid, packing, simhash
from millwright.llm.common import materialise

#: Differing bits of fingerprints up to which documents are near copies here; wider than the operator's own radius.
RADIUS = 6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those without a letter (null and empty texts too), and those between languages."""
    model, prefix = langid.fit(docs.filter(~langid.held_out())), "__lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    judged = langid.predict(docs, model, prefix=prefix)
    return judged.filter((F.col(prefix + "pred") != "und") & ~F.col(prefix + "ambiguous")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the last of the documents with the same text; a null text is empty, rows that share an id stay or go together."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies; documents without a word are one group."""
    return simhash.keep_one(docs, radius=RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs; null and empty texts stay, rows that share an id stay or go together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences, related documents together; repeated rows are packed as often as they occur."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The language model, fingerprints and packing are beyond SQL; stages and run() are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
