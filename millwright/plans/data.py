"""The tables as the queries see them, with the same derived columns in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.quality import Roles

EVENT_ROLES = Roles(key="event_id", target="event_type", asset="user_id", ts="ts")
#: Readings: value is missing in every seventeenth row, k is the number in props.
EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
SPLIT_DATE = "2024-01-16"
LINE_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", value, F.get_json_object("props", "$.k").cast("int").alias("k"))


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Baseline and production readings."""
    e = events(spark, sf_dir)
    cut = F.to_timestamp_ntz(F.lit(SPLIT_DATE), F.lit("yyyy-MM-dd"))
    return e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut)


def rounded(df: DataFrame, columns: Sequence[str] = (), places: int = 6) -> DataFrame:
    """df with double columns (or the named ones) rounded."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in names}) if names else df


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, event_id, label (1 for an error event), prediction, score: three deterministic scores that stand for models."""
    e = table(spark, sf_dir, "events")
    label = (F.col("event_type") == "error").cast("int")
    base = F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0
    scores: dict[str, Column] = {
        "a_noise": base,
        "b_mixed": 0.6 * base + 0.4 * label * (F.col("event_id") % 3 > 0).cast("int"),
        "c_sharp": F.floor((0.3 * base + 0.7 * label * (F.col("event_id") % 10 > 0).cast("int")) * 100) / 100.0,
    }
    each = F.array(*[F.struct(F.lit(n).alias("model"), s.cast("double").alias("score")) for n, s in scores.items()])
    rows = e.select("event_id", label.alias("label"), F.explode(each).alias("m")).select("m.model", "event_id", "label", "m.score")
    return rows.select("model", "event_id", "label", (F.col("score") >= 0.5).cast("int").alias("prediction"), "score")


SCORES_SQL = """
SELECT m.model, event_id, label, CAST(m.score >= 0.5 AS INTEGER) AS prediction, m.score FROM (
  SELECT event_id, label, unnest([
    {'model': 'a_noise', 'score': base}, {'model': 'b_mixed', 'score': 0.6::DOUBLE * base + 0.4::DOUBLE * label * CAST(event_id % 3 > 0 AS INTEGER)},
    {'model': 'c_sharp', 'score': floor((0.3::DOUBLE * base + 0.7::DOUBLE * label * CAST(event_id % 10 > 0 AS INTEGER)) * 100) / 100.0::DOUBLE}]) AS m
  FROM (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS base FROM events))"""
