"""Profiles of a table and of its columns, and the meaning of columns inferred from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import (
    BOOLEAN_WORDS, IDENTIFIER_HINTS, SENSOR_HINTS, TARGET_HINTS, TIMESTAMP_HINTS, coarse_dtype, has_hint, is_numeric, normalise_missing, unpivot,
)
from millwright.functions.quantiles import quantiles, value_counts

MOST_CLASSES, NEAR_UNIQUE = 30, 0.9


def table_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_cells, missing_cells, missing_rate. One scan without a shuffle of rows."""
    df = normalise_missing(df)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    out = df.agg(F.count("*").alias("n_rows"), missing.alias("missing_cells"))
    cells = F.col("n_rows") * len(df.columns)
    return out.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), cells.alias("n_cells"), "missing_cells",
        F.coalesce(F.try_divide(F.col("missing_cells"), cells), F.lit(0.0)).alias("missing_rate"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, duplicate_rows (rows beyond the first of each set of equal rows; nulls are equal), duplicate_rate."""
    sets = normalise_missing(df).groupBy(*[f"`{c}`" for c in df.columns]).count()
    out = sets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_rate", F.coalesce(F.try_divide("duplicate_rows", "n_rows"), F.lit(0.0)))


def type_distribution(df: DataFrame) -> dict[str, int]:
    kinds = [coarse_dtype(f.dataType) for f in df.schema]
    return {k: kinds.count(k) for k in sorted(set(kinds))}


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, n_rows, missing, missing_rate, n_distinct, unique_ratio, constant: one row for each column.

    exact: one shuffle of (column, value) counts serves all distinct counts; else HyperLogLog without it.
    """
    cells = unpivot(normalise_missing(df), columns or df.columns, "string")
    if exact:
        values = cells.groupBy("column", "value").count()
        out = values.groupBy("column").agg(F.sum("count").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing"), F.count("value").alias("n_distinct"))
    else:
        out = cells.groupBy("column").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.approx_count_distinct("value").alias("n_distinct"))
    present = F.col("n_rows") - F.col("missing")
    return out.select(
        "column", "n_rows", "missing", (F.col("missing") / F.col("n_rows")).alias("missing_rate"), "n_distinct",
        F.coalesce(F.try_divide(F.col("n_distinct"), present), F.lit(0.0)).alias("unique_ratio"), (F.col("n_distinct") <= 1).alias("constant"),
    )


def numeric_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType, booleans)]


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """column, n, minimum, maximum, mean, std (population), q1, median, q3, iqr. accuracy: approximate quantiles instead of exact ones."""
    cells = unpivot(normalise_missing(df), columns or numeric_columns(df), "double")
    points = [0.25, 0.5, 0.75]
    rough = [] if accuracy is None else [F.percentile_approx("value", F.array(*map(F.lit, points)), accuracy).alias("q")]
    out = cells.groupBy("column").agg(
        F.count("value").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), *rough,
    )
    if accuracy is None:
        out = out.join(F.broadcast(quantiles(value_counts(cells), points).select("column", "q")), "column", "left")  # one row for each column
    q = [F.col("q")[i] for i in range(3)]
    return out.select("column", "n", "minimum", "maximum", "mean", "std", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"))


def top_categories(df: DataFrame, columns: Sequence[str], n: int = 10, most_numeric: int = 20) -> DataFrame:
    """column, place, value, n, ratio (within the kept values): the n most frequent values; numeric columns with more different values are left out."""
    counts = unpivot(normalise_missing(df), columns, "string").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    kept = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    wide = counts.filter(F.col("column").isin(numeric)).groupBy("column").count().filter(F.col("count") > most_numeric) if numeric else None
    if wide is not None:
        kept = kept.join(wide.select("column"), "column", "left_anti")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column"))
    return kept.select("column", "place", "value", "n", share.alias("ratio"))


def boolean_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, boolean_like: booleans; numbers that are 0 and 1 only; text of at most two words (case and outer space ignored) of a fixed list."""
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType, booleans=False)]
    booleans = [c for c in columns if isinstance(df.schema[c].dataType, T.BooleanType)]
    words = F.lower(F.trim("value"))
    values = unpivot(normalise_missing(df), columns, "string").filter("value is not null").groupBy("column", words.alias("word")).count().select("column", "word")
    fits = F.when(F.col("column").isin(numeric), F.col("word").try_cast("double").isin(0.0, 1.0)).otherwise(F.col("word").isin(*BOOLEAN_WORDS))
    found = values.groupBy("column").agg(F.bool_and(fits).alias("fits"), F.count("*").alias("n"))
    return found.select("column", (F.col("column").isin(booleans) | (F.col("fits") & (F.col("n") <= 2))).alias("boolean_like"))


def datetime_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, datetime_like: whether all present texts are timestamps, by one scan; the first rows of a table without an order would not do."""
    present = [F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), F.try_to_timestamp(F.col(f"`{c}`")).isNotNull())) for c in columns]
    facts = df.agg(F.array(*[F.coalesce(p, F.lit(False)) for p in present]).alias("all_dates"))
    return facts.select(F.posexplode("all_dates").alias("at", "datetime_like")).select(F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("column"), "datetime_like")


def infer_schema(df: DataFrame) -> DataFrame:
    """column, dtype, semantic, target_score, asset_score, timestamp_score: one row for each column; a score of 0 is no candidate.

    Rules over names and types are decided here, those over values are columns of the profile.
    """
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f.name, coarse_dtype(f.dataType), *[has_hint(f.name, h) for h in (IDENTIFIER_HINTS, SENSOR_HINTS, TARGET_HINTS, TIMESTAMP_HINTS)]) for f in df.schema],
        "column string, dtype string, id_hint boolean, sensor_hint boolean, target_hint boolean, time_hint boolean",
    )
    texts = [f.name for f in df.schema if coarse_dtype(f.dataType) == "string"]
    facts = meta.join(column_profile(df), "column").join(boolean_like(df, df.columns), "column", "left")
    if texts:
        facts = facts.join(datetime_like(df, texts), "column", "left")
    else:
        facts = facts.withColumn("datetime_like", F.lit(False))
    number = F.col("dtype").isin("int", "float")
    semantic = (
        F.when((F.col("dtype") == "datetime") | F.coalesce("datetime_like", F.lit(False)), "datetime")
        .when(F.coalesce("boolean_like", F.lit(False)), "boolean")
        .when(number & F.col("id_hint") & (F.col("unique_ratio") >= NEAR_UNIQUE), "identifier_like")
        .when(number & (F.col("sensor_hint") | (F.col("dtype") == "float")), "sensor_numeric")
        .when(number, F.when(F.col("n_distinct") <= MOST_CLASSES, "categorical").otherwise("numeric"))
        .when(F.col("unique_ratio") >= NEAR_UNIQUE, "identifier_like")
        .otherwise("categorical")
    )
    out = facts.withColumn("semantic", semantic)
    s, few = F.col("semantic"), F.col("n_distinct") <= MOST_CLASSES
    target = (
        F.when(s.isin("datetime", "identifier_like") | (F.col("n_distinct") < 2) | (F.col("n_distinct") > 1000), 0)
        .when(s == "boolean", F.when(F.col("target_hint"), 3).otherwise(2))
        .when(s.isin("categorical", "sensor_numeric", "numeric") & few, F.when(F.col("target_hint"), 3).otherwise(1))
        .when(F.col("target_hint"), 2)
        .otherwise(0)
    )
    asset = F.when((s == "datetime") | ~F.col("id_hint"), 0).when(s == "identifier_like", 3).otherwise(1)
    time = F.when(s == "datetime", F.when(F.col("time_hint"), 3).otherwise(2)).when(F.col("time_hint") & F.col("dtype").isin("datetime", "string") & (s != "identifier_like"), 1).otherwise(0)
    return out.select("column", "dtype", "semantic", target.alias("target_score"), asset.alias("asset_score"), time.alias("timestamp_score"))


def candidates(report: DataFrame, score: str) -> DataFrame:
    """column, in order of its score, then of its name."""
    return report.filter(F.col(score) > 0).orderBy(F.desc(score), "column").select("column", score)


def profile_view(df: DataFrame) -> DataFrame:
    """column, missing_rate, unique_ratio, minimum, median, maximum: what a user looks at first."""
    return column_profile(df).join(numeric_profile(df), "column", "left").select("column", "missing_rate", "unique_ratio", "minimum", "median", "maximum")
