"""Reading tables and labelled sensor files, limits, new files by content, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import normalise_missing
from millwright.functions.prefix import written

FORMATS = ("csv", "parquet")
NA_TOKENS = ("", "na", "n/a", "nan", "null", "none")


class SourceError(ValueError):
    """A file that cannot be read as told, or that exceeds a limit."""


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, na: Sequence[str] = NA_TOKENS,
    check: bool = True, max_rows: int | None = None, max_columns: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """A CSV file with a header (UTF-8) or Parquet; NaN and, in CSV texts, NA tokens become null. A malformed file, or one beyond a limit, is one SourceError.

    Limits of Parquet are held against footers, before any data is read. A CSV file is checked line by line when it is read (one pass more;
    check=False leaves that out, and the first action fails at a malformed line). max_bytes is a file's size.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FORMATS:
        raise SourceError(f"unknown format {fmt}: one of {FORMATS}")
    try:
        if fmt == "parquet":
            if max_rows is not None or max_columns is not None or max_bytes is not None:
                check_footers(spark, path, max_rows, max_columns, max_bytes)
            return normalise_missing(spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path))
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("mode", "FAILFAST")
        df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
        if check:
            _check_csv(spark, path, df.schema, max_rows, max_columns, max_bytes)
    except SourceError:
        raise
    except Exception as error:
        raise SourceError(f"{path} cannot be read as {fmt}") from error
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(~F.lower(F.trim(c)).isin(*na), F.col(c)) for c in texts}) if texts else df
    return normalise_missing(df)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes, n_rows of Parquet files, by their footers: executors read no column, so any store that Spark reads will do."""
    read = spark.read.parquet(path)
    return read.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))


def check_footers(spark: SparkSession, path: str, max_rows: int | None = None, max_columns: int | None = None, max_bytes: int | None = None) -> None:
    """A SourceError if the files have too many rows together, one is too large, or there are too many columns."""
    columns = len(spark.read.parquet(path).columns)
    if max_columns is not None and columns > max_columns:
        raise SourceError(f"{path} has {columns} columns: {max_columns} at most")
    sizes = footers(spark, path).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.max("n_bytes").alias("largest")).first()
    if max_rows is not None and sizes["rows"] > max_rows:
        raise SourceError(f"{path} has {sizes['rows']} rows: {max_rows} at most")
    if max_bytes is not None and (sizes["largest"] or 0) > max_bytes:
        raise SourceError(f"{path} has a file of {sizes['largest']} bytes: {max_bytes} at most")


def judged_lines(spark: SparkSession, path: str, schema: T.StructType, max_line: int | None = None) -> DataFrame:
    """Every line of CSV files but headers and empty ones: file, line, n_bytes, width (fields, commas within quotes are none), row and reason (null: it fits).

    The first of these that holds is the reason: "line too long" (over max_line bytes), "too many fields", "too few fields", "bad value". A line that is the schema's names is a header.
    """
    bare = F.regexp_replace("value", '"([^"]|"")*"', "")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    lines = lines.filter((F.trim("value") != "") & (F.regexp_replace(F.trim("value"), '"', "") != ",".join(schema.names)))
    wide = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["`_bad` string"])
    row = F.from_csv("value", F.lit(wide), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'})
    out = lines.select("file", F.col("value").alias("line"), F.octet_length("value").alias("n_bytes"), (F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1).alias("width"), row.alias("row"))
    long = F.col("n_bytes") > max_line if max_line is not None else F.lit(False)
    reason = F.when(long, "line too long").when(F.col("width") > len(schema), "too many fields").when(F.col("width") < len(schema), "too few fields").when(F.col("row._bad").isNotNull(), "bad value")
    return out.withColumn("reason", reason)


def quarantine(spark: SparkSession, path: str, schema: T.StructType, max_line: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files that fit the schema, and the other lines (file, line, n_bytes, width, reason). Lines are parsed once."""
    rows = written(judged_lines(spark, path, schema, max_line), "parsed")
    good = rows.filter("reason is null").select(*[F.col(f"row.`{c}`").alias(c) for c in schema.names])
    return good, rows.filter("reason is not null").drop("row")


def _check_csv(spark: SparkSession, path: str, schema: T.StructType, max_rows: int | None, max_columns: int | None, max_bytes: int | None) -> None:
    """A SourceError that names what is wrong with a CSV file, by one pass."""
    if max_columns is not None and len(schema) > max_columns:
        raise SourceError(f"{path} has {len(schema)} columns: {max_columns} at most")
    if max_bytes is not None:
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # the files' list only
        if largest > max_bytes:
            raise SourceError(f"{path} has a file of {largest} bytes: {max_bytes} at most")
    found = {r["reason"]: r["n"] for r in judged_lines(spark, path, schema).groupBy("reason").agg(F.count("*").alias("n")).collect()}  # a row for each reason
    if max_rows is not None and sum(found.values()) > max_rows:
        raise SourceError(f"{path} has {sum(found.values())} rows: {max_rows} at most")
    if bad := {k: n for k, n in found.items() if k}:
        raise SourceError(f"{path} has malformed lines: " + ", ".join(f"{n} with {k}" for k, n in sorted(bad.items())))


def check_limits(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """One row: within, n_columns, too_many_rows. No more than one row beyond the limit is counted."""
    spark = df.sparkSession
    columns = len(df.columns)
    rows = df.limit(max_rows + 1).agg(F.count("*").alias("n")) if max_rows is not None else spark.range(1).select(F.lit(0).alias("n"))
    too_many = F.col("n") > max_rows if max_rows is not None else F.lit(False)
    wide = max_columns is not None and columns > max_columns
    return rows.select((~too_many & F.lit(not wide)).alias("within"), F.lit(columns).alias("n_columns"), too_many.alias("too_many_rows"))


def new_files(spark: SparkSession, glob: str, catalog: DataFrame | None = None) -> DataFrame:
    """path, length, sha256 of files whose content is not in the catalog; of equal files the first path. For files that fit a row (2 GB)."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if catalog is not None:
        files = files.join(catalog.select("sha256"), "sha256", "left_anti")
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("length")).select("path", "length", "sha256")


def read_labelled_csv(spark: SparkSession, path: str, columns: Sequence[str], label: str, labels: Mapping[str, int], na: str = "na", sensor_type: str = "double") -> tuple[DataFrame, DataFrame]:
    """A sensor file with a text preamble before its header: good rows with the label as a number, and rejected lines with the reason.

    The preamble is what stands before a file's header. All lines behind it count, so one that was cut off is rejected; in a
    file without the header all lines count.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
    )
    header = F.trim("value") == F.lit(",".join(columns))
    width = F.size(F.split("value", ","))
    headers = lines.filter(header).groupBy("file").agg(F.min("place").alias("header"))
    body = lines.join(headers, "file", "left").filter("header is null or place > header").filter(~header & (F.trim("value") != ""))
    schema = ", ".join(f"`{c}` {'string' if c == label else sensor_type}" for c in columns)
    parsed = body.select("value", width.alias("width"), F.from_csv("value", F.lit(schema), {"nullValue": na, "mode": "PERMISSIVE"}).alias("row"))
    codes = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    raw = F.trim(F.col(f"row.{label}"))
    reason = F.when(F.col("width") != len(columns), "column count").when(raw.isNull(), "missing label").when(~raw.isin(*labels), "unexpected label")
    parsed = parsed.withColumn("reason", reason).withColumn("__label", F.try_element_at(codes, raw))
    good = parsed.filter("reason is null").select(F.col("__label").alias(label), *[F.col(f"row.`{c}`").alias(c) for c in columns if c != label])
    return good, parsed.filter("reason is not null").select(F.col("value").alias("line"), "reason")


def write_prepared(train: DataFrame, test: DataFrame, path: str) -> None:
    """Both folds in one Parquet table, partitioned by split."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    both.write.partitionBy("split").parquet(path)


def split_summary(df: DataFrame, target: str) -> DataFrame:
    """split, n_rows, n_positive (target = 1), missing_cells, missing_rate: one aggregate."""
    df = normalise_missing(df)
    columns = [c for c in df.columns if c != "split"]
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in columns), F.lit(0))
    out = df.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col(target) == 1).alias("n_positive"), missing.alias("missing_cells"))
    return out.withColumn("missing_rate", F.col("missing_cells") / (F.col("n_rows") * len(columns)))


def split_classes(df: DataFrame, target: str) -> DataFrame:
    """split, label, n, rate: the classes of each split; a missing target is no class. Totals have one row for each split and are broadcast."""
    counts = normalise_missing(df).filter(F.col(target).isNotNull()).groupBy("split", F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(totals), "split").select("split", "label", "n", (F.col("n") / F.col("all")).alias("rate"))


def write_reports(report: DataFrame, path: str) -> None:
    """A small report as JSON and CSV; numbers that are not finite become null, nested values JSON in the CSV."""
    fractions = [f.name for f in report.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    report = report.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in fractions}) if fractions else report
    report.write.mode("overwrite").json(f"{path}/json")
    nested = [f.name for f in report.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    flat = report.withColumns({c: F.to_json(c) for c in nested}) if nested else report
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_scoring_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, empty cells null: cells are read as their feature's type when they are scored."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_scores_csv(scores: DataFrame, path: str) -> None:
    nested = [f.name for f in scores.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    out = scores.withColumns({c: F.to_json(c) for c in nested}) if nested else scores
    out.write.option("header", True).csv(path)


def load(spark: SparkSession, catalog: DataFrame, name: str, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """A dataset of the catalog (name, path, fmt), read again under the limits."""
    row = catalog.filter(F.col("name") == name).select("path", "fmt").first()
    if row is None:
        raise SourceError(f"unknown dataset {name}")
    df = read_table(spark, row["path"], row["fmt"])
    if (max_rows or max_columns) and not check_limits(df, max_rows, max_columns).first()["within"]:
        raise SourceError(f"{name} exceeds a limit")
    return df


def check_same_schema(a: DataFrame, b: DataFrame, target: str, rows: tuple[int, int] | None = None) -> None:
    """Raise SourceError unless both have the same columns, the target first, and the told numbers of rows."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise SourceError("the columns differ")
    if a.columns[0] != target:
        raise SourceError("the target is not the first column")
    if rows and (a.count(), b.count()) != rows:
        raise SourceError("unexpected number of rows")
