"""Data quality of sensor tables: findings with penalties, and a health score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import IDENTIFIER_HINTS, has_hint, is_numeric, normalise_missing, unpivot
from millwright.functions.prefix import written
from millwright.functions.quantiles import at_ranks, median_mad, ordered_values, value_counts
from millwright.operators.profile import NEAR_UNIQUE, boolean_like, column_profile, duplicate_rows, table_profile
from millwright.operators.succession import gap_counts, runs_by_asset, succession


#: What each check found, for its reader; the column's name follows.
MESSAGES = {
    "missing": "cells without a value", "duplicates": "rows that repeat another row", "constant_sensor": "readings never change", "near_constant_sensor": "readings hardly change",
    "flatline": "a long run of equal readings", "duplicate_timestamps": "several readings at one time", "timestamp_gaps": "gaps far longer than the usual interval",
    "sampling_irregularity": "intervals between readings vary", "outlier": "many readings far from the median", "asset_imbalance": "one asset has far more rows than the usual one",
    "target_imbalance": "classes of very different size, or one only", "few_samples": "too few rows to train on",
}


@dataclass(frozen=True)
class Roles:
    """What columns mean: key makes rows distinct and breaks ties; the others may be missing."""

    key: str
    target: str | None = None
    asset: str | None = None
    ts: str | None = None

    def named(self) -> set[str]:
        return {c for c in (self.key, self.target, self.asset, self.ts) if c}


@dataclass(frozen=True)
class Thresholds:
    missing: tuple[float, float] = (0.05, 0.20)
    duplicates: tuple[float, float] = (0.01, 0.10)
    near_constant: float = 0.001
    flatline_rows: int = 10
    flatline_ratio: float = 0.05
    outlier_z: float = 3.5
    outlier_rate: float = 0.10
    gap_factor: float = 5.0
    sampling_cv: float = 1.0
    asset_ratio: float = 10.0
    target_ratio: float = 20.0
    samples: int = 100
    penalties: dict[str, float] = field(
        default_factory=lambda: {
            "missing_severe": 15.0, "missing": 5.0, "duplicates_severe": 15.0, "duplicates": 5.0, "constant_sensor": 3.0, "near_constant_sensor": 1.0,
            "flatline": 3.0, "duplicate_timestamps": 2.0, "timestamp_gaps": 3.0, "sampling_irregularity": 2.0, "outlier": 5.0, "asset_imbalance": 3.0,
            "target_imbalance": 5.0, "single_class": 10.0, "few_samples": 10.0,
        }
    )


def sensor_columns(df: DataFrame, roles: Roles, identifiers: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns without a role that are not known as identifiers."""
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in roles.named() and f.name not in identifiers]


def identifier_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Numeric columns without a role whose name is an identifier's and whose values are nearly unique; 0 and 1 alone are no identifiers."""
    named = [c for c in sensor_columns(df, roles) if has_hint(c, IDENTIFIER_HINTS)]
    if not named:
        return []
    facts = column_profile(df, named).join(boolean_like(df, named), "column", "left")
    found = {r[0] for r in facts.filter((F.col("unique_ratio") >= NEAR_UNIQUE) & ~F.coalesce("boolean_like", F.lit(False))).select("column").collect()}  # a row for each column
    return [c for c in named if c in found]


def _per_asset(roles: Roles) -> list[str]:
    return [roles.asset] if roles.asset else []


def successive(df: DataFrame, roles: Roles, columns: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """The summaries of successive readings that flatlines and gaps are made from; make them once where both are wanted."""
    return succession(df, roles.asset, roles.ts, roles.key, columns, kind)


def flatline_runs(df: DataFrame, roles: Roles, columns: Sequence[str], kind: str = "double", summaries: DataFrame | None = None) -> DataFrame:
    """column, asset, longest, n_rows: the longest run of equal successive readings of each asset; a null ends a run."""
    return runs_by_asset(successive(df, roles, columns, kind) if summaries is None else summaries)


def longest_flatline(df: DataFrame, roles: Roles, columns: Sequence[str], kind: str = "double", summaries: DataFrame | None = None) -> DataFrame:
    """column, asset, longest, n_rows, ratio: one row for each column, of the asset with its longest run (the smallest such asset)."""
    runs = flatline_runs(df, roles, columns, kind, summaries)
    best = runs.groupBy("column").agg(F.min(F.struct((-F.col("longest")).alias("least"), F.col("asset"), F.col("n_rows"))).alias("b"))
    return best.select("column", F.col("b.asset"), (-F.col("b.least")).alias("longest"), F.col("b.n_rows")).withColumn("ratio", F.col("longest") / F.col("n_rows"))


def sampling_gaps(df: DataFrame, roles: Roles, factor: float = 5.0, summaries: DataFrame | None = None) -> DataFrame:
    """One row: n_gaps, median_gap, long_gaps (over factor medians), sampling_cv (population std by median); nulls without gaps or a zero median."""
    found = gap_counts(successive(df, roles) if summaries is None else summaries)
    counts = ordered_values(found.select(F.lit(0).alias("all"), "gap", "n"), "all", "gap")
    middle = at_ranks(counts, [0.5], "all", "gap").select("all", F.col("q")[0].alias("median_gap"))
    mean = counts.groupBy("all").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("mean"))
    both = counts.join(F.broadcast(middle), "all").join(F.broadcast(mean), "all")  # one row each
    n = F.coalesce(F.sum("n"), F.lit(0))
    out = both.agg(
        n.alias("n_gaps"), F.max("median_gap").alias("median_gap"), F.sum(F.when(F.col("gap") > factor * F.col("median_gap"), F.col("n")).otherwise(0)).alias("long_gaps"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("gap") - F.col("mean"), 2)) / n).alias("std"),
    )
    known = F.col("median_gap") > 0
    return out.select("n_gaps", "median_gap", F.when(known, F.col("long_gaps")).alias("long_gaps"), F.when(known, F.col("std") / F.col("median_gap")).alias("sampling_cv"))


def duplicate_timestamps(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: duplicate_timestamps, readings of an asset at a time that it already has."""
    rows = df.filter(F.col(roles.ts).isNotNull()).groupBy(*_per_asset(roles), roles.ts).count()
    return rows.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_timestamps"))


def robust_outliers(df: DataFrame, columns: Sequence[str], z: float = 3.5) -> DataFrame:
    """column, median, mad, rate: share of readings whose robust z score exceeds z; not for columns without spread or with one reading.

    Counts of different values serve both medians and the rate; the statistics, one row for each column, are broadcast.
    """
    cells = unpivot(normalise_missing(df), columns, "double").filter("value is not null")
    counts = ordered_values(value_counts(cells))
    middle = median_mad(counts).filter("total > 1 AND mad > 0")
    far = F.when(0.6745 * F.abs(F.col("value") - F.col("median")) / F.col("mad") > z, F.col("n")).otherwise(0)
    return counts.join(F.broadcast(middle), "column").groupBy("column", "median", "mad").agg((F.sum(far) / F.sum("n")).alias("rate"))


def asset_imbalance(df: DataFrame, asset: str) -> DataFrame:
    """One row: n_assets, most, middle, least (rows of an asset), ratio of most to middle (null for one asset)."""
    counts = df.filter(F.col(asset).isNotNull()).groupBy(asset).agg(F.count("*").alias("n"))
    out = counts.agg(F.count("*").alias("n_assets"), F.max("n").alias("most"), F.percentile("n", 0.5).alias("middle"), F.min("n").alias("least"))
    return out.withColumn("ratio", F.when(F.col("n_assets") > 1, F.col("most") / F.col("middle")))


def target_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: n_classes, ratio of the largest to the smallest class (null for one class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_classes"), F.when(F.count("*") > 1, F.max("n") / F.min("n")).alias("ratio"))


def _finding(df: DataFrame, check: str, severity: str | Column, value: Column, penalty: Column, column: Column | None = None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(check).alias("check"), severity.alias("severity"), (F.lit(None).cast("string") if column is None else column).alias("column"),
        value.cast("double").alias("value"), penalty.cast("double").alias("penalty"),
        F.concat(F.lit(MESSAGES[check]), F.lit("") if column is None else F.concat(F.lit(": "), column)).alias("message"),
    )


def _bands(df: DataFrame, check: str, rate: Column, bands: tuple[float, float], p: dict[str, float]) -> DataFrame:
    severe = rate > bands[1]
    return _finding(df.filter(rate > bands[0]), check, F.when(severe, "error").otherwise("warning"), rate, F.when(severe, p[f"{check}_severe"]).otherwise(p[check]))


def quality_findings(df: DataFrame, roles: Roles, t: Thresholds = Thresholds(), identifiers: Sequence[str] | None = None) -> DataFrame:
    """check, severity, column, value, penalty, message: one row for each finding. Every part is an aggregate; their union is a small table.

    identifiers are no sensors; None finds them by identifier_columns.
    """
    p = t.penalties
    df = normalise_missing(df)
    sensors = sensor_columns(df, roles, identifier_columns(df, roles) if identifiers is None else identifiers)
    parts = [
        _bands(table_profile(df), "missing", F.col("missing_rate"), t.missing, p),
        _bands(duplicate_rows(df), "duplicates", F.col("duplicate_rate"), t.duplicates, p),
    ]
    if sensors:
        columns = written(column_profile(df, sensors), "facts")  # like the other facts that are written: a few rows, read twice
        parts.append(_finding(columns.filter("n_distinct <= 1"), "constant_sensor", "warning", F.col("n_distinct"), F.lit(p["constant_sensor"]), F.col("column")))
        near = columns.filter(F.col("n_distinct") > 1).filter(F.col("unique_ratio") <= t.near_constant)
        parts.append(_finding(near, "near_constant_sensor", "warning", F.col("n_distinct"), F.lit(p["near_constant_sensor"]), F.col("column")))
        outliers = robust_outliers(df, sensors, t.outlier_z).filter(F.col("rate") > t.outlier_rate)
        parts.append(_finding(outliers, "outlier", "warning", F.col("rate"), F.lit(p["outlier"]), F.col("column")))
    if roles.ts:
        summaries = successive(df, roles, sensors)
        if sensors:
            flat = longest_flatline(df, roles, sensors, summaries=summaries).filter((F.col("longest") >= t.flatline_rows) & (F.col("ratio") >= t.flatline_ratio))
            parts.append(_finding(flat, "flatline", "warning", F.col("longest"), F.lit(p["flatline"]), F.col("column")))
        twice = duplicate_timestamps(df, roles).filter("duplicate_timestamps > 0")
        parts.append(_finding(twice, "duplicate_timestamps", "warning", F.col("duplicate_timestamps"), F.lit(p["duplicate_timestamps"])))
        between = written(sampling_gaps(df, roles, t.gap_factor, summaries), "facts")
        parts.append(_finding(between.filter("long_gaps > 0"), "timestamp_gaps", "warning", F.col("long_gaps"), F.lit(p["timestamp_gaps"])))
        parts.append(_finding(between.filter(F.col("sampling_cv") > t.sampling_cv), "sampling_irregularity", "warning", F.col("sampling_cv"), F.lit(p["sampling_irregularity"])))
    if roles.asset:
        assets = asset_imbalance(df, roles.asset).filter(F.col("ratio") > t.asset_ratio)
        parts.append(_finding(assets, "asset_imbalance", "warning", F.col("ratio"), F.lit(p["asset_imbalance"])))
    if roles.target:
        classes, name = written(target_imbalance(df, roles.target), "facts"), F.lit(roles.target)
        parts.append(_finding(classes.filter(F.col("ratio") > t.target_ratio), "target_imbalance", "warning", F.col("ratio"), F.lit(p["target_imbalance"]), name))
        parts.append(_finding(classes.filter("n_classes = 1"), "target_imbalance", "error", F.col("n_classes"), F.lit(p["single_class"]), name))
    usable = df.agg((F.count(roles.target) if roles.target else F.count("*")).alias("n")).filter(F.col("n") < t.samples)
    parts.append(_finding(usable, "few_samples", "error", F.col("n"), F.lit(p["few_samples"])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def health_score(findings: DataFrame) -> DataFrame:
    """One row: n_findings, penalty, score (100 less the penalties, within 0 and 100, two decimals)."""
    total = F.coalesce(F.sum("penalty"), F.lit(0.0))
    return findings.agg(F.count("*").alias("n_findings"), total.alias("penalty"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - total)), 2).alias("score"))


def by_severity(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return findings.orderBy(rank.desc(), F.desc("penalty"), "check", "column")


def asset_health(df: DataFrame, roles: Roles, sensor: str, state: str, t: Thresholds = Thresholds()) -> DataFrame:
    """The quality of each asset's own readings: asset, n_rows, missing_rate, median_gap, long_gaps, longest_flatline (of state), outlier_rate, score.

    All windows and groups are by asset, so one shuffle of the readings by asset serves them.
    """
    df = normalise_missing(df)
    rows = df.select(F.col(roles.asset).alias("asset"), F.col(roles.ts).alias("ts"), F.col(roles.key).alias("key"), F.col(sensor).cast("double").alias("value"), F.col(state).alias("state"))
    w = Window.partitionBy("asset").orderBy("ts", "key")
    rows = rows.withColumns({"before": F.lag("ts").over(w), "starts": (~F.coalesce(F.col("state") == F.lag("state").over(w), F.lit(False))).cast("int")})
    rows = rows.withColumn("gap", F.expr("timestampdiff(SECOND, before, ts)")).withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = rows.groupBy("asset").agg(F.count("*").alias("n_rows"), F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"), F.percentile("gap", 0.5).alias("median_gap"), F.percentile("value", 0.5).alias("m"))
    joined = rows.select("asset", "gap", "value").join(one, "asset")
    two = joined.groupBy("asset").agg(F.count_if(F.col("gap") > t.gap_factor * F.col("median_gap")).alias("long_gaps"), F.percentile(F.abs(F.col("value") - F.col("m")), 0.5).alias("mad"))
    rate = F.avg(F.when(F.col("value").isNotNull(), (0.6745 * F.abs(F.col("value") - F.col("m")) > t.outlier_z * F.col("mad")).cast("int")))
    three = joined.join(two.select("asset", "mad"), "asset").groupBy("asset", "mad").agg(rate.alias("rate")).select("asset", F.when(F.col("mad") > 0, F.col("rate")).otherwise(0.0).alias("outlier_rate"))
    runs = rows.groupBy("asset", "island").agg(F.count("state").alias("run")).groupBy("asset").agg(F.greatest(F.max("run"), F.lit(1)).alias("longest_flatline"))
    out = one.drop("m").join(two.drop("mad"), "asset").join(three, "asset").join(runs, "asset")
    p = t.penalties
    penalty = (
        F.when(F.col("missing_rate") > t.missing[1], p["missing_severe"]).when(F.col("missing_rate") > t.missing[0], p["missing"]).otherwise(0.0)
        + F.when((F.col("longest_flatline") >= t.flatline_rows) & (F.col("longest_flatline") / F.col("n_rows") >= t.flatline_ratio), p["flatline"]).otherwise(0.0)
        + F.when(F.col("long_gaps") > 0, p["timestamp_gaps"]).otherwise(0.0)
        + F.when(F.col("outlier_rate") > t.outlier_rate, p["outlier"]).otherwise(0.0)
    )
    return out.withColumn("score", 100 - penalty)
