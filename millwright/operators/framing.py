"""What to predict (task) and what must not be used for it (leakage)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import IDENTIFIER_HINTS, coarse_dtype, has_hint, is_numeric, normalise_missing, normalise_name, unpivot
from millwright.operators.profile import MOST_CLASSES, column_profile
from millwright.operators.quality import Roles

# Substrings of names that tell what is known only after the event, and names of labels.
POST_EVENT_HINTS = ("failure", "fault", "repair", "downtime", "maintenance", "breakdown", "error", "alarm", "incident", "workorder")
LABEL_TOKENS = ("label", "target", "groundtruth")
LABEL_NAMES = ("class", "predictedclass", "outputclass", "groundtruth")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """label, n, rate: present classes of the target."""
    counts = normalise_missing(df).filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row; a window over all classes would be one task
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("all")).alias("rate"))


def recommend_task(df: DataFrame, target: str) -> DataFrame:
    """One row: task, trainable, confidence, n, n_classes, least_rate, evidence, alternative."""
    kind = df.schema[target].dataType
    rows = normalise_missing(df).select(F.col(target).alias("t")).filter("t is not null")
    classes = rows.groupBy("t").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_classes"), F.min("c").alias("least"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    number = F.col("t").cast("double") if is_numeric(kind) else F.lit(None).cast("double")
    spread = rows.agg(F.stddev_samp(number).alias("std"), F.avg(number).alias("mean"))
    facts = classes.join(F.broadcast(spread)).withColumn("least_rate", F.try_divide("least", "n"))  # one row each
    many = F.col("n_classes") > MOST_CLASSES
    task = (
        F.when(F.col("n") < 2, "insufficient_target")
        .when(F.col("n_classes") <= 1, "single_class")
        .when(F.col("n_classes") == 2, "binary_classification")
        .when(F.lit(is_numeric(kind)) & many, "regression")
        .otherwise("multiclass_classification")
    )
    rate = F.col("least_rate")
    binary = F.when(rate < 0.005, 0.55).when(rate < 0.05, 0.70).when(rate < 0.40, 0.85).otherwise(0.75)
    multi = 0.75 - 0.05 * F.greatest(F.lit(0), F.col("n_classes") - 2) - F.when(rate < 0.02, 0.10).otherwise(0.0)
    cv = F.try_divide(F.col("std"), F.abs("mean"))
    far = F.coalesce(cv, F.lit(float("inf")))
    regression = F.when(F.col("std") == 0, 0.30).otherwise(0.75 - F.when(far < 0.05, 0.20).otherwise(0.0) - F.when(far > 3, 0.10).otherwise(0.0))
    out = facts.withColumn("task", task)
    trainable = ~F.col("task").isin("insufficient_target", "single_class")
    chosen = F.when(F.col("task") == "binary_classification", binary).when(F.col("task") == "regression", regression).otherwise(multi)
    confidence = F.when(trainable, F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), chosen)), 2)).otherwise(0.0)
    evidence = F.concat(F.col("n").cast("string"), F.lit(" values, "), F.col("n_classes").cast("string"), F.lit(" different"))
    other = F.when((F.col("task") == "regression") & (F.col("n_classes") <= 100), "ordinal_multiclass")
    return out.select("task", trainable.alias("trainable"), confidence.alias("confidence"), "n", "n_classes", "least_rate", evidence.alias("evidence"), other.alias("alternative"))


def task_evidence(df: DataFrame, target: str) -> DataFrame:
    """place, text: what the recommended task rests on. Classes, and the smallest one (the first label of equals) with its share, or the
    number of different values and their spread; a target that could hold ordinal labels has a third line."""
    smallest = class_distribution(df, target).agg(F.min_by("label", F.struct("n", "label")).alias("label"))
    number = F.col(target).cast("double") if is_numeric(df.schema[target].dataType) else F.lit(None).cast("double")
    spread = normalise_missing(df).agg(F.stddev_samp(number).alias("std"))
    facts = recommend_task(df, target).join(F.broadcast(smallest)).join(F.broadcast(spread))  # one row each
    continuous, classes = F.col("task") == "regression", F.col("n_classes").cast("string")
    share = F.format_string("%.1f", 100 * F.col("least_rate"))
    lines = F.array(
        F.when(continuous, F.concat(classes, F.lit(" different numbers"))).otherwise(F.concat(classes, F.lit(" classes"))),
        F.when(continuous, F.concat(F.lit("standard deviation "), F.format_string("%.3f", "std")))
        .when(F.col("trainable"), F.concat(F.lit("smallest class "), F.col("label"), F.lit(" has "), share, F.lit(" %"))),
        F.when(F.col("alternative").isNotNull(), F.concat(F.lit("the "), classes, F.lit(" numbers may be ordinal labels"))),
    )
    return facts.select(F.posexplode(F.array_compact(lines)).alias("place", "text")).withColumn("place", F.col("place") + 1)


def label_name(name: str) -> bool:
    return bool(set(re.findall("[a-z0-9]+", name.lower())) & set(LABEL_TOKENS)) or normalise_name(name) in LABEL_NAMES


def leakage_stats(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """column, agreement (rate of equal text, both present), correlation (Pearson, both present; null if constant): one scan."""
    df = normalise_missing(df)
    kind = df.schema[target].dataType
    cells = unpivot(df, features, "string", [F.col(target).cast("string").alias("t")])
    same = cells.filter("value is not null and t is not null").groupBy("column").agg(F.avg((F.col("value") == F.col("t")).cast("int")).alias("agreement"))
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)] if is_numeric(kind) else []
    if not numeric:
        return same.withColumn("correlation", F.lit(None).cast("double"))
    pairs = unpivot(df, numeric, "double", [F.col(target).cast("double").alias("t")]).filter("value is not null and t is not null")
    # the built-in correlation raises an error on a constant column
    moments = pairs.groupBy("column").agg(F.covar_pop("value", "t").alias("c"), F.stddev_pop("value").alias("a"), F.stddev_pop("t").alias("b"))
    moments = moments.select("column", F.try_divide(F.col("c"), F.col("a") * F.col("b")).alias("correlation"))
    return same.join(moments, "column", "full_outer")


def leakage_report(df: DataFrame, roles: Roles, features: Sequence[str] | None = None, identifiers: Sequence[str] = ()) -> DataFrame:
    """column, kind, severity (block or warning), agreement, correlation, unique_ratio: the first rule that fits each feature.

    A further row warns of a datetime feature beside the known timestamp.
    """
    features = list(features or [c for c in df.columns if c not in roles.named()])
    spark = df.sparkSession
    facts = [(c, is_numeric(df.schema[c].dataType), label_name(c), has_hint(c, POST_EVENT_HINTS), has_hint(c, IDENTIFIER_HINTS), c in identifiers) for c in features]
    names = spark.createDataFrame(facts, "column string, numeric boolean, label_name boolean, post_event boolean, id_hint boolean, identifier boolean")
    found = names.join(leakage_stats(df, roles.target, features), "column", "left").join(column_profile(df, features).select("column", "unique_ratio"), "column", "left")
    agreement, r, unique = F.coalesce("agreement", F.lit(0.0)), F.abs("correlation"), F.coalesce("unique_ratio", F.lit(0.0))
    rules = [
        (agreement >= 0.999, "target_duplicate", "block"),
        (r >= 0.99, "target_correlated", "block"),
        (agreement >= 0.90, "highly_identical", "warning"),
        (F.col("label_name"), "label_derived_name", "block"),
        (F.col("post_event"), "post_event_name", "warning"),
        (F.col("identifier") | ((unique >= 0.99) & F.col("id_hint")), "near_one_to_one_id", "block"),
        ((unique >= 0.99) & ~F.col("numeric"), "high_cardinality", "warning"),
    ]
    first = F.coalesce(*[F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for rule, kind, severity in rules])
    out = found.withColumn("rule", first).filter("rule is not null").select("column", "rule.kind", "rule.severity", "agreement", "correlation", "unique_ratio")
    dates = [f.name for f in df.schema if coarse_dtype(f.dataType) == "datetime" and f.name not in (roles.ts, roles.target, roles.key)]
    if roles.ts and dates:
        extra = spark.createDataFrame([(c, "extra_datetime", "warning", None, None, None) for c in dates], out.schema)
        out = out.union(extra)
    return out


def leakage_verdict(report: DataFrame) -> DataFrame:
    """One row: verdict (safe, warning or block) and the blocked features."""
    rank = F.max(F.when(F.col("severity") == "block", 2).otherwise(1))
    verdict = F.when(rank == 2, "block").when(rank == 1, "warning").otherwise("safe")
    return report.agg(verdict.alias("verdict"), F.array_sort(F.collect_set(F.when(F.col("severity") == "block", F.col("column")))).alias("excluded"))


def training_exclusions(report: DataFrame, roles: Roles) -> list[str]:
    """Blocked features, the asset, the timestamp and the key, sorted; one name for each feature at most."""
    blocked = [r[0] for r in report.filter("severity = 'block'").select("column").distinct().collect()]
    return sorted({*blocked, *(c for c in (roles.asset, roles.ts, roles.key) if c)})
