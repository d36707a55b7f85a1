"""Monitoring of a model's data: one run over a baseline and a production window, and the advice to retrain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.columns import config_hash
from millwright.functions.prefix import written
from millwright.operators import anomaly, drift
from millwright.operators.ledger import append_once


def monitor_features(columns: Sequence[str], plan: Sequence[str], roles: Sequence[str | None], leaking: Sequence[str]) -> list[str]:
    """Columns of the frozen plan without roles and leaking features."""
    return [c for c in columns if c in plan and c not in roles and c not in leaking]


def retraining_recommendation(facts: DataFrame, drop: float = 0.05, jump: float = 0.10, days: int = 30) -> DataFrame:
    """facts (one row: drift_severity, metric_drop, anomaly_jump, days_since, due, manual) -> trigger, fired, value: five rows.

    A trigger at its threshold fires. Nothing is deployed here; this is advice.
    """
    rows = [
        ("high_drift", F.col("drift_severity") == "HIGH", F.col("drift_severity")),
        ("metric_drop", F.col("metric_drop") >= drop, F.col("metric_drop").cast("string")),
        ("anomaly_jump", F.col("anomaly_jump") >= jump, F.col("anomaly_jump").cast("string")),
        ("schedule", (F.col("days_since") >= days) | F.coalesce("due", F.lit(False)), F.col("days_since").cast("string")),
        ("manual", F.col("manual"), F.col("manual").cast("string")),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("trigger"), F.coalesce(f, F.lit(False)).alias("fired"), v.alias("value")) for n, f, v in rows])
    return facts.select(F.explode(each).alias("t")).select("t.*")


def recommendation(triggers: DataFrame) -> DataFrame:
    """One row: retrain, reasons (sorted)."""
    return triggers.agg(F.bool_or("fired").alias("retrain"), F.array_sort(F.collect_list(F.when(F.col("fired"), F.col("trigger")))).alias("reasons"))


def monitoring_run(base: DataFrame, prod: DataFrame, columns: Sequence[str], key: Sequence[str], numbers: Sequence[str], threshold: float = anomaly.THRESHOLD, metric_drop: float | None = None, days_since: int | None = None, manual: bool = False) -> DataFrame:
    """One row for the run log: severity of drift, features by severity, anomaly rates of both windows, retrain and its reasons.

    Anomalies are by the robust score of the numbers, against the baseline's fit.
    """
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, numbers))
    rates = []
    for df in (base, prod):
        scored = anomaly.robust_scores(df, stats, numbers, key)
        flagged = F.col("robust_score") > threshold
        rates.append(scored.agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(F.count_if(flagged), F.count("*")), F.lit(0.0)), 6).alias("rate")))
    worst = drift.overall_severity(drift.drift_report(base, prod, columns))
    # four tables of one row each
    run = worst.join(F.broadcast(rates[0].toDF("base_rows", "base_rate"))).join(F.broadcast(rates[1].toDF("prod_rows", "prod_rate")))
    facts = run.select(
        F.col("severity").alias("drift_severity"), F.lit(metric_drop).cast("double").alias("metric_drop"), (F.col("prod_rate") - F.col("base_rate")).alias("anomaly_jump"),
        F.lit(days_since).cast("int").alias("days_since"), F.lit(None).cast("boolean").alias("due"), F.lit(manual).alias("manual"),
    )
    return run.join(F.broadcast(recommendation(retraining_recommendation(facts))))


@dataclass(frozen=True)
class Monitor:
    """What a baseline was fitted to, once for all windows that are held against it."""

    numbers: list[str]
    stats: anomaly.RobustStats
    forest: DataFrame
    combiner: anomaly.Combiner

    def scores(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """The key, robust_score, isolation_score, combined_score and flagged of each row, in one pass without a shuffle."""
        robust = anomaly.robust_scores(df, self.stats, self.numbers, key).drop("z")
        both = anomaly.isolation_scores(robust, self.forest, self.stats, self.numbers, [*key, "robust_score"])
        return anomaly.combined_score(both, self.combiner)


def fit_monitor(base: DataFrame, numbers: Sequence[str], key: str, path: str, trees: int = anomaly.TREES, contamination: float = 0.05) -> None:
    """Fit the robust statistics, the forest and the combiner to a baseline, and store them at path: three small tables."""
    numbers = list(numbers)
    anomaly.fit_robust_baseline(base, numbers).write.parquet(f"{path}/stats")
    spark = base.sparkSession
    stats = anomaly.RobustStats.of(spark.read.parquet(f"{path}/stats"))
    anomaly.fit_isolation_forest(base, stats, numbers, key, trees).write.parquet(f"{path}/forest")
    names = ["robust_score", "isolation_score"]
    open_ = Monitor(numbers, stats, spark.read.parquet(f"{path}/forest"), anomaly.Combiner(dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)))
    scored = open_.scores(base, [key]).select(*names)
    scored.write.parquet(f"{path}/scores")  # both passes of the combiner's fit read these
    found = anomaly.fit_combiner(spark.read.parquet(f"{path}/scores"), names, contamination)
    rows = [(n, found.centre[n], found.scale[n], found.threshold, i, c) for i, (n, c) in enumerate(zip(names, [",".join(numbers)] * 2, strict=True))]
    spark.createDataFrame(rows, "score string, centre double, scale double, threshold double, place int, numbers string").coalesce(1).write.parquet(f"{path}/combiner")


def load_monitor(spark: SparkSession, path: str) -> Monitor:
    """A fitted monitor; only its statistics, a row for each column and score, reach the driver."""
    rows = spark.read.parquet(f"{path}/combiner").orderBy("place").collect()
    combiner = anomaly.Combiner({r["score"]: r["centre"] for r in rows}, {r["score"]: r["scale"] for r in rows}, rows[0]["threshold"])
    return Monitor(rows[0]["numbers"].split(","), anomaly.RobustStats.of(spark.read.parquet(f"{path}/stats")), spark.read.parquet(f"{path}/forest"), combiner)


def rates(scored: DataFrame, prefix: str, threshold: float = anomaly.THRESHOLD) -> DataFrame:
    """One row: the shares of rows beyond each score's limit: the robust threshold, 0 for isolation, the combiner's threshold."""
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 6)
    flags = {"robust": F.col("robust_score") > threshold, "isolation": F.col("isolation_score") > 0, "combined": F.col("flagged")}
    return scored.agg(*[share(c).alias(f"{prefix}_{n}_rate") for n, c in flags.items()])


def full_run(fitted: Monitor, base: DataFrame, prod: DataFrame, columns: Sequence[str], key: Sequence[str], log: str, settings: dict, **how: object) -> DataFrame:
    """monitoring_run with the rates of all three scores, appended to a log once: the row's run_id is the hash of the settings, which name the window."""
    run = monitoring_run(base, prod, columns, key, fitted.numbers, **how)
    for prefix, df in (("base", base), ("prod", prod)):
        run = run.join(F.broadcast(rates(fitted.scores(df, key), prefix)))  # one row each
    row = written(run.select(F.lit(config_hash(settings)).alias("run_id"), "*"), "run")
    append_once(row, log, "run_id")
    return row
