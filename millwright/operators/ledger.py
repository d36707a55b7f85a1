"""Append-only logs of models, approvals, work orders and feedback; the current state is a query over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.prefix import exists

# Outcomes of feedback, a work order's payload, its longest values and what it must have.
OUTCOMES = ("confirmed_issue", "false_alarm", "different_issue", "no_action_needed")
PAYLOAD = "asset_id string, priority string, recommended_action string, prediction_event_id string, reason string, risk_score double, source_model_version string"
LENGTHS = {"asset_id": 255, "priority": 32, "recommended_action": 1024, "prediction_event_id": 64, "reason": 2048, "source_model_version": 32}
REQUIRED = ("asset_id", "priority", "recommended_action", "prediction_event_id")


def latest(df: DataFrame, created: str, key: str, filters: Mapping[str, object] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest rows first; limit is clamped to 1..500. The filters reach the scan and the order is a top-k."""
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == value)
    return df.orderBy(F.desc(created), key).offset(max(0, offset)).limit(max(1, min(500, limit)))


def _last(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__rn = 1").drop("__rn")


def lineage(models: DataFrame, runs: DataFrame, experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """Registered models with their run, experiment and dataset, by run_id, experiment_id and dataset_id; lost links are null."""
    return models.join(runs, "run_id", "left").join(experiments, "experiment_id", "left").join(datasets, "dataset_id", "left")


def eligible_runs(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Runs that are the recommended one of an experiment that succeeded."""
    wanted = experiments.filter("status = 'succeeded'").select("experiment_id", F.col("recommended_run").alias("run_id"))
    return runs.join(wanted, ["experiment_id", "run_id"], "left_semi")


def new_registrations(requests: DataFrame, registered: DataFrame) -> DataFrame:
    """requests (run_id, name) with status: existing (same run and name), conflict (the run has another name) or new."""
    names = registered.groupBy("run_id").agg(F.collect_set("name").alias("names"))
    status = F.when(F.col("names").isNull(), "new").when(F.array_contains("names", F.col("name")), "existing").otherwise("conflict")
    return requests.join(names, "run_id", "left").withColumn("status", status).drop("names")


def current_state(log: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """The latest event of each name: what is deployed, or the newest candidate."""
    return _last(log, [by], [F.desc(at), F.desc(key)])


def state_intervals(log: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Each event with valid_from and valid_to (the next event of the same name; null: current): a promotion archives the one before."""
    following = F.lead(at).over(Window.partitionBy(by).orderBy(at, key))
    return log.withColumn("valid_from", F.col(at)).withColumn("valid_to", following).withColumn("is_current", F.col("valid_to").isNull())


def first_valid_decision(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with verdict: applied (the first that expects the pending request's version and is complete), invalid or conflict.

    requests: request_id, version; decisions: decision_id, request_id, status, expected_version, reason, payload, decided_at.
    """
    joined = decisions.join(requests.select("request_id", "version"), "request_id", "left")
    complete = (
        F.col("status").isin("approved", "rejected", "modified")
        & ((F.col("status") == "approved") | (F.trim(F.coalesce("reason", F.lit(""))) != ""))
        & ((F.col("status") != "modified") | F.col("payload").isNotNull())
    )
    fits = complete & (F.col("expected_version") == F.col("version"))
    joined = joined.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("complete", F.coalesce(complete, F.lit(False)) & F.col("version").isNotNull())
    order = Window.partitionBy("request_id", "fits").orderBy("decided_at", "decision_id")
    joined = joined.withColumn("rn", F.row_number().over(order))
    verdict = F.when(F.col("fits") & (F.col("rn") == 1), "applied").when(~F.col("complete"), "invalid").otherwise("conflict")
    return joined.withColumn("verdict", verdict).drop("fits", "complete", "rn")


def pending_conflicts(requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of several pending requests for the same thing, and their number."""
    return requests.filter("status = 'pending'").groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def work_orders(approvals: DataFrame, predictions: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Work orders of approved and modified approvals, and rejected approvals with the reason; one order for each approval.

    approvals: approval_id, status, payload, decision_payload (JSON texts); predictions: prediction_event_id.
    """
    done = approvals.filter(F.col("status").isin("approved", "modified")).dropDuplicates(["approval_id"])
    if existing is not None:
        done = done.join(existing.select("approval_id"), "approval_id", "left_anti")
    text = F.when(F.col("status") == "modified", F.col("decision_payload")).otherwise(F.col("payload"))
    allowed = [*LENGTHS, "risk_score", "evidence"]
    rows = done.select("approval_id", "status", F.from_json(text, PAYLOAD).alias("p"), F.json_object_keys(text).alias("keys"))
    extra = F.size(F.array_except("keys", F.array(*[F.lit(x) for x in allowed]))) > 0
    blank = F.coalesce(*[F.when(F.trim(F.coalesce(F.col(f"p.{c}"), F.lit(""))) == "", F.lit(c)) for c in REQUIRED])
    long = F.coalesce(*[F.when(F.length(f"p.{c}") > n, F.lit(c)) for c, n in LENGTHS.items()])
    rows = rows.withColumn("reason", F.when(F.col("p").isNull() | F.col("keys").isNull(), "not an object").when(extra, "unknown key").when(blank.isNotNull(), F.concat(F.lit("missing "), blank)).when(long.isNotNull(), F.concat(F.lit("too long "), long)))
    known = predictions.select(F.col("prediction_event_id").alias("__event")).distinct()
    rows = rows.join(known, F.col("p.prediction_event_id") == F.col("__event"), "left")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("__event").isNull(), "unknown prediction")))
    return rows.filter("reason is null").select("approval_id", "status", "p.*"), rows.filter("reason is not null").select("approval_id", "reason")


def receipts(orders: DataFrame, executions: DataFrame) -> DataFrame:
    """Work orders with their execution, if there is one."""
    return orders.join(executions, "approval_id", "left")


def feedback_intake(batch: DataFrame, predictions: DataFrame, outcomes: Sequence[str] = OUTCOMES, longest: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Accepted feedback with the prediction's model_id, and rejected feedback with the reason.

    batch: feedback_id, prediction_event_id, outcome, technician, comment; predictions: prediction_event_id, model_id.
    """
    rows = batch.join(predictions.select("prediction_event_id", "model_id").withColumn("__known", F.lit(True)), "prediction_event_id", "left")
    reason = (
        F.when(F.col("outcome").isNull() | ~F.col("outcome").isin(*outcomes), "unknown outcome")
        .when(F.trim(F.coalesce("technician", F.lit(""))) == "", "no technician")
        .when(F.length("comment") > longest, "comment too long")
        .when(F.col("__known").isNull(), "unknown prediction")
    )
    rows = rows.withColumn("reason", reason).drop("__known")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("feedback_id", "reason")


def experiment_runs(runs: DataFrame, experiments: DataFrame, experiment_id: str) -> DataFrame:
    """The runs of an experiment in order of creation, marked where recommended."""
    own = experiments.filter(F.col("experiment_id") == experiment_id).select("experiment_id", "recommended_run")
    out = runs.join(own, "experiment_id")
    return out.withColumn("recommended", F.col("run_id") == F.col("recommended_run")).drop("recommended_run").orderBy("created_at", "run_id")


def append(rows: DataFrame, path: str, allow: Sequence[str] | None = None) -> None:
    """Append to a log; with allow only those columns are written."""
    (rows if allow is None else rows.select([c for c in rows.columns if c in allow])).write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the log does not have, so that an append that is tried again adds nothing. New columns extend the log's schema.

    Two writers at once may both add a key; read_log counts it once.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.option("mergeSchema", True).parquet(path).select(key).distinct(), key, "left_anti")
    rows.dropDuplicates([key]).withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The log's rows, each key once as it was logged first; columns that came later are null in older rows."""
    log = spark.read.option("mergeSchema", True).parquet(path)
    return log.groupBy(key).agg(F.min_by(F.struct(*log.columns), "logged_at").alias("row")).select("row.*")


def versions(models: DataFrame, name: str) -> DataFrame:
    """A model's versions in numeric order."""
    return models.filter(F.col("name") == name).orderBy(F.col("version").cast("int"))


def flat(rows: DataFrame, key: Sequence[str], nested: str) -> DataFrame:
    """One row for each item of an array of structs, with its place."""
    return rows.select(*key, F.posexplode(nested).alias("place", "item")).select(*key, (F.col("place") + 1).alias("place"), "item.*")


def report_for(reports: Mapping[str, DataFrame], kind: str, key: str, value: object) -> DataFrame:
    """Rows of a named report table for one id: a point query."""
    if kind not in reports:
        raise KeyError(f"unknown report {kind}")
    return reports[kind].filter(F.col(key) == value)
