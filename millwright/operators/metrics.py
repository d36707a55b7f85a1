"""Metrics of predictions, the choice of a model by metric, and by cost.

Predictions are rows (model, label, prediction, score); all models are evaluated in one pass. Ranks and
running sums are over grouped scores of a model, not over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.prefix import running_within
from millwright.functions.quantiles import quantiles, value_counts

LOWER_IS_BETTER = ("rmse", "mae", "mse")
METRICS = {"binary_classification": ("precision", "recall", "f1", "roc_auc", "pr_auc"), "multiclass_classification": ("precision", "recall", "f1"), "regression": ("mae", "rmse", "r2")}


def confusion_matrix(pred: DataFrame, labels: Sequence[str]) -> DataFrame:
    """model, label, prediction, n for all pairs of the declared labels, zeros included."""
    grid = pred.select("model").distinct()
    grid = grid.select("model", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    grid = grid.select("model", "label", F.explode(F.array(*[F.lit(x) for x in labels])).alias("prediction"))
    counts = pred.groupBy("model", F.col("label").cast("string").alias("label"), F.col("prediction").cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["model", "label", "prediction"], "left").fillna(0, ["n"])


def confusion_lists(pred: DataFrame, labels: Sequence[str]) -> DataFrame:
    """model, confusion: its matrix as a list of label, prediction, n, in the order of labels; for the run log."""
    place = {x: i for i, x in enumerate(labels)}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    cells = F.sort_array(F.collect_list(F.struct(order[F.col("label")].alias("i"), order[F.col("prediction")].alias("j"), "label", "prediction", "n")))  # labels squared
    return confusion_matrix(pred, labels).groupBy("model").agg(F.transform(cells, lambda c: F.struct(c["label"].alias("label"), c["prediction"].alias("prediction"), c["n"].alias("n"))).alias("confusion"))


def per_class(pred: DataFrame, labels: Sequence[str]) -> DataFrame:
    """model, class, precision, recall, f1, support; a division by zero is 0."""
    m = confusion_matrix(pred, labels)
    both = m.select("model", F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("support"))
    both = both.unionByName(m.select("model", F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support")))
    s = both.groupBy("model", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": zero(F.col("tp"), F.col("predicted")), "recall": zero(F.col("tp"), F.col("support"))})
    return s.select("model", "class", "precision", "recall", zero(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def classification_metrics(pred: DataFrame, labels: Sequence[str], positive: str | None = None) -> DataFrame:
    """model, precision, recall, f1: of the positive label, or the plain mean over all labels."""
    classes = per_class(pred, labels)
    if positive is not None:
        return classes.filter(F.col("class") == positive).select("model", "precision", "recall", "f1")
    return classes.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def _by_score(pred: DataFrame, positive: str) -> DataFrame:
    hit = (F.col("label").cast("string") == positive).cast("long")
    return pred.filter("score is not null").groupBy("model", "score").agg(F.count("*").alias("n"), F.sum(hit).alias("p"))


def roc_auc(pred: DataFrame, positive: str) -> DataFrame:
    """model, roc_auc: share of pairs of a positive and a negative row in the right order, ties half; null with one class."""
    s = _by_score(pred, positive).withColumn("q", F.col("n") - F.col("p"))
    s = running_within(s, "model", ["score"], {"neg": "q"})
    u = F.sum(F.col("p") * (F.col("neg") - F.col("q") / 2))  # negatives below, and half of those with the same score
    out = s.groupBy("model").agg(u.alias("u"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return out.select("model", F.try_divide(F.col("u"), F.col("pos") * F.col("neg").cast("double")).alias("roc_auc"))


def average_precision(pred: DataFrame, positive: str) -> DataFrame:
    """model, pr_auc: sum of precision by gain of recall over descending scores; null without a positive row."""
    s = running_within(_by_score(pred, positive), "model", [F.desc("score")], {"tp": "p", "seen": "n"})
    out = s.groupBy("model").agg(F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("a"), F.sum("p").alias("pos"))
    return out.select("model", F.try_divide(F.col("a"), F.col("pos")).alias("pr_auc"))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """model, mae, rmse, r2 of numeric label and prediction; r2 is null for a constant label."""
    e = F.col("label") - F.col("prediction")
    out = pred.filter("label is not null and prediction is not null").groupBy("model").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), F.var_pop("label").alias("v"), F.count("*").alias("n")
    )
    return out.select("model", "mae", "rmse", (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"))


def positive_label(df: DataFrame, target: str) -> str:
    """The rarer of two classes; of equal ones 1, else the last as text."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).count()
    return counts.orderBy("count", F.desc(F.col("label") == "1"), F.desc("label")).first()["label"]


def primary_metric(task: str, positive_rate: float | None = None, has_pr_auc: bool = True) -> str:
    """rmse for regression, f1 for classes, pr_auc for a rare positive class if a model has it."""
    if task == "regression":
        return "rmse"
    return "pr_auc" if task == "binary_classification" and positive_rate is not None and positive_rate < 0.10 and has_pr_auc else "f1"


def validate_plan(task: str, metric: str, seed: int) -> None:
    if metric not in METRICS.get(task, ()):
        raise ValueError(f"{metric} is no metric of {task}")
    if seed < 0:
        raise ValueError("the seed must not be negative")


def rank_models(metrics: DataFrame, metric: str, min_recall: float | None = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """metrics with place: models that reach the recall floor (or have no recall), by metric, complexity, latency and name; others have no place."""
    floor = F.lit(True) if min_recall is None or "recall" not in metrics.columns else F.col("recall").isNull() | (F.col("recall") >= min_recall)
    value = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    order = Window.partitionBy(*by, floor).orderBy(value, "complexity", "latency", "model")
    return metrics.withColumn("place", F.when(floor, F.row_number().over(order)))


def compare_costs(confusion: DataFrame, positive: str, costs: Sequence[tuple[float, float]] = ((1.0, 1.0),), complexity: DataFrame | None = None) -> DataFrame:
    """fn_cost, fp_cost, model, fn, fp, total_cost, place: binary models by cost, then fn, fp, complexity and name; a model without counts is last.

    confusion: model, label, prediction, n; costs: any number of (cost of a missed failure, cost of a false alarm).
    """
    hit = lambda actual, said: F.sum(F.when(((F.col("label") == positive) == F.lit(actual)) & ((F.col("prediction") == positive) == F.lit(said)), F.col("n")))
    counts = confusion.groupBy("model").agg(hit(True, False).alias("fn"), hit(False, True).alias("fp"))
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("fn_cost"), F.lit(float(b)).alias("fp_cost")) for a, b in costs])
    out = counts.withColumn("c", F.explode(pairs)).select("c.fn_cost", "c.fp_cost", "model", "fn", "fp")
    out = out.withColumn("total_cost", F.col("fn") * F.col("fn_cost") + F.col("fp") * F.col("fp_cost"))
    out = out.join(complexity.select("model", "complexity"), "model", "left") if complexity is not None else out.withColumn("complexity", F.lit(0))
    order = Window.partitionBy("fn_cost", "fp_cost").orderBy(F.col("total_cost").asc_nulls_last(), "fn", "fp", "complexity", "model")
    return out.withColumn("place", F.row_number().over(order)).select("fn_cost", "fp_cost", "model", "fn", "fp", "total_cost", "place")


def cost_selection(
    confusion: DataFrame, positive: str, ranked: DataFrame, costs: Sequence[tuple[float, float]] = ((1.0, 1.0),), failed: DataFrame | None = None, complexity: DataFrame | None = None
) -> DataFrame:
    """compare_costs with the choice by metric beside it: available, reason, cost_best, metric_best and saving, for each pair of costs.

    ranked is what rank_models gives (model, place); failed has model and reason of models that could not be trained: they come last, unavailable and
    without a place. saving is what the cheapest model saves against the best one by metric, null where no model has a place by metric.
    """
    found = compare_costs(confusion, positive, costs, complexity).withColumns({"available": F.lit(True), "reason": F.lit(None).cast("string")})
    if failed is not None:
        pairs = F.array(*[F.struct(F.lit(float(a)).alias("fn_cost"), F.lit(float(b)).alias("fp_cost")) for a, b in costs])
        lost = failed.select("model", "reason", F.explode(pairs).alias("c")).select("c.fn_cost", "c.fp_cost", "model", "reason", F.lit(False).alias("available"))
        found = found.unionByName(lost, allowMissingColumns=True)
    first = ranked.filter("place = 1").select(F.col("model").alias("__first"))
    found = found.join(F.broadcast(first), F.col("model") == F.col("__first"), "left")  # one model
    one = Window.partitionBy("fn_cost", "fp_cost")  # a row for each model
    cost = lambda flag: F.max(F.when(flag, F.col("total_cost"))).over(one)
    best, chosen = F.coalesce(F.col("place") == 1, F.lit(False)), F.col("__first").isNotNull() & F.col("available")
    out = found.withColumns({"cost_best": best, "metric_best": chosen})
    return out.withColumn("saving", cost(F.col("metric_best")) - cost(F.col("cost_best"))).drop("__first")


def residual_interval(pred: DataFrame, q: float = 0.9) -> DataFrame:
    """model, half_width: the q quantile of the absolute residuals."""
    counts = value_counts(pred.select("model", F.abs(F.col("label") - F.col("prediction")).alias("away")), "model", "away")
    return quantiles(counts, [q], "model", "away").select("model", F.col("q")[0].alias("half_width"))


def with_interval(pred: DataFrame, widths: DataFrame) -> DataFrame:
    """pred with lower and upper; widths has one row for each model."""
    out = pred.join(F.broadcast(widths), "model")
    return out.withColumns({"lower": F.col("prediction") - F.col("half_width"), "upper": F.col("prediction") + F.col("half_width")}).drop("half_width")
