"""One run over an official holdout: profile, quality and task on train only, then models, ranking and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from millwright.operators import framing, metrics, models, profile, quality
from millwright.operators.features import resolve_features
from millwright.operators.quality import Roles
from millwright.operators.split import split_by_source
from millwright.sources.tables import check_same_schema, split_summary, write_reports


def benchmark(
    train: DataFrame, test: DataFrame, roles: Roles, costs: Sequence[tuple[float, float]] = ((500.0, 10.0),), names: Sequence[str] | None = None, seed: int = 42,
    min_recall: float = 0.80, path: str | None = None,
) -> dict[str, DataFrame]:
    """Reports by name: summary, profile, findings, task, ranking, confusion and, for two classes, costs; written under path if it is given.

    The target is the first column of both tables.
    """
    check_same_schema(train, test, roles.target)
    task = framing.recommend_task(train, roles.target)
    kind = task.first()["task"]
    if kind not in models.CATALOG:
        raise ValueError(f"nothing to train: {kind}")
    excluded = framing.training_exclusions(framing.leakage_report(train, roles), roles)
    done, _ = models.train_all(train, test, resolve_features(train, roles.target, excluded), roles.target, kind, names, seed)
    evaluated = models.evaluate(done, test, [roles.key])
    rate = None
    if done[0].positive is not None:
        rate = framing.class_distribution(train, roles.target).filter(f"label = '{done[0].positive}'").first()["rate"]
    reports = {
        "summary": split_summary(split_by_source(train, test).withColumnRenamed("fold", "split"), roles.target),
        "profile": profile.column_profile(train),
        "findings": quality.quality_findings(train, roles),
        "task": task,
        "ranking": metrics.rank_models(evaluated, metrics.primary_metric(kind, rate, "pr_auc" in evaluated.columns), min_recall if kind != "regression" else None),
    }
    if kind != "regression":
        reports["confusion"] = metrics.confusion_matrix(models.predictions(done, test, [roles.key]), done[0].labels)
    if done[0].positive is not None:
        reports["costs"] = metrics.compare_costs(reports["confusion"], done[0].positive, costs, evaluated)
    if path is not None:
        for name, report in reports.items():
            write_reports(report, f"{path}/{name}")
    return reports
