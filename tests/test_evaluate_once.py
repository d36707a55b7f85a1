"""Evaluation of models scores each row once, however many metrics there are."""

from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators import models


def test_rows_are_scored_once_for_all_metrics(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    def count(score):
        scored.add(1)
        return score

    rows = spark.range(0, 40, 1, 2).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").cast("string").alias("label"), (F.col("id") / 40).alias("score"))
    made = rows.select(F.lit("logistic_regression").alias("model"), "key", "label", F.lit("1").alias("prediction"), F.udf(count, T.DoubleType())("score").alias("score"))
    monkeypatch.setattr(models, "predictions", lambda *_: made)
    monkeypatch.setattr(models, "_scoring_seconds", lambda *_: 0.0)
    one = SimpleNamespace(name="logistic_regression", task="binary_classification", labels=("0", "1"), positive="1", seconds=0.0)
    found = models.evaluate([one], rows, ["key"]).collect()
    assert len(found) == 1 and found[0]["recall"] == 1.0
    assert scored.value == 40
