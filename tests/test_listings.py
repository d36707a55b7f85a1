"""What is listed row by row: failures, new categories, local features, anomalies, classes of splits and evidence of tasks."""

import pytest
from pyspark.sql import functions as F

from millwright.operators import anomaly, drift, evallog, framing, models
from millwright.sources import tables


def test_failing_rows_have_their_reasons(spark):
    flags = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False), (4, True, None), (5, None, False)], "key int, counts boolean, good boolean")
    why = F.concat(F.lit("row "), F.col("key"))
    metrics = {"a": (F.col("counts"), F.col("good"), why), "b": (F.lit(True), F.col("key") < 5, F.lit("late"))}
    got = sorted(map(tuple, evallog.failing_rows(flags, "key", metrics).collect()))
    assert got == [("a", 2, "row 2"), ("a", 4, "row 4"), ("b", 5, "late")]
    card = {r.metric: r.denominator - r.numerator for r in evallog.scorecard(flags, "key", {n: m[:2] for n, m in metrics.items()}).collect()}
    assert card == {"a": 2, "b": 1}
    assert evallog.failing_rows(flags.filter("false"), "key", metrics).count() == 0


def test_local_features_by_sign_ties_and_nulls(spark):
    rows = [(1, "a", 2.0), (1, "b", -3.0), (1, "c", 2.0), (1, "d", 0.0), (1, "e", None), (1, "f", 5.0), (1, "g", -1.0), (2, "a", -1.0)]
    got = {r.id: r for r in models.local_features(spark.createDataFrame(rows, "id int, feature string, impact double"), ["id"], 2).collect()}
    assert [tuple(x) for x in got[1].positive] == [("f", 5.0), ("a", 2.0)] and [tuple(x) for x in got[1].negative] == [("b", -3.0), ("g", -1.0)]
    assert got[2].positive == [] and [tuple(x) for x in got[2].negative] == [("a", -1.0)]


def test_new_categories_as_rows(spark):
    base = spark.createDataFrame([("a", 1), ("b", None)], "x string, n int")
    prod = spark.createDataFrame([("a", 2), ("c", 2), ("c", None), (None, 1)], "x string, n int")
    assert sorted(map(tuple, drift.new_category_rows(base, prod, ["x", "n"]).collect())) == [("n", "2", 2), ("x", "c", 2)]
    assert drift.new_category_rows(base, prod.filter("false"), ["x"]).count() == 0


def test_anomaly_listing_counts_what_it_leaves_out(spark):
    base = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(50)], "id int, u double, v double")
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, ["u", "v"]))
    prod = spark.createDataFrame([(1, 900.0, 1.0), (2, 1.0, -700.0), (3, 2.0, 2.0), (4, None, None)], "id int, u double, v double")
    scores = anomaly.robust_scores(prod, stats, ["u", "v"], ["id"])
    got = anomaly.anomaly_listing(scores, "robust_score", ["id"], ["u", "v"], 2, 1).orderBy("id").collect()
    assert [(r.id, r.top[0].column, r.rows_omitted) for r in got] == [(1, "u", 2), (2, "v", 2)] and "value" not in got[0].top[0].asDict()
    assert {r.rows_omitted for r in anomaly.anomaly_listing(scores, "robust_score", ["id"], ["u", "v"], 20).collect()} == {0}
    assert anomaly.anomaly_listing(scores.filter("false"), "robust_score", ["id"], ["u", "v"]).count() == 0


def test_classes_of_splits(spark):
    df = spark.createDataFrame([("train", 1), ("train", 1), ("train", 0), ("train", None), ("test", 0)], "split string, t int")
    assert sorted(map(tuple, tables.split_classes(df, "t").collect())) == [("test", "0", 1, 1.0), ("train", "0", 1, 1 / 3), ("train", "1", 2, 2 / 3)]


@pytest.mark.parametrize(
    ("values", "lines"),
    [
        (["x"] * 3 + ["y"] + [None], ["2 classes", "smallest class y has 25.0 %"]),
        (["b", "a"], ["2 classes", "smallest class a has 50.0 %"]),
        ([float(i) for i in range(40)], ["40 different numbers", "standard deviation 11.690", "the 40 numbers may be ordinal labels"]),
        (["x", "x"], ["1 classes"]),
    ],
)
def test_evidence_of_tasks(spark, values, lines):
    df = spark.createDataFrame([(v,) for v in values], f"t {'double' if isinstance(values[0], float) else 'string'}")
    assert [r.text for r in framing.task_evidence(df, "t").orderBy("place").collect()] == lines


def test_a_target_of_too_many_classes_is_refused(spark):
    df = spark.createDataFrame([(i, float(i), str(i)) for i in range(20)], "id int, x double, t string")
    with pytest.raises(ValueError, match="over 10 classes"):
        models.train_all(df, df, ["x"], "t", "multiclass_classification", most_classes=10)
