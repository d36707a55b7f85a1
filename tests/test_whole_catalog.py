"""All models of the catalog are trained and reported, and boosting on weights is boosting on the rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millwright.operators import models
from millwright.plans import model_queries


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    return spark.range(240).select(n.alias("key"), ((n % 2 * 3 + (n * 37 % 11)) / 5.0).alias("num"), (n % 2).cast("int").alias("target"))


def test_the_query_trains_every_model(spark):
    found = __spark_entry__.queries()["train_catalog"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["model"], r["complexity"]) for r in found) == [("boosted_trees", 2), ("logistic_regression", 0), ("random_forest", 1)]
    assert all(r["error"] is None and r["roc_auc"] is not None and r["pr_auc"] is not None for r in found)


def test_the_query_lists_a_model_that_fails(spark, monkeypatch):
    plain = models.train_one

    def fails(train, name, *rest):
        if name != "logistic_regression":
            raise RuntimeError("no memory")
        return plain(train, name, *rest)

    monkeypatch.setattr(models, "train_one", fails)
    found = {r["model"]: r for r in model_queries.train_catalog(spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == set(models.CATALOG["binary_classification"])
    assert found["boosted_trees"]["error"] == "RuntimeError: no memory" and found["boosted_trees"]["recall"] is None
    assert found["logistic_regression"]["error"] is None and found["logistic_regression"]["recall"] is not None


def test_boosting_takes_equal_rows_as_one_of_their_weight(spark, table):
    often = table.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("key") % 3 == 0, 4).otherwise(1)))).drop("times")
    done, failed = models.train_all(often, often, ["num"], "target", "binary_classification", ["boosted_trees"])
    assert not failed
    rows = models._with_label(done[0].preprocessor.transform(often), "binary_classification", "target", ["0", "1"])
    plain = models.build_model("boosted_trees", "binary_classification", rows.count()).fit(rows)
    scores = lambda model: {r["key"]: r["probability"][1] for r in model.transform(done[0].preprocessor.transform(table)).collect()}
    mine, wanted = scores(done[0].model), scores(plain)
    assert len(mine) == 240 and all(abs(mine[k] - wanted[k]) < 1e-6 for k in wanted)
