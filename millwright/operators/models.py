"""A small fixed catalog of Spark ML models: training, scoring under a strict contract, explanation, run log."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import coarse_dtype, config_hash, is_numeric, normalise_missing, seeded_order
from millwright.functions.prefix import global_order, written
from millwright.operators import metrics
from millwright.operators.features import FeatureError, Preprocessor, fit_preprocessor
from millwright.operators.ledger import append_once, read_log

#: Models by task, in order of complexity.
CATALOG = {
    "binary_classification": ("logistic_regression", "random_forest", "boosted_trees"),
    "multiclass_classification": ("logistic_regression", "random_forest", "boosted_trees"),
    "regression": ("ridge", "random_forest", "boosted_trees"),
}


def build_model(name: str, task: str, n: int, seed: int = 42):
    """The estimator; n rows set the strength of its regularisation, 1 / n."""
    if name not in CATALOG.get(task, ()):
        raise ValueError(f"{name} is not in the catalog of {task}")
    columns = {"featuresCol": "features", "labelCol": "__label"}
    if name == "logistic_regression":
        return LogisticRegression(maxIter=1000, regParam=1 / max(1, n), standardization=False, **columns)
    if name == "ridge":
        return LinearRegression(regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False, **columns)
    forest, boosted = (RandomForestRegressor, GBTRegressor) if task == "regression" else (RandomForestClassifier, GBTClassifier)
    if name == "random_forest":
        return forest(numTrees=100, maxDepth=8, seed=seed, **columns)
    model = boosted(maxIter=100, maxDepth=4, stepSize=0.1, seed=seed, **columns)
    return OneVsRest(classifier=model, parallelism=2, **columns) if task == "multiclass_classification" else model


@dataclass(frozen=True)
class Trained:
    name: str
    task: str
    features: tuple[str, ...]
    target: str
    labels: tuple[str, ...]
    positive: str | None
    preprocessor: Preprocessor
    model: object
    seconds: float
    feature_types: dict[str, str]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction (a label, or a number), score (probability of the positive label) and probabilities by label."""
        out = self.model.transform(self.preprocessor.transform(df))
        if self.task == "regression":
            return out.drop("features")
        labels = F.array(*[F.lit(x) for x in self.labels])
        if "probability" in out.columns:
            p = vector_to_array("probability")
            out = out.withColumn("probabilities", F.map_from_arrays(labels, p))
            out = out.withColumn("score", p[self.labels.index(self.positive)] if self.positive else F.array_max(p))
        else:
            out = out.withColumn("probabilities", F.lit(None).cast("map<string,double>")).withColumn("score", F.lit(None).cast("double"))
        return out.withColumn("prediction", F.element_at(labels, F.col("prediction").cast("int") + 1)).drop("features", "probability", "rawPrediction")


def _with_label(rows: DataFrame, task: str, target: str, labels: Sequence[str]) -> DataFrame:
    """features and __label, a number, of prepared rows."""
    if task == "regression":
        label = F.col(target).cast("double")
    else:
        label = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target).cast("string")) - 1).cast("double")
    return rows.select("features", label.alias("__label"))


def train_one(train: DataFrame, name: str, task: str, features: Sequence[str], target: str, labels: Sequence[str], positive: str | None, prepared: Preprocessor, n: int, seed: int) -> Trained:
    """A model of the catalog, fitted on all rows. Boosting takes rows without drawing any, so equal rows are one row of their weight there."""
    rows, model = _with_label(prepared.transform(train), task, target, labels), build_model(name, task, n, seed)
    began = time.monotonic()
    if name == "boosted_trees":
        rows = rows.groupBy("features", "__label").agg(F.count("*").cast("double").alias("__weight"))
        rows = written(rows.repartition(train.sparkSession.sparkContext.defaultParallelism), "weighted")  # a few bytes a row: what was one file would be one task
        model = model.setWeightCol("__weight")
    model = model.fit(rows)
    kinds = {c: coarse_dtype(train.schema[c].dataType) for c in features}
    return Trained(name, task, tuple(features), target, tuple(labels), positive, prepared, model, time.monotonic() - began, kinds)


def train_all(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, task: str, names: Sequence[str] | None = None, seed: int = 42, most_classes: int = 1000) -> tuple[list[Trained], dict[str, str]]:
    """The models that could be trained and the errors of the others; an error if there is none. Fits are distributed, the loop has three steps at most."""
    names = list(names or CATALOG[task])
    if len(set(names)) < len(names):
        raise ValueError("a model is named twice")
    train = train.filter(F.col(target).isNotNull())
    labels, positive = [], None
    if task != "regression":
        labels = sorted(r[0] for r in train.select(F.col(target).cast("string")).distinct().limit(most_classes + 1).collect())
        if len(labels) > most_classes:
            raise ValueError(f"the target has over {most_classes} classes: it is no label")
        unseen = test.filter(F.col(target).isNotNull() & ~F.col(target).cast("string").isin(labels)).limit(1)
        if not unseen.isEmpty():
            raise ValueError("the test fold has a class that the train fold lacks")
        positive = metrics.positive_label(train, target) if task == "binary_classification" else None
    prepared, n = fit_preprocessor(train, features), train.count()
    done, failed = [], {}
    for name in names:
        try:
            done.append(train_one(train, name, task, features, target, labels, positive, prepared, n, seed))
        except Exception as error:  # one model's failure is a result
            failed[name] = f"{type(error).__name__}: {error}"[:500]
    if not done:
        raise RuntimeError(f"no model could be trained: {failed}")
    return done, failed


def predictions(models: Sequence[Trained], df: DataFrame, key: Sequence[str]) -> DataFrame:
    """model, the key, label, prediction, score: rows of all models in one table, evaluated together."""
    out = None
    for m in models:
        p = m.predict(df)
        score = F.col("score") if m.task != "regression" else F.lit(None).cast("double")
        part = p.select(F.lit(m.name).alias("model"), *key, F.col(m.target).alias("label"), "prediction", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def _scoring_seconds(model: Trained, df: DataFrame) -> float:
    """Seconds to score all rows of df, which are computed and not kept."""
    start = time.perf_counter()
    model.predict(df).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def evaluate(models: Sequence[Trained], df: DataFrame, key: Sequence[str], failed: dict[str, str] | None = None) -> DataFrame:
    """model, the metrics of the task, complexity, latency (seconds to score df) and training_seconds.

    With failed (what train_all gives) there is a column error, and a row for each model that could not be trained, without metrics.
    """
    first, pred = models[0], written(predictions(models, df, key), "predictions")  # each row is scored once for all metrics
    if first.task == "regression":
        out = metrics.regression_metrics(pred)
    else:
        out = metrics.classification_metrics(pred, first.labels, first.positive)
        if first.positive:
            out = out.join(metrics.roc_auc(pred, first.positive), "model", "left").join(metrics.average_precision(pred, first.positive), "model", "left")
    order = {m: i for i, m in enumerate(CATALOG[first.task])}
    facts = [(m.name, order[m.name], _scoring_seconds(m, df), float(m.seconds)) for m in models]
    known = df.sparkSession.createDataFrame(facts, "model string, complexity int, latency double, training_seconds double")
    out = out.join(known, "model")
    if failed is None:
        return out
    lost = df.sparkSession.createDataFrame([(m, order.get(m), e) for m, e in failed.items()], "model string, complexity int, error string")
    return out.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def append_runs(evaluated: DataFrame, settings: dict, path: str) -> None:
    """One row for each model in the run log: run_id, model, params, metrics without nulls, config_hash, and evaluated's other columns, such as its confusion.

    run_id is the hash of settings and model: a run is logged once, however often it is appended. A metric that is not finite is refused.
    """
    numbers = [f.name for f in evaluated.schema if isinstance(f.dataType, T.DoubleType)]
    others = [c for c in evaluated.columns if c not in (*numbers, "model")]
    params = F.create_map(*[F.lit(str(x)) for kv in sorted(settings.items()) for x in kv]) if settings else F.lit(None).cast("map<string,string>")
    measured = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]), F.array(*numbers)), lambda _, v: v.isNotNull())
    known = config_hash(settings)
    rows = evaluated.select(F.sha2(F.concat(F.lit(f"{known}|"), "model"), 256).alias("run_id"), "model", params.alias("params"), measured.alias("metrics"), F.lit(known).alias("config_hash"), *others)
    if not rows.filter(F.exists(F.map_values("metrics"), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).isEmpty():
        raise ValueError("a metric is not finite")
    append_once(rows, path, "run_id")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log, each run once."""
    return read_log(spark, path, "run_id")


def check_contract(model: Trained, df: DataFrame, key: Sequence[str]) -> None:
    """Raise FeatureError unless df has the model's features, with their types, and nothing else beside the key and the target."""
    extra = [c for c in df.columns if c not in (*model.features, *key, model.target)]
    if missing := [c for c in model.features if c not in df.columns]:
        raise FeatureError(f"missing features: {missing}")
    if extra:
        raise FeatureError(f"unknown features: {extra}")


def score_batch(model: Trained, df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scored rows, and rejected rows with the features that are of another type. Text is accepted where it can be read as the feature's type; nulls are allowed."""
    check_contract(model, df, key)
    bad, casts = [], {}
    for c in model.features:
        kind = {"int": "bigint", "float": "double", "bool": "boolean"}.get(model.feature_types[c])
        if kind and coarse_dtype(df.schema[c].dataType) == "string":
            casts[c] = F.col(c).try_cast(kind)
            bad.append(F.when(F.col(c).isNotNull() & casts[c].isNull(), F.lit(c)))
        elif kind and not is_numeric(df.schema[c].dataType):
            bad.append(F.when(F.col(c).isNotNull(), F.lit(c)))
    marked = df.withColumn("bad_features", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
    good = marked.filter(F.size("bad_features") == 0).drop("bad_features").withColumns(casts)
    return model.predict(good), marked.filter(F.size("bad_features") > 0).select(*key, "bad_features")


def model_score(model: Trained, df: DataFrame) -> Column:
    return F.col("score") if model.task != "regression" else F.col("prediction")


def permutation_importance(model: Trained, df: DataFrame, key: str, rows: int = 200, repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, importance: the loss of agreement with the label when the feature's values are shuffled among rows, mean of the repeats.

    The rows with the least seeded hash are taken (all of them with rows=None). A shuffle joins two global orders; all
    variants are one table that the model scores once.
    """
    base = normalise_missing(df).select(key, *model.features, model.target).withColumn("__h", seeded_order(F.col(key), seed))
    if rows:
        base = base.orderBy("__h", key).limit(rows)
    base = global_order(base, ["__h", key]).drop("__h", "total")
    variants = base.drop("rank").withColumn("variant", F.lit("")).withColumn("repeat", F.lit(0))
    for feature in model.features:
        for r in range(repeats):
            mixed = global_order(base.select(F.col(feature).alias("__v"), key), [seeded_order(F.col(key), seed + 1 + r), key]).select(F.col("rank"), "__v")
            part = base.join(mixed, "rank").withColumn(feature, F.col("__v")).drop("__v", "rank")
            variants = variants.unionByName(part.withColumn("variant", F.lit(feature)).withColumn("repeat", F.lit(r)))
    scored = model.predict(variants)
    if model.task == "regression":
        quality = -F.sqrt(F.avg((F.col(model.target) - F.col("prediction")) ** 2))
    else:
        quality = F.avg((F.col(model.target).cast("string") == F.col("prediction")).cast("int"))
    each = scored.groupBy("variant", "repeat").agg(quality.alias("q"))
    base_q = each.filter("variant = ''").select(F.col("q").alias("base"))
    return each.filter("variant <> ''").join(F.broadcast(base_q)).groupBy(F.col("variant").alias("feature")).agg(F.avg(F.col("base") - F.col("q")).alias("importance"))  # one row


def perturbation_attribution(model: Trained, df: DataFrame, key: str, background: dict) -> DataFrame:
    """key, feature, impact: the score less the score with the feature at its background value, for every row at once."""
    base = normalise_missing(df).select(key, *model.features)
    rows = base.withColumn("variant", F.explode(F.array(*[F.lit(x) for x in ("", *model.features)])))
    changed = {c: F.when(F.col("variant") == c, F.lit(background[c]).cast(base.schema[c].dataType)).otherwise(F.col(c)) for c in model.features}
    scored = model.predict(rows.withColumns(changed)).select(key, "variant", model_score(model, rows).alias("s"))
    whole = scored.filter("variant = ''").select(key, F.col("s").alias("whole"))
    return scored.filter("variant <> ''").join(whole, key).select(key, F.col("variant").alias("feature"), (F.col("whole") - F.col("s")).alias("impact"))


def linear_contributions(model: Trained, df: DataFrame, key: str, background: DataFrame) -> DataFrame:
    """key, feature, impact: coefficient by distance from the background's mean, for a linear model."""
    means = model.preprocessor.transform(background).select(vector_to_array("features").alias("x"))
    names, coefficients = model.preprocessor.names(), [float(c) for c in model.model.coefficients]
    mean = means.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    x = vector_to_array("features")
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(c) * (x[i] - mean[i])).alias("impact")) for i, (n, c) in enumerate(zip(names, coefficients, strict=True))])
    return model.preprocessor.transform(df).select(key, F.explode(parts).alias("p")).select(key, "p.feature", "p.impact")


def top_features(impacts: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """impacts with place: the k largest absolute impacts of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("impact")), "feature")
    return impacts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def strongest(parts: Column, k: int = 5) -> tuple[Column, Column]:
    """Of an array of (feature, impact): the k features that raise a score most and the k that lower it most, strongest first, by name where equal.

    Features without an impact, or with none known, are in neither list. A row's list has an item for each feature, so no rows are shuffled.
    """
    def best(sign: int) -> Column:
        some = F.filter(parts, lambda x: sign * x["impact"] > 0)
        ranked = F.array_sort(F.transform(some, lambda x: F.struct((-sign * x["impact"]).alias("o"), x["feature"].alias("feature"), x["impact"].alias("impact"))))
        return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["impact"].alias("impact")))

    return best(1), best(-1)


def local_features(impacts: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """key, positive, negative: the strongest features of each row of impacts (key, feature, impact)."""
    rows = impacts.groupBy(*key).agg(F.collect_list(F.struct("feature", "impact")).alias("parts"))  # an item for each feature
    positive, negative = strongest(F.col("parts"), k)
    return rows.select(*key, positive.alias("positive"), negative.alias("negative"))


def global_importance(impacts: DataFrame) -> DataFrame:
    return impacts.groupBy("feature").agg(F.avg(F.abs("impact")).alias("impact"))
