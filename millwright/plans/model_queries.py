"""Queries over features, models, metrics, drift, anomalies and monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import redact_nested
from millwright.functions.prefix import shared_dir
from millwright.operators import anomaly, drift, features, ledger, metrics, models, monitor
from millwright.plans.data import EVENTS_SQL, LINE_SENSORS, SCORES_SQL, SPLIT_DATE, events, model_scores, rounded, table, windows

NUMBERS = ("value", "k")
_COMPLEXITY = {"a_noise": 0, "b_mixed": 1, "c_sharp": 2}


def _train(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return e.withColumn("failed", (F.col("event_type") == "error").cast("int")).withColumn("kind", F.when(F.col("event_id") % 23 != 0, F.col("event_type"))).drop("event_type", "ts")


def feature_baseline(spark, sf_dir):
    return rounded(features.feature_baseline(events(spark, sf_dir), ["value", "k", "event_type"]))


def impute_scale_encode(spark, sf_dir):
    """Scaled numbers and filled categories of each reading, fitted on the baseline window."""
    base, _ = windows(spark, sf_dir)
    fitted = features.fit_preprocessor(base, ["value", "k", "event_type"])
    out = fitted.impute(events(spark, sf_dir))
    return rounded(out.select("event_id", F.col("value__x").alias("value_scaled"), F.col("k__x").alias("k_scaled"), F.col("event_type__text").alias("event_type")))


def encoded_features(spark, sf_dir):
    """The feature vector of each reading as an array."""
    from pyspark.ml.functions import vector_to_array

    base, _ = windows(spark, sf_dir)
    out = features.fit_preprocessor(base, ["value", "event_type"]).transform(events(spark, sf_dir))
    x = vector_to_array("features")
    return rounded(out.select("event_id", x[0].alias("value_scaled"), F.aggregate(F.slice(x, 2, 100), F.lit(0.0), lambda s, v: s + v).alias("levels_set")))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(model_scores(spark, sf_dir), ["0", "1"])


def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(model_scores(spark, sf_dir), ["0", "1"], "1"))


def macro_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(model_scores(spark, sf_dir), ["0", "1"]))


def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(model_scores(spark, sf_dir), "1"))


def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(model_scores(spark, sf_dir), "1"))


def _regression(spark, sf_dir) -> DataFrame:
    """The price of a line, predicted by its quantity alone."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.lit("by_quantity").alias("model"), (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 1.5).alias("prediction"))


def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_regression(spark, sf_dir)))


def residual_interval(spark, sf_dir):
    return rounded(metrics.residual_interval(_regression(spark, sf_dir)))


def interval_coverage(spark, sf_dir):
    """How many lines are within prediction and interval."""
    pred = _regression(spark, sf_dir)
    out = metrics.with_interval(pred, metrics.residual_interval(pred, 0.8))
    return rounded(out.groupBy("model").agg(F.avg(F.col("label").between(F.col("lower"), F.col("upper")).cast("int")).alias("coverage")), places=4)


def _evaluated(spark, sf_dir) -> DataFrame:
    pred = model_scores(spark, sf_dir)
    out = metrics.classification_metrics(pred, ["0", "1"], "1").join(metrics.average_precision(pred, "1"), "model")
    order = spark.createDataFrame([(m, c, 0.5) for m, c in _COMPLEXITY.items()], "model string, complexity int, latency double")
    return out.join(order, "model")


def rank_models(spark, sf_dir):
    return rounded(metrics.rank_models(_evaluated(spark, sf_dir), "f1", 0.5).drop("latency").withColumn("place", F.col("place").cast("double")))


def compare_costs(spark, sf_dir):
    counts = metrics.confusion_matrix(model_scores(spark, sf_dir), ["0", "1"])
    return metrics.compare_costs(counts, "1", [(500.0, 10.0)])


def cost_grid(spark, sf_dir):
    counts = metrics.confusion_matrix(model_scores(spark, sf_dir), ["0", "1"])
    return metrics.compare_costs(counts, "1", [(1.0, 1.0), (5.0, 1.0), (50.0, 1.0), (500.0, 10.0)])


def cost_selection(spark, sf_dir):
    """The cheapest model beside the best one by F1, for three pairs of costs; a fourth model failed."""
    counts = metrics.confusion_matrix(model_scores(spark, sf_dir), ["0", "1"])
    ranked = metrics.rank_models(_evaluated(spark, sf_dir), "f1", 0.5)
    failed = spark.createDataFrame([("d_failed", "no convergence")], "model string, reason string")
    return metrics.cost_selection(counts, "1", ranked, [(1.0, 1.0), (1.0, 20.0), (500.0, 10.0)], failed)


def psi_numeric(spark, sf_dir):
    return rounded(drift.psi_numeric(*windows(spark, sf_dir), NUMBERS))


def psi_categorical(spark, sf_dir):
    return rounded(drift.psi_categorical(*windows(spark, sf_dir), ["event_type", "user_id"]).drop("new_categories"))


def new_category_rows(spark, sf_dir):
    """Pairs of hour and asset that only the production window has, and how often."""
    base, prod = (df.withColumn("pair", F.concat(F.hour("ts"), F.lit(":"), F.col("user_id"))) for df in windows(spark, sf_dir))
    return drift.new_category_rows(base, prod, ["pair", "event_type"])


def local_features(spark, sf_dir):
    """What raises and what lowers the sum of an order line's standardised numbers most: a linear score's own contributions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in LINE_SENSORS])
    facts = lines.agg(*[f(c).alias(f"{c}_{n}") for c in LINE_SENSORS for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")).alias("impact")) for c in LINE_SENSORS])
    positive, negative = models.strongest(parts, 2)
    out = lines.join(F.broadcast(facts)).select("l_orderkey", "l_linenumber", positive.alias("p"), negative.alias("n"))  # one row
    return rounded(out.select("l_orderkey", "l_linenumber", F.array_join("p.feature", ",").alias("positive"), F.array_join("n.feature", ",").alias("negative"), F.get("n", F.lit(0))["impact"].alias("lowest")))


def new_categories(spark, sf_dir):
    """Pairs of hour and type that only the production window has."""
    base, prod = (df.withColumn("pair", F.concat(F.hour("ts"), F.lit(":"), F.col("user_id") % 40)) for df in windows(spark, sf_dir))
    out = drift.psi_categorical(base, prod, ["pair"])
    return out.select("column", F.size("new_categories").alias("n_new"), F.array_join("new_categories", ",").alias("new_categories"))


def ks_two_sample(spark, sf_dir):
    return rounded(drift.ks_two_sample(*windows(spark, sf_dir), NUMBERS))


def moment_shift(spark, sf_dir):
    return rounded(drift.moment_shift(*windows(spark, sf_dir), NUMBERS))


def missing_shift(spark, sf_dir):
    return rounded(drift.missing_shift(*windows(spark, sf_dir), ["value", "k", "event_type"]))


def drift_report(spark, sf_dir):
    return rounded(drift.drift_report(*windows(spark, sf_dir), ["value", "k", "event_type"]).drop("new_categories"))


def robust_baseline(spark, sf_dir):
    return rounded(anomaly.fit_robust_baseline(windows(spark, sf_dir)[0], NUMBERS))


def _scored(spark, sf_dir) -> DataFrame:
    base, prod = windows(spark, sf_dir)
    return anomaly.robust_scores(prod, anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, NUMBERS)), NUMBERS, ["event_id"])


def robust_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("event_id", "robust_score"))


def top_deviating(spark, sf_dir):
    out = anomaly.top_deviating(_scored(spark, sf_dir), NUMBERS, 1)
    return rounded(out.select("event_id", F.col("top")[0]["column"].alias("column"), F.col("top")[0]["z"].alias("z"), F.col("top")[0]["value"].alias("value")))


def top_anomalies(spark, sf_dir):
    """The twenty strangest readings: the report's own limit."""
    return rounded(anomaly.top_anomalies(_scored(spark, sf_dir), "robust_score", ["event_id"]))


def anomaly_listing(spark, sf_dir):
    """The twenty strangest readings with what deviates, and how many are not listed."""
    out = anomaly.anomaly_listing(_scored(spark, sf_dir), "robust_score", ["event_id"], NUMBERS, 20, 2)
    return rounded(out.select("event_id", "robust_score", F.array_join(F.col("top.column"), ",").alias("deviating"), F.round(F.col("top")[0]["z"], 6).alias("z"), "rows_omitted"))


def combined_scores(spark, sf_dir):
    """Robust and value scores combined, flagged at the baseline's 0.98 quantile."""
    base, prod = windows(spark, sf_dir)
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, NUMBERS))
    both = [anomaly.robust_scores(df, stats, NUMBERS, ["event_id"]).withColumn("k_score", F.abs(F.col("z")[1])) for df in (base, prod)]
    combiner = anomaly.fit_combiner(both[0], ["robust_score", "k_score"], 0.02)
    return rounded(anomaly.combined_score(both[1], combiner).select("event_id", "combined_score", "flagged"))


def anomaly_summary(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("flagged", F.col("robust_score") > 3.0)
    return rounded(anomaly.anomaly_summary(scored, NUMBERS).drop("features"))


def isolation_scores(spark, sf_dir):
    """Isolation scores of production readings against the baseline's forest."""
    base, prod = windows(spark, sf_dir)
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, NUMBERS))
    forest = anomaly.fit_isolation_forest(base, stats, NUMBERS, "event_id", trees=50)
    return rounded(anomaly.isolation_scores(prod, forest, stats, NUMBERS, ["event_id"]))


def isolation_sample(spark, sf_dir):
    """What each tree of the baseline's forest grows from: its rows' number, greatest rank and sum of keys."""
    base, _ = windows(spark, sf_dir)
    return anomaly.tree_sample(base.select("event_id"), "event_id", trees=50).groupBy("tree").agg(F.count("*").alias("n"), F.max("rank").alias("greatest"), F.sum("event_id").alias("keys"))


def retraining_recommendation(spark, sf_dir):
    """Triggers by the worst drift of the readings and the change of their anomaly rate."""
    run = monitoring_run(spark, sf_dir)
    facts = run.select(
        F.col("severity").alias("drift_severity"), F.lit(0.05).alias("metric_drop"), F.round(F.col("prod_rate") - F.col("base_rate"), 6).alias("anomaly_jump"),
        F.lit(29).alias("days_since"), F.lit(None).cast("boolean").alias("due"), F.lit(False).alias("manual"),
    )
    return monitor.retraining_recommendation(facts).select("trigger", "fired")


def monitoring_run(spark, sf_dir):
    base, prod = windows(spark, sf_dir)
    return rounded(monitor.monitoring_run(base, prod, ["value", "k", "event_type"], ["event_id"], list(NUMBERS)).drop("reasons"))


def monitoring_log(spark, sf_dir):
    """The full run over both windows with a monitor that was fitted to the baseline, stored and loaded; its append is tried twice."""
    base, prod = windows(spark, sf_dir)
    path = f"{shared_dir(spark)}/millwright/monitor-{uuid.uuid4().hex[:12]}"
    monitor.fit_monitor(base, NUMBERS, "event_id", f"{path}/fitted", trees=50)
    fitted = monitor.load_monitor(spark, f"{path}/fitted")
    row = monitor.full_run(fitted, base, prod, ["value", "k", "event_type"], ["event_id"], f"{path}/log", {"window": SPLIT_DATE})
    ledger.append_once(row, f"{path}/log", "run_id")
    log = ledger.read_log(spark, f"{path}/log", "run_id")
    share = lambda c: F.col(c).between(0, 1)
    near = (F.abs(F.col("base_combined_rate") - 0.05) < 0.01).alias("base_combined_near")
    return rounded(log.select("base_rows", "prod_rows", "base_robust_rate", "prod_robust_rate", "severity", "retrain", near, (share("base_isolation_rate") & share("prod_isolation_rate") & share("prod_combined_rate")).alias("shares")))


def run_log(spark, sf_dir):
    """Runs of three models under two settings, the second ones with their confusion; all appends are tried twice."""
    path = f"{shared_dir(spark)}/millwright/runs-{uuid.uuid4().hex[:12]}"
    pred = model_scores(spark, sf_dir)
    measured = metrics.classification_metrics(pred, ["0", "1"], "1").select("model", "precision", "recall", "f1")
    for _ in range(2):
        models.append_runs(measured, {"seed": 1}, path)
        models.append_runs(measured.drop("precision").join(metrics.confusion_lists(pred, ["0", "1"]), "model"), {"seed": 2}, path)
    log = models.read_runs(spark, path)
    metric = lambda m: F.try_element_at("metrics", F.lit(m)).alias(m)
    hits = F.filter("confusion", lambda c: (c["label"] == "1") & (c["prediction"] == "1"))[0]["n"].alias("hits")
    return rounded(log.select("model", F.element_at("params", "seed").alias("seed"), metric("precision"), metric("recall"), metric("f1"), F.size("metrics").alias("n_metrics"), hits))


def redacted_reports(spark, sf_dir):
    """A nested report of each user's readings without comments and raw values, as JSON."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    finding = F.struct(F.col("event_type").alias("kind"), "n", F.concat(F.lit("seen by "), "user_id").alias("comment"), F.struct("k", F.lit("x").alias("value")).alias("detail"))
    report = e.groupBy("user_id").agg(F.array_sort(F.collect_list(finding)).alias("findings"))  # one for each kind of event
    report = report.select("user_id", F.struct("user_id", F.lit("text").alias("comment"), "findings").alias("report"), F.lit("y").alias("value"))
    return redact_nested(report, ["comment", "value"]).select("user_id", F.to_json("report").alias("report"))


def _folds(spark, sf_dir):
    rows = _train(spark, sf_dir)
    cut = F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0
    return rows.filter(~cut), rows.filter(cut)


def _fitted(spark, sf_dir):
    train, test = _folds(spark, sf_dir)
    done, _ = models.train_all(train, test, ["value", "k", "kind"], "failed", "binary_classification", ["logistic_regression"])
    return done, train, test


def train_catalog(spark, sf_dir):
    """Metrics of all models of the catalog on held-out readings; a model that could not be trained has its error instead."""
    train, test = _folds(spark, sf_dir)
    done, failed = models.train_all(train, test, ["value", "k", "kind"], "failed", "binary_classification")
    return rounded(models.evaluate(done, test, ["event_id"], failed).drop("latency", "training_seconds"))


def score_batch(spark, sf_dir):
    """Scores of readings whose k comes as text, some of which is not a number."""
    done, _, test = _fitted(spark, sf_dir)
    raw = test.select("event_id", "value", F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("k").cast("string")).alias("k"), "kind")
    good, bad = models.score_batch(done[0], raw, ["event_id"])
    good = good.select("event_id", "prediction", "score", F.lit(None).cast("string").alias("rejected"))
    return rounded(good.unionByName(bad.select("event_id", F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("double").alias("score"), F.array_join("bad_features", ",").alias("rejected"))))


def permutation_importance(spark, sf_dir):
    """On 200 rows with the least hash, as an explanation's sample is documented."""
    done, _, test = _fitted(spark, sf_dir)
    return rounded(models.permutation_importance(done[0], test, "event_id", repeats=2))


def perturbation_attribution(spark, sf_dir):
    done, train, test = _fitted(spark, sf_dir)
    background = features.feature_baseline(train, ["value", "k", "kind"]).first().asDict()
    return rounded(models.perturbation_attribution(done[0], test, "event_id", background))


def linear_contributions(spark, sf_dir):
    done, train, test = _fitted(spark, sf_dir)
    return rounded(models.linear_contributions(done[0], test, "event_id", train))


def global_importance(spark, sf_dir):
    done, train, test = _fitted(spark, sf_dir)
    return rounded(models.top_features(models.global_importance(models.linear_contributions(done[0], test, "event_id", train)), 3))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_E = f"e AS ({EVENTS_SQL}), b AS (SELECT * FROM e WHERE ts < TIMESTAMP '{SPLIT_DATE}'), p AS (SELECT * FROM e WHERE ts >= TIMESTAMP '{SPLIT_DATE}')"
_S = f"s AS ({SCORES_SQL})"
_COUNTS = f"""WITH {_S}, c AS (SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM s GROUP BY model)"""
_PRF = "CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp}) END AS precision, CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn}) END AS recall, CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0 ELSE 2 * {tp} / (2 * {tp} + {fp} + {fn}) END AS f1"
_POS, _NEG = _PRF.format(tp="tp", fp="fp", fn="fn"), _PRF.format(tp="tn", fp="fn", fn="fp")
_AP = """SELECT model, sum(p * tp / seen) / sum(p) AS pr_auc FROM (SELECT model, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM (
SELECT model, score, count(*) AS n, sum(label) AS p FROM s GROUP BY model, score) WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model"""


def _fit(column: str) -> str:
    return f"""(SELECT {column}_m AS m, {column}_std AS std, quantile_cont(abs({column} - {column}_m), 0.5) AS mad FROM b,
(SELECT quantile_cont({column}::DOUBLE, 0.5) AS {column}_m, stddev_pop({column}) AS {column}_std FROM b) GROUP BY 1, 2)"""


_FITS = f", fv AS {_fit('value')}, fk AS {_fit('k')}"
_Z = "coalesce(({c} - {f}.m) / CASE WHEN {f}.mad > 0 THEN {f}.mad / 0.6745 ELSE {f}.std END, 0)"
_ZV, _ZK = _Z.format(c="value", f="fv"), _Z.format(c="k", f="fk")


def _psi(column: str) -> str:
    edges = ", ".join(str(i / 10) for i in range(11))
    return f"""SELECT '{column}' AS "column", CAST(k + 1 AS INTEGER) AS n_bins, CASE WHEN k >= 2 THEN sum((pp - bb) * ln(pp / bb)) END AS psi FROM (
SELECT k, (coalesce(nb, 0) + 1e-6::DOUBLE) / (tb + 1e-6::DOUBLE * (k + 1)) AS bb, (coalesce(np, 0) + 1e-6::DOUBLE) / (tp + 1e-6::DOUBLE * (k + 1)) AS pp FROM (
  SELECT k, unnest(range(0, k + 1)) AS bin, (SELECT count({column}) FROM b) AS tb, (SELECT count({column}) FROM p) AS tp FROM (SELECT len(x) AS k FROM (SELECT list_distinct(quantile_cont({column}::DOUBLE, [{edges}])) AS x FROM b)))
LEFT JOIN (SELECT bin, count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS np FROM (
  SELECT side, CASE WHEN v = list_max(x) THEN len(x) - 1 ELSE len(list_filter(x, lambda q: q <= v)) END AS bin FROM (
    SELECT 0 AS side, {column}::DOUBLE AS v FROM b UNION ALL SELECT 1, {column}::DOUBLE FROM p), (SELECT list_distinct(quantile_cont({column}::DOUBLE, [{edges}])) AS x FROM b) WHERE v IS NOT NULL) GROUP BY bin) USING (bin)) GROUP BY k"""


def _cat(column: str) -> str:
    return f"""SELECT '{column}' AS "column", sum((pp - bb) * ln(pp / bb)) AS psi, 0.5 * sum(abs(y / tp - x / tb)) AS total_variation FROM (
SELECT x, y, tb, tp, (x + 1e-6::DOUBLE) / (tb + 1e-6::DOUBLE * n) AS bb, (y + 1e-6::DOUBLE) / (tp + 1e-6::DOUBLE * n) AS pp FROM (
SELECT x::DOUBLE AS x, y::DOUBLE AS y, sum(x) OVER () AS tb, sum(y) OVER () AS tp, count(*) OVER () AS n FROM (
SELECT v, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM (SELECT {column} AS v, 0 AS side FROM b UNION ALL SELECT {column}, 1 FROM p) WHERE v IS NOT NULL GROUP BY v)))"""


def _ks(column: str) -> str:
    return f"""SELECT '{column}' AS "column", max(abs(f - g)) AS ks, any_value(nb) AS nb, any_value(np) AS np FROM (
SELECT sum(x) OVER w / sum(x) OVER () AS f, sum(y) OVER w / sum(y) OVER () AS g, sum(x) OVER () AS nb, sum(y) OVER () AS np FROM (
SELECT v, (count(*) FILTER (side = 0))::DOUBLE AS x, (count(*) FILTER (side = 1))::DOUBLE AS y FROM (SELECT {column} AS v, 0 AS side FROM b UNION ALL SELECT {column}, 1 FROM p) WHERE v IS NOT NULL GROUP BY v)
WINDOW w AS (ORDER BY v))"""


def _shift(column: str) -> str:
    return f"""SELECT '{column}' AS "column", (m1 - m0) / nullif(s0, 0) AS mean_shift, (s1 - s0) / nullif(s0, 0) AS std_shift FROM (SELECT avg({column}) AS m0, stddev_pop({column}) AS s0 FROM b), (SELECT avg({column}) AS m1, stddev_pop({column}) AS s1 FROM p)"""


def _missing(column: str) -> str:
    one = f"avg(CASE WHEN {column} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"SELECT '{column}' AS \"column\", (SELECT {one} FROM p) - (SELECT {one} FROM b) AS missing_shift"


_DRIFT = f"""WITH {_E}, d AS (SELECT m."column", psi, ks, NULL::DOUBLE AS total_variation, mean_shift, std_shift, missing_shift FROM ({_missing('value')} UNION ALL {_missing('k')}) m
JOIN ({_psi('value')} UNION ALL {_psi('k')}) USING ("column") JOIN ({_ks('value')} UNION ALL {_ks('k')}) USING ("column") JOIN ({_shift('value')} UNION ALL {_shift('k')}) USING ("column")
UNION ALL SELECT "column", psi, NULL, total_variation, NULL, NULL, missing_shift FROM ({_cat('event_type')}) JOIN ({_missing('event_type')}) USING ("column")),
r AS (SELECT *, greatest(CASE WHEN psi >= .25 THEN 2 WHEN psi >= .1 THEN 1 ELSE 0 END, CASE WHEN coalesce(ks, total_variation) >= .2 THEN 2 WHEN coalesce(ks, total_variation) >= .1 THEN 1 ELSE 0 END,
CASE WHEN abs(mean_shift) >= 1 THEN 2 WHEN abs(mean_shift) >= .5 THEN 1 ELSE 0 END, CASE WHEN abs(std_shift) >= 1 THEN 2 WHEN abs(std_shift) >= .5 THEN 1 ELSE 0 END,
CASE WHEN abs(missing_shift) >= .15 THEN 2 WHEN abs(missing_shift) >= .05 THEN 1 ELSE 0 END) AS rank FROM d)"""
_NAME = "CASE {r} WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
_RATE = "(SELECT count(*) AS {n}_rows, round(avg(CASE WHEN greatest(abs(" + _ZV + "), abs(" + _ZK + ")) > 3 THEN 1.0 ELSE 0.0 END), 6) AS {n}_rate FROM {s}, fv, fk)"
_RUN = _DRIFT + _FITS + f""", run AS (SELECT {_NAME.format(r='max(rank)')} AS severity, count(*) FILTER (rank = 0) AS n_low, count(*) FILTER (rank = 1) AS n_medium, count(*) FILTER (rank = 2) AS n_high FROM r),
w AS (SELECT * FROM run, {_RATE.format(n='base', s='b')}, {_RATE.format(n='prod', s='p')})"""
_REG = "(SELECT l_extendedprice / 1000 AS label, l_quantity * 1.5::DOUBLE AS prediction FROM lineitem)"


def _costs(pairs: str) -> str:
    return _COUNTS + f""" SELECT a AS fn_cost, z AS fp_cost, model, fn, fp, total_cost, CAST(row_number() OVER (PARTITION BY a, z ORDER BY total_cost, fn, fp, model) AS INTEGER) AS place FROM (
SELECT a, z, model, fn, fp, fn * a + fp * z AS total_cost FROM c, (VALUES {pairs}) v(a, z))"""


ORACLE_SQL = {
    "monitoring_log": _RUN + " SELECT base_rows, prod_rows, round(base_rate, 6) AS base_robust_rate, round(prod_rate, 6) AS prod_robust_rate, severity, severity = 'HIGH' OR prod_rate - base_rate >= 0.1 AS retrain, TRUE AS base_combined_near, TRUE AS shares FROM w",
    "run_log": _COUNTS + f""", m AS (SELECT model, {_POS} FROM c), h AS (SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS hits FROM ({SCORES_SQL}) GROUP BY model)
SELECT model, seed, CASE WHEN seed = '1' THEN round(precision, 6) END AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CASE WHEN seed = '1' THEN 3 ELSE 2 END AS n_metrics, CASE WHEN seed = '2' THEN hits END AS hits
FROM m JOIN h USING (model), (VALUES ('1'), ('2')) s(seed)""",
    "redacted_reports": f"""WITH {_E}, g AS (SELECT user_id, event_type, count(*) AS n, max(k) AS k FROM e GROUP BY 1, 2)
SELECT user_id, '{{"user_id":' || user_id || ',"findings":[' || string_agg('{{"kind":"' || event_type || '","n":' || n || ',"detail":{{"k":' || k || '}}}}', ',' ORDER BY event_type) || ']}}' AS report FROM g GROUP BY user_id""",
    "isolation_sample": f"""WITH b AS (SELECT event_id, md5(event_id || '|42') AS h FROM events WHERE ts < TIMESTAMP '{SPLIT_DATE}'), f AS (SELECT least(50, CAST(ceil(4 * 50 * 256 / greatest(1, count(*))) AS BIGINT)) AS few FROM b),
w AS (SELECT event_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS w0, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS w1, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS w2, unnest(range(few)) AS j FROM b, f),
r AS (SELECT (w0 + j) % 50 AS tree, (w1 + j * w2) % 4294967296 AS rank, event_id FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY rank, event_id) AS place FROM r)
SELECT CAST(tree AS INTEGER) AS tree, count(*) AS n, max(rank) AS greatest, CAST(sum(event_id) AS BIGINT) AS keys FROM t WHERE place <= 256 GROUP BY 1""",
    "feature_baseline": f"WITH {_E} SELECT round(quantile_cont(value, 0.5), 6) AS value, round(quantile_cont(k, 0.5), 6) AS k, (SELECT event_type FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS event_type FROM e",
    "impute_scale_encode": f"""WITH {_E}, f AS (SELECT quantile_cont(value, 0.5) AS vm, quantile_cont(k, 0.5) AS km FROM b), g AS (SELECT avg(coalesce(value, vm)) AS va, stddev_pop(coalesce(value, vm)) AS vs, avg(k) AS ka, stddev_pop(k) AS ks FROM b, f)
SELECT event_id, round((coalesce(value, vm) - va) / vs, 6) AS value_scaled, round((k - ka) / ks, 6) AS k_scaled, event_type FROM e, f, g""",
    "encoded_features": f"""WITH {_E}, f AS (SELECT quantile_cont(value, 0.5) AS vm FROM b), g AS (SELECT avg(coalesce(value, vm)) AS va, stddev_pop(coalesce(value, vm)) AS vs FROM b, f)
SELECT event_id, round((coalesce(value, vm) - va) / vs, 6) AS value_scaled, CASE WHEN event_type IN (SELECT event_type FROM b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS levels_set FROM e, f, g""",
    "confusion_matrix": f"WITH {_S} SELECT m.model, CAST(a.x AS VARCHAR) AS label, CAST(z.x AS VARCHAR) AS prediction, count(s.model) AS n FROM (SELECT DISTINCT model FROM s) m, (VALUES (0), (1)) a(x), (VALUES (0), (1)) z(x) LEFT JOIN s ON s.model = m.model AND s.label = a.x AND s.prediction = z.x GROUP BY ALL",
    "classification_metrics": _COUNTS + f" SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT model, {_POS} FROM c)",
    "macro_metrics": _COUNTS + f" SELECT model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM (SELECT model, {_POS} FROM c UNION ALL SELECT model, {_NEG} FROM c) GROUP BY model",
    "roc_auc": f"""WITH {_S} SELECT model, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)::DOUBLE), 6) AS roc_auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
SELECT model, score, sum(label) AS p, count(*) - sum(label) AS q FROM s GROUP BY model, score)) GROUP BY model""",
    "average_precision": f"WITH {_S} SELECT model, round(pr_auc, 6) AS pr_auc FROM ({_AP})",
    "regression_metrics": f"SELECT 'by_quantity' AS model, round(avg(abs(label - prediction)), 6) AS mae, round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse, round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) AS r2 FROM {_REG}",
    "residual_interval": f"SELECT 'by_quantity' AS model, round(quantile_cont(abs(label - prediction), 0.9), 6) AS half_width FROM {_REG}",
    "interval_coverage": f"SELECT 'by_quantity' AS model, round(avg(CASE WHEN label BETWEEN prediction - h AND prediction + h THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM {_REG}, (SELECT quantile_cont(abs(label - prediction), 0.8) AS h FROM {_REG})",
    "rank_models": _COUNTS + f""", r AS (SELECT model, {_POS}, CASE model WHEN 'a_noise' THEN 0 WHEN 'b_mixed' THEN 1 ELSE 2 END AS complexity FROM c)
SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc, complexity,
CASE WHEN recall >= 0.5 THEN CAST(row_number() OVER (PARTITION BY recall >= 0.5 ORDER BY f1 DESC, complexity, model) AS DOUBLE) END AS place FROM r JOIN ({_AP}) USING (model)""",
    "compare_costs": _costs("(500.0::DOUBLE, 10.0::DOUBLE)"),
    "cost_grid": _costs("(1.0::DOUBLE, 1.0::DOUBLE), (5.0, 1.0), (50.0, 1.0), (500.0, 10.0)"),
    "psi_numeric": f"WITH {_E}, x AS ({_psi('value')} UNION ALL {_psi('k')}) SELECT \"column\", n_bins, round(psi, 6) AS psi FROM x",
    "psi_categorical": f"WITH {_E}, x AS ({_cat('event_type')} UNION ALL {_cat('user_id')}) SELECT \"column\", round(psi, 6) AS psi, round(total_variation, 6) AS total_variation FROM x",
    "new_categories": f"""WITH {_E}, x AS (SELECT DISTINCT concat(hour(ts), ':', user_id % 40) AS pair FROM p EXCEPT SELECT concat(hour(ts), ':', user_id % 40) FROM b)
SELECT 'pair' AS "column", CAST(count(*) AS INTEGER) AS n_new, coalesce(string_agg(pair, ',' ORDER BY pair), '') AS new_categories FROM x""",
    "ks_two_sample": f"""WITH {_E}, x AS ({_ks('value')} UNION ALL {_ks('k')}), y AS (SELECT *, ks * sqrt(nb * np / (nb + np)) AS t FROM x)
SELECT "column", round(ks, 6) AS ks, round(CASE WHEN t < 0.2 THEN 1.0 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * j * j * t * t)) FROM range(1, 101) g(j)))) END, 6) AS p_value, CASE WHEN nb * np <= 10000 THEN 'exact' ELSE 'asymptotic' END AS method FROM y""",
    "moment_shift": f"WITH {_E}, x AS ({_shift('value')} UNION ALL {_shift('k')}) SELECT \"column\", round(mean_shift, 6) AS mean_shift, round(std_shift, 6) AS std_shift FROM x",
    "missing_shift": f"WITH {_E}, x AS ({_missing('value')} UNION ALL {_missing('k')} UNION ALL {_missing('event_type')}) SELECT \"column\", round(missing_shift, 6) AS missing_shift FROM x",
    "drift_report": _DRIFT + f""" SELECT "column", round(psi, 6) AS psi, round(ks, 6) AS ks, round(total_variation, 6) AS total_variation, round(mean_shift, 6) AS mean_shift, round(std_shift, 6) AS std_shift,
round(missing_shift, 6) AS missing_shift, {_NAME.format(r='rank')} AS severity FROM r""",
    "robust_baseline": f"WITH {_E}{_FITS} SELECT 'value' AS \"column\", round(m, 6) AS median, round(mad, 6) AS mad, round(std, 6) AS std FROM fv UNION ALL SELECT 'k', round(m, 6), round(mad, 6), round(std, 6) FROM fk",
    "robust_scores": f"WITH {_E}{_FITS} SELECT event_id, round(greatest(abs({_ZV}), abs({_ZK})), 6) AS robust_score FROM p, fv, fk",
    "top_deviating": f"""WITH {_E}{_FITS}, z AS (SELECT event_id, value, k, {_ZV} AS zv, {_ZK} AS zk FROM p, fv, fk)
SELECT event_id, CASE WHEN abs(zv) >= abs(zk) THEN 'value' ELSE 'k' END AS "column", round(CASE WHEN abs(zv) >= abs(zk) THEN zv ELSE zk END, 6) AS z, round(CASE WHEN abs(zv) >= abs(zk) THEN value ELSE k END, 6) AS value FROM z""",
    "top_anomalies": f"WITH {_E}{_FITS} SELECT event_id, round(greatest(abs({_ZV}), abs({_ZK})), 6) AS robust_score FROM p, fv, fk ORDER BY greatest(abs({_ZV}), abs({_ZK})) DESC, event_id LIMIT 20",
    "combined_scores": f"""WITH {_E}{_FITS}, s AS (SELECT event_id, ts < TIMESTAMP '{SPLIT_DATE}' AS base, greatest(abs({_ZV}), abs({_ZK})) AS r, abs({_ZK}) AS q FROM e, fv, fk),
m AS (SELECT quantile_cont(r, 0.5) AS rm, stddev_pop(r) AS rs, quantile_cont(q, 0.5) AS qm, stddev_pop(q) AS qs FROM s WHERE base), d AS (SELECT quantile_cont(abs(r - rm), 0.5) AS rd, quantile_cont(abs(q - qm), 0.5) AS qd FROM s, m WHERE base),
c AS (SELECT event_id, base, ((r - rm) / CASE WHEN rd > 0 THEN rd / 0.6745 WHEN rs > 0 THEN rs ELSE 1 END + (q - qm) / CASE WHEN qd > 0 THEN qd / 0.6745 WHEN qs > 0 THEN qs ELSE 1 END) / 2 AS c FROM s, m, d)
SELECT event_id, round(c, 6) AS combined_score, c > (SELECT quantile_cont(c, 0.98) FROM c WHERE base) AS flagged FROM c WHERE NOT base""",
    "anomaly_listing": f"""WITH {_E}{_FITS}, z AS (SELECT event_id, {_ZV} AS zv, {_ZK} AS zk FROM p, fv, fk) SELECT event_id, round(greatest(abs(zv), abs(zk)), 6) AS robust_score,
CASE WHEN abs(zv) >= abs(zk) THEN 'value,k' ELSE 'k,value' END AS deviating, round(CASE WHEN abs(zv) >= abs(zk) THEN zv ELSE zk END, 6) AS z, greatest((SELECT count(*) FROM p) - 20, 0) AS rows_omitted
FROM z ORDER BY greatest(abs(zv), abs(zk)) DESC, event_id LIMIT 20""",
    "new_category_rows": f"""WITH {_E}, x AS (SELECT ts, unnest([{{'column': 'pair', 'category': concat(hour(ts), ':', user_id)}}, {{'column': 'event_type', 'category': event_type}}]) AS c FROM e)
SELECT c."column" AS "column", c.category AS category, count(*) AS n FROM x WHERE c.category IS NOT NULL GROUP BY 1, 2 HAVING min(ts) >= TIMESTAMP '{SPLIT_DATE}'""",
    "local_features": f"""WITH m AS (SELECT {", ".join(f"avg({c}::DOUBLE) AS {c}_m, stddev_pop({c}::DOUBLE) AS {c}_s" for c in LINE_SENSORS)} FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, [{", ".join(f"{{'i': ({c}::DOUBLE - {c}_m) / {c}_s, 'f': '{c}'}}" for c in LINE_SENSORS)}] AS a FROM lineitem, m),
y AS (SELECT l_orderkey, l_linenumber, list_sort(list_transform(list_filter(a, lambda v: v.i > 0), lambda v: {{'o': -v.i, 'f': v.f}})) AS p, list_sort(list_transform(list_filter(a, lambda v: v.i < 0), lambda v: {{'o': v.i, 'f': v.f}})) AS n FROM x)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(p[1:2], lambda v: v.f), ',') AS positive, array_to_string(list_transform(n[1:2], lambda v: v.f), ',') AS negative, round(n[1].o, 6) AS lowest FROM y""",
    "anomaly_summary": f"WITH {_E}{_FITS} SELECT count(*) AS n_rows, count(*) FILTER (greatest(abs({_ZV}), abs({_ZK})) > 3) AS n_flagged, round(avg(CASE WHEN greatest(abs({_ZV}), abs({_ZK})) > 3 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p, fv, fk",
    "monitoring_run": _RUN + " SELECT *, severity = 'HIGH' OR prod_rate - base_rate >= 0.1 AS retrain FROM w",
    "retraining_recommendation": _RUN + """ SELECT t.trigger, t.fired FROM (SELECT unnest([{'trigger': 'high_drift', 'fired': severity = 'HIGH'}, {'trigger': 'metric_drop', 'fired': TRUE}, {'trigger': 'anomaly_jump', 'fired': round(prod_rate - base_rate, 6) >= 0.1},
{'trigger': 'schedule', 'fired': FALSE}, {'trigger': 'manual', 'fired': FALSE}]) AS t FROM w)""",
}
_PAIRS = "(1.0::DOUBLE, 1.0::DOUBLE), (1.0, 20.0), (500.0, 10.0)"
ORACLE_SQL["cost_selection"] = f"""WITH k AS ({_costs(_PAIRS)}), r AS (SELECT model FROM ({ORACLE_SQL["rank_models"]}) WHERE place = 1),
a AS (SELECT fn_cost, fp_cost, k.model, fn, fp, total_cost, place, TRUE AS available, NULL AS reason, place = 1 AS cost_best, r.model IS NOT NULL AS metric_best FROM k LEFT JOIN r ON r.model = k.model
  UNION ALL SELECT x, y, 'd_failed', NULL, NULL, NULL, NULL, FALSE, 'no convergence', FALSE, FALSE FROM (VALUES {_PAIRS}) p(x, y))
SELECT *, max(total_cost) FILTER (metric_best) OVER w - max(total_cost) FILTER (cost_best) OVER w AS saving FROM a WINDOW w AS (PARTITION BY fn_cost, fp_cost)"""

