"""Metrics, models, drift, anomalies, logs and streams on small frames with known answers."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millwright.operators import anomaly, drift, evallog, features, ledger, metrics, models, monitor
from millwright.operators.benchmark import benchmark
from millwright.operators.quality import Roles
from millwright.streaming import streams


def test_costs_of_the_published_confusions(spark):
    counts = {"boosted": (15609, 16, 97, 278), "forest": (15612, 13, 146, 229), "logistic": (15574, 51, 112, 263)}
    rows = [(m, a, p, n) for m, c in counts.items() for (a, p), n in zip([("0", "0"), ("0", "1"), ("1", "0"), ("1", "1")], c, strict=True)]
    out = metrics.compare_costs(spark.createDataFrame(rows, "model string, label string, prediction string, n long"), "1", [(500.0, 10.0)]).orderBy("place").collect()
    assert [(r.model, r.total_cost) for r in out] == [("boosted", 48660.0), ("logistic", 56510.0), ("forest", 73130.0)]


def test_metrics_with_ties_and_one_class(spark):
    rows = [("m", 1, 1, 0.9), ("m", 0, 1, 0.9), ("m", 1, 0, 0.4), ("m", 0, 0, 0.1), ("one", 1, 1, 0.5)]
    pred = spark.createDataFrame(rows, "model string, label int, prediction int, score double")
    auc = dict(metrics.roc_auc(pred, "1").collect())
    assert auc == {"m": 0.625, "one": None}
    assert dict(metrics.average_precision(pred, "1").collect())["m"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    prf = {r.model: (r.precision, r.recall, r.f1) for r in metrics.classification_metrics(pred, ["0", "1"], "1").collect()}
    assert prf == {"m": (0.5, 0.5, 0.5), "one": (1.0, 1.0, 1.0)}
    macro = {r.model: r.f1 for r in metrics.classification_metrics(pred, ["0", "1"]).collect()}
    assert macro == {"m": 0.5, "one": 0.5}  # a class without rows counts 0


def test_ranking(spark):
    rows = [("a", 0.9, 0.5, 0, 1.0), ("b", 0.7, 0.9, 1, 1.0), ("c", 0.7, 0.85, 0, 2.0), ("d", 0.6, None, 0, 0.1)]
    out = metrics.rank_models(spark.createDataFrame(rows, "model string, f1 double, recall double, complexity int, latency double"), "f1", 0.8)
    assert {r.model: r.place for r in out.collect()} == {"a": None, "b": 2, "c": 1, "d": 3}
    assert metrics.primary_metric("binary_classification", 0.05) == "pr_auc" and metrics.primary_metric("binary_classification", 0.05, False) == "f1"
    with pytest.raises(ValueError):
        metrics.validate_plan("regression", "f1", 1)


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    return spark.range(240).select(
        n.alias("key"), (n % 2 * 3 + (n * 37 % 11) / 5.0).alias("num"), F.element_at(F.array(*map(F.lit, "abc")), (n % 3 + 1).cast("int")).alias("cat"),
        (n % 4 == 0).alias("flag"), (n % 2).cast("int").alias("target"),
    )


def test_preprocessor_fits_train_only(spark, table):
    fitted = features.fit_preprocessor(table, ["num", "cat", "flag"])
    odd = spark.createDataFrame([(1, None, "unseen", None)], "key long, num double, cat string, flag boolean")
    assert fitted.transform(odd).first()["features"].toArray().tolist()[2:] == [0.0, 0.0, 0.0]
    assert fitted.names() == ["num", "flag", "cat=a", "cat=b", "cat=c"]
    assert features.resolve_features(table.withColumn("serial", F.col("key").cast("string")), "target", ["key"]) == ["num", "cat", "flag"]
    with pytest.raises(features.FeatureError):
        features.resolve_features(table.select("key", "target"), "target", ["key"])


def test_training_scoring_and_explanation(spark, table, tmp_path):
    train, test = table.filter("key % 5 <> 0"), table.filter("key % 5 = 0")
    done, failed = models.train_all(train, test, ["num", "cat", "flag"], "target", "binary_classification", ["logistic_regression"])
    assert not failed and done[0].labels == ("0", "1")
    out = models.evaluate(done, test, ["key"])
    assert out.first()["roc_auc"] > 0.95
    for _ in range(2):  # the second append is a retry
        models.append_runs(out, {"seed": 42}, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    assert models.read_runs(spark, str(tmp_path / "runs")).first()["metrics"]["f1"] > 0.9
    with pytest.raises(ValueError, match="finite"):
        models.append_runs(out.withColumn("f1", F.lit(float("nan"))), {"seed": 43}, str(tmp_path / "runs"))
    raw = test.select("key", F.when(F.col("key") == 5, "bad").otherwise(F.col("num").cast("string")).alias("num"), "cat", "flag")
    good, bad = models.score_batch(done[0], raw, ["key"])
    assert [tuple(r) for r in bad.collect()] == [(5, ["num"])] and good.count() == test.count() - 1
    with pytest.raises(features.FeatureError):
        models.score_batch(done[0], raw.drop("cat"), ["key"])
    with pytest.raises(features.FeatureError):
        models.score_batch(done[0], raw.withColumn("more", F.lit(1)), ["key"])
    background = features.feature_baseline(train, ["num", "cat", "flag"]).first().asDict()
    impact = models.global_importance(models.perturbation_attribution(done[0], test, "key", background))
    assert models.top_features(impact, 1).first()["feature"] == "num"
    linear = models.linear_contributions(done[0], test, "key", train)
    assert linear.count() == test.count() * 5
    importance = models.permutation_importance(done[0], test, "key", repeats=1)
    assert importance.orderBy(F.desc("importance")).first()["feature"] == "num"


def test_benchmark_run(spark, table, tmp_path):
    rows = table.select("target", "key", "num", "cat", F.when(F.col("key") % 9 != 0, F.col("num")).alias("holed"))
    reports = benchmark(rows.filter("key % 4 > 0"), rows.filter("key % 4 = 0"), Roles("key", target="target"), names=["logistic_regression"], path=str(tmp_path))
    assert reports["ranking"].first()["place"] == 1 and reports["costs"].first()["total_cost"] >= 0
    assert {r.split: r.n_rows for r in reports["summary"].collect()} == {"train": 180, "test": 60}
    assert spark.read.json(str(tmp_path / "task/json")).first()["task"] == "binary_classification"


def test_one_failed_model_does_not_stop_the_others(spark, table):
    done, failed = models.train_all(table, table, ["num"], "target", "binary_classification", ["logistic_regression", "unknown"])
    assert [m.name for m in done] == ["logistic_regression"] and "unknown" in failed
    with pytest.raises(ValueError):
        models.train_all(table.filter("target = 0"), table, ["num"], "target", "binary_classification")


def test_regression_interval(spark):
    pred = spark.createDataFrame([("m", float(i), float(i) + (i % 3 - 1)) for i in range(30)], "model string, label double, prediction double")
    assert metrics.regression_metrics(pred).first()["mae"] == pytest.approx(2 / 3)
    wide = metrics.with_interval(pred, metrics.residual_interval(pred))
    assert wide.filter("label between lower and upper").count() == 30


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"key int, a {kind}")


def test_drift_severities(spark):
    import random

    rng = random.Random(1)
    base, mild, far = ([rng.gauss(m, 1) for _ in range(400)] for m in (0, 0.3, 3))
    same = drift.drift_report(frame(spark, base), frame(spark, base), ["a"]).first()
    assert (same.severity, same.psi, same.ks) == ("LOW", pytest.approx(0), 0.0)
    some = drift.drift_report(frame(spark, base), frame(spark, mild), ["a"]).first()
    high = drift.drift_report(frame(spark, base), frame(spark, far), ["a"]).first()
    assert high.severity == "HIGH" and high.psi > some.psi
    moved = drift.drift_report(frame(spark, [5.0] * 50), frame(spark, [7.0] * 50), ["a"]).first()
    assert (moved.psi, moved.mean_shift, moved.ks, moved.severity) == (None, None, 1.0, "HIGH")
    gone = drift.drift_report(frame(spark, [1.0, 2.0] * 50), frame(spark, [1.0, None] * 50), ["a"]).first()
    assert gone.missing_shift == 0.5 and gone.severity == "HIGH"
    outside = drift.psi_numeric(frame(spark, [0.0, 1.0] * 20), frame(spark, [10.0, 20.0] * 20), ["a"]).first()["psi"]
    assert 0 < outside < 100


def test_category_drift(spark):
    base = frame(spark, ["a"] * 40 + ["b"] * 40 + ["c"] * 20, "string")
    prod = frame(spark, ["a"] * 20 + ["b"] * 30 + ["c"] * 10 + ["new"] * 40, "string")
    row = drift.psi_categorical(base, prod, ["a"]).first()
    assert row.total_variation == pytest.approx(0.4) and row.new_categories == ["new"]
    assert drift.overall_severity(drift.drift_report(base, prod, ["a"])).first()["severity"] == "HIGH"
    assert drift.align(base, prod.drop("a").withColumn("z", F.lit(1))) == (["key"], ["a"], ["z"])
    with pytest.raises(ValueError):
        drift.align(base, prod, ["nope"])


def test_anomalies(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(10, 3), 5.0, None) for i in range(200)]
    schema = "key int, a double, b double, flat double, gone double"
    base, columns = spark.createDataFrame(rows, schema), ["a", "b", "flat", "gone"]
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(base, columns))
    prod = spark.createDataFrame([(1, 0.0, 10.0, 5.0, None), (2, 50.0, 10.0, 9.0, 1.0), (3, None, float("inf"), 5.0, 2.0)], schema)
    scored = anomaly.robust_scores(prod, stats, columns, ["key"])
    scores = {r.key: r.robust_score for r in scored.collect()}
    assert scores[2] > 30 and scores[1] < 1 and scores[3] == 0.0
    top = anomaly.top_deviating(scored, columns, 2).filter("key = 2").first()["top"]
    assert (top[0]["column"], top[0]["value"]) == ("a", 50.0)
    assert anomaly.top_anomalies(scored, "robust_score", ["key"], 1).first()["key"] == 2
    forest = anomaly.fit_isolation_forest(base, stats, ["a", "b"], "key", trees=30)
    again = anomaly.fit_isolation_forest(base.repartition(7), stats, ["a", "b"], "key", trees=30)
    assert sorted(map(tuple, forest.collect())) == sorted(map(tuple, again.collect()))
    strange = {r.key: r.isolation_score for r in anomaly.isolation_scores(prod, forest, stats, ["a", "b"], ["key"]).collect()}
    assert max(strange, key=strange.get) == 2
    both = anomaly.robust_scores(base, stats, columns, ["key"]).join(anomaly.isolation_scores(base, forest, stats, ["a", "b"], ["key"]), "key")
    combiner = anomaly.fit_combiner(both, ["robust_score", "isolation_score"], contamination=0.05)
    summary = anomaly.anomaly_summary(anomaly.combined_score(both, combiner), columns).first()
    assert summary.n_flagged == 10 and summary.rate == 0.05
    with pytest.raises(ValueError):
        anomaly.fit_robust_baseline(base.limit(3), columns)


def test_retraining_triggers_at_their_thresholds(spark):
    facts = spark.createDataFrame([("MEDIUM", 0.05, 0.0999, 30, None, False)], "drift_severity string, metric_drop double, anomaly_jump double, days_since int, due boolean, manual boolean")
    assert monitor.recommendation(monitor.retraining_recommendation(facts)).first().asDict() == {"retrain": True, "reasons": ["metric_drop", "schedule"]}
    assert monitor.monitor_features(["a", "b", "c"], ["a", "b"], ["b", None], []) == ["a"]


def test_ledger(spark):
    log = spark.createDataFrame([("m", 1, "x"), ("m", 3, "y"), ("n", 2, "z"), ("m", 3, "yy")], "name string, at int, version string")
    assert {(r.name, r.version) for r in ledger.current_state(log, "name", "at", "version").collect()} == {("m", "yy"), ("n", "z")}
    assert ledger.state_intervals(log, "name", "at", "version").filter("is_current").count() == 2
    assert ledger.latest(log, "at", "version", {"name": "m"}, limit=0).count() == 1
    requests = spark.createDataFrame([("r1", 1), ("r2", 2)], "request_id string, version int")
    decisions = spark.createDataFrame(
        [("d1", "r1", "rejected", 1, " ", None, 1), ("d2", "r1", "approved", 1, None, None, 2), ("d3", "r1", "approved", 1, None, None, 3), ("d4", "r2", "approved", 1, None, None, 1), ("d5", "r9", "approved", 1, None, None, 1), ("d6", "r2", "modified", 2, "why", None, 2)],
        "decision_id string, request_id string, status string, expected_version int, reason string, payload string, decided_at int",
    )
    verdicts = {r.decision_id: r.verdict for r in ledger.first_valid_decision(requests, decisions).collect()}
    assert verdicts == {"d1": "invalid", "d2": "applied", "d3": "conflict", "d4": "conflict", "d5": "invalid", "d6": "invalid"}
    payload = '{"asset_id":"a","priority":"high","recommended_action":"stop","prediction_event_id":"p1"}'
    approvals = spark.createDataFrame(
        [("a1", "approved", payload, None), ("a2", "modified", "{}", payload), ("a3", "pending", payload, None), ("a4", "approved", "nonsense", None), ("a5", "approved", payload.replace("p1", "p9"), None), ("a6", "approved", payload[:-1] + ',"more":1}', None), ("a7", "approved", payload.replace('"high"', f'"{"h" * 40}"'), None), ("a1", "approved", payload, None)],
        "approval_id string, status string, payload string, decision_payload string",
    )
    predictions = spark.createDataFrame([("p1", "m1")], "prediction_event_id string, model_id string")
    good, bad = ledger.work_orders(approvals, predictions)
    assert sorted(r.approval_id for r in good.collect()) == ["a1", "a2"]
    assert {r.approval_id: r.reason for r in bad.collect()} == {"a4": "not an object", "a5": "unknown prediction", "a6": "unknown key", "a7": "too long priority"}
    assert ledger.work_orders(approvals, predictions, good)[0].count() == 0
    batch = spark.createDataFrame([(1, "p1", "false_alarm", "ann", None), (2, "p1", "odd", "ann", None), (3, "p1", "false_alarm", " ", None), (4, "p9", "false_alarm", "ann", "c" * 3000)], "feedback_id int, prediction_event_id string, outcome string, technician string, comment string")
    good, bad = ledger.feedback_intake(batch, predictions)
    assert good.first()["model_id"] == "m1" and {r.feedback_id: r.reason for r in bad.collect()} == {2: "unknown outcome", 3: "no technician", 4: "comment too long"}
    versions = spark.createDataFrame([("m", "10"), ("m", "9")], "name string, version string")
    assert [r.version for r in ledger.versions(versions, "m").collect()] == ["9", "10"]
    assert ledger.flat(spark.createDataFrame([(1, [("f", 0.5)])], "k int, top array<struct<feature:string,impact:double>>"), ["k"], "top").first().asDict() == {"k": 1, "place": 1, "feature": "f", "impact": 0.5}
    with pytest.raises(KeyError):
        ledger.report_for({}, "none", "k", 1)


def test_logs(spark, tmp_path):
    ledger.append(spark.createDataFrame([(1, "secret")], "k int, payload string"), str(tmp_path / "log"), ["k"])
    ledger.append(spark.createDataFrame([(2, "secret")], "k int, payload string"), str(tmp_path / "log"), ["k"])
    assert [r.k for r in spark.read.parquet(str(tmp_path / "log")).orderBy("k").collect()] == [1, 2]
    runs = spark.createDataFrame([("r1", "e", 2), ("r2", "e", 1)], "run_id string, experiment_id string, created_at int")
    experiments = spark.createDataFrame([("e", "r1")], "experiment_id string, recommended_run string")
    assert [(r.run_id, r.recommended) for r in ledger.experiment_runs(runs, experiments, "e").collect()] == [("r2", False), ("r1", True)]


def test_assistant_checks(spark):
    asks = ["Promote to production", "Create a WORK ORDER!", "Fix before deploy", "deployment status?", "retrain please", "Register it", "Deploy", "explain this", "Which model is best?", "why not accuracy", "show recall", "Any missing data?", "hello", None]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(asks)], "i int, t string").orderBy("i").select(evallog.route_intent(F.col("t"))).collect()]
    assert got == ["action_production_promotion", "action_work_order", "fix_before_deploy", "deployment_status", "action_train", "action_register", "action_deploy", "explain_prediction", "best_model", "why_not_accuracy", "experiment_results", "quality", "unknown", "unknown"]
    text = spark.createDataFrame([("F1 is 0.76, up +5% from x9 and -.5", "0.76 and +5% -.5", "no 1")], "a string, e string, n string")
    row = text.select(evallog.extract_numbers(F.col("a")), evallog.grounded(F.col("a"), F.col("e")), evallog.grounded(F.col("a"), F.col("n"))).first()
    assert tuple(row) == (["0.76", "+5%", "-.5"], True, False)
    cases = spark.createDataFrame(
        [
            (1, "F1 is 0.76\n\nEvidence:\n99", "best_model", "best_model", "t", "t", "answer", None, None, 1, False, [0.76], "lr", False), (2, "F1 is 0.5 lr", "best_model", "task", "t", "t", "answer", None, None, 1, False, [0.76], "lr", False),
            (3, "", "a", "a", None, None, "block", "not_executed", True, 0, False, None, None, False), (4, "It is not available", "a", "a", None, None, "answer", None, None, 0, True, None, None, False), (5, "9", "a", "b", None, "t", "answer", None, None, 0, False, None, None, True),
        ],
        "case_id int, answer string, expected_intent string, observed_intent string, expected_tool string, observed_tool string, safety string, action_status string, approval_required boolean, n_evidence int, unsupported_metric boolean, expected_numbers array<double>, expected_model string, na boolean",
    )
    pool = evallog.report_numbers(spark.createDataFrame([("lr", 0.76, True)], "model string, f1 double, ok boolean"))
    out = {r.case_id: r.failed_reasons for r in evallog.assess_cases(cases, pool).collect()}
    assert out == {1: ["model_missing"], 2: ["unsupported_number", "wrong_tool", "number_missing"], 3: [], 4: [], 5: []}


def test_stream_state_equals_batch(spark, tmp_path):
    for part, rows in enumerate([[("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)], [("b", 0, 4)]]):
        spark.createDataFrame(rows, "name string, at int, key int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    streams.drain(stream, "state", sink=streams.keyed_state(str(tmp_path / "out"), "name", "at", "key"))
    assert {(r.name, r.key) for r in streams.latest_state(spark, str(tmp_path / "out")).collect()} == {("a", 3), ("b", 2)}


def test_every_query_has_sql_or_is_listed():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    models_only = {"isolation_scores", "train_catalog", "score_batch", "permutation_importance", "perturbation_attribution", "linear_contributions", "global_importance"}
    assert {q for q in queries if q not in sql and not q.startswith("op") and q != "pipeline"} == models_only


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_exact_p_values_of_small_windows(spark):
    from itertools import combinations
    from math import comb

    def counted(n, m, ks):  # over all orders of n and m readings
        far = 0
        for own in combinations(range(n + m), n):
            i = j = 0
            best = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in own else (i, j + 1)
                best = max(best, abs(i / n - j / m))
            far += best >= ks - 1e-9
        return far / comb(n + m, n)

    for n, m in ((1, 1), (3, 4), (5, 5), (2, 7)):
        for k in range(n * m + 1):
            assert abs(drift.exact_p_value(n, m, k / (n * m)) - counted(n, m, k / (n * m))) < 1e-12
    assert abs(drift.exact_p_value(10, 10, 0.6) - 0.05244755244755244) < 1e-12
    base, prod = (spark.createDataFrame([(float(x),) for x in xs], "x double") for xs in (range(5), range(3, 8)))
    row = drift.ks_two_sample(base, prod, ["x"]).first()
    assert (row["method"], round(row["ks"], 6), round(row["p_value"], 6)) == ("exact", 0.6, round(drift.exact_p_value(5, 5, 0.6), 6))
    many = spark.range(200).selectExpr("CAST(id AS double) AS x")
    assert drift.ks_two_sample(many, many, ["x"]).first()["method"] == "asymptotic"


def test_nested_values_are_redacted_at_any_depth(spark):
    from millwright.functions.columns import redact_nested

    rows = [(1, "no", {"a": {"value": 1.0, "n": 2}}, [([{"Comment": "c", "n": 3}],)], {"value": "x", "kept": "y"}, (5,)), (2, None, None, [None, (None,)], None, None)]
    schema = "k int, comment string, m map<string,struct<value:double,n:int>>, a array<struct<inner:array<struct<Comment:string,n:int>>>>, t map<string,string>, s struct<value:int>"
    out = redact_nested(spark.createDataFrame(rows, schema), ["VALUE", "comment"])
    assert out.columns == ["k", "m", "a", "t"]
    first, second = (r.asDict(recursive=True) for r in out.orderBy("k").collect())
    assert first == {"k": 1, "m": {"a": {"n": 2}}, "a": [{"inner": [{"n": 3}]}], "t": {"kept": "y"}}
    assert second == {"k": 2, "m": None, "a": [None, {"inner": None}], "t": None}


def test_trees_sample_every_row_alike_and_do_not_depend_on_partitions(spark):
    rows = spark.range(6000).withColumnRenamed("id", "key")
    found = anomaly.tree_sample(rows.repartition(5), "key", trees=20, sample=64)
    sets = {}
    for r in found.collect():
        sets.setdefault(r["tree"], []).append((r["rank"], r["key"]))
    again = {(r["tree"], r["key"]) for r in anomaly.tree_sample(rows.coalesce(1), "key", trees=20, sample=64).collect()}
    assert again == {(t, k) for t, own in sets.items() for _, k in own}
    assert sorted(sets) == list(range(20)) and all(len(own) == 64 for own in sets.values())
    picked = [k for own in sets.values() for _, k in own]
    thirds = [sum(lo <= k < lo + 2000 for k in picked) for lo in (0, 2000, 4000)]
    assert all(abs(n - 20 * 64 / 3) < 100 for n in thirds)  # about six standard deviations
    small = anomaly.tree_sample(rows.limit(50), "key", trees=4, sample=64).groupBy("tree").count().collect()
    assert sorted(tuple(r) for r in small) == [(t, 50) for t in range(4)]  # few rows are in all trees
    assert anomaly.tree_sample(rows.limit(0), "key").count() == 0


def test_a_monitor_is_fitted_once_and_its_run_is_logged_once(spark, tmp_path):
    base = spark.range(400).select(F.col("id").alias("key"), F.sin("id").alias("a"), (F.col("id") % 17).cast("double").alias("b"))
    prod = base.withColumn("a", F.when(F.col("key") % 4 == 0, F.lit(40.0)).otherwise(F.col("a")))
    monitor.fit_monitor(base, ["a", "b"], "key", str(tmp_path / "fitted"), trees=20)
    fitted = monitor.load_monitor(spark, str(tmp_path / "fitted"))
    for _ in range(2):
        row = monitor.full_run(fitted, base, prod, ["a", "b"], ["key"], str(tmp_path / "log"), {"window": "w"}).first()
    assert abs(row["base_combined_rate"] - 0.05) < 0.02 and row["prod_combined_rate"] > 0.2 and row["prod_robust_rate"] == 0.25
    assert row["prod_isolation_rate"] > row["base_isolation_rate"] and row["retrain"]
    assert ledger.read_log(spark, str(tmp_path / "log"), "run_id").count() == spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_cost_best_beside_metric_best_and_failed_models(spark):
    counts = {"cheap": (90, 10, 1, 9), "sharp": (99, 1, 4, 6)}  # tn, fp, fn, tp
    rows = [(m, a, p, n) for m, c in counts.items() for (a, p), n in zip([("0", "0"), ("0", "1"), ("1", "0"), ("1", "1")], c, strict=True)]
    confusion = spark.createDataFrame(rows, "model string, label string, prediction string, n long")
    ranked = spark.createDataFrame([("sharp", 1), ("cheap", 2)], "model string, place int")
    failed = spark.createDataFrame([("lost", "no memory")], "model string, reason string")
    out = {(r.fn_cost, r.model): r for r in metrics.cost_selection(confusion, "1", ranked, [(100.0, 1.0), (1.0, 1.0)], failed).collect()}
    assert out[100.0, "cheap"].cost_best and out[100.0, "sharp"].metric_best and out[100.0, "sharp"].saving == 401.0 - 110.0
    assert out[1.0, "sharp"].cost_best and out[1.0, "sharp"].metric_best and out[1.0, "sharp"].saving == 0.0
    lost = out[1.0, "lost"]
    assert (lost.available, lost.reason, lost.place, lost.total_cost, lost.cost_best, lost.metric_best) == (False, "no memory", None, None, False, False)
    nobody = metrics.cost_selection(confusion, "1", ranked.limit(0)).first()
    assert nobody["saving"] is None
