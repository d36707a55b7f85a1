"""Profiles, quality, framing, splits and sources on small frames with known answers."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwright.functions.columns import boolean_code, coarse_dtype, config_hash, decode_label, input_hash, percent_text, redact
from millwright.functions.prefix import global_order
from millwright.operators import framing, profile, quality, split
from millwright.operators.quality import Roles
from millwright.sources import tables

T0 = datetime(2024, 1, 1)


def hourly(n, step=3600):
    return [T0 + timedelta(seconds=step * i) for i in range(n)]


def test_profile_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "a"), (3, None, None)], "k int, x double, c string")
    assert profile.table_profile(df).first().asDict() == {"n_rows": 3, "n_columns": 3, "n_cells": 9, "missing_cells": 3, "missing_rate": 3 / 9}
    columns = {r["column"]: (r["missing"], r["n_distinct"], r["constant"]) for r in profile.column_profile(df).collect()}
    assert columns == {"k": (0, 3, False), "x": (2, 1, True), "c": (1, 1, True)}
    assert {r["column"]: r["n_distinct"] for r in profile.column_profile(df, exact=False).collect()} == {"k": 3, "x": 1, "c": 1}
    numbers = {r["column"]: (r["n"], r["median"], r["std"]) for r in profile.numeric_profile(df).collect()}
    assert numbers["x"] == (1, 1.0, 0.0) and numbers["k"][1] == 2.0
    assert profile.table_profile(df.filter("false")).first()["missing_rate"] == 0.0


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "k int, c string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_top_category_ratio_is_within_the_kept(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 2 + [("c",)], "c string")
    assert [(r.value, r.ratio) for r in profile.top_categories(df, ["c"], 2).orderBy("place").collect()] == [("a", 4 / 6), ("b", 2 / 6)]


def test_semantic_types(spark):
    rows = [(float(i), i * 1.5, f"m{i}", "LMH"[i % 3], T0, i % 2, "yes" if i % 2 else "No", "2024-01-01 00:00:00", i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "air_temp double, bar double, machine_id string, type string, ts timestamp_ntz, machine_failure int, flag string, at string, grade int")
    report = {r["column"]: r for r in profile.infer_schema(df).collect()}
    kinds = {c: r["semantic"] for c, r in report.items()}
    assert kinds == {
        "air_temp": "sensor_numeric", "bar": "sensor_numeric", "machine_id": "identifier_like", "type": "categorical", "ts": "datetime",
        "machine_failure": "boolean", "flag": "boolean", "at": "datetime", "grade": "categorical",
    }
    assert profile.candidates(profile.infer_schema(df), "target_score").first()["column"] == "machine_failure"
    assert report["machine_id"]["asset_score"] == 3


def test_constant_and_near_constant(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("constant"), (F.col("id") % 2).cast("double").alias("near"), F.col("id").cast("double").alias("fine"))
    found = {(r.check, r.column) for r in quality.quality_findings(df, Roles("id")).collect()}
    assert found == {("constant_sensor", "constant"), ("near_constant_sensor", "near")}


def test_identifiers_are_no_sensors_and_findings_have_messages(spark):
    far = F.when(F.col("k") % 5 == 0, F.col("k") * 1e9).otherwise(F.col("k") % 7)
    df = spark.range(400).select(F.col("id").alias("k")).select("k", far.alias("serial_id"), F.lit(3.0).alias("load"), (F.col("k") % 2).alias("unit_id"))
    near = df.withColumn("serial_id", F.col("k") * 1000)
    assert quality.identifier_columns(near, Roles("k")) == ["serial_id"]
    assert quality.identifier_columns(df, Roles("k")) == []
    found = {r["check"]: (r["column"], r["message"]) for r in quality.quality_findings(near, Roles("k")).collect()}
    assert found == {"constant_sensor": ("load", "readings never change: load")}
    assert ("outlier", "serial_id") in {(r["check"], r["column"]) for r in quality.quality_findings(df, Roles("k")).collect()}


def test_flatline_does_not_cross_assets(spark):
    rows = [(i, "ab"[i % 2], t, 5.0) for i, t in enumerate(hourly(12))]
    df = spark.createDataFrame(rows, "k int, asset string, ts timestamp_ntz, x double")
    assert quality.longest_flatline(df, Roles("k", asset="asset", ts="ts"), ["x"]).first()["longest"] == 6
    assert quality.longest_flatline(df, Roles("k", ts="ts"), ["x"]).first()["longest"] == 12
    holed = df.withColumn("x", F.when(F.col("k") != 6, F.col("x")))
    assert quality.longest_flatline(holed, Roles("k", ts="ts"), ["x"]).first()["longest"] == 6


def test_gaps_and_duplicate_timestamps(spark):
    at = [0, 1, 2, 2, 3, 98, 99]
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1.0) for i, s in enumerate(at)], "k int, ts timestamp_ntz, x double")
    roles = Roles("k", ts="ts")
    assert quality.duplicate_timestamps(df, roles).first()[0] == 1
    row = quality.sampling_gaps(df, roles).first()
    assert (row.n_gaps, row.median_gap, row.long_gaps) == (6, 1.0, 1)
    none = quality.sampling_gaps(df.limit(1), roles).first()
    assert (none.n_gaps, none.median_gap, none.long_gaps) == (0, None, None)


def test_outliers_imbalance_and_score(spark):
    values = [8.0, 9.0, 10.0, 11.0, 12.0] * 3 + [1000.0, -500.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double")
    assert quality.robust_outliers(df, ["x"]).first()["rate"] == pytest.approx(2 / 17)
    assets = spark.createDataFrame([("A",)] * 100 + [(c,) for c in "BCDE"], "asset string")
    assert quality.asset_imbalance(assets, "asset").first()["ratio"] == 100.0
    score = quality.health_score(quality.quality_findings(df, Roles("k"))).first()
    assert score["score"] == 85.0  # outliers 5, few samples 10
    single = spark.createDataFrame([(i, "x") for i in range(200)], "k int, t string")
    assert {(r.check, r.severity) for r in quality.quality_findings(single, Roles("k", target="t")).collect()} == {("target_imbalance", "error")}


@pytest.mark.parametrize(
    ("values", "kind", "task", "confidence"),
    [
        ([0, 1] * 20, "int", "binary_classification", 0.75), ([0] * 99 + [1], "int", "binary_classification", 0.70), ([0, 1, 2] * 10, "int", "multiclass_classification", 0.70),
        (["ok", "fail"] * 5, "string", "binary_classification", 0.75), ([float(i) for i in range(50)], "double", "regression", 0.75), ([1] * 9, "int", "single_class", 0.0), ([1], "int", "insufficient_target", 0.0),
        ([None, None], "int", "insufficient_target", 0.0), ([f"c{i}" for i in range(40)], "string", "multiclass_classification", 0.05),
    ],
)
def test_tasks(spark, values, kind, task, confidence):
    row = framing.recommend_task(spark.createDataFrame([(v,) for v in values], f"t {kind}"), "t").first()
    assert (row.task, row.confidence) == (task, confidence)


def test_leakage_rules(spark):
    rows = [(i, i % 2, i % 2, float(i % 2) * 3 + 1, float(i * 7 % 5), f"s{i}", 1, "x", T0) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, target int, leak int, scaled double, feature double, serial_id string, label int, failure_note string, other_date timestamp_ntz")
    report = framing.leakage_report(df, Roles("k", target="target", ts="k"))
    got = {r["column"]: (r.kind, r.severity) for r in report.collect()}
    assert got == {
        "leak": ("target_duplicate", "block"), "scaled": ("target_correlated", "block"), "serial_id": ("near_one_to_one_id", "block"), "label": ("label_derived_name", "block"),
        "failure_note": ("post_event_name", "warning"), "other_date": ("extra_datetime", "warning"),
    }
    assert framing.leakage_verdict(report).first().asDict() == {"verdict": "block", "excluded": ["label", "leak", "scaled", "serial_id"]}
    assert framing.training_exclusions(report, Roles("k", target="target", asset="a")) == ["a", "k", "label", "leak", "scaled", "serial_id"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_splits_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    lowest = sorted(sorted(range(60), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())[:12])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, "ABC"[i % 3], t, int(i % 5 < 3)) for i, t in enumerate(hourly(60))]
        df = spark.createDataFrame(rows, "k int, asset string, ts timestamp_ntz, y int").repartition(parts)
        roles = Roles("k", target="y", asset="asset", ts="ts")
        audit = {r.fold: r for r in split.split_audit(split.split_group_time(df, roles), roles).collect()}
        assert (audit["test"].n, audit["test"].early_assets) == (12, 0)
        held = split.split_group(df, roles).filter("fold = 'test'")
        assert held.select("asset").distinct().count() == 1 and held.count() == 20
        assert sorted(r.k for r in split.split_chronological(df, roles).filter("fold = 'test'").collect()) == list(range(48, 60))
        strata = {(r.y, r.fold): r["count"] for r in split.split_stratified(df, roles).groupBy("y", "fold").count().collect()}
        assert strata == {(0, "test"): 5, (0, "train"): 19, (1, "test"): 7, (1, "train"): 29}
        assert sorted(r.k for r in split.split_random(df, roles).filter("fold = 'test'").collect()) == lowest
        folds = {r.fold: r["count"] for r in split.split(df, roles, "group_time").groupBy("fold").count().collect()}
        assert folds == {"test": 12, "validation": 12, "train": 36}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_guards(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, None, 0), (4, "b", 0)], "k int, asset string, y int")
    for strategy, roles, plan in (
        ("group", Roles("k", asset="asset"), split.SplitPlan()), ("random", Roles("k"), split.SplitPlan(test=0.7, validation=0.5)), ("group", Roles("k", asset="nope"), split.SplitPlan()),
        ("stratified", Roles("k", target="y"), split.SplitPlan()),
    ):
        with pytest.raises(split.SplitError):
            split.split(df, roles, strategy, plan)
    with pytest.raises(split.SplitError):
        split.split(df.limit(2), Roles("k"), "random")
    assert split.choose_strategy(Roles("k", target="y"), True) == "stratified"


def test_single_row_assets_stay_in_train(spark):
    df = spark.createDataFrame([(i, f"a{i}", t) for i, t in enumerate(hourly(5))], "k int, asset string, ts timestamp_ntz")
    roles = Roles("k", asset="asset", ts="ts")
    assert split.split_group_time(df, roles).filter("fold = 'test'").count() == 0
    assert split.split(df, roles, "group_time", split.SplitPlan(validation=0.0)).filter("fold = 'test'").count() == 1  # falls back to time


def test_global_order_matches_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v"))
    got = {r.id: (r["rank"], r.run, r.total) for r in global_order(df, ["v", "id"], {"run": "v"}).collect()}
    total, want = 0, {}
    for n, (v, i) in enumerate(sorted((i * 37 % 101, i) for i in range(500)), 1):
        total += v
        want[i] = (n, total, 500)
    assert got == want


def test_columns(spark):
    df = spark.createDataFrame([("Yes", 1, 0.5), (" off", None, 0.25), ("maybe", 3, 1.0)], "w string, n int, r double")
    assert [r[0] for r in df.select(boolean_code(F.col("w"), df.schema["w"].dataType)).collect()] == [1.0, 0.0, None]
    assert [r[0] for r in df.select(percent_text(F.col("r"))).collect()] == ["50.0%", "25.0%", "100.0%"]
    assert df.select(input_hash(["w", "n"])).distinct().count() == 3
    assert df.select(decode_label(F.lit(1), ["a", "b"])).first()[0] == "b"
    assert redact(df, ["r", "w"]).columns == ["w", "r"]
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})
    assert [coarse_dtype(f.dataType) for f in df.schema] == ["string", "int", "float"]


def test_labelled_file_with_preamble(spark, tmp_path):
    path = tmp_path / "labelled.csv"
    path.write_text("A file of readings\nby someone\n\nclass,a,b\nneg,1,na\npos,2.5,3\n,1,2\nodd,1,2\nneg,1\n")
    good, bad = tables.read_labelled_csv(spark, str(path), ["class", "a", "b"], "class", {"neg": 0, "pos": 1})
    assert sorted(tuple(r) for r in good.fillna(-1.0).collect()) == [(0, 1.0, -1.0), (1, 2.5, 3.0)]
    assert sorted(r.reason for r in bad.collect()) == ["column count", "missing label", "unexpected label"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x,c\n1,2.5,NA\n2,,b\n")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, 2.5, None), (2, None, "b")]
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, str(tmp_path / "a.xls"))
    assert tables.check_limits(df, max_rows=1).first().asDict() == {"within": False, "n_columns": 3, "too_many_rows": True}
    assert tables.check_limits(df, max_columns=3).first()["within"]
    (tmp_path / "b.csv").write_text("k,x,c\n1,2.5,NA\n2,,b\n")
    files = tables.new_files(spark, str(tmp_path / "*.csv"))
    assert files.count() == 1 and tables.new_files(spark, str(tmp_path / "*.csv"), files).count() == 0
    train = spark.createDataFrame([(0, 1.0), (1, None)], "y int, x double")
    tables.write_prepared(train, train.limit(1), str(tmp_path / "prepared"))
    summary = {r.split: (r.n_rows, r.missing_cells) for r in tables.split_summary(spark.read.parquet(str(tmp_path / "prepared")), "y").collect()}
    assert summary == {"train": (2, 1), "test": (1, 0)}
    tables.check_same_schema(train, train, "y", (2, 2))
    with pytest.raises(tables.SourceError):
        tables.check_same_schema(train, train, "x")
    tables.write_reports(spark.createDataFrame([("m", float("inf"), [1, 2])], "model string, f1 double, cm array<int>"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).columns == ["cm", "model"]
    tables.write_scores_csv(spark.createDataFrame([(1, {"a": 0.5})], "k int, p map<string,double>"), str(tmp_path / "scores"))
    assert tables.read_scoring_csv(spark, str(tmp_path / "scores")).first()["p"] == '{"a":0.5}'
    catalog = spark.createDataFrame([("a", str(tmp_path / "a.csv"), "csv")], "name string, path string, fmt string")
    assert tables.load(spark, catalog, "a").count() == 2
    with pytest.raises(tables.SourceError):
        tables.load(spark, catalog, "a", max_rows=1)
    good, bad = tables.quarantine(spark, str(tmp_path / "a.csv"), df.schema)
    assert good.count() + bad.count() == 2


def test_split_keeps_train_where_validation_cannot_be_carved(spark):
    from millwright.operators import split
    from millwright.operators.quality import Roles

    rows = [(i, f"a{i % 2}", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, asset string, target long")
    folds, note = split.split_with_note(df, Roles(key="id", asset="asset", target="target"), "group")
    assert {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()} == {"train": 10, "test": 10} and "no validation fold" in note
    folds, note = split.split_with_note(df, Roles(key="id", asset="asset", target="target"), "stratified")
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {"train", "validation", "test"} and note is None


def test_cut_off_lines_behind_the_header_are_rejected(spark, tmp_path):
    from millwright.sources.tables import read_labelled_csv

    (tmp_path / "a.csv").write_text("About, this file\nno header yet\nclass,s1\npos,1.5\ncut\nneg,na\nother,2\npos\n")
    good, bad = read_labelled_csv(spark, str(tmp_path / "a.csv"), ["class", "s1"], "class", {"neg": 0, "pos": 1})
    assert sorted(map(tuple, good.collect()), key=str) == [(0, None), (1, 1.5)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("cut", "column count"), ("other,2", "unexpected label"), ("pos", "column count")]


def test_running_sums_within_a_key(spark):
    from pyspark.sql import functions as F

    from millwright.functions.prefix import running_within

    rows = [(k, float(v), v % 3) for k in ("x", "y", "z") for v in range(40)]
    out = running_within(spark.createDataFrame(rows, "k string, v double, n long"), "k", [F.desc("v")], {"s": "n"}).collect()
    assert all(r.s == sum(v % 3 for v in range(int(r.v), 40)) and r.s_all == 39 for r in out)


def test_malformed_csv_is_one_error_when_it_is_read(spark, tmp_path):
    schema = "k long, x double, c string"
    (tmp_path / "bad.csv").write_text('k,x,c\n1,2.5,"a, ""b"""\n2,1,b,more\n3,oops,c\n4\n5,1,' + "y" * 90 + "\n")
    for given in (schema, None):
        with pytest.raises(tables.SourceError, match="malformed lines: .*1 with too few fields, 1 with too many fields"):
            tables.read_table(spark, str(tmp_path / "bad.csv"), schema=given)
    assert tables.read_table(spark, str(tmp_path / "bad.csv"), schema=schema, check=False).columns == ["k", "x", "c"]
    good, bad = tables.quarantine(spark, str(tmp_path / "bad.csv"), spark.createDataFrame([], schema).schema, max_line=50)
    assert [tuple(r) for r in good.collect()] == [(1, 2.5, 'a, "b"')]
    assert {(r["reason"], r["width"]) for r in bad.collect()} == {("too many fields", 4), ("bad value", 3), ("too few fields", 1), ("line too long", 3)}
    (tmp_path / "good.csv").write_text("k,x,c\n1,2.5,a\n2,,b\n")
    assert tables.read_table(spark, str(tmp_path / "good.csv"), max_rows=2, max_columns=3, max_bytes=100).count() == 2
    for limit in ({"max_rows": 1}, {"max_columns": 2}, {"max_bytes": 3}):
        with pytest.raises(tables.SourceError, match="at most"):
            tables.read_table(spark, str(tmp_path / "good.csv"), **limit)


def test_parquet_limits_come_from_footers_alone(spark, tmp_path):
    path = tmp_path / "damaged.parquet"
    spark.range(5000).selectExpr("id", "id * 2 AS x").coalesce(1).write.parquet(str(tmp_path / "whole"))
    (part,) = (tmp_path / "whole").glob("part-*.parquet")
    data = bytearray(part.read_bytes())
    length = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - length] = b"\xff" * (len(data) - 12 - length)  # all pages; the footer stays
    path.write_bytes(bytes(data))
    row = tables.footers(spark, str(path)).first()
    assert (row["n_rows"], row["n_bytes"]) == (5000, len(data))
    for limit in ({"max_rows": 4999}, {"max_columns": 1}, {"max_bytes": 100}):
        with pytest.raises(tables.SourceError, match="at most"):
            tables.read_table(spark, str(path), **limit)
    with pytest.raises(Exception, match="(?i)parquet|page|header"):
        tables.read_table(spark, str(path), max_rows=5000).agg({"x": "sum"}).collect()
