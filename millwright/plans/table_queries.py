"""Queries over profiles, quality, framing and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.prefix import shared_dir
from millwright.operators import framing, profile, quality, split
from millwright.operators.quality import Roles
from millwright.plans.data import EVENT_ROLES, EVENTS_SQL, LINE_SENSORS, SPLIT_DATE, events, rounded, table, windows
from millwright.sources import tables

NO_TARGET = Roles(key="event_id", asset="user_id", ts="ts")
LINE_ROLES = Roles(key="line_key", target="is_returned", asset="l_suppkey", ts="l_shipdate")


def _lines(spark, sf_dir) -> DataFrame:
    """Lines with a key, the target is_returned and a copy of it that leaks, and a number of each order line."""
    line = table(spark, sf_dir, "lineitem")
    returned = (F.col("l_returnflag") == "R").cast("int")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.select(key.alias("line_key"), "l_suppkey", "l_shipdate", *LINE_SENSORS, "l_linestatus", returned.alias("is_returned"), (returned * 2).alias("outcome"), returned.alias("copy_of_it"))


_LINES_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS line_key, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
  CAST(l_returnflag = 'R' AS INTEGER) AS is_returned, CAST(l_returnflag = 'R' AS INTEGER) * 2 AS outcome, CAST(l_returnflag = 'R' AS INTEGER) AS copy_of_it
FROM lineitem"""

_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "k")


def _column_stats(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, count({c}) AS present FROM {source}" for c in columns
    )


def asset_health(spark, sf_dir):
    """Flagship: the quality of each user's readings."""
    return rounded(quality.asset_health(events(spark, sf_dir), NO_TARGET, "value", "event_type"))


def table_profile(spark, sf_dir):
    return rounded(profile.table_profile(events(spark, sf_dir)))


def column_profile(spark, sf_dir):
    return rounded(profile.column_profile(events(spark, sf_dir)))


def numeric_profile(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), LINE_SENSORS), places=4)


def profile_view(spark, sf_dir):
    return rounded(profile.profile_view(events(spark, sf_dir).drop("ts", "event_id")), places=4)


def top_categories(spark, sf_dir):
    return rounded(profile.top_categories(events(spark, sf_dir), ["event_type", "k"], 3))


def duplicate_rows(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return rounded(profile.duplicate_rows(e))


def schema_report(spark, sf_dir):
    return profile.infer_schema(events(spark, sf_dir))


def flatline_runs(spark, sf_dir):
    return quality.flatline_runs(events(spark, sf_dir), NO_TARGET, ["event_type"], "string").drop("column")


def longest_flatline(spark, sf_dir):
    return rounded(quality.longest_flatline(events(spark, sf_dir), NO_TARGET, ["value", "k"]))


def sampling_gaps(spark, sf_dir):
    return rounded(quality.sampling_gaps(events(spark, sf_dir), NO_TARGET))


def duplicate_timestamps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return quality.duplicate_timestamps(e, NO_TARGET)


def robust_outliers(spark, sf_dir):
    return rounded(quality.robust_outliers(events(spark, sf_dir), ["value", "k"]))


def split_summary(spark, sf_dir):
    """Shape and missing cells of the readings before and after the split date."""
    base, prod = windows(spark, sf_dir)
    both = split.split_by_source(base, prod).withColumnRenamed("fold", "split").withColumn("failed", (F.col("event_type") == "error").cast("int"))
    return rounded(tables.split_summary(both, "failed"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def file_footers(spark, sf_dir):
    """Rows and columns of every table by the footers of its files."""
    found = [tables.footers(spark, f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.sum("n_rows").alias("n_rows"), F.lit(len(table(spark, sf_dir, t).columns)).alias("n_columns")) for t in _TABLES]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def csv_reasons(spark, sf_dir):
    """Orders as lines of CSV files, some of them damaged: how many fit, and how many are rejected for each reason."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 13 == 0, "dear").otherwise(F.col("o_totalprice").cast("string"))
    fields = F.concat_ws(",", key.cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', "" '), "o_orderstatus", F.lit('"')), price)
    line = F.when(key % 19 == 0, F.rpad(fields, 300, "x")).when(key % 11 == 0, F.concat(fields, F.lit(",more"))).when(key % 17 == 0, key.cast("string")).otherwise(fields)
    path = f"{shared_dir(spark)}/millwright/csv-{uuid.uuid4().hex[:12]}"
    orders.select(line).write.text(path)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
    good, bad = tables.quarantine(spark, path, schema, max_line=250)
    rows = good.select(F.lit("fits").alias("reason"), "key", F.when(F.col("name").endswith("O"), "O").alias("status")).unionByName(bad.select("reason", F.lit(0).cast("long").alias("key"), F.lit(None).cast("string").alias("status")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.count("status").alias("n_open"))


def limits(spark, sf_dir):
    return tables.check_limits(events(spark, sf_dir), max_rows=500, max_columns=10)


def asset_imbalance(spark, sf_dir):
    return rounded(quality.asset_imbalance(table(spark, sf_dir, "lineitem"), "l_suppkey"))


def target_imbalance(spark, sf_dir):
    return rounded(quality.target_imbalance(events(spark, sf_dir), "event_type"))


def quality_findings(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("unit_state", F.lit(1))
    return rounded(quality.quality_findings(e, EVENT_ROLES))


def health_score(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("unit_state", F.lit(1))
    return rounded(quality.health_score(quality.quality_findings(e, EVENT_ROLES)))


def class_distribution(spark, sf_dir):
    return rounded(framing.class_distribution(table(spark, sf_dir, "embeddings"), "label"))


def recommend_task(spark, sf_dir):
    """The task for each of three targets."""
    parts = [("event_type", events(spark, sf_dir), "event_type"), ("is_returned", _lines(spark, sf_dir), "is_returned"), ("l_extendedprice", table(spark, sf_dir, "lineitem"), "l_extendedprice")]
    out = None
    for name, df, target in parts:
        part = framing.recommend_task(df, target).select(F.lit(name).alias("target"), "task", "trainable", "confidence", "n", "n_classes", "least_rate", "alternative")
        out = part if out is None else out.union(part)
    return rounded(out)


def task_evidence(spark, sf_dir):
    """Why each of four targets has its task; line numbers as prices could be ordinal labels."""
    quantity = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"))
    parts = [("event_type", events(spark, sf_dir), "event_type"), ("is_returned", _lines(spark, sf_dir), "is_returned"), ("l_extendedprice", table(spark, sf_dir, "lineitem"), "l_extendedprice"), ("l_quantity", quantity, "l_quantity")]
    out = None
    for name, df, target in parts:
        part = framing.task_evidence(df, target).select(F.lit(name).alias("target"), "place", "text")
        out = part if out is None else out.union(part)
    return out


def split_classes(spark, sf_dir):
    base, prod = windows(spark, sf_dir)
    return rounded(tables.split_classes(split.split_by_source(base, prod).withColumnRenamed("fold", "split"), "event_type"))


def leakage_stats(spark, sf_dir):
    return rounded(framing.leakage_stats(_lines(spark, sf_dir), "is_returned", ["l_quantity", "l_tax", "outcome", "copy_of_it", "l_linestatus"]))


def leakage_report(spark, sf_dir):
    lines = _lines(spark, sf_dir).drop("copy_of_it").withColumnRenamed("line_key", "line_no").withColumn("repair_cost", F.col("l_tax") * 2)
    report = framing.leakage_report(lines, Roles(key="l_orderkey_", target="is_returned", ts="l_shipdate"))
    return rounded(report.select("column", "kind", "severity", "unique_ratio"))


def _fold_query(function):
    def run(spark, sf_dir):
        return function(events(spark, sf_dir), NO_TARGET).select("event_id", "user_id", "fold")

    return run


split_group_time = _fold_query(split.split_group_time)
split_group = _fold_query(split.split_group)
split_chronological = _fold_query(split.split_chronological)
split_random = _fold_query(split.split_random)


def split_stratified(spark, sf_dir):
    return split.split_stratified(events(spark, sf_dir), EVENT_ROLES).select("event_id", "user_id", "fold")


def split_validation(spark, sf_dir):
    """Train, validation and test by asset and time."""
    return split.split(events(spark, sf_dir), NO_TARGET, "group_time").select("event_id", "user_id", "fold")


def split_audit(spark, sf_dir):
    return split.split_audit(split.split_group_time(events(spark, sf_dir), NO_TARGET), NO_TARGET)


QUERIES = {
    f.__name__ if f.__name__ != "run" else n: f
    for n, f in list(globals().items())
    if callable(f) and (getattr(f, "__module__", "") == __name__) and not n.startswith("_")
}

_E = f"e AS ({EVENTS_SQL})"
_GAPS = f"""WITH {_E}, g AS (SELECT date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM e),
p AS (SELECT gap FROM g WHERE gap IS NOT NULL), m AS (SELECT quantile_cont(gap, 0.5) AS median_gap, stddev_pop(gap) AS std FROM p)"""


def _runs(column: str) -> str:
    return f"""SELECT user_id AS asset, greatest(max(run), 1) AS longest, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT user_id, island, count({column}) AS run, count(*) AS n FROM (
    SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
      SELECT *, CASE WHEN {column} = lag({column}) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS starts FROM e))
  GROUP BY user_id, island) GROUP BY user_id"""


def _outliers(columns) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS "column", median, mad, avg(CASE WHEN 0.6745 * abs({c} - median) / mad > 3.5 THEN 1.0 ELSE 0.0 END) AS rate
FROM e, (SELECT median, quantile_cont(abs({c} - median), 0.5) AS mad FROM e, (SELECT quantile_cont({c}::DOUBLE, 0.5) AS median FROM e) GROUP BY median)
WHERE {c} IS NOT NULL AND mad > 0 GROUP BY median, mad""")
    return " UNION ALL ".join(parts)


def _folds(chosen: str, with_: str = "") -> str:
    return f"WITH {_E}{with_} SELECT event_id, user_id, CASE WHEN {chosen} THEN 'test' ELSE 'train' END AS fold FROM "


def _profile_sql(columns) -> str:
    return f"""WITH {_E}, s AS ({_column_stats("e", columns)}) SELECT "column", n_rows, missing, round(missing / n_rows, 6) AS missing_rate, n_distinct,
round(CASE WHEN present = 0 THEN 0 ELSE n_distinct / present END, 6) AS unique_ratio, n_distinct <= 1 AS "constant" FROM s"""


_TASKS = {"event_type": ("events", "event_type", False), "is_returned": (f"({_LINES_SQL})", "is_returned", True), "l_extendedprice": ("lineitem", "l_extendedprice", True)}


def _task_sql(name: str) -> str:
    source, column, numeric = _TASKS[name]
    spread = f"(SELECT stddev_samp({column}) AS std, avg({column}) AS mean FROM {source})" if numeric else "(SELECT NULL::DOUBLE AS std, NULL::DOUBLE AS mean)"
    return f"""SELECT '{name}' AS target, task, task NOT IN ('insufficient_target', 'single_class') AS trainable,
  round(greatest(0.05, least(0.95, CASE task
    WHEN 'binary_classification' THEN CASE WHEN rate < 0.005 THEN 0.55 WHEN rate < 0.05 THEN 0.70 WHEN rate < 0.40 THEN 0.85 ELSE 0.75 END
    WHEN 'regression' THEN CASE WHEN std = 0 THEN 0.30 ELSE 0.75 - CASE WHEN std / abs(mean) < 0.05 THEN 0.20 ELSE 0 END - CASE WHEN std / abs(mean) > 3 THEN 0.10 ELSE 0 END END
    ELSE 0.75 - 0.05 * greatest(0, n_classes - 2) - CASE WHEN rate < 0.02 THEN 0.10 ELSE 0 END END))::DOUBLE, 2) AS confidence,
  n, n_classes, round(rate, 6) AS least_rate, CASE WHEN task = 'regression' AND n_classes <= 100 THEN 'ordinal_multiclass' END AS alternative
FROM (SELECT *, CASE WHEN n < 2 THEN 'insufficient_target' WHEN n_classes <= 1 THEN 'single_class' WHEN n_classes = 2 THEN 'binary_classification'
  WHEN {str(numeric).upper()} AND n_classes > 30 THEN 'regression' ELSE 'multiclass_classification' END AS task FROM (
  SELECT count(*) AS n_classes, CAST(sum(c) AS BIGINT) AS n, min(c) / sum(c)::DOUBLE AS rate FROM (SELECT count(*) AS c FROM {source} GROUP BY {column})), {spread})"""


def _evidence_sql(name: str, source: str, column: str, numeric: bool) -> str:
    std = "stddev_samp(t::DOUBLE)" if numeric else "max(NULL::DOUBLE)"
    return f"""SELECT '{name}' AS target, place, text FROM (
  SELECT 1 AS place, n_classes || CASE WHEN continuous THEN ' different numbers' ELSE ' classes' END AS text FROM f_{name}
  UNION ALL SELECT 2, CASE WHEN continuous THEN 'standard deviation ' || printf('%.3f', std) ELSE 'smallest class ' || label || ' has ' || printf('%.1f', 100 * least / n) || ' %' END FROM f_{name}
  UNION ALL SELECT 3, 'the ' || n_classes || ' numbers may be ordinal labels' FROM f_{name} WHERE continuous AND n_classes <= 100)""".replace(
        f"f_{name}",
        f"""(SELECT *, {str(numeric).upper()} AND n_classes > 30 AS continuous FROM (SELECT count(*) AS n_classes, CAST(sum(c) AS DOUBLE) AS n, CAST(min(c) AS DOUBLE) AS least, arg_min(label, (c, label)) AS label FROM (
    SELECT CAST({column} AS VARCHAR) AS label, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})), (SELECT {std} AS std FROM (SELECT {column} AS t FROM {source})))""",
    )


_FINDINGS = f"""WITH e AS (SELECT *, 1 AS unit_state FROM ({EVENTS_SQL})),
cells AS (SELECT sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::DOUBLE / (count(*) * 7) AS rate, count(*) AS n FROM e),
c AS ({_column_stats("e", ["value", "k", "unit_state"])}), o AS ({_outliers(["value", "k"])}),
runs AS ({" UNION ALL ".join(f'''(SELECT '{c}' AS "column", longest, n_rows FROM ({_runs(c)}) ORDER BY longest DESC, asset LIMIT 1)''' for c in ("value", "k", "unit_state"))}),
g AS (SELECT date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM e),
m AS (SELECT quantile_cont(gap, 0.5) AS med, stddev_pop(gap) AS std FROM g), a AS (SELECT max(n) / quantile_cont(n, 0.5) AS ratio FROM (SELECT count(*) AS n FROM e GROUP BY user_id)),
t AS (SELECT max(n) / min(n)::DOUBLE AS ratio FROM (SELECT count(*) AS n FROM e GROUP BY event_type)),
f AS (
SELECT 'missing' AS "check", CASE WHEN rate > 0.2 THEN 'error' ELSE 'warning' END AS severity, NULL AS "column", rate AS value, CASE WHEN rate > 0.2 THEN 15.0 ELSE 5.0 END AS penalty FROM cells WHERE rate > 0.05
UNION ALL SELECT 'constant_sensor', 'warning', "column", n_distinct, 3.0 FROM c WHERE n_distinct <= 1
UNION ALL SELECT 'near_constant_sensor', 'warning', "column", n_distinct, 1.0 FROM c WHERE n_distinct > 1 AND n_distinct / present <= 0.001
UNION ALL SELECT 'outlier', 'warning', "column", rate, 5.0 FROM o WHERE rate > 0.10
UNION ALL SELECT 'flatline', 'warning', "column", longest, 3.0 FROM runs WHERE longest >= 10 AND longest / n_rows >= 0.05
UNION ALL SELECT 'duplicate_timestamps', 'warning', NULL, d, 2.0 FROM (SELECT count(*) - count(DISTINCT (user_id, ts)) AS d FROM e) WHERE d > 0
UNION ALL SELECT 'timestamp_gaps', 'warning', NULL, n, 3.0 FROM (SELECT count(*) AS n FROM g, m WHERE gap > 5 * med AND med > 0) WHERE n > 0
UNION ALL SELECT 'sampling_irregularity', 'warning', NULL, std / med, 2.0 FROM m WHERE med > 0 AND std / med > 1
UNION ALL SELECT 'asset_imbalance', 'warning', NULL, ratio, 3.0 FROM a WHERE ratio > 10
UNION ALL SELECT 'target_imbalance', 'warning', 'event_type', ratio, 5.0 FROM t WHERE ratio > 20
UNION ALL SELECT 'few_samples', 'error', NULL, n, 10.0 FROM cells WHERE n < 100)"""

_STATS = "SELECT '{c}' AS \"column\", avg(CASE WHEN CAST({c} AS VARCHAR) = CAST(is_returned AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS agreement, {r} AS correlation FROM l"
_CORR = "covar_pop({c}, is_returned) / nullif(stddev_pop({c}) * stddev_pop(is_returned), 0)"

ORACLE_SQL = {
    "asset_health": f"""
WITH {_E}, w AS (SELECT *, lag(ts) OVER p AS before, CASE WHEN event_type = lag(event_type) OVER p THEN 0 ELSE 1 END AS starts FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, date_sub('second', before, ts) AS gap, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM w),
one AS (SELECT user_id, count(*) AS n_rows, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(value, 0.5) AS m FROM i GROUP BY user_id),
two AS (SELECT user_id, CAST(count(*) FILTER (gap > 5 * median_gap) AS BIGINT) AS long_gaps, quantile_cont(abs(value - m), 0.5) AS mad FROM i JOIN one USING (user_id) GROUP BY user_id),
three AS (SELECT user_id, CASE WHEN mad > 0 THEN avg(CASE WHEN value IS NULL THEN NULL WHEN 0.6745 * abs(value - m) > 3.5 * mad THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS outlier_rate
  FROM i JOIN one USING (user_id) JOIN two USING (user_id) GROUP BY user_id, mad),
runs AS (SELECT user_id, greatest(max(run), 1) AS longest_flatline FROM (SELECT user_id, island, count(event_type) AS run FROM i GROUP BY user_id, island) GROUP BY user_id)
SELECT user_id AS asset, n_rows, round(missing_rate, 6) AS missing_rate, round(median_gap, 6) AS median_gap, long_gaps, round(outlier_rate, 6) AS outlier_rate, longest_flatline,
  (100 - CASE WHEN missing_rate > 0.2 THEN 15 WHEN missing_rate > 0.05 THEN 5 ELSE 0 END - CASE WHEN longest_flatline >= 10 AND longest_flatline / n_rows >= 0.05 THEN 3 ELSE 0 END
  - CASE WHEN long_gaps > 0 THEN 3 ELSE 0 END - CASE WHEN outlier_rate > 0.1 THEN 5 ELSE 0 END)::DOUBLE AS score
FROM one JOIN two USING (user_id) JOIN three USING (user_id) JOIN runs USING (user_id)""",
    "table_profile": f"""WITH {_E} SELECT count(*) AS n_rows, 6 AS n_columns, count(*) * 6 AS n_cells, count(*) - count(value) AS missing_cells,
round((count(*) - count(value)) / (count(*) * 6), 6) AS missing_rate FROM e""",
    "column_profile": _profile_sql(_EVENT_COLUMNS),
    "numeric_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std,
round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM lineitem"""
        for c in LINE_SENSORS
    ),
    "profile_view": f"""WITH {_E}, s AS ({_column_stats("e", ["user_id", "event_type", "value", "k"])}), q AS (
{" UNION ALL ".join(f'''SELECT '{c}' AS "column", min({c})::DOUBLE AS minimum, quantile_cont({c}, 0.5)::DOUBLE AS median, max({c})::DOUBLE AS maximum FROM e''' for c in ("user_id", "value", "k"))})
SELECT "column", round(missing / n_rows, 4) AS missing_rate, round(n_distinct / present, 4) AS unique_ratio, round(minimum, 4) AS minimum, round(median, 4) AS median, round(maximum, 4) AS maximum FROM s LEFT JOIN q USING ("column")""",
    "top_categories": f"""WITH {_E} SELECT 'event_type' AS "column", CAST(place AS INTEGER) AS place, value, n, round(n / sum(n) OVER (), 6) AS ratio FROM (
SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM e GROUP BY event_type) WHERE place <= 3""",
    "duplicate_rows": """SELECT count(*) AS n_rows, count(*) - count(DISTINCT (user_id, event_type, date_trunc('day', ts))) AS duplicate_rows,
round((count(*) - count(DISTINCT (user_id, event_type, date_trunc('day', ts)))) / count(*), 6) AS duplicate_rate FROM events""",
    "schema_report": f"""WITH {_E}, s AS ({_column_stats("e", _EVENT_COLUMNS)}), f AS (SELECT s.*, n_distinct / present AS u, dtype, id_hint,
  CASE "column" WHEN 'k' THEN n_distinct <= 2 AND (SELECT bool_and(k IN (0, 1)) FROM e) ELSE FALSE END AS bool_like
  FROM s JOIN (VALUES ('event_id', 'int', TRUE), ('ts', 'datetime', FALSE), ('user_id', 'int', TRUE), ('event_type', 'string', FALSE), ('value', 'float', FALSE), ('k', 'int', FALSE)) v("column", dtype, id_hint) USING ("column")),
m AS (SELECT *, CASE WHEN dtype = 'datetime' THEN 'datetime' WHEN bool_like THEN 'boolean' WHEN dtype IN ('int', 'float') AND id_hint AND u >= 0.9 THEN 'identifier_like'
  WHEN dtype = 'float' THEN 'sensor_numeric' WHEN dtype = 'int' AND n_distinct <= 30 THEN 'categorical' WHEN dtype = 'int' THEN 'numeric' WHEN u >= 0.9 THEN 'identifier_like' ELSE 'categorical' END AS semantic FROM f)
SELECT "column", dtype, semantic, CASE WHEN semantic IN ('datetime', 'identifier_like') OR n_distinct < 2 OR n_distinct > 1000 THEN 0 WHEN semantic = 'boolean' THEN 2 WHEN n_distinct <= 30 THEN 1 ELSE 0 END AS target_score,
CASE WHEN semantic = 'datetime' OR NOT id_hint THEN 0 WHEN semantic = 'identifier_like' THEN 3 ELSE 1 END AS asset_score, CASE WHEN semantic = 'datetime' THEN 2 ELSE 0 END AS timestamp_score FROM m""",
    "flatline_runs": f"WITH {_E} {_runs('event_type')}",
    "longest_flatline": f"WITH {_E} " + " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", asset, longest, n_rows, round(longest / n_rows, 6) AS ratio FROM ({_runs(c)}) ORDER BY longest DESC, asset LIMIT 1)""" for c in ("value", "k")),
    "sampling_gaps": _GAPS + """ SELECT count(*) AS n_gaps, round(median_gap, 6) AS median_gap, CASE WHEN median_gap > 0 THEN count(*) FILTER (gap > 5 * median_gap) END AS long_gaps,
round(CASE WHEN median_gap > 0 THEN std / median_gap END, 6) AS sampling_cv FROM p, m GROUP BY median_gap, std""",
    "duplicate_timestamps": "SELECT count(*) - count(DISTINCT (user_id, date_trunc('hour', ts))) AS duplicate_timestamps FROM events",
    "robust_outliers": f"WITH {_E}, o AS ({_outliers(['value', 'k'])}) SELECT \"column\", round(median, 6) AS median, round(mad, 6) AS mad, round(rate, 6) AS rate FROM o",
    "split_summary": f"""WITH {_E} SELECT CASE WHEN ts < TIMESTAMP '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_positive,
count(*) - count(value) AS missing_cells, round((count(*) - count(value)) / (count(*) * 7), 6) AS missing_rate FROM e GROUP BY 1""",
    "file_footers": " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns" for t in _TABLES),
    "csv_reasons": """SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'fits' THEN o_orderkey ELSE 0 END) AS BIGINT) AS keys, count(*) FILTER (reason = 'fits' AND o_orderstatus = 'O') AS n_open FROM (SELECT *, CASE
WHEN o_orderkey % 19 = 0 THEN 'line too long' WHEN o_orderkey % 11 = 0 THEN 'too many fields' WHEN o_orderkey % 17 = 0 THEN 'too few fields' WHEN o_orderkey % 13 = 0 THEN 'bad value' ELSE 'fits' END AS reason FROM orders) GROUP BY reason""",
    "limits": "SELECT count(*) <= 500 AS within, 6 AS n_columns, count(*) > 500 AS too_many_rows FROM events",
    "asset_imbalance": """SELECT count(*) AS n_assets, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS middle, min(n) AS least, round(CASE WHEN count(*) > 1 THEN max(n) / quantile_cont(n, 0.5) END, 6) AS ratio
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)""",
    "target_imbalance": "SELECT count(*) AS n_classes, round(CASE WHEN count(*) > 1 THEN max(n) / min(n) END, 6) AS ratio FROM (SELECT count(*) AS n FROM events GROUP BY event_type)",
    "quality_findings": _FINDINGS + ' SELECT "check", severity, "column", round(value::DOUBLE, 6) AS value, penalty::DOUBLE AS penalty, CASE "check" '
    + " ".join(f"WHEN '{check}' THEN '{message}'" for check, message in quality.MESSAGES.items()) + """ END || coalesce(': ' || "column", '') AS message FROM f""",
    "health_score": _FINDINGS + " SELECT count(*) AS n_findings, coalesce(sum(penalty), 0)::DOUBLE AS penalty, round(greatest(0, least(100, 100 - coalesce(sum(penalty), 0)))::DOUBLE, 2) AS score FROM f",
    "class_distribution": "SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM embeddings GROUP BY label",
    "recommend_task": " UNION ALL ".join(_task_sql(n) for n in _TASKS),
    "task_evidence": " UNION ALL ".join(_evidence_sql(n, *x) for n, x in (_TASKS | {"l_quantity": ("lineitem", "l_quantity", True)}).items()),
    "split_classes": f"""WITH {_E}, c AS (SELECT CASE WHEN ts < TIMESTAMP '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split, event_type AS label, count(*) AS n FROM e WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS rate FROM c""",
    "leakage_stats": f"WITH l AS ({_LINES_SQL}), s AS (" + " UNION ALL ".join(
        _STATS.format(c=c, r=_CORR.format(c=c) if c != "l_linestatus" else "NULL::DOUBLE") for c in ("l_quantity", "l_tax", "outcome", "copy_of_it", "l_linestatus")
    ) + ') SELECT "column", round(agreement, 6) AS agreement, round(correlation, 6) AS correlation FROM s',
    "leakage_report": f"""WITH l AS ({_LINES_SQL}) SELECT 'line_no' AS "column", 'near_one_to_one_id' AS kind, 'block' AS severity, round(count(DISTINCT line_key) / count(line_key), 6) AS unique_ratio FROM l HAVING count(DISTINCT line_key) / count(line_key) >= 0.99
UNION ALL SELECT 'outcome', 'target_correlated', 'block', round(count(DISTINCT outcome) / count(outcome), 6) FROM l HAVING abs({_CORR.format(c="outcome")}) >= 0.99
UNION ALL SELECT 'repair_cost', 'post_event_name', 'warning', round(count(DISTINCT l_tax * 2) / count(l_tax), 6) FROM l""",
    "split_group_time": _folds("n > 1 AND rn <= greatest(1, ceil(n * 0.2::DOUBLE))") + "(SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e)",
    "split_group": _folds(
        "chosen",
        ", a AS (SELECT user_id AS u, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR) || '|42'), user_id) <= greatest(1, ceil(count(*) OVER () * 0.2::DOUBLE)) AS chosen FROM (SELECT DISTINCT user_id FROM e))",
    ) + "e JOIN a ON u = user_id",
    "split_chronological": _folds("rn <= greatest(1, ceil(n * 0.2::DOUBLE))") + "(SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM e)",
    "split_random": _folds("rn <= greatest(1, ceil(n * 0.2::DOUBLE))") + "(SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS rn FROM e)",
    "split_stratified": _folds("rn <= round(n * 0.2::DOUBLE)")
    + "(SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS rn FROM e)",
    "split_validation": f"""WITH {_E}, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e),
t AS (SELECT *, n > 1 AND rn <= greatest(1, ceil(n * 0.2::DOUBLE)) AS test FROM a),
v AS (SELECT *, count(*) OVER (PARTITION BY user_id, test) AS vn, row_number() OVER (PARTITION BY user_id, test ORDER BY ts DESC, event_id DESC) AS vr FROM t)
SELECT event_id, user_id, CASE WHEN test THEN 'test' WHEN vn > 1 AND vr <= greatest(1, ceil(vn * (0.2::DOUBLE / (1 - 0.2::DOUBLE)))) THEN 'validation' ELSE 'train' END AS fold FROM v""",
    "split_audit": f"""WITH {_E}, f AS (SELECT *, CASE WHEN n > 1 AND rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS fold FROM (
SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e)),
g AS (SELECT user_id, fold, count(*) AS n, min(ts) AS first, max(ts) AS last FROM f GROUP BY user_id, fold),
j AS (SELECT g.*, t.last AS train_last FROM g LEFT JOIN g t ON t.user_id = g.user_id AND t.fold = 'train')
SELECT fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_assets, count(*) FILTER (fold <> 'train' AND train_last IS NOT NULL) AS shared_assets, count(*) FILTER (fold <> 'train' AND first < train_last) AS early_assets FROM j GROUP BY fold""",
}
