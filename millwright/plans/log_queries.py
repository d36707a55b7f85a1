"""Queries over logs, assistant turns and streams of readings.

Orders stand for a log of requests and decisions: a customer is a name, an order an event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.prefix import shared_dir
from millwright.functions.quantiles import quantiles, value_counts
from millwright.operators import anomaly, evallog, ledger
from millwright.plans.data import EVENTS_SQL, SPLIT_DATE, rounded, table, windows
from millwright.streaming import streams


def latest_listing(spark, sf_dir):
    """The second page of fifty open orders, newest first: the listing's own limit."""
    orders = table(spark, sf_dir, "orders")
    return ledger.latest(orders, "o_orderdate", "o_orderkey", {"o_orderstatus": "O"}, 50, 50).select("o_orderkey", "o_custkey", "o_totalprice")


def lineage(spark, sf_dir):
    """Each order with its customer, nation and region: model, run, experiment and dataset."""
    models = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("run_id"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), "c_name", F.col("c_nationkey").alias("experiment_id"))
    experiments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("experiment_id"), "n_name", F.col("n_regionkey").alias("dataset_id"))
    datasets = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("dataset_id"), "r_name")
    return ledger.lineage(models, runs, experiments, datasets).select("o_orderkey", "c_name", "n_name", "r_name")


def eligible_runs(spark, sf_dir):
    """Orders that are the dearest one of a customer of the building segment."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), "o_totalprice")
    best = runs.groupBy("experiment_id").agg(F.max_by("run_id", F.struct("o_totalprice", "run_id")).alias("recommended_run"))
    experiments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_id"), F.when(F.col("c_mktsegment") == "BUILDING", "succeeded").otherwise("failed").alias("status"))
    return ledger.eligible_runs(runs, experiments.join(best, "experiment_id")).select("run_id", "experiment_id")


def new_registrations(spark, sf_dir):
    """Orders as requests, of which those by customers with an even key are registered under their priority."""
    orders = table(spark, sf_dir, "orders")
    registered = orders.filter(F.col("o_custkey") % 2 == 0).select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name")).filter(F.col("name").isin("1-URGENT", "2-HIGH")).distinct()
    requests = orders.select("o_orderkey", F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"))
    return ledger.new_registrations(requests, registered).select("o_orderkey", "status")


def current_state(spark, sf_dir):
    """The last order of each customer."""
    return ledger.current_state(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


def state_intervals(spark, sf_dir):
    """For each order the days until its customer's next one."""
    log = ledger.state_intervals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return log.select("o_custkey", "o_orderkey", F.coalesce(F.datediff("valid_to", "valid_from"), F.lit(-1)).alias("days"), "is_current")


def first_valid_decision(spark, sf_dir):
    """Line items as decisions on their order, which expects its number of lines as version."""
    line = table(spark, sf_dir, "lineitem")
    requests = line.groupBy(F.col("l_orderkey").alias("request_id")).agg((F.count("*") % 3).alias("version"))
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("modified")
    decisions = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.col("l_orderkey").alias("request_id"), status.alias("status"), (F.col("l_linenumber") % 3).cast("long").alias("expected_version"),
        F.when(F.col("l_quantity") > 10, "because").alias("reason"), F.when(F.col("l_tax") > 0.02, "{}").alias("payload"), F.col("l_shipdate").alias("decided_at"),
    )
    return ledger.first_valid_decision(requests, decisions).select("decision_id", "verdict")


def pending_conflicts(spark, sf_dir):
    """Customers with several open orders of one priority."""
    orders = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done"))
    return ledger.pending_conflicts(orders, ["o_custkey", "o_orderpriority"])


def _approvals(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    payload = F.to_json(F.struct(
        F.col("o_custkey").cast("string").alias("asset_id"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, "inspect").alias("recommended_action"),
        F.col("o_custkey").cast("string").alias("prediction_event_id"), F.when(F.col("o_orderkey") % 11 == 0, "x").alias("note"),
    ))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "modified").otherwise("pending")
    return orders.select(F.col("o_orderkey").alias("approval_id"), status.alias("status"), payload.alias("payload"), payload.alias("decision_payload"))


def work_orders(spark, sf_dir):
    """Orders as approvals: accepted ones, and rejected ones with the reason. Customers with a balance have a prediction."""
    predictions = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("prediction_event_id"))
    good, bad = ledger.work_orders(_approvals(spark, sf_dir), predictions)
    return good.select("approval_id", "asset_id", "priority", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("approval_id", F.lit(None).cast("string").alias("asset_id"), F.lit(None).cast("string").alias("priority"), "reason"))


def receipts(spark, sf_dir):
    """Orders with their number of shipped lines."""
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("approval_id")).agg(F.count("*").alias("n_done"))
    return ledger.receipts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("approval_id")), done).fillna(0, ["n_done"])


def feedback_intake(spark, sf_dir):
    """Labels as feedback on documents."""
    outcome = F.when(F.col("toxic") == 1, "confirmed_issue").when(F.col("quality") == 1, "false_alarm").when(F.col("doc_id") % 5 == 0, "maybe").otherwise("no_action_needed")
    batch = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("prediction_event_id"), outcome.alias("outcome"), F.when(F.col("doc_id") % 13 != 0, "ann").alias("technician"), F.lit(None).cast("string").alias("comment")
    )
    predictions = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("prediction_event_id"), F.col("source").alias("model_id"))
    good, bad = ledger.feedback_intake(batch, predictions)
    return good.select("feedback_id", "model_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("feedback_id", F.lit(None).cast("string").alias("model_id"), "reason"))


def intent_routing(spark, sf_dir):
    """Intents of user turns; a word of each turn decides which request stands before it."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    asks = F.element_at(F.array(*[F.lit(x) for x in ("How is data quality?", "Deploy it now", "Which model is best?", "Fix before deploy", "Hello there", "Create a work order")]), (F.col("conv_id") % 6 + 1).cast("int"))
    return turns.select("conv_id", "turn", evallog.route_intent(F.concat_ws(" ", asks, "text")).alias("intent"))


def number_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("id "), F.col("conv_id"), F.lit(": "), F.coalesce("text", F.lit("")))
    return t.select("conv_id", "turn", F.array_join(evallog.extract_numbers(text), " ").alias("numbers"))


def grounded_turns(spark, sf_dir):
    """Whether an answer's numbers occur in what the user said before in the conversation."""
    t = table(spark, sf_dir, "conversations")
    said = t.filter("role = 'user'").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("evidence"))  # a conversation's turns
    answer = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 == 0, " costs 12.5%").otherwise(""))
    rows = t.filter("role = 'assistant'").join(said, "conv_id", "left")
    return rows.select("conv_id", "turn", evallog.grounded(answer, F.col("evidence")).alias("grounded"))


def scorecard(spark, sf_dir):
    """Rates over turns: user turns with a known intent, and answers without a causal claim."""
    t = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 4 == 0, " therefore the best model").otherwise(""))
    flags = t.select("key", "role", evallog.route_intent(text).alias("intent"), evallog.text_markers(text)["causal_claim"].alias("causal"))
    return rounded(evallog.scorecard(flags, "key", {"known_intent": (F.col("role") == "user", F.col("intent") != "unknown"), "no_causal_claim": (F.col("role") == "assistant", ~F.col("causal")), "system_turns": (F.col("role") == "nobody", F.lit(True))})).withColumn("first_failing", F.col("first_failing").cast("string"))


def scorecard_failures(spark, sf_dir):
    """Each turn that fails a rate of the scorecard, and why."""
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 4 == 0, " therefore the best model").otherwise(""))
    flags = t.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "role", evallog.route_intent(text).alias("intent"), evallog.text_markers(text)["causal_claim"].alias("causal"))
    why = F.concat(F.lit("intent "), F.col("intent"))
    return evallog.failing_rows(flags, "key", {"known_intent": (F.col("role") == "user", F.col("intent") != "unknown", why), "no_causal_claim": (F.col("role") == "assistant", ~F.col("causal"), F.lit("causal claim"))})


def resolve_expected(spark, sf_dir):
    """The value of each supplier's case in a report of its lines, looked up."""
    report = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("model")).agg(F.avg("l_quantity").alias("mean_quantity"), F.max("l_tax").alias("max_tax"))
    values = evallog.unpivot_metrics(report, ["mean_quantity", "max_tax"])
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_suppkey").cast("string").alias("model"), F.when(F.col("s_suppkey") % 2 == 0, "mean_quantity").when(F.col("s_suppkey") % 3 == 0, "max_tax").otherwise("f1").alias("metric"))
    return rounded(evallog.resolve_expected(cases, values).select("case_id", "metric", "value"))


def report_numbers(spark, sf_dir):
    report = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") > 3).alias("flag"))
    return evallog.report_numbers(report).select(F.explode("numbers").alias("number"))


def _stream(spark, sf_dir) -> DataFrame:
    """The events table as a file stream, with the readings' derived columns."""
    raw = streams.read_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    value = F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", value, F.get_json_object("props", "$.k").cast("int").alias("k"))


def stream_scores(spark, sf_dir):
    """Scores of all readings against the baseline window's fit, from a stream."""
    stats = anomaly.RobustStats.of(anomaly.fit_robust_baseline(windows(spark, sf_dir)[0], ["value", "k"]))
    return rounded(streams.drain(streams.stream_scores(_stream(spark, sf_dir), stats, ["value", "k"], ["event_id"]), "scores"))


def stream_dedup(spark, sf_dir):
    """Users and hours, each once, from a stream that has them often."""
    hourly = _stream(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    out = streams.drain(streams.stream_dedup(hourly, "user_id", "ts", "60 days"), "dedup")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


def stream_drift(spark, sf_dir):
    """Population stability of each day's readings against the baseline window, from a stream."""
    base, _ = windows(spark, sf_dir)
    counts = value_counts(base.select(F.lit("value").alias("column"), "value"))
    edges = quantiles(counts, [i / 10 for i in range(11)]).select(F.array_distinct("q")).first()[0]
    place = F.when(F.col("value") == edges[-1], len(edges) - 1).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("value"))))
    baseline = base.filter("value is not null").groupBy(place.alias("bin")).agg(F.count("*").alias("b"))
    bins = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    baseline = bins.join(baseline, "bin", "left").fillna(0, ["b"])
    counts = _complete(spark, streams.stream_window_counts(_stream(spark, sf_dir), "ts", "value", edges))
    out = streams.window_psi(counts, baseline, len(edges) + 1)
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "psi"))


def _complete(spark, stream: DataFrame) -> DataFrame:
    """All windows of a stream that has ended, also those that its watermark has not passed."""
    path = f"{shared_dir(spark)}/millwright/windows-{uuid.uuid4().hex[:12]}"
    streams.drain(stream, "windows", "complete", lambda batch, epoch: batch.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def stream_flatline(spark, sf_dir):
    """Runs of three equal event types of a user, as the stream finds them."""
    out = streams.drain(streams.stream_flatline(_stream(spark, sf_dir), "user_id", "ts", "event_type", 3), "flatline")
    return out.groupBy("asset", "state").agg(F.count("*").alias("n_runs"))


def stream_watch(spark, sf_dir):
    """Runs, gaps and silences of users, from a stream of readings that arrive up to two hours late, in three parts and an end mark."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    arrival = F.col("ts") + F.make_dt_interval(secs=F.pmod(F.col("event_id") * 7919, F.lit(7200)))
    part = (arrival >= "2024-01-11").cast("int") + (arrival >= "2024-01-21").cast("int")
    end = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    path = f"{shared_dir(spark)}/millwright/arrivals-{uuid.uuid4().hex[:12]}"
    for rows in (*[e.filter(part == k) for k in range(3)], end):
        rows.write.mode("append").parquet(path)
    found = streams.drain(streams.stream_watch(streams.read_stream(spark, path, e.schema, files=1000), "user_id", "ts", "event_id", "event_type", delay="3 hours"), "watch", rocksdb=True)
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("asset", "kind", when("started"), when("ended"), "n", "state")


def stream_state(spark, sf_dir):
    """The last event of each user, kept by a stream."""
    store = f"{shared_dir(spark)}/millwright/state-{uuid.uuid4().hex[:12]}"
    stream = _stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    streams.drain(stream, "state", sink=streams.keyed_state(store, "user_id", "ts", "event_id"))
    return streams.latest_state(spark, store).select("user_id", "event_id", "event_type")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}


def _intents(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')"
    cases = " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{intent}'" for intent, words in evallog.INTENTS)
    return f"(SELECT CASE {cases} ELSE 'unknown' END FROM (SELECT {plain} AS x))"


_FOLLOWS = r"'(?:^|[^A-Za-z0-9_])([+-]?(?:\d+(?:\.\d+)?|\.\d+)%?)'"
_E = f"e AS ({EVENTS_SQL})"

ORACLE_SQL = {
    "latest_listing": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50",
    "lineage": "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "eligible_runs": """SELECT o_orderkey AS run_id, o_custkey AS experiment_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders)
JOIN customer ON o_custkey = c_custkey WHERE rn = 1 AND c_mktsegment = 'BUILDING'""",
    "new_registrations": """WITH r AS (SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS name FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT run_id FROM r) THEN 'new' WHEN EXISTS (SELECT 1 FROM r WHERE run_id = o_custkey AND name = o_orderpriority) THEN 'existing' ELSE 'conflict' END AS status FROM orders""",
    "current_state": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "state_intervals": """SELECT o_custkey, o_orderkey, CAST(coalesce(date_diff('day', o_orderdate, following), -1) AS INTEGER) AS days, following IS NULL AS is_current
FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders)""",
    "first_valid_decision": """WITH v AS (SELECT l_orderkey AS request_id, count(*) % 3 AS version FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey * 10 + l_linenumber AS decision_id, l_orderkey, l_shipdate, l_linenumber % 3 = version AS same,
  l_returnflag = 'A' OR (l_quantity > 10 AND (l_returnflag = 'R' OR l_tax > 0.02)) AS complete FROM lineitem JOIN v ON request_id = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, same AND complete ORDER BY l_shipdate, decision_id) AS rn FROM d)
SELECT decision_id, CASE WHEN same AND complete AND rn = 1 THEN 'applied' WHEN NOT complete THEN 'invalid' ELSE 'conflict' END AS verdict FROM r""",
    "pending_conflicts": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1",
    "work_orders": """WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown key' WHEN o_orderkey % 7 = 0 THEN 'missing recommended_action'
  WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) THEN 'unknown prediction' END AS reason FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT o_orderkey AS approval_id, CASE WHEN reason IS NULL THEN CAST(o_custkey AS VARCHAR) END AS asset_id, CASE WHEN reason IS NULL THEN o_orderpriority END AS priority, reason FROM a""",
    "receipts": "SELECT o_orderkey AS approval_id, coalesce(n_done, 0) AS n_done FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_done FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey",
    "feedback_intake": """SELECT l.doc_id AS feedback_id, CASE WHEN reason IS NULL THEN source END AS model_id, reason FROM (SELECT l.doc_id, d.source, CASE
  WHEN NOT (toxic = 1 OR quality = 1) AND l.doc_id % 5 = 0 THEN 'unknown outcome' WHEN l.doc_id % 13 = 0 THEN 'no technician' WHEN d.doc_id IS NULL THEN 'unknown prediction' END AS reason
  FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id) l""",
    "intent_routing": "SELECT conv_id, turn, " + _intents("concat_ws(' ', ['How is data quality?', 'Deploy it now', 'Which model is best?', 'Fix before deploy', 'Hello there', 'Create a work order'][CAST(conv_id % 6 + 1 AS INTEGER)], text)") + " AS intent FROM conversations WHERE role = 'user'",
    "number_tokens": f"SELECT conv_id, turn, array_to_string(regexp_extract_all('id ' || conv_id || ': ' || coalesce(text, ''), {_FOLLOWS}, 1), ' ') AS numbers FROM conversations",
    "grounded_turns": f"""WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY text) AS evidence FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT c.conv_id, turn, regexp_extract_all(coalesce(text, '') || CASE WHEN c.conv_id % 3 = 0 THEN ' costs 12.5%' ELSE '' END, {_FOLLOWS}, 1) AS x, regexp_extract_all(coalesce(evidence, ''), {_FOLLOWS}, 1) AS y
FROM conversations c LEFT JOIN u USING (conv_id) WHERE role = 'assistant') SELECT conv_id, turn, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS grounded FROM a""",
    "scorecard": f"""WITH f AS (SELECT conv_id * 1000 + turn AS key, role, t, {_intents('t')} AS intent, {" OR ".join(f"contains(lower(t), '{w}')" for w in evallog.CAUSAL)} AS causal
FROM (SELECT *, coalesce(text, '') || CASE WHEN conv_id % 4 = 0 THEN ' therefore the best model' ELSE '' END AS t FROM conversations)),
m AS (SELECT 'known_intent' AS metric, key, role = 'user' AS d, intent <> 'unknown' AS g FROM f UNION ALL SELECT 'no_causal_claim', key, role = 'assistant', NOT causal FROM f UNION ALL SELECT 'system_turns', key, role = 'nobody', TRUE FROM f)
SELECT metric, count(*) FILTER (d AND g) AS numerator, count(*) FILTER (d) AS denominator, round(count(*) FILTER (d AND g) / nullif(count(*) FILTER (d), 0), 6) AS rate, CAST(min(key) FILTER (d AND NOT g) AS VARCHAR) AS first_failing FROM m GROUP BY metric""",
    "scorecard_failures": f"""WITH f AS (SELECT concat_ws(':', conv_id, turn) AS key, role, {_intents('t')} AS intent, {" OR ".join(f"contains(lower(t), '{w}')" for w in evallog.CAUSAL)} AS causal
FROM (SELECT *, coalesce(text, '') || CASE WHEN conv_id % 4 = 0 THEN ' therefore the best model' ELSE '' END AS t FROM conversations))
SELECT 'known_intent' AS metric, key, 'intent ' || intent AS reason FROM f WHERE role = 'user' AND intent = 'unknown' UNION ALL SELECT 'no_causal_claim', key, 'causal claim' FROM f WHERE role = 'assistant' AND causal""",
    "resolve_expected": """SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 2 = 0 THEN 'mean_quantity' WHEN s_suppkey % 3 = 0 THEN 'max_tax' ELSE 'f1' END AS metric,
round(CASE WHEN s_suppkey % 2 = 0 THEN q WHEN s_suppkey % 3 = 0 THEN t END, 6) AS value FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""",
    "report_numbers": "SELECT DISTINCT n::DOUBLE AS number FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT n_regionkey FROM nation)",
    "stream_scores": f"""WITH {_E}, b AS (SELECT * FROM e WHERE ts < TIMESTAMP '{SPLIT_DATE}'), f AS (SELECT quantile_cont(value, 0.5) AS vm, stddev_pop(value) AS vs, quantile_cont(k, 0.5) AS km, stddev_pop(k) AS ks FROM b),
g AS (SELECT quantile_cont(abs(value - vm), 0.5) AS vd, quantile_cont(abs(k - km), 0.5) AS kd FROM b, f),
s AS (SELECT event_id, greatest(abs(coalesce((value - vm) / CASE WHEN vd > 0 THEN vd / 0.6745 ELSE vs END, 0)), abs(coalesce((k - km) / CASE WHEN kd > 0 THEN kd / 0.6745 ELSE ks END, 0))) AS r FROM e, f, g)
SELECT event_id, round(r, 6) AS robust_score, r > 3 AS flagged FROM s""",
    "stream_dedup": "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H') AS hour FROM events",
    "stream_drift": f"""WITH {_E}, q AS (SELECT list_distinct(quantile_cont(value, [{", ".join(str(i / 10) for i in range(11))}])) AS x FROM e WHERE ts < TIMESTAMP '{SPLIT_DATE}'),
v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts < TIMESTAMP '{SPLIT_DATE}' AS base, len(x) AS k, CASE WHEN value = list_max(x) THEN len(x) - 1 ELSE len(list_filter(x, lambda y: y <= value)) END AS bin FROM e, q WHERE value IS NOT NULL),
g AS (SELECT day, n, k, unnest(range(0, k + 1)) AS bin FROM (SELECT day, count(*) AS n, any_value(k) AS k FROM v GROUP BY day)),
t AS (SELECT g.*, (SELECT count(*) FROM v WHERE base) AS total, (SELECT count(*) FROM v w WHERE w.base AND w.bin = g.bin) AS b, (SELECT count(*) FROM v w WHERE w.day = g.day AND w.bin = g.bin) AS c FROM g),
p AS (SELECT day, n, (c + 1e-6::DOUBLE) / (n + 1e-6::DOUBLE * (k + 1)) AS p, (b + 1e-6::DOUBLE) / (total + 1e-6::DOUBLE * (k + 1)) AS q FROM t)
SELECT day, n, round(sum((p - q) * ln(p / q)), 6) AS psi FROM p GROUP BY day, n""",
    "stream_flatline": """WITH s AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS starts FROM events),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM s)
SELECT user_id AS asset, state, count(*) AS n_runs FROM (SELECT user_id, island, event_type AS state FROM i GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1, 2""",
    "stream_watch": """WITH s AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS following, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s),
f AS (SELECT user_id, 'flatline' AS kind, min(ts) AS a, max(ts) AS b, count(*) AS n, event_type AS state FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 3
  UNION ALL SELECT user_id, 'gap', before, ts, (epoch_us(ts) - epoch_us(before)) // 1000000, NULL FROM s WHERE ts - before > INTERVAL 1 DAY
  UNION ALL SELECT user_id, 'silent', ts, ts + INTERVAL 2 DAY, NULL, NULL FROM s WHERE following IS NULL OR following - ts > INTERVAL 2 DAY)
SELECT user_id AS asset, kind, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS ended, n, state FROM f""",
    "stream_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
}
