"""Registered grading, gate, log, trace and compaction queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import redact_json
from shelfmark.operators import compaction as K
from shelfmark.operators import gates as G
from shelfmark.operators import grading as R
from shelfmark.operators import runlogs as L
from shelfmark.operators import traces as T
from shelfmark.plans import domain as D
from shelfmark.streaming import windows as W

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def texts(*v):
    return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")


# --- trajectories graded from the call log -----------------------------------------------
def graded(spark, sf):
    c = D.calls(spark, sf)
    n = F.regexp_extract("task_id", "[0-9]+", 0).cast("int")
    t = R.tool_sets(c).withColumns(
        {
            "expected_tools": F.when(n % 3 == 0, texts("search_catalog", "get_product")).when(n % 3 == 1, texts("get_order")).otherwise(texts()),
            "forbidden_tools": F.when(n % 2 == 0, texts("create_return_request")).otherwise(texts()),
            "handoff_expected": n % 4 == 0,
            "retrieval_gold_ok": F.col("n_calls") % 4 != 0,
            "state_ok": F.col("n_failed") < 3,
            "turns": F.col("n_calls") + 1,
            "answer_ok": F.col("n_calls") % 5 != 1,
            "n3": n % 3,
            "split": F.when(n < 20, "dev").otherwise("locked"),
        }
    )
    seq = R.sequence_match(c, ["search_catalog", "get_product"])
    t = t.join(seq, "trajectory_id").withColumn("sequence_failure", F.when(F.col("n3") == 0, F.col("failure")))
    return R.grade(t)


GRADED = D.with_sql("dom_calls", body="").rstrip() + """,
 ts AS (SELECT trajectory_id, any_value(task_id) AS task_id, CAST(regexp_extract(any_value(task_id), '[0-9]+') AS INTEGER) AS n, list_sort(list(DISTINCT tool)) AS observed, coalesce(list(DISTINCT tool) FILTER (ok), []) AS succeeded,
   coalesce(list(DISTINCT tool) FILTER (ok AND changed), []) AS changed_tools, bool_or(tool = 'escalate_to_human' AND ok) AS handoff, count(*) AS n_calls, count(*) FILTER (NOT ok) AS n_failed, sum(latency_ms) AS latency_ms FROM dom_calls GROUP BY 1),
 s1 AS (SELECT trajectory_id, min(seq) AS a FROM dom_calls WHERE ok AND tool = 'search_catalog' GROUP BY 1),
 s2 AS (SELECT c.trajectory_id, min(seq) AS b, arg_min(item, seq) AS item FROM dom_calls c JOIN s1 USING (trajectory_id) WHERE ok AND tool = 'get_product' AND seq > a GROUP BY 1),
 sq AS (SELECT ts.trajectory_id, CASE WHEN a IS NULL THEN 'missing-required-tool' WHEN b IS NULL THEN CASE WHEN list_contains(succeeded, 'get_product') THEN 'wrong-tool-order' ELSE 'missing-required-tool' END
   WHEN NOT EXISTS (SELECT 1 FROM dom_calls d WHERE d.trajectory_id = ts.trajectory_id AND d.ok AND d.tool = 'search_catalog' AND d.item = s2.item AND d.seq < b) THEN 'wrong-tool-order' END AS failure FROM ts LEFT JOIN s1 USING (trajectory_id) LEFT JOIN s2 USING (trajectory_id)),
 x AS (SELECT ts.*, CASE n % 3 WHEN 0 THEN ['search_catalog', 'get_product'] WHEN 1 THEN ['get_order'] ELSE [] END AS ex, CASE WHEN n % 2 = 0 THEN ['create_return_request'] ELSE [] END AS fb, n % 4 = 0 AS hx, n_calls % 4 <> 0 AS gold, n_failed < 3 AS st, n_calls + 1 AS turns,
   n_calls % 5 <> 1 AS ans, CASE WHEN n % 3 = 0 THEN failure END AS sf, CASE WHEN n < 20 THEN 'dev' ELSE 'locked' END AS split FROM ts JOIN sq USING (trajectory_id)),
 y AS (SELECT *, len(list_intersect(ex, observed)) AS tp, list_has_any(observed, fb) AS fa, list_has_any(changed_tools, fb) AS il, len([e FOR e IN ex IF list_contains(observed, e) AND NOT list_contains(succeeded, e)]) > 0 AS rf,
   len([o FOR o IN observed IF NOT list_contains(ex, o) AND NOT (hx AND o = 'escalate_to_human')]) AS excess FROM x),
 z AS (SELECT *, CASE WHEN len(observed) > 0 THEN tp / len(observed) ELSE 0 END AS p, CASE WHEN len(ex) > 0 THEN tp / len(ex) ELSE 1.0 END AS r FROM y),
 g AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, st AND NOT fa AND r = 1 AND handoff = hx AND NOT rf AND gold AND sf IS NULL AS success FROM z),
 gr AS (SELECT *, (CASE WHEN success THEN 5 ELSE 0 END) + (CASE WHEN fa THEN 0 ELSE 2 END) + (CASE WHEN gold THEN 1 ELSE 0 END) - 2 * excess - (CASE WHEN handoff <> hx THEN 3 ELSE 0 END) - (CASE WHEN il THEN 5 ELSE 0 END) - 0.1 * greatest(0, turns - 2) AS reward,
   CASE WHEN fa THEN 'forbidden-tool-attempt' WHEN rf THEN 'required-tool-failed' WHEN sf IS NOT NULL THEN sf WHEN NOT gold THEN 'retrieval-gold-missing' WHEN NOT st THEN 'state-mismatch' WHEN r < 1 THEN 'wrong-tool' WHEN handoff <> hx THEN 'handoff-mismatch' END AS ft FROM g)"""


@register("tool_prf", GRADED + " SELECT trajectory_id, round(p, 6) AS tool_precision, round(r, 6) AS tool_recall, round(f, 6) AS tool_f1, fa AS forbidden_tool_attempt, il AS illegal_state_change, rf AS required_tool_failure FROM gr")
def tool_prf(spark, sf):
    return graded(spark, sf).select(
        "trajectory_id", *[F.round(c, 6).alias(c) for c in ("tool_precision", "tool_recall", "tool_f1")], "forbidden_tool_attempt", "illegal_state_change", "required_tool_failure"
    )


@register("sequence_match", GRADED + " SELECT trajectory_id, failure IS NULL AS matched, failure FROM sq")
def sequence_match(spark, sf):
    return R.sequence_match(D.calls(spark, sf), ["search_catalog", "get_product"])


@register("grade_reward", GRADED + " SELECT trajectory_id, success, CAST(round(reward, 3) AS DOUBLE) AS reward, ft AS failure_type, success AND st AND ans AS joint_success FROM gr")
def grade_reward(spark, sf):
    return graded(spark, sf).select("trajectory_id", "success", F.round("reward", 3).alias("reward"), "failure_type", "joint_success")


@register("failure_taxonomy", GRADED + " SELECT ft AS failure_type, count(*) AS n FROM gr WHERE ft IS NOT NULL GROUP BY 1")
def failure_taxonomy(spark, sf):
    return R.failure_taxonomy(graded(spark, sf))


@register(
    "run_summary_rollup",
    GRADED
    + """ SELECT split, count(*) AS trajectories, count(DISTINCT task_id) AS tasks, round(avg(CAST(success AS INTEGER)), 6) AS task_success, round(avg(CAST(NOT fa AS INTEGER)), 6) AS policy_compliance, round(avg(f), 6) AS tool_call_f1,
     round(coalesce(count(*) FILTER (hx AND handoff) / nullif(count(*) FILTER (handoff), 0), 1), 6) AS handoff_precision, round(coalesce(count(*) FILTER (hx AND handoff) / nullif(count(*) FILTER (hx), 0), 1), 6) AS handoff_recall,
     round(avg(turns), 6) AS average_turns, round(avg(latency_ms), 4) AS average_latency_ms, round(avg(round(reward, 3)), 6) AS average_reward, round(avg(CAST(st AS INTEGER)), 6) AS terminal_state_accuracy, round(avg(CAST(success AND st AND ans AS INTEGER)), 6) AS joint_success
     FROM gr GROUP BY ROLLUP (split)""",
)
def run_summary_rollup(spark, sf):
    s = R.summarize(graded(spark, sf), ["split"])
    rates = ["task_success", "policy_compliance", "tool_call_f1", "handoff_precision", "handoff_recall", "average_turns", "average_reward", "terminal_state_accuracy", "joint_success"]
    return s.select("split", "trajectories", "tasks", *[F.round(c, 6).alias(c) for c in rates], F.round("average_latency_ms", 4).alias("average_latency_ms"))


@register(
    "pass_at_k",
    GRADED
    + """, k AS (SELECT task_id, success, row_number() OVER (PARTITION BY task_id ORDER BY trajectory_id) AS rn, count(*) OVER (PARTITION BY task_id) AS c FROM gr),
     p AS (SELECT task_id, bool_and(success) AS a FROM k WHERE rn <= 3 AND c >= 3 GROUP BY 1)
     SELECT (SELECT round(avg(CAST(success AS INTEGER)), 6) FROM gr) AS pass_1, round(avg(CAST(a AS INTEGER)), 6) AS pass_k, count(*) AS tasks_k FROM p""",
)
def pass_at_k(spark, sf):
    return R.pass_at_k(graded(spark, sf), "trajectory_id").select(F.round("pass_1", 6).alias("pass_1"), F.round("pass_k", 6).alias("pass_k"), "tasks_k")


@register(
    "gold_retrieved",
    D.with_sql("dom_calls", body="""SELECT trajectory_id, bool_and(h) AS retrieval_gold_ok FROM (SELECT g.trajectory_id, EXISTS (SELECT 1 FROM dom_calls c WHERE c.trajectory_id = g.trajectory_id AND c.item = g.d AND c.ok AND c.tool IN ('search_catalog', 'get_product')) AS h
     FROM (SELECT DISTINCT trajectory_id, unnest([printf('P%05d', user_id % 20), printf('P%05d', (user_id + 1) % 20)]) AS d FROM dom_calls) g) GROUP BY 1"""),
)
def gold_retrieved(spark, sf):
    c = D.calls(spark, sf)
    gold = c.select("trajectory_id", F.explode(F.array(F.format_string("P%05d", F.col("user_id") % 20), F.format_string("P%05d", (F.col("user_id") + 1) % 20))).alias("doc_id")).distinct()
    got = c.where(F.col("ok") & F.col("tool").isin("search_catalog", "get_product")).select("trajectory_id", F.col("item").alias("doc_id"))
    return R.gold_retrieved(gold, got)


@register("failed_or_empty", D.with_sql("dom_calls", body="SELECT tool, CASE WHEN NOT ok THEN 'failed' ELSE 'empty_result' END AS status, count(*) AS n FROM dom_calls WHERE NOT ok OR k % 7 = 0 GROUP BY 1, 2"))
def failed_or_empty(spark, sf):
    c = D.calls(spark, sf).withColumn("n_results", F.col("k") % 7)
    return R.failed_or_empty(c).groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n"))


@register(
    "state_diff",
    D.with_sql("dom_orders", body="""SELECT order_id AS trajectory_id, order_id || '.status' AS path, CASE WHEN order_key % 3 = 0 THEN 'pending' ELSE status END AS expected, status AS actual FROM dom_orders WHERE order_key % 3 = 0 AND status <> 'pending'
      UNION ALL SELECT order_id, order_id || '.return_status', 'requested', return_status FROM dom_orders WHERE return_status IS DISTINCT FROM 'requested'"""),
)
def state_diff(spark, sf):
    o = D.orders(spark, sf)

    def rows(status, ret):
        state = F.create_map(F.col("order_id"), F.create_map(F.lit("status"), status, F.lit("return_status"), ret))
        return o.select(F.col("order_id").alias("trajectory_id"), F.explode(R.nested_paths(state)).alias("e")).select("trajectory_id", "e.*")

    want = rows(F.when(F.col("order_key") % 3 == 0, "pending").otherwise(F.col("status")), F.lit("requested"))
    return R.state_diff(want, rows(F.col("status"), F.col("return_status")))


# --- paired runs ---------------------------------------------------------------------------
GR = D.with_sql("dom_grades", body="").rstrip()
AGG_SQL = """count(*) AS tasks, count(*) FILTER (success) AS success_count, round(avg(CAST(success AS INTEGER)), 6) AS success_rate, count(*) FILTER (illegal_state_change) AS illegal_state_change_count,
  count(*) FILTER (inappropriate_handoff) AS inappropriate_handoff_count, CAST(sum(duplicate_writes) AS BIGINT) AS duplicate_writes, round(avg(CAST(terminal_state_accurate AS INTEGER)), 6) AS terminal_state_accuracy,
  round(avg(decision_steps), 6) AS mean_decision_steps, count(*) FILTER (correction_eligible) AS correction_eligible_tasks, round(count(*) FILTER (correction_eligible AND success) / nullif(count(*) FILTER (correction_eligible), 0), 6) AS correction_task_recovery_rate,
  list_sort(list(elapsed_ms))[CAST(greatest(1, floor(count(*) * 0.95 + 0.999999)) AS INTEGER)] AS p95_latency_ms"""


@register("grade_aggregate", GR + f" SELECT config, {AGG_SQL} FROM dom_grades GROUP BY 1")
def grade_aggregate(spark, sf):
    a = R.aggregate_grades(D.grades(spark, sf), ["config"])
    r = lambda c: F.round(c, 6).alias(c)
    return a.select(
        "config", "tasks", "success_count", r("success_rate"), "illegal_state_change_count", "inappropriate_handoff_count", "duplicate_writes",
        r("terminal_state_accuracy"), r("mean_decision_steps"), "correction_eligible_tasks", r("correction_task_recovery_rate"), "p95_latency_ms",
    )


TOT = GR + """, p AS (SELECT coalesce(a.task_id, b.task_id) AS task_id, a.task_id IS NOT NULL AS ha, b.task_id IS NOT NULL AS hb, coalesce(a.success, false) AS sa, coalesce(b.success, false) AS sb, coalesce(a.illegal_state_change, false) AS ia, coalesce(b.illegal_state_change, false) AS ib,
   coalesce(a.inappropriate_handoff, false) AS xa, coalesce(b.inappropriate_handoff, false) AS xb, coalesce(a.terminal_state_accurate, false) AS ta, coalesce(b.terminal_state_accurate, false) AS tb, coalesce(b.protocol_error, false) AS pb, coalesce(b.correction_eligible, false) AS eb, b.duplicate_writes AS db
   FROM (SELECT * FROM dom_grades WHERE config = 'A') a FULL JOIN (SELECT * FROM dom_grades WHERE config = 'B') b ON a.task_id = b.task_id),
 t AS (SELECT count(*) FILTER (ha) AS na, count(*) FILTER (hb) AS nb, count(*) FILTER (NOT (ha AND hb)) AS unp, count(*) FILTER (sa AND NOT sb) AS reg, count(*) FILTER (sa AND NOT xa AND xb) AS nh, count(*) FILTER (sa) AS sa, count(*) FILTER (sb) AS sb, count(*) FILTER (ia) AS ia, count(*) FILTER (ib) AS ib,
   count(*) FILTER (xa) AS xa, count(*) FILTER (xb) AS xb, count(*) FILTER (ta) AS ta, count(*) FILTER (tb) AS tb, count(*) FILTER (pb) AS pb, count(*) FILTER (eb) AS eb, count(*) FILTER (eb AND sb) AS rb, coalesce(sum(db), 0) AS db FROM p)"""


def gate_sql(base: str, checks: dict[str, str], yes: str, no: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", coalesce({c}, false) AS passed FROM t" for n, c in checks.items())
    return f"{base}, c AS ({rows}) SELECT \"check\", passed, CASE WHEN (SELECT bool_and(passed) FROM c) THEN '{yes}' ELSE '{no}' END AS decision FROM c"


def runs(spark, sf):
    g = D.grades(spark, sf)
    return g.where(F.col("config") == "A"), g.where(F.col("config") == "B")


@register(
    "progress_gate",
    gate_sql(
        TOT,
        {
            "derived_state_present": "true", "paired_task_sets_match": "unp = 0", "baseline_successes_preserved": "reg = 0", "success_not_below_baseline": "sb / nb >= sa / na",
            "illegal_state_change_not_increased": "ib <= ia", "no_new_inappropriate_handoff_on_baseline_success": "nh = 0", "protocol_errors_zero": "pb = 0",
        },
        "allow_action_evaluator", "hold_for_progress_diagnosis",
    ),
)
def progress_gate(spark, sf):
    return G.progress_gate(*runs(spark, sf))


@register(
    "action_evaluator_gate",
    gate_sql(
        TOT,
        {
            "paired_task_sets_match": "unp = 0", "fixed_refusal_reducer_safe": "true", "fixed_successes_preserved": "reg = 0", "success_improves_by_at_least_one_task": "sb >= sa + 1", "illegal_state_change_zero": "ib = 0",
            "terminal_state_accuracy_not_decreased": "tb / nb >= ta / na", "inappropriate_handoff_not_increased": "xb <= xa", "protocol_errors_zero": "pb = 0", "rejected_actions_never_executed": "true",
            "correction_sample_size_at_least_ten": "eb >= 10", "correction_task_recovery_at_least_half": "rb / nullif(eb, 0) >= 0.5",
        },
        "allow_completion_evaluator", "hold_for_action_evaluator_diagnosis",
    ),
)
def action_evaluator_gate(spark, sf):
    return G.action_evaluator_gate(*runs(spark, sf))


@register(
    "protocol_fix_gate",
    gate_sql(
        GR
        + """, j AS (SELECT b.*, CASE WHEN CAST(substr(task_id, 2) AS BIGINT) % 9 = 0 THEN 'target' WHEN CAST(substr(task_id, 2) AS BIGINT) % 9 = 1 THEN 'observe' END AS role FROM dom_grades b WHERE config = 'B'),
       t AS (SELECT count(*) FILTER (role = 'target' AND NOT success) AS tf, count(*) FILTER (role IS NULL AND NOT success) AS reg, count(*) FILTER (illegal_state_change) AS il, count(*) FILTER (protocol_error) AS pe, sum(duplicate_writes) AS dup FROM j)""",
        {
            "dev_task_count": "true", "locked_not_executed": "true", "target_protocol_tasks_all_success": "tf = 0", "baseline_successes_preserved": "reg = 0", "illegal_state_change_zero": "il = 0",
            "protocol_errors_zero": "pe = 0", "duplicate_writes_zero": "dup = 0",
        },
        "accept_protocol_fix", "hold_for_protocol_fix_diagnosis",
    ),
)
def protocol_fix_gate(spark, sf):
    _, b = runs(spark, sf)
    n = F.substring("task_id", 2, 20).cast("bigint") % 9
    named = b.select("task_id", F.when(n == 0, "target").when(n == 1, "observe").alias("role")).where(F.col("role").isNotNull())
    return G.protocol_fix_gate(b, named)


@register(
    "action_constraint_gate",
    gate_sql(
        TOT.replace("coalesce(sum(db), 0) AS db FROM p)", "coalesce(sum(db), 0) AS db, count(*) FILTER (CAST(substr(task_id, 2) AS BIGINT) % 9 = 1 AND NOT sa AND sb) AS rec, count(*) FILTER (CAST(substr(task_id, 2) AS BIGINT) % 27 = 1) AS prem, (SELECT CAST(sum(semantic_retries) AS BIGINT) FROM dom_grades WHERE config = 'B') AS cor FROM p)"),
        {
            "paired_task_sets_match": "unp = 0", "locked_not_executed": "true", "protocol_fixed_successes_preserved": "reg = 0", "observe_policy_recovers_at_least_one": "rec > 0", "no_observe_premature_final_migration": "prem = 0",
            "no_extra_constraint_llm_calls": "true", "no_action_evaluator_correction_spans": "cor = 0", "illegal_state_change_zero": "ib = 0", "protocol_errors_zero": "pb = 0", "duplicate_writes_zero": "db = 0",
        },
        "accept_action_constraint", "hold_for_action_constraint_diagnosis",
    ),
)
def action_constraint_gate(spark, sf):
    a, b = runs(spark, sf)
    n = F.substring("task_id", 2, 20).cast("bigint")
    watched = b.where(n % 9 == 1).select("task_id", (n % 27 == 1).alias("premature"))
    spans = b.select(F.lit(0).alias("extra_calls"), F.col("semantic_retries").alias("corrections"))
    return G.action_constraint_gate(a, b, watched, spans)


@register("run_regressions", TOT + " SELECT task_id, sa AND NOT sb AS success_regression, NOT xa AND xb AS new_inappropriate_handoff FROM p WHERE sa AND (NOT sb OR (NOT xa AND xb))")
def run_regressions(spark, sf):
    return G.regressions(*runs(spark, sf))


@register(
    "compare_reports",
    GR + " SELECT metric, max(value) FILTER (config = 'A') AS \"A\", max(value) FILTER (config = 'B') AS \"B\" FROM (SELECT config, 'tasks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dom_grades GROUP BY 1 UNION ALL SELECT config, 'success_rate', round(avg(CAST(success AS INTEGER)), 6) FROM dom_grades GROUP BY 1) GROUP BY 1",
)
def compare_reports(spark, sf):
    a = R.aggregate_grades(D.grades(spark, sf), ["config"]).select(F.col("config").alias("report"), "tasks", F.round("success_rate", 6).alias("success_rate"))
    return R.side_by_side(a, ["tasks", "success_rate"], ["A", "B"])


@register(
    "replay_compare",
    GR + """ SELECT coalesce(a.task_id, b.task_id) AS task_id, a.success IS NOT DISTINCT FROM b.success AND a.duplicate_writes IS NOT DISTINCT FROM b.duplicate_writes AND a.protocol_error IS NOT DISTINCT FROM b.protocol_error AS same_grade
    FROM (SELECT * FROM dom_grades WHERE config = 'A') a FULL JOIN (SELECT * FROM dom_grades WHERE config = 'B') b ON a.task_id = b.task_id""",
)
def replay_compare(spark, sf):
    a, b = runs(spark, sf)
    return R.replay_compare(a, b, "task_id", ["success", "duplicate_writes", "protocol_error"]).select("task_id", "same_grade")


@register(
    "record_grades",
    D.with_sql("dom_orders", body="""SELECT order_id, CASE WHEN k % 17 = 0 THEN 'FAILED' WHEN k % 5 = 0 THEN 'HANDED_OFF' WHEN k % 7 = 0 THEN 'WAITING_USER' ELSE 'COMPLETED' END = 'COMPLETED' AND k % 3 <> 2 AND coalesce(return_status = 'requested', false) AND k % 13 <> 0 AND k % 3 <= 1 AS success,
      return_status IS NOT DISTINCT FROM 'requested' AS terminal_state_accurate, k % 17 <> 0 AND k % 5 = 0 AS inappropriate_handoff FROM (SELECT *, order_key AS k FROM dom_orders)"""),
)
def record_grades(spark, sf):
    k = F.col("order_key")
    rec = D.orders(spark, sf).select(
        "order_id", "return_status",
        R.record_status(k % 17 == 0, k % 5 == 0, k % 7 == 0).alias("status"),
        F.lit("COMPLETED").alias("expected_status"), F.lit(True).alias("expected_write"), F.lit(False).alias("active_fixture"), F.lit("x").alias("scenario"),
        F.when(k % 3 == 2, texts()).otherwise(texts("create_return_request")).alias("successful_tools"),
        F.when(k % 3 == 2, 2).otherwise(k % 3).alias("n_changed_writes"), (k % 13 == 0).alias("protocol_error"),
    )
    return R.grade_records(rec).select("order_id", "success", "terminal_state_accurate", "inappropriate_handoff")


@register(
    "redaction",
    r"""SELECT event_id, '{"verification_code":"[REDACTED]","note":"code [REDACTED] for O' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '","k":' || CASE WHEN event_id % 1000000 >= 100000 THEN '[REDACTED]' ELSE CAST(event_id AS VARCHAR) END || '}' AS record FROM events""",
)
def redaction(spark, sf):
    e = F.col("event_id")
    raw = F.concat(F.lit('{"verification_code": "12'), e.cast("string"), F.lit('","note":"code 654321 for O'), F.format_string("%06d", e), F.lit('","k":'), e.cast("string"), F.lit("}"))
    return D.table(spark, sf, "events").select("event_id", redact_json(raw).alias("record"))


# --- write-gate probes: users are probes, months of days are repeats ---------------------------------
def probe_spans(spark, sf):
    k = D.event_k()
    e = D.table(spark, sf, "events").withColumn("k", k)
    t = F.col("event_type")
    return e.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("task_id"),
        (F.dayofmonth("ts") % 3).alias("repeat"),
        F.when(F.col("user_id") % 2 == 0, "verification_code").otherwise("confirmation").alias("missing"),
        F.col("event_id").alias("step"),
        F.when(t == "view", F.when(F.col("k") % 2 == 0, "verification_code").otherwise("confirmation")).alias("asked"),
        F.when(t == "purchase", "create_return_request").alias("write_tool"),
        F.when(t == "error", F.col("k") % 11 == 0).alias("native_missing"),
        F.when(t == "click", F.when(F.col("k") % 9 == 0, "verification_code_required").when(F.col("k") % 9 == 1, "confirmation_required")).alias("guard_reason"),
        F.when(t == "purchase", F.col("k") % 2 == 0).alias("wrote_ok"),
    )


PROBE = """WITH e AS (SELECT 'p' || user_id AS task_id, day(ts) % 3 AS rep, CASE WHEN user_id % 2 = 0 THEN 'verification_code' ELSE 'confirmation' END AS missing, event_id AS step, event_type AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
 s AS (SELECT *, CASE WHEN t = 'view' THEN CASE WHEN k % 2 = 0 THEN 'verification_code' ELSE 'confirmation' END END AS asked FROM e),
 r AS (SELECT task_id, rep, missing, min(step) FILTER (asked IS NOT NULL) AS fa, arg_min(asked, step) FILTER (asked IS NOT NULL) AS fav, min(step) FILTER (asked = missing) AS ea, min(step) FILTER (t = 'purchase') AS fw, bool_or(t = 'error' AND k % 11 = 0) AS nat,
   bool_or(t = 'click' AND k % 9 = 0) AS cg, bool_or(t = 'click' AND k % 9 = 1) AS cfg, bool_or(t = 'purchase' AND k % 2 = 0) AS w FROM s GROUP BY 1, 2, 3),
 sc AS (SELECT task_id, rep, missing, CASE WHEN NOT early OR fa <= fw THEN fav END AS asked, ea IS NOT NULL AND NOT early AS asked_expected, early, missing = 'verification_code' AND (cg OR early OR nat) AS ve, missing = 'confirmation' AND (cfg OR early) AS ce, w AND missing = 'confirmation' AND NOT (ea IS NOT NULL AND NOT early) AS uw
   FROM (SELECT *, coalesce(fw < coalesce(ea, 1073741824), false) AS early FROM r)),
 pr AS (SELECT rep, missing, count(*) AS n, coalesce(count(*) FILTER (asked = missing) / nullif(count(asked), 0), 0) AS ap, count(*) FILTER (asked = missing) / count(*) AS ar, avg(CAST(early AS INTEGER)) AS fr, avg(CAST(uw AS INTEGER)) AS ur, avg(CAST(ve AS INTEGER)) AS vr, avg(CAST(ce AS INTEGER)) AS cr FROM sc GROUP BY 1, 2)"""


@register("probe_scores", PROBE + ' SELECT task_id, CAST(rep AS BIGINT) AS "repeat", asked, asked_expected, early AS write_before_ask, ve AS verification_code_required_event, ce AS confirmation_required_event, uw AS unconfirmed_write FROM sc')
def probe_scores(spark, sf):
    return R.score_probes(probe_spans(spark, sf)).drop("missing", "first_write_tool").withColumn("repeat", F.col("repeat").cast("bigint"))


@register("probe_rates", PROBE + ' SELECT CAST(rep AS BIGINT) AS "repeat", missing, n, round(ap, 6) AS ask_user_precision, round(ar, 6) AS ask_user_recall, round(fr, 6) AS forbidden_write_attempt_rate, round(ur, 6) AS unconfirmed_write_rate FROM pr')
def probe_rates(spark, sf):
    r = R.probe_rates(R.score_probes(probe_spans(spark, sf)))
    return r.select(F.col("repeat").cast("bigint").alias("repeat"), "missing", "n", *[F.round(c, 6).alias(c) for c in ("ask_user_precision", "ask_user_recall", "forbidden_write_attempt_rate", "unconfirmed_write_rate")])


@register(
    "probe_go_nogo",
    PROBE
    + """, a AS (SELECT missing, arg_min(n, rep) AS n, avg(CASE WHEN missing = 'verification_code' THEN vr ELSE cr END) AS m, stddev_pop(CASE WHEN missing = 'verification_code' THEN vr ELSE cr END) AS s FROM pr GROUP BY 1)
     SELECT missing, n, round(m, 6) AS error_mean, round(s, 6) AS error_stdev, n >= 20 AND (s <= 0.15 OR m >= 0.4) AND m >= 0.2 AS go FROM a""",
)
def probe_go_nogo(spark, sf):
    rates = R.probe_rates(R.score_probes(probe_spans(spark, sf)))
    agg = R.over_repeats(rates, ["verification_code_required_rate", "confirmation_required_rate"])
    return R.go_nogo(agg).select("missing", "n", F.round("error_mean", 6).alias("error_mean"), F.round("error_stdev", 6).alias("error_stdev"), "go")


@register(
    "task_grid",
    D.with_sql("dom_orders", body="""SELECT kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY kind ORDER BY order_id) AS VARCHAR), 2, '0') AS task_id, order_id, CASE WHEN kind = 'eligible' THEN 'requested' END AS expected_return_status FROM
     (SELECT *, CASE WHEN status = 'delivered' AND (quality_issue OR (delivered_at >= DATE '1998-07-13' AND NOT opened)) THEN 'eligible' WHEN status = 'delivered' THEN 'ineligible' ELSE 'safety' END AS kind FROM dom_orders) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY order_id) <= 10"""),
)
def task_grid(spark, sf):
    return R.task_grid(D.orders(spark, sf), "1998-07-13", 10).select("task_id", "order_id", "expected_return_status")


# --- run logs ------------------------------------------------------------------------------------
RG = "rg AS (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS s, avg(quality) AS m, var_pop(quality) AS v FROM labels JOIN documents USING (doc_id) GROUP BY 1), rc AS (SELECT *, CASE WHEN s = 0 THEN 'all_fail' WHEN s = n THEN 'all_pass' ELSE 'mixed' END AS c FROM rg)"


def rewards(spark, sf):
    j = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return L.reward_groups(j.select("source", F.col("quality").cast("double").alias("reward")), "source")


@register("reward_groups", f'WITH {RG} SELECT source, n, s AS successes, round(m, 6) AS mean_reward, round(v, 6) AS variance, c AS "class" FROM rc')
def reward_groups(spark, sf):
    return rewards(spark, sf).select("source", "n", "successes", F.round("mean_reward", 6).alias("mean_reward"), F.round("variance", 6).alias("variance"), "class")


@register("class_census", f"WITH {RG} SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS simulations, count(*) FILTER (c = 'mixed') AS mixed, count(*) FILTER (c = 'all_fail') AS all_fail, count(*) FILTER (c = 'all_pass') AS all_pass, count(*) FILTER (v > 0) AS non_zero_variance, count(*) FILTER (c <> 'all_fail') AS non_all_zero FROM rc")
def class_census(spark, sf):
    return L.class_census(rewards(spark, sf))


def usage(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", D.event_k())
    m = e.select(
        F.col("user_id").alias("sim"), F.when(F.col("event_type") != "view", F.concat(F.when(F.col("k") % 3 == 0, "Other").otherwise("Model-X"), F.lit("-1"))).alias("model"),
        F.when(F.col("k") % 4 == 0, 0).otherwise(F.floor("value")).alias("prompt_tokens"), F.col("k").alias("completion_tokens"), (F.col("k") + 1).alias("raw_prompt_tokens"), F.lit(None).cast("bigint").alias("raw_completion_tokens"),
        F.col("k").alias("cache_hit"), F.lit(None).cast("bigint").alias("cache_miss"),
    )
    return L.usage_per_simulation(e.select(F.col("user_id").alias("sim")), m, "model")


US = """us AS (SELECT user_id AS sim, count(*) FILTER (hit) AS calls, coalesce(CAST(sum(p) FILTER (hit) AS BIGINT), 0) AS pt, coalesce(CAST(sum(k) FILTER (hit) AS BIGINT), 0) AS ct, coalesce(CAST(sum(k) FILTER (hit) AS BIGINT), 0) AS ch FROM (SELECT user_id, k, event_type <> 'view' AND k % 3 <> 0 AS hit,
  CASE WHEN k % 4 = 0 OR floor(value) = 0 THEN k + 1 ELSE CAST(floor(value) AS BIGINT) END AS p FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)) GROUP BY 1)"""


@register("usage_per_simulation", f"WITH {US} SELECT sim, calls, pt AS prompt_tokens, ct AS completion_tokens, pt + ct AS total_tokens FROM us")
def usage_per_simulation(spark, sf):
    return usage(spark, sf).select("sim", "calls", "prompt_tokens", "completion_tokens", "total_tokens")


@register(
    "usage_distribution",
    f"WITH {US} SELECT sim % 5 AS grp, round(avg(pt + ct), 6) AS mean, round(quantile_cont(pt + ct, 0.5), 6) AS median, round(quantile_cont(pt + ct, 0.9), 6) AS p90 FROM us GROUP BY 1",
)
def usage_distribution(spark, sf):
    d = L.distribution(usage(spark, sf).withColumn("grp", F.col("sim") % 5), ["grp"], "total_tokens")
    return d.select("grp", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90")])


@register(
    "usage_cost",
    f"WITH {US} SELECT r AS rollouts, round(sum(CASE WHEN calls > 0 THEN (ch * 0.1 + ct * 2.0) / 1000000 END) * r / count(*), 6) AS cost_usd FROM us, (SELECT unnest([144, 288]) AS r) GROUP BY 1",
)
def usage_cost(spark, sf):
    return L.projected_cost(usage(spark, sf), L.cost_usd(0.1, 0.5, 2.0), [144, 288]).select("rollouts", F.round("cost_usd", 6).alias("cost_usd"))


@register(
    "time_span",
    "SELECT count(*) AS n, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS span_seconds, round(count(*) / (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6), 6) AS per_second FROM events",
)
def time_span(spark, sf):
    t = L.time_span(D.table(spark, sf, "events").select("ts"), "ts", "ts")
    return t.select("n", F.round("span_seconds", 3).alias("span_seconds"), F.round("per_second", 6).alias("per_second"))


@register(
    "run_totals",
    D.with_sql("dom_sims", body="""SELECT count(*) AS num_simulations, count(*) FILTER (reward = 1) AS passed, count(*) FILTER (termination_reason = 'max_steps') AS infrastructure_errors, round(coalesce(sum(reward), 0) / count(*), 6) AS mean_reward, count(*) FILTER (NOT db_match) AS db_mismatches,
     (SELECT count(*) FROM (SELECT unnest(path) AS p FROM dom_sims) WHERE p IN ('cancel_pending_order', 'return_delivered_order_items')) AS write_action_checks FROM dom_sims"""),
)
def run_totals(spark, sf):
    s = D.simulations(spark, sf)
    checks = s.select(F.explode("path").alias("p")).select(F.when(F.col("p").isin("cancel_pending_order", "return_delivered_order_items"), "write").otherwise("read").alias("tool_type"), F.lit(True).alias("action_match"))
    out = L.run_summary(s.withColumn("termination_reason", F.when(F.col("termination_reason") == "max_steps", "infrastructure_error").otherwise(F.col("termination_reason"))), checks)
    return out.select("num_simulations", "passed", "infrastructure_errors", F.round("mean_reward", 6).alias("mean_reward"), "db_mismatches", "write_action_checks")


@register(
    "config_drift",
    """WITH r AS (SELECT s_suppkey AS run, unnest(['name', 'nation']) AS key, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS v FROM supplier), o AS (SELECT s_suppkey AS run, unnest(['name', 'nation']) AS key, unnest([s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'x' ELSE CAST(s_nationkey AS VARCHAR) END]) AS v FROM supplier)
     SELECT run, key, r.v AS requested, o.v AS observed FROM r JOIN o USING (run, key) WHERE o.v IS NULL OR o.v <> r.v""",
)
def config_drift(spark, sf):
    s = D.table(spark, sf, "supplier")

    def melt(nation):
        return s.select(F.col("s_suppkey").alias("run"), F.explode(F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), nation)).alias("key", "value"))

    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 4
    return L.config_drift(melt(n), melt(F.when(k == 1, "x").when(k != 0, n)))


@register("incomplete_runs", "SELECT o_orderkey AS run, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 4")
def incomplete_runs(spark, sf):
    sims = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"))
    expected = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.lit(2).alias("tasks"), F.lit(2).alias("trials"))
    return L.incomplete_runs(sims, expected).select("run", "n")


@register(
    "systematic_sample",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER () // 40) AS st FROM events) WHERE i % st = 0 AND i / st < 40",
)
def systematic_sample(spark, sf):
    e = D.table(spark, sf, "events").select("event_id")
    return L.systematic_sample(e, ["event_id"], 40, F.floor(F.col("event_id") / 1000)).select("event_id")


@register("label_agreement", "SELECT count(*) AS n, round(avg(CAST(quality = CASE WHEN n_chars % 4 = 0 THEN 0 ELSE 1 END AS INTEGER)), 6) AS agreement FROM labels JOIN documents USING (doc_id)")
def label_agreement(spark, sf):
    h = D.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"))
    a = D.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 4 == 0, 0).otherwise(1).alias("q"))
    return L.agreement(h, a, "doc_id", "q").select("n", F.round("agreement", 6).alias("agreement"))


CENSUS = """cs AS (SELECT lang AS domain, sp AS split, count(*) AS num_tasks, count(*) FILTER (n_chars % 3 = 0) AS db_gated_tasks, count(*) FILTER (n_chars % 5 = 0) AS judge_gated_tasks, CAST(sum(n_chars % 11) AS BIGINT) AS actions_total, avg(n_chars % 11) AS am, max(n_chars % 11) AS actions_max
  FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS sp FROM documents UNION ALL SELECT *, 'all' FROM documents) GROUP BY 1, 2)"""


def census(spark, sf):
    d = D.table(spark, sf, "documents")
    n = F.col("n_chars")
    tasks = d.select(F.col("lang").alias("domain"), F.col("doc_id").alias("task_id"), (n % 5 == 0).alias("judge_gated"), (n % 3 == 0).alias("db_gated"), (n % 11).alias("n_actions"))
    splits = d.select(F.col("doc_id").alias("task_id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    return L.split_census(tasks, splits)


@register("split_census", f"WITH {CENSUS} SELECT domain, split, num_tasks, db_gated_tasks, judge_gated_tasks, actions_total, round(am, 6) AS actions_mean, actions_max FROM cs")
def split_census(spark, sf):
    return census(spark, sf).withColumn("actions_mean", F.round("actions_mean", 6))


@register(
    "token_budget",
    f"""WITH {CENSUS}, q AS (SELECT *, am * 2.0 AS turns, CAST(floor(am * 2.0) AS BIGINT) AS t, greatest(1, CAST(floor(am) AS BIGINT)) AS ut FROM cs)
     SELECT domain, split, CAST(3 * ((1000 * t + 150 * t * (t - 1) / 2) * num_tasks * 4 + (200 * ut + 150 * ut * (ut - 1) / 2) * num_tasks * 4 + (1000 + floor(turns * 150)) * judge_gated_tasks * 4) AS BIGINT) AS prompt_tokens,
      CAST(3 * (t * 50 * num_tasks * 4 + ut * 20 * num_tasks * 4 + 30 * judge_gated_tasks * 4) AS BIGINT) AS output_tokens FROM q""",
)
def token_budget(spark, sf):
    return L.token_budget(census(spark, sf), 4, 3, 1000, 150.0, 2.0, 50, 200, 20, 30)


@register(
    "step_log_problems",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 1 AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1) THEN 'not_contiguous' WHEN l_returnflag = 'A' THEN 'group_count' WHEN l_linestatus = 'F' AND l_suppkey % 2 = 0 THEN 'group_size' WHEN l_suppkey % 9 = 0 THEN 'version_not_refreshed' END AS reason FROM lineitem l) GROUP BY 1",
)
def step_log_problems(spark, sf):
    li = D.table(spark, sf, "lineitem")
    s = li.select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("n_groups"), F.lit(8).alias("max_size"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 2 == 0), 7).otherwise(8).alias("min_size"), F.lit("v1").alias("version_before"), F.when(F.col("l_suppkey") % 9 == 0, "v1").otherwise("v2").alias("version_after"),
    )
    return L.step_problems(s, 2, 8).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "reward_validity",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'truncated' WHEN event_id % 11 = 0 THEN 'not_terminated' WHEN event_type = 'error' THEN 'interaction_error' WHEN event_id % 7 = 0 THEN 'evaluator_error' WHEN event_id % 5 = 0 THEN 'incomplete' WHEN event_id % 4 = 0 THEN 'invalid_reward' WHEN event_id % 3 = 0 THEN 'not_binary' END AS reason FROM events) GROUP BY 1",
)
def reward_validity(spark, sf):
    i = F.col("event_id")
    e = D.table(spark, sf, "events").select(
        (i % 13 == 0).alias("truncated"), (i % 11 != 0).alias("terminated"), (F.col("event_type") == "error").alias("interaction_error"), (i % 7 == 0).alias("evaluator_error"), (i % 5 != 0).alias("run_complete"), F.lit(True).alias("evaluator_ok"),
        F.when(i % 4 == 0, "n/a").when(i % 3 == 0, "0.5").otherwise("1.0").alias("reward"),
    )
    return e.select(L.reward_problem().alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- traces -----------------------------------------------------------------------------------------
def tries(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", D.event_k())
    k = F.col("k")
    one = F.struct(
        F.col("event_id").alias("attempt"), F.when(k % 10 == 0, "generation_error").when(k % 10 == 1, "unknown_tool").when(k % 10 == 2, "unbalanced_json").alias("parse_stage"),
        F.when(k % 10 != 0, F.when(k % 2 == 0, "stop").otherwise("length")).alias("finish_reason"), (k % 8 == 0).alias("truncated"), F.floor("value").alias("prompt_tokens"),
    )
    calls = e.select(F.col("user_id").alias("trajectory_id"), F.col("event_id").alias("step"), F.array(F.struct(F.lit("initial").alias("phase"), F.array(one).alias("attempts"))).alias("traces"))
    return T.attempts(calls)


TRY = "tr AS (SELECT user_id, event_id, event_type, value, k, CASE k % 10 WHEN 0 THEN 'generation_error' WHEN 1 THEN 'unknown_tool' WHEN 2 THEN 'unbalanced_json' END AS stage FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"


@register(
    "trace_histograms",
    f"WITH {TRY} SELECT 'parse_stage' AS kind, stage AS value, count(*) AS n FROM tr WHERE stage IS NOT NULL GROUP BY 2 UNION ALL SELECT 'finish_reason', CASE WHEN stage = 'generation_error' THEN '<generation_error>' WHEN k % 2 = 0 THEN 'stop' ELSE 'length' END, count(*) FROM tr GROUP BY 2",
)
def trace_histograms(spark, sf):
    t = tries(spark, sf)
    return T.histogram(t, "parse_stage", F.col("parse_stage")).unionByName(T.histogram(t, "finish_reason", T.finish_reason()))


@register(
    "trace_diagnosis",
    f"""WITH {TRY}, a AS (SELECT count(*) AS n, count(*) FILTER (k % 3 = 0) AS strict, count(*) FILTER (k % 3 = 1) AS rec, count(*) FILTER (k % 8 = 0) AS tru, count(*) FILTER (stage = 'unknown_tool') AS ill, count(*) FILTER (stage = 'generation_error') AS err FROM tr),
     b AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS re, count(*) FILTER (event_type <> 'error') = 0 AND bool_and(k % 2 = 0) AS fo FROM tr GROUP BY 1), c AS (SELECT count(*) AS nt, count(*) FILTER (fo) AS fo, sum(re) AS re, count(*) FILTER (re > 0) AS wr FROM b)
     SELECT nt AS trajectories, n AS steps, n AS generations, round((strict + rec) / n, 4) AS effective_action_parse_rate, round(strict / n, 4) AS strict_envelope_parse_rate, round(ill / n, 4) AS illegal_tool_rate, round(err / n, 4) AS generation_error_rate, round(tru / n, 4) AS truncation_rate,
      round(fo / nt, 4) AS fallback_only_trajectory_rate, round(re / nt, 4) AS avg_non_fallback_tool_calls FROM a, c""",
)
def trace_diagnosis(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", D.event_k())
    steps = e.select(D.pick(["parsed", "parsed_with_violations", "fallback"], F.col("k")).alias("resolution"))
    tools = e.select(
        F.col("user_id").alias("trajectory_id"), F.when(F.col("event_type") == "error", "escalate_to_human").otherwise(F.col("event_type")).alias("tool"),
        F.when(F.col("k") % 2 == 0, "model_generation_error").otherwise("x").alias("reason"),
    )
    return T.diagnosis(steps, tries(spark, sf), tools).drop("recovered_parse_rate", "trajectories_with_real_tool_call_rate")


@register("trace_samples", f"WITH {TRY} SELECT stage AS parse_stage, event_id AS attempt, row_number() OVER (PARTITION BY stage ORDER BY event_id) AS sample_no FROM tr WHERE stage IS NOT NULL QUALIFY sample_no <= 3")
def trace_samples(spark, sf):
    return T.stage_samples(tries(spark, sf), ["attempt"]).select("parse_stage", "attempt", F.col("sample_no").cast("bigint").alias("sample_no"))


@register(
    "token_stats",
    f"WITH {TRY} SELECT stage AS parse_stage, CAST(min(floor(value)) AS BIGINT) AS min, CAST(max(floor(value)) AS BIGINT) AS max, round(avg(floor(value)), 2) AS mean, list_sort(list(floor(value)))[CAST(floor(count(*) / 2) + 1 AS INTEGER)] AS median FROM tr WHERE stage IS NOT NULL GROUP BY 1",
)
def token_stats(spark, sf):
    return T.token_stats(tries(spark, sf).where(F.col("parse_stage").isNotNull()), "prompt_tokens", ["parse_stage"]).select("parse_stage", F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"), "mean", "median")


RAW_OUTPUTS = [
    ('{"action_type":"final_answer","tool_name":null,"arguments":{},"content":"ok","requires_user_response":false}', None, ""),
    ("no json here", "no_json_object", ""),
    ('{"action_type":"final_answer"', "unbalanced_json", ""),
    ('```json\n{"action_type":"final_answer","tool_name":null,"arguments":{},"content":"a } b","requires_user_response":false}\n```', None, "markdown_fence"),
    ('Sure: {"action_type":"final_answer","arguments":{},"content":"","requires_user_response":false,"x":1}', None, "content_outside_json_object|unknown_envelope_field:x|missing_envelope_field:tool_name"),
    ('{"action_type":"dance"}', "bad_action_type", ""),
    ('{"action_type":"tool_call","tool_name":"fly","arguments":{},"content":"","requires_user_response":false}', "unknown_tool", ""),
    ('{"action_type":"tool_call","tool_name":"get_order","arguments":{"verification_code":123456},"content":"","requires_user_response":false}', "missing_verification_code", ""),
    ('{"action_type":"tool_call","tool_name":"get_product","arguments":{"product_id":"B00X"},"content":"","requires_user_response":false}', "external_product_identifier", ""),
    ('{"action_type":"handoff","tool_name":null,"arguments":{},"content":"","requires_user_response":false}', "handoff_missing_reason", ""),
    ('{"action_type":"final_answer","tool_name":null,"arguments":[1],"content":"","requires_user_response":false}', "arguments_not_object", ""),
    ("   ", "empty_output", ""),
]


@register(
    "action_envelopes",
    "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s, _v) in enumerate(RAW_OUTPUTS) if s) + " END AS parse_stage, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, (_, _s, v) in enumerate(RAW_OUTPUTS)) + " END AS violations FROM events",
)
def action_envelopes(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", D.pick([r for r, _, _ in RAW_OUTPUTS], F.col("event_id")).alias("raw_output"))
    return T.envelope(e, ["get_order", "get_product", "search_catalog"]).select("event_id", "parse_stage", F.array_join("violations", "|").alias("violations"))


@register(
    "native_call_problems",
    "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'content_and_tool_call' WHEN 1 THEN 'empty_output' WHEN 2 THEN 'parallel_tool_calls' WHEN 3 THEN 'missing_tool_name' WHEN 4 THEN 'unknown_tool' WHEN 5 THEN 'tool_arguments_json' WHEN 6 THEN 'tool_arguments_not_object' END AS problem FROM events",
)
def native_call_problems(spark, sf):
    i = F.col("event_id") % 8
    call = lambda n, a: F.struct(F.lit(n).alias("name"), F.lit(a).alias("arguments"))
    calls = (
        F.when(i == 1, F.array().cast("array<struct<name:string,arguments:string>>")).when(i == 2, F.array(call("get_order", "{}"), call("get_order", "{}"))).when(i == 3, F.array(call("", "{}")))
        .when(i == 4, F.array(call("fly", "{}"))).when(i == 5, F.array(call("get_order", "{oops"))).when(i == 6, F.array(call("get_order", "[1]"))).otherwise(F.array(call("get_order", '{"a":1}')))
    )
    return D.table(spark, sf, "events").select("event_id", T.native_call_problem(F.when(i == 0, "hi"), calls, ["get_order"]).alias("problem"))


@register(
    "tagged_calls",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'second' END AS name, CASE event_id % 3 WHEN 0 THEN '{"k":' || event_id || '}' WHEN 1 THEN '{}' END AS arguments, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM events""",
)
def tagged_calls(spark, sf):
    i = F.col("event_id")
    good = F.concat(F.lit('<tool_call>\n{"name": "'), "event_type", F.lit('", "arguments": {"k": '), i.cast("string"), F.lit("}}\n</tool_call>"))
    second = F.lit('<tool_call>{"name":"second","arguments":{}}</tool_call>')
    text = F.when(i % 3 == 0, F.concat(good, second)).when(i % 3 == 1, F.concat(F.lit("<tool_call>{oops</tool_call>"), second)).otherwise("plain text")
    c = T.tagged_calls(text)
    first = F.try_element_at(c, F.lit(1))
    return D.table(spark, sf, "events").select("event_id", first["name"].alias("name"), first["arguments"].alias("arguments"), F.size(c).alias("n"))


@register(
    "turn_messages",
    "SELECT c_custkey, i, CASE i WHEN 0 THEN 'user' WHEN 1 THEN 'tool' ELSE 'user' END AS role, CASE i WHEN 0 THEN c_name || chr(10) || 'more' WHEN 1 THEN '{}' ELSE 'assistant: done' END AS content FROM customer, (SELECT unnest([0, 1, 2]) AS i)",
)
def turn_messages(spark, sf):
    text = F.concat(F.lit("user: "), "c_name", F.lit("\nmore\ntool: {}\nassistant: done"))
    return D.table(spark, sf, "customer").select("c_custkey", F.posexplode(T.turn_messages(text)).alias("i", "m")).select("c_custkey", "i", "m.*")


@register(
    "tool_result_names",
    """WITH e AS (SELECT user_id AS conv, event_id AS pos, event_type AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 5 AS call_id FROM events)
     SELECT r.conv, r.pos, c.t AS name FROM (SELECT * FROM e WHERE t = 'click') r ASOF LEFT JOIN (SELECT * FROM e WHERE t IN ('view', 'purchase')) c ON c.conv = r.conv AND c.call_id = r.call_id AND c.pos < r.pos""",
)
def tool_result_names(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), (D.event_k() % 5).alias("call_id"))
    return T.name_results(e.where(F.col("name") == "click").drop("name"), e.where(F.col("name").isin("view", "purchase"))).select("conv", "pos", "name")


# --- compaction: a user's events as a history -----------------------------------------------------
def history(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", D.event_k())
    t = F.col("event_type")
    tool = F.when(t.isin("click", "purchase"), F.when(F.col("k") % 2 == 0, "get_order_details").otherwise("get_user_details"))
    oid = F.concat(F.lit("O"), (F.col("k") % 6).cast("string"))
    content = F.when(tool == "get_order_details", F.concat(F.lit('{"order_id":"'), oid, F.lit('","status":"pending","memo":"'), F.repeat(F.lit("x"), F.col("k").cast("int")), F.lit('"}'))).when(
        tool == "get_user_details", F.concat(F.lit('{"user_id":"U'), (F.col("k") % 3).cast("string"), F.lit('","name":"n","memo":"zzz"}'))
    ).otherwise(F.repeat(F.lit("m"), F.col("k").cast("int")))
    return e.select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), F.when(tool.isNotNull(), "tool").otherwise("user").alias("role"), tool.alias("tool"), content.alias("content"))


HIST = """h AS (SELECT user_id AS conv, event_id AS pos, k, event_type IN ('click', 'purchase') AS is_tool, CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k % 2 = 0 THEN 'get_order_details' ELSE 'get_user_details' END END AS tool,
   CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k % 2 = 0 THEN 'O' || (k % 6) ELSE 'U' || (k % 3) END END AS ent FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)),
 c AS (SELECT *, CASE WHEN tool = 'get_order_details' THEN length('{"order_id":"O0","status":"pending","memo":""}') + k WHEN is_tool THEN length('{"user_id":"U0","name":"n","memo":"zzz"}') ELSE k END AS raw,
   CASE WHEN tool = 'get_order_details' THEN length('{"status":"pending","order_id":"O0"}') WHEN is_tool THEN length('{"user_id":"U0","name":"n"}') ELSE k END AS full_len,
   CASE WHEN tool = 'get_order_details' THEN length('{"ok":true,"superseded_by_later_read":true,"order_id":"O0"}') ELSE length('{"ok":true,"superseded_by_later_read":true,"user_id":"U0"}') END AS short_len,
   lead(pos) OVER (PARTITION BY conv, tool, ent ORDER BY pos) AS nxt FROM h)"""


@register(
    "compaction_stats",
    f"""WITH {HIST} SELECT conv, CAST(sum(raw) AS BIGINT) AS raw_chars, CAST(sum(CASE WHEN is_tool AND nxt IS NOT NULL THEN short_len ELSE full_len END) AS BIGINT) AS compact_chars, CAST(sum(CASE WHEN is_tool THEN raw ELSE 0 END) AS BIGINT) AS raw_tool_chars, count(*) FILTER (is_tool) AS tool_messages FROM c GROUP BY 1""",
)
def compaction_stats(spark, sf):
    s = K.stats(K.compact_history(history(spark, sf)))
    return s.select("conv", *[F.col(c).cast("bigint").alias(c) for c in ("raw_chars", "compact_chars", "raw_tool_chars")], "tool_messages")


@register("superseded_reads", f"WITH {HIST} SELECT conv, pos, CASE WHEN nxt IS NOT NULL THEN true ELSE false END AS superseded, CASE WHEN nxt IS NOT NULL THEN '{{\"ok\":true,\"superseded_by_later_read\":true,\"' || CASE WHEN tool = 'get_order_details' THEN 'order' ELSE 'user' END || '_id\":\"' || ent || '\"}}' WHEN tool = 'get_order_details' THEN '{{\"status\":\"pending\",\"order_id\":\"' || ent || '\"}}' ELSE '{{\"user_id\":\"' || ent || '\",\"name\":\"n\"}}' END AS compact FROM c WHERE is_tool")
def superseded_reads(spark, sf):
    return K.compact_history(history(spark, sf)).where(F.col("role") == "tool").select("conv", "pos", "superseded", "compact")


@register(
    "prefix_sizes",
    f"""WITH {HIST} SELECT p.conv, p.pos, coalesce(CAST(sum(q.raw) AS BIGINT), 0) AS raw_prefix, coalesce(CAST(sum(CASE WHEN q.is_tool AND q.nxt < p.pos THEN q.short_len ELSE q.full_len END) AS BIGINT), 0) AS compact_prefix FROM c p LEFT JOIN c q ON q.conv = p.conv AND q.pos < p.pos GROUP BY 1, 2""",
)
def prefix_sizes(spark, sf):
    return K.prefix_sizes(K.compact_history(history(spark, sf)), block=2000).select("conv", "pos", "raw_prefix", "compact_prefix")


@register(
    "compaction_report",
    f"""WITH {HIST}, s AS (SELECT conv, sum(raw) AS r, sum(CASE WHEN is_tool AND nxt IS NOT NULL THEN short_len ELSE full_len END) AS m FROM c GROUP BY 1), x AS (SELECT *, 1.0 - CAST(m AS DOUBLE) / r AS red FROM s)
     SELECT count(*) AS conversations, round(avg(red), 6) AS reduction_mean, round(quantile_cont(red, 0.5), 6) AS reduction_p50, round(list_sort(list(red))[CAST(greatest(1, floor(count(*) * 0.95)) AS INTEGER)], 6) AS reduction_p95, round(1.0 - CAST(sum(m) AS DOUBLE) / sum(r), 6) AS character_reduction_ratio FROM x""",
)
def compaction_report(spark, sf):
    r = K.report(K.stats(K.compact_history(history(spark, sf))))
    return r.select("conversations", *[F.round(c, 6).alias(c) for c in ("reduction_mean", "reduction_p50", "reduction_p95", "character_reduction_ratio")])


@register(
    "compaction_losses",
    f"""WITH {HIST}, a AS (SELECT * FROM c WHERE is_tool AND nxt IS NULL) SELECT tool, field, count(*) AS n, count(*) FILTER (field = 'memo') AS lost FROM (SELECT tool, unnest(CASE WHEN tool = 'get_order_details' THEN ['order_id', 'status', 'memo'] ELSE ['user_id', 'name', 'memo'] END) AS field FROM a) GROUP BY 1, 2""",
)
def compaction_losses(spark, sf):
    return K.field_losses(K.compact_history(history(spark, sf)))


def payloads(spark, sf):
    """Tool results over the tables: orders with all their lines, brands with variants, types as searches, policies, failed reads."""
    li, part = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    pid = lambda c: F.format_string("P%05d", c)
    memo = F.lit("not kept").alias("memo")
    # an order's lines are gathered and sorted once, as numbers; the lists are views of them
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", cents("l_tax").alias("tax"), cents("l_extendedprice").alias("price"), pid("l_partkey").alias("pid"))
    of_lines = lambda then: F.transform("ls", then)
    method = lambda x: F.concat(F.lit("card_"), x["l_linenumber"].cast("string")).alias("payment_method_id")
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls")).select(
        "l_orderkey",
        of_lines(lambda x: F.struct(x["pid"].alias("item_id"), x["l_suppkey"].alias("product_id"), memo, x["price"].alias("price"))).alias("items"),
        of_lines(lambda x: F.struct(F.lit("payment").alias("transaction_type"), x["tax"].alias("amount"), memo, method(x))).alias("payment_history"),
        of_lines(lambda x: F.struct(x["l_suppkey"].alias("tracking_id"), F.array(x["pid"]).alias("item_ids"), memo)).alias("fulfillments"),
    )
    orders = D.orders(spark, sf).join(lines, F.col("order_key") == F.col("l_orderkey"))
    order = F.struct("order_id", memo, "user_id", "status", "items", "payment_history", "fulfillments")
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", cents("p_retailprice").alias("price"))))
    variant = F.map_from_entries(F.transform("ps", lambda p: F.struct(pid(p["p_partkey"]), F.struct(pid(p["p_partkey"]).alias("item_id"), memo, p["p_name"].alias("name"), p["price"].alias("price")))))
    hits = F.transform("ps", lambda p: F.struct(pid(p["p_partkey"]).alias("product_id"), p["p_name"].alias("title"), memo, p["p_type"].alias("category"), p["price"].alias("price")))
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text", "lang")
    policies = docs.groupBy(F.floor(F.col("doc_id") / 4).alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "title", "text", "lang"))).alias("policies"))
    ok = F.lit(True).alias("ok")
    return (
        orders.select(F.lit("get_order_details").alias("tool"), F.col("order_id").alias("key"), F.to_json(order).alias("result"))
        .unionByName(part.groupBy("p_brand").agg(listed.alias("ps")).select(F.lit("get_product_details").alias("tool"), F.col("p_brand").alias("key"), F.to_json(F.struct(F.col("p_brand").alias("title"), memo, variant.alias("variants"))).alias("result")))
        .unionByName(part.groupBy("p_type").agg(listed.alias("ps")).select(F.lit("search_catalog").alias("tool"), F.col("p_type").alias("key"), F.to_json(F.struct(ok, hits.alias("items"))).alias("result")))
        .unionByName(policies.select(F.lit("get_policy").alias("tool"), F.col("g").cast("string").alias("key"), F.to_json(F.struct(ok, "policies")).alias("result")))
        .unionByName(orders.where(F.col("order_key") % 37 == 0).select(F.lit("get_order").alias("tool"), F.col("order_id").alias("key"), F.lit('{"ok":false,"error":"order_not_found","memo":1}').alias("result")))
    )


@register(
    "compact_payloads",
    D.with_sql("dom_orders", body="""SELECT tool, key, md5(c) AS digest, length(c) AS chars FROM (
  SELECT 'get_order_details' AS tool, order_id AS key, '{"status":"' || status || '","order_id":"' || order_id || '","user_id":"' || user_id || '","items":[' || items || '],"payment_history":[' || pays || '],"fulfillments":[' || fuls || ']}' AS c
   FROM dom_orders JOIN (SELECT l_orderkey,
      string_agg(printf('{"item_id":"P%05d","product_id":%d,"price":%d}', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (up <= 12) AS items,
      string_agg(printf('{"transaction_type":"payment","amount":%d,"payment_method_id":"card_%d"}', CAST(round(l_tax * 100) AS BIGINT), l_linenumber), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (down <= 4) AS pays,
      string_agg(printf('{"tracking_id":%d,"item_ids":["P%05d"]}', l_suppkey, l_partkey), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS fuls
     FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS up, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS down FROM lineitem) GROUP BY 1) ON l_orderkey = order_key
  UNION ALL SELECT 'get_product_details', p_brand, '{"title":' || to_json(p_brand) || ',"variants":{' || string_agg(printf('"P%05d":{"item_id":"P%05d","name":%s,"price":%d}', p_partkey, p_partkey, to_json(p_name)::VARCHAR, CAST(round(p_retailprice * 100) AS BIGINT)), ',' ORDER BY p_partkey) || '}}'
   FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 24) GROUP BY p_brand
  UNION ALL SELECT 'search_catalog', p_type, '{"ok":true,"items":[' || string_agg(printf('{"product_id":"P%05d","title":%s,"category":%s,"price":%d}', p_partkey, to_json(p_name)::VARCHAR, to_json(p_type)::VARCHAR, CAST(round(p_retailprice * 100) AS BIGINT)), ',' ORDER BY p_partkey) || ']}'
   FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= 12) GROUP BY p_type
  UNION ALL SELECT 'get_policy', CAST(doc_id // 4 AS VARCHAR), '{"ok":true,"policies":[' || string_agg('{"doc_id":' || doc_id || ',"title":' || to_json(source) || ',"text":' || to_json(text[1:800]) || '}', ',' ORDER BY doc_id) || ']}'
   FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) <= 3) GROUP BY doc_id // 4
  UNION ALL SELECT 'get_order', order_id, '{"ok":false,"error":"order_not_found","order":{}}' FROM dom_orders SEMI JOIN lineitem ON l_orderkey = order_key WHERE order_key % 37 = 0)"""),
)
def compact_payloads(spark, sf):
    small = payloads(spark, sf).select("tool", "key", K.compact_payload(F.col("tool"), F.col("result")).alias("c"))
    return small.select("tool", "key", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("chars"))


@register(
    "payload_losses",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS down, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS up FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey),
  p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS t FROM part),
  o AS (SELECT count(DISTINCT l_orderkey) AS n FROM l),
  d AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS i FROM documents),
  ord AS (SELECT count(*) AS n, count(*) FILTER (down > 4) AS early, count(*) FILTER (up > 12) AS late FROM l),
  hit AS (SELECT count(*) AS n, count(*) FILTER (t > 12) AS late FROM p),
  doc AS (SELECT count(*) AS n, count(*) FILTER (i > 3) AS late, count(*) FILTER (i > 3 OR length(text) > 800) AS cut FROM d)
  SELECT tool, field, CAST(n AS BIGINT) AS n, CAST(lost AS BIGINT) AS lost FROM (
   SELECT 'get_order_details' AS tool, unnest(['order_id', 'user_id', 'status']) AS field, n, 0 AS lost FROM o
   UNION ALL SELECT 'get_order_details', 'memo', n, n FROM o
   UNION ALL SELECT 'get_order_details', unnest(['items.item_id', 'items.product_id', 'items.price']), n, late FROM ord
   UNION ALL SELECT 'get_order_details', unnest(['items.memo', 'payment_history.memo', 'fulfillments.memo']), n, n FROM ord
   UNION ALL SELECT 'get_order_details', unnest(['payment_history.transaction_type', 'payment_history.amount', 'payment_history.payment_method_id']), n, early FROM ord
   UNION ALL SELECT 'get_order_details', unnest(['fulfillments.tracking_id', 'fulfillments.item_ids']), n, 0 FROM ord
   UNION ALL SELECT 'get_product_details', 'title', count(DISTINCT p_brand), 0 FROM p
   UNION ALL SELECT 'get_product_details', 'memo', count(DISTINCT p_brand), count(DISTINCT p_brand) FROM p
   UNION ALL SELECT 'search_catalog', 'ok', count(DISTINCT p_type), 0 FROM p
   UNION ALL SELECT 'search_catalog', unnest(['items.product_id', 'items.title', 'items.category', 'items.price']), n, late FROM hit
   UNION ALL SELECT 'search_catalog', 'items.memo', n, n FROM hit
   UNION ALL SELECT 'get_policy', 'ok', count(DISTINCT doc_id // 4), 0 FROM d
   UNION ALL SELECT 'get_policy', unnest(['policies.doc_id', 'policies.title']), n, late FROM doc
   UNION ALL SELECT 'get_policy', 'policies.lang', n, n FROM doc
   UNION ALL SELECT 'get_policy', 'policies.text', n, cut FROM doc
   UNION ALL SELECT 'get_order', unnest(['ok', 'error']), count(DISTINCT l_orderkey), 0 FROM l WHERE l_orderkey % 37 = 0
   UNION ALL SELECT 'get_order', 'memo', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) FROM l WHERE l_orderkey % 37 = 0)""",
)
def payload_losses(spark, sf):
    """Lost values per tool and subfield; a product's variants are named by their ids and stand in compact_payloads."""
    p = payloads(spark, sf)
    h = p.select(F.concat_ws("/", "tool", "key").alias("conv"), F.lit(0).alias("pos"), F.lit("tool").alias("role"), "tool", F.lit(False).alias("superseded"), F.col("result").alias("content"), K.compact_payload(F.col("tool"), F.col("result")).alias("compact"))
    return K.field_losses(h).where(~F.col("field").startswith("variants."))


# --- batch twins of the windowed streams ----------------------------------------------------------
@register(
    "tumbling_calls",
    D.with_sql("dom_calls", body="SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS window_start, tool, count(*) AS calls, round(avg(CAST(NOT ok AS INTEGER)), 6) AS error_rate, round(avg(latency_ms), 6) AS mean_latency_ms FROM dom_calls GROUP BY 1, 2"),
)
def tumbling_calls(spark, sf):
    m = W.call_metrics(D.calls(spark, sf), "1 hour")
    return m.select(F.col("window_start"), "tool", "calls", F.round("error_rate", 6).alias("error_rate"), F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


@register(
    "sliding_calls",
    D.with_sql("dom_calls", body="SELECT time_bucket(INTERVAL 30 MINUTE, started_at) - INTERVAL 30 MINUTE * i AS window_start, tool, count(*) AS calls FROM dom_calls, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2"),
)
def sliding_calls(spark, sf):
    return W.call_metrics(D.calls(spark, sf), "1 hour", "30 minutes").select("window_start", "tool", "calls")


@register(
    "sessions",
    D.with_sql("dom_calls", body="""SELECT user_id, min(started_at) AS session_start, count(*) AS turns, count(DISTINCT tool) AS tools FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started_at, seq) AS s FROM
     (SELECT *, coalesce(started_at - lag(started_at) OVER (PARTITION BY user_id ORDER BY started_at, seq) >= INTERVAL 120 MINUTE, true) AS gap FROM dom_calls)) GROUP BY user_id, s"""),
)
def sessions(spark, sf):
    return W.sessions(D.calls(spark, sf), "user_id", "120 minutes").select("user_id", "session_start", "turns", F.size("tools").cast("bigint").alias("tools"))
