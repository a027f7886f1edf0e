"""Registered progress, audit and dataset queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.canon import hash_split
from shelfmark.operators import audit as A
from shelfmark.operators import dataset as S
from shelfmark.operators import progress as P
from shelfmark.operators.components import connected_components
from shelfmark.plans import domain as D

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


# --- conversation progress: events of a user as a conversation ------------------------
USER_SAYS = ["我要退货 O00000{}", "验证码 123456", "退货原因: 坏了", "不提供", "确认", "不确认", "退货原因：拒绝提供", "你好", "太大了", "确认提交退货"]
ASKS = ["verification_code", "confirmation", "return_reason"]


def progress_events(spark, sf):
    k = D.event_k()
    e = D.table(spark, sf, "events").withColumn("k", k)
    t = F.col("event_type")
    said = D.pick([s.replace("{}", "") for s in USER_SAYS], F.col("k"))
    said = F.when(F.col("k") % 10 == 0, F.concat(said, (F.col("k") % 7).cast("string"))).otherwise(said)
    tool = F.when(t == "click", D.pick(["get_order", "check_return_eligibility"], F.col("k"))).when(
        t == "purchase", F.when(F.col("k") % 37 == 0, "escalate_to_human").otherwise("create_return_request")
    )
    return e.select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.when(t.isin("view", "signup"), "user").when(t == "error", "assistant").otherwise("tool").alias("role"),
        F.when(t.isin("view", "signup"), said).alias("content"),
        F.when((t == "error") & (F.col("k") % 4 != 3), D.pick(ASKS, F.col("k"))).alias("requested_input_type"),
        tool.alias("tool"),
        F.when(tool.isNotNull(), F.col("k") % 5 != 0).alias("ok"),
        F.when(F.col("k") % 25 == 0, "identity_verification_failed").when(F.col("k") % 5 == 0, "other").alias("error"),
        (F.col("k") % 3 != 0).alias("has_order"),
        (F.col("k") % 4 != 1).alias("eligible"),
    )


def facts(spark, sf):
    return P.conversation_facts(progress_events(spark, sf), ["user_id"], "seq", F.floor(F.col("seq") / 2000))


_SAID = "[" + ", ".join("'" + s.replace("{}", "") + "'" for s in USER_SAYS) + "]"
PROGRESS_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS seq, event_type AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
 m AS (SELECT u, seq, k, CASE WHEN t IN ('view', 'signup') THEN 'user' WHEN t = 'error' THEN 'assistant' ELSE 'tool' END AS role,
   CASE WHEN t IN ('view', 'signup') THEN CAST(k % 10 AS INTEGER) END AS s, CASE WHEN t = 'error' AND k % 4 <> 3 THEN ['verification_code', 'confirmation', 'return_reason'][CAST(k % 3 + 1 AS INTEGER)] END AS ask,
   CASE WHEN t = 'click' THEN ['get_order', 'check_return_eligibility'][CAST(k % 2 + 1 AS INTEGER)] WHEN t = 'purchase' THEN CASE WHEN k % 37 = 0 THEN 'escalate_to_human' ELSE 'create_return_request' END END AS tool,
   k % 5 <> 0 AS ok, k % 25 = 0 AS idfail, k % 3 <> 0 AS has_order, k % 4 <> 1 AS elig, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT *, u AS user_id, seq AS event_id FROM e)),
 f AS (SELECT u, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS intent, CAST(NULL AS VARCHAR) AS oid, false AS ver, false AS idv, false AS ld, CAST(NULL AS BOOLEAN) AS el, CAST(NULL AS VARCHAR) AS rs, CAST(NULL AS BOOLEAN) AS cf, false AS cr, CAST(NULL AS VARCHAR) AS bl, false AS ho, CAST(NULL AS VARCHAR) AS rq FROM (SELECT DISTINCT u FROM m)
  UNION ALL SELECT m.u, m.n, m.seq,
   f.intent OR coalesce(role = 'user' AND s IN (0, 2, 6, 9), false),
   CASE WHEN s = 0 THEN 'O00000' || CAST(k % 7 AS VARCHAR) ELSE oid END,
   CASE WHEN s = 1 THEN true WHEN rq = 'verification_code' AND s = 3 THEN false WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN false ELSE ver END,
   CASE WHEN tool IN ('get_order', 'check_return_eligibility') AND ok THEN true WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN false ELSE idv END,
   CASE WHEN tool IN ('get_order', 'check_return_eligibility') AND ok THEN has_order WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN false ELSE ld END,
   CASE WHEN tool = 'check_return_eligibility' AND ok THEN elig WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN NULL ELSE el END,
   CASE WHEN s = 2 THEN '坏了' WHEN s = 6 THEN NULL WHEN rq = 'return_reason' AND s = 3 THEN NULL WHEN rq = 'return_reason' AND role = 'user' AND s <> 5 THEN CASE s WHEN 0 THEN '我要退货 O00000' || CAST(k % 7 AS VARCHAR) WHEN 1 THEN '验证码 123456' WHEN 4 THEN '确认' WHEN 7 THEN '你好' WHEN 8 THEN '太大了' WHEN 9 THEN '确认提交退货' END ELSE rs END,
   CASE WHEN rq = 'confirmation' AND s IN (4, 9) THEN true WHEN rq = 'confirmation' AND s = 5 THEN false WHEN s IN (2, 6) THEN NULL WHEN rq = 'return_reason' AND s = 3 THEN NULL WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN NULL ELSE cf END,
   CASE WHEN tool = 'create_return_request' AND ok THEN true WHEN s = 0 AND oid <> 'O00000' || CAST(k % 7 AS VARCHAR) THEN false ELSE cr END,
   CASE WHEN s = 1 AND bl = 'verification_code_refused' THEN NULL WHEN s = 2 AND bl = 'return_reason_refused' THEN NULL WHEN s = 6 THEN 'return_reason_refused' WHEN rq = 'verification_code' AND s = 3 THEN 'verification_code_refused' WHEN rq = 'return_reason' AND s = 3 THEN 'return_reason_refused'
     WHEN rq = 'return_reason' AND role = 'user' AND s <> 5 AND s <> 2 AND bl = 'return_reason_refused' THEN NULL
     WHEN tool IN ('get_order', 'check_return_eligibility') AND NOT ok AND idfail THEN 'identity_verification_failed' ELSE bl END,
   f.ho OR coalesce(tool = 'escalate_to_human' AND ok, false),
   CASE WHEN role = 'assistant' THEN ask WHEN role = 'user' THEN NULL ELSE rq END
  FROM f JOIN m ON m.u = f.u AND m.n = f.n + 1)"""


@register(
    "conversation_facts",
    PROGRESS_SQL
    + " SELECT u AS user_id, seq, intent AS return_intent, oid AS order_id, ver AS verification_available, idv AS identity_verified, ld AS order_loaded, el AS eligibility, rs AS return_reason, cf AS confirmation, cr AS return_created, bl AS blocked_by, ho AS handed_off FROM f WHERE n > 0",
)
def conversation_facts(spark, sf):
    return facts(spark, sf)


STATE_SQL = """CASE WHEN NOT intent THEN 'not_applicable' WHEN ho THEN 'handed_off' WHEN bl IS NOT NULL THEN 'handoff_required' WHEN oid IS NULL THEN 'read_only' WHEN NOT ver THEN 'identity_required'
  WHEN el IS NULL THEN 'identity_available' WHEN NOT el THEN 'ineligible' WHEN rs IS NULL THEN 'reason_required' WHEN cf IS NULL THEN 'confirmation_required' WHEN NOT cf THEN 'cancelled' WHEN NOT cr THEN 'write_authorized' ELSE 'complete' END"""


@register(
    "task_progress",
    PROGRESS_SQL
    + f""", g AS (SELECT *, {STATE_SQL} AS st FROM f WHERE n > 0) SELECT u AS user_id, seq, st AS guard_state,
     CASE WHEN st IN ('handed_off', 'ineligible', 'cancelled', 'complete') THEN 'final_answer' WHEN st = 'handoff_required' THEN 'handoff' WHEN st = 'read_only' THEN 'ask_user:order_id' WHEN st = 'identity_required' THEN 'ask_user:verification_code'
       WHEN st = 'reason_required' THEN 'ask_user:return_reason' WHEN st = 'confirmation_required' THEN 'ask_user:confirmation' WHEN st = 'identity_available' THEN CASE WHEN ld THEN 'check_return_eligibility' ELSE 'get_order|check_return_eligibility' END
       WHEN st = 'write_authorized' THEN 'create_return_request' ELSE '' END AS allowed,
     CAST(CASE WHEN intent THEN CAST(oid IS NOT NULL AS INTEGER) + CAST(ver AS INTEGER) + CAST(idv AS INTEGER) + CAST(ld AS INTEGER) + CAST(el IS NOT NULL AS INTEGER) + CAST(rs IS NOT NULL AS INTEGER) + CAST(coalesce(cf, false) AS INTEGER) + CAST(cr AS INTEGER) ELSE 0 END AS BIGINT) AS n_completed FROM g""",
)
def task_progress(spark, sf):
    p = P.progress(facts(spark, sf))
    return p.select("user_id", "seq", "guard_state", F.array_join("allowed_next_actions", "|").alias("allowed"), F.size("completed").cast("bigint").alias("n_completed"))


@register(
    "action_constraint",
    PROGRESS_SQL
    + f""", g AS (SELECT *, {STATE_SQL} AS st FROM f WHERE n > 0), a AS (SELECT seq, st, ld, ['final_answer', 'get_order', 'create_return_request', 'handoff', 'ask_user:confirmation'][CAST(seq % 5 + 1 AS INTEGER)] AS act,
      CASE WHEN st IN ('handed_off', 'ineligible', 'cancelled', 'complete') THEN ['final_answer'] WHEN st = 'handoff_required' THEN ['handoff'] WHEN st = 'read_only' THEN ['ask_user:order_id'] WHEN st = 'identity_required' THEN ['ask_user:verification_code']
       WHEN st = 'reason_required' THEN ['ask_user:return_reason'] WHEN st = 'confirmation_required' THEN ['ask_user:confirmation'] WHEN st = 'identity_available' THEN CASE WHEN ld THEN ['check_return_eligibility'] ELSE ['get_order', 'check_return_eligibility'] END
       WHEN st = 'write_authorized' THEN ['create_return_request'] END AS al FROM g),
      d AS (SELECT seq, al IS NULL OR list_contains(al, act) AS free, len(al) = 1 AND (starts_with(al[1], 'ask_user:') OR al[1] IN ('final_answer', 'handoff')) AS can, al FROM a)
     SELECT seq, free OR can AS accepted, NOT free AND can AS remapped, NOT free AND NOT can AS fail_closed, CAST(CASE WHEN al IS NULL THEN NULL ELSE 16 - len(al) END AS BIGINT) AS n_forbidden FROM (SELECT seq, free, coalesce(can, false) AS can, al FROM d)""",
)
def action_constraint(spark, sf):
    c = P.contract(P.progress(facts(spark, sf)))
    acts = c.withColumn("action", D.pick(["final_answer", "get_order", "create_return_request", "handoff", "ask_user:confirmation"], F.col("seq"))).withColumn("content", F.lit("x"))
    return P.constrain(acts).select("seq", "accepted", "remapped", "fail_closed", F.size("forbidden_actions").cast("bigint").alias("n_forbidden"))


@register(
    "refusals_and_requests",
    """SELECT c_custkey, c_custkey % 6 IN (0, 1) AS reason_refused, c_custkey % 6 IN (0, 2) AS code_refused, CASE c_custkey % 5 WHEN 0 THEN 'verification_code' WHEN 1 THEN 'return_reason' WHEN 2 THEN 'confirmation' WHEN 3 THEN 'order_id' END AS requested FROM customer""",
)
def refusals_and_requests(spark, sf):
    k = F.col("c_custkey")
    said = D.pick(["不提供。", "我不想说明退货原因", "拒绝提供验证码", "好的", "原因是坏了", "hello"], k)
    q = D.pick(["请提供六位数字", "请告知退货原因", "Please confirm the order", "请给出订单号", "稍等"], k)
    return D.table(spark, sf, "customer").select(
        "c_custkey", P.reason_refused(said).alias("reason_refused"), P.code_refused(said).alias("code_refused"), P.requested_input(q).alias("requested")
    )


@register(
    "action_keys",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'handoff' WHEN 2 THEN 'ask_user:' || CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'order_id' END ELSE 'final_answer' END AS key FROM events",
)
def action_keys(spark, sf):
    i = F.col("event_id")
    kind = D.pick(["tool_call", "handoff", "final_answer", "final_answer"], i)
    return D.table(spark, sf, "events").select(
        "event_id", P.action_key(kind, F.col("event_type"), i % 4 == 2, F.when(i % 3 != 0, "order_id")).alias("key")
    )


@register(
    "intent_rules",
    """SELECT c_custkey, ['get_policy', 'ask:order_id', 'ask:code', 'get_order', 'check_return_eligibility', 'compare_products', 'get_policy', 'search_catalog'][CAST(c_custkey % 8 + 1 AS INTEGER)] AS intent,
     ['return', 'shipping', 'return', 'return', 'refund', 'return', 'warranty', 'return'][CAST(c_custkey % 8 + 1 AS INTEGER)] AS policy_type FROM customer""",
)
def intent_rules(spark, sf):
    text = D.pick(["退换货政策", "我的物流呢", "看 O000001", "O000001 验证码 654321", "O000001 654321 退款", "P00001 和 P00002 哪个好", "保修多久", "找耳机"], F.col("c_custkey"))
    return D.table(spark, sf, "customer").select("c_custkey", P.intent(text).alias("intent"), P.policy_type(text).alias("policy_type"))


# --- process audit: a user's events as a simulation --------------------------------------
def audit_messages(spark, sf):
    k = D.event_k()
    e = D.table(spark, sf, "events").withColumn("k", k)
    t, kk = F.col("event_type"), F.col("k")
    oid = F.concat(F.lit("O"), (kk % 5).cast("string"))
    write = D.pick(["modify_user_address", "cancel_pending_order", "return_delivered_order_items"], kk)
    name = (
        F.when(t == "signup", "find_user_id_by_email")
        .when(t == "view", F.when(kk % 4 == 0, "get_user_details").otherwise("get_order_details"))
        .when(t == "purchase", write)
    )
    args = F.when(name.isin("get_user_details", "modify_user_address"), F.create_map(F.lit("user_id"), F.lit("U1"))).when(
        name == "find_user_id_by_email", F.create_map(F.lit("email"), F.lit("x"))
    ).otherwise(F.create_map(F.lit("order_id"), oid))
    said = F.when(kk % 3 == 0, "yes, go ahead").when(kk % 3 == 2, "hello")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sim"),
        F.col("event_id").alias("pos"),
        F.when(t == "click", "tool").when((t == "error") & (kk % 3 != 1), "user").otherwise("assistant").alias("role"),
        F.when((t == "error") & (kk % 3 == 1), F.concat(F.lit("Please confirm order "), oid)).when(t == "error", said).alias("content"),
        ((t == "click") & (kk % 10 == 0)).alias("error"),
        F.when(name.isNotNull(), F.array(F.struct(name.alias("name"), args.alias("args")))).alias("calls"),
    )


AUDIT_SQL = """WITH e AS (SELECT 'u' || user_id AS sim, event_id AS pos, event_type AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
 m AS (SELECT *, 'O' || (k % 5) AS oid, CASE WHEN t = 'signup' THEN 'find_user_id_by_email' WHEN t = 'view' THEN CASE WHEN k % 4 = 0 THEN 'get_user_details' ELSE 'get_order_details' END
   WHEN t = 'purchase' THEN ['modify_user_address', 'cancel_pending_order', 'return_delivered_order_items'][CAST(k % 3 + 1 AS INTEGER)] END AS name FROM e),
 c AS (SELECT *, sum(CAST(name IS NOT NULL AS INTEGER)) OVER w AS c, sum(CAST(t = 'click' AS INTEGER)) OVER w AS r FROM m WINDOW w AS (PARTITION BY sim ORDER BY pos)),
 q AS (SELECT *, greatest(0, coalesce(max(CASE WHEN t = 'click' THEN r - c END) OVER (PARTITION BY sim ORDER BY pos), 0)) AS lost, greatest(0, coalesce(max(CASE WHEN t = 'click' THEN r - c END) OVER (PARTITION BY sim ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lost0 FROM c),
 call AS (SELECT sim, pos, name, c AS ord, CASE WHEN name IN ('get_user_details', 'modify_user_address') THEN 'U1' WHEN name = 'find_user_id_by_email' THEN 'unknown' ELSE oid END AS target FROM q WHERE name IS NOT NULL),
 res AS (SELECT sim, pos AS rpos, r - lost AS ord, k % 10 = 0 AS err FROM q WHERE t = 'click' AND lost = lost0),
 done AS (SELECT call.*, rpos, err FROM call JOIN res USING (sim, ord)),
 au AS (SELECT sim, min(rpos) AS a FROM done WHERE NOT err AND name = 'find_user_id_by_email' GROUP BY 1),
 ur AS (SELECT sim, min(rpos) AS a FROM done WHERE NOT err AND name = 'get_user_details' GROUP BY 1),
 rd AS (SELECT sim, target, min(rpos) AS a FROM done WHERE NOT err AND name = 'get_order_details' GROUP BY 1, 2),
 cf AS (SELECT q.sim, q.pos, q.t, q.k, CASE WHEN t = 'error' AND k % 3 = 1 THEN CASE WHEN rd.a < q.pos THEN q.oid ELSE 'none' END END AS asked FROM q LEFT JOIN rd ON rd.sim = q.sim AND rd.target = q.oid),
 pe AS (SELECT *, last_value(asked IGNORE NULLS) OVER (PARTITION BY sim ORDER BY pos) AS pend FROM cf),
 bo AS (SELECT *, last_value(CASE WHEN t = 'error' AND k % 3 <> 1 THEN k % 3 = 0 END IGNORE NULLS) OVER (PARTITION BY sim ORDER BY pos) AS yes,
   last_value(CASE WHEN t = 'error' AND k % 3 = 0 THEN coalesce(pend, 'none') END IGNORE NULLS) OVER (PARTITION BY sim ORDER BY pos) AS bound FROM pe),
 wr AS (SELECT call.*, au.a AS auth, ur.a AS uread, rd.a AS oread, yes, bound, row_number() OVER (PARTITION BY call.sim, name, call.target ORDER BY call.pos) AS rep FROM call LEFT JOIN au USING (sim) LEFT JOIN ur USING (sim) LEFT JOIN rd ON rd.sim = call.sim AND rd.target = call.target JOIN bo ON bo.sim = call.sim AND bo.pos = call.pos
   WHERE name IN ('modify_user_address', 'cancel_pending_order', 'return_delivered_order_items')),
 v AS (SELECT sim, 'unmatched_tool_result' AS violation FROM q WHERE t = 'click' AND lost > lost0
  UNION ALL SELECT sim, 'tool_error' FROM done WHERE err
  UNION ALL SELECT call.sim, 'private_read_before_successful_authentication' FROM call LEFT JOIN au USING (sim) WHERE name IN ('get_order_details', 'get_user_details') AND coalesce(au.a > pos, true)
  UNION ALL SELECT sim, 'write_before_successful_authentication' FROM wr WHERE coalesce(auth > pos, true)
  UNION ALL SELECT sim, 'write_without_successful_required_read' FROM wr WHERE name = 'modify_user_address' AND coalesce(uread > pos, true)
  UNION ALL SELECT sim, 'write_without_successful_target_read' FROM wr WHERE name <> 'modify_user_address' AND coalesce(oread > pos, true)
  UNION ALL SELECT sim, 'write_without_explicit_confirmation' FROM wr WHERE NOT coalesce(yes, false)
  UNION ALL SELECT sim, 'confirmation_not_bound_to_write_target' FROM wr WHERE coalesce(yes, false) AND coalesce(bound, 'none') <> target
  UNION ALL SELECT sim, 'repeated_write_attempt' FROM wr WHERE rep > 1
  UNION ALL SELECT sim, 'missing_tool_result' FROM q GROUP BY sim HAVING max(c) > max(r - lost))"""


@register("process_audit", AUDIT_SQL + " SELECT sim, violation, count(*) AS n FROM v GROUP BY 1, 2")
def process_audit(spark, sf):
    return A.audit(audit_messages(spark, sf), block_size=2000).groupBy("sim", "violation").agg(F.count(F.lit(1)).alias("n"))


@register(
    "audit_summary",
    AUDIT_SQL
    + """, d AS (SELECT DISTINCT sim, violation FROM v), s AS (SELECT DISTINCT sim FROM m) SELECT 'total' AS item, count(*) AS n FROM s UNION ALL SELECT 'violation:' || violation, count(*) FROM d GROUP BY 1
     UNION ALL SELECT CASE WHEN x IS NULL THEN 'process_compliant' ELSE 'noncompliant' END, count(*) FROM (SELECT s.sim, dd.sim AS x FROM s LEFT JOIN (SELECT DISTINCT sim FROM d) dd USING (sim)) GROUP BY 1""",
)
def audit_summary(spark, sf):
    m = audit_messages(spark, sf)
    return A.audit_summary(A.verdicts(m, A.audit(m, block_size=2000)))


# --- dataset -------------------------------------------------------------------------------
_W = "['cancel_pending_order', 'exchange_delivered_order_items', 'modify_pending_order_address', 'modify_pending_order_items', 'modify_pending_order_payment', 'modify_user_address', 'return_delivered_order_items']"
FAMILY = f"coalesce([p FOR p IN path IF list_contains({_W}, p)][-1], CASE WHEN list_contains(path, 'transfer_to_human_agents') THEN 'handoff' ELSE 'read_or_clarify' END)"
SIG = f"""sha256('{{"behavior_family":"' || {FAMILY} || '","has_handoff":' || CAST(list_contains(path, 'transfer_to_human_agents') AS VARCHAR) || ',"has_write":' || CAST(list_has_any(path, {_W}) AS VARCHAR)
  || ',"tool_count":' || len(path) || ',"tool_path":[' || array_to_string(['"' || p || '"' FOR p IN path], ',') || ']}}')"""
SIMS = D.with_sql("dom_sims", body="").rstrip() + f", sg AS (SELECT *, {SIG} AS sig FROM dom_sims)"


def sims(spark, sf):
    return D.simulations(spark, sf).withColumn("signature_hash", S.structure_signature("path"))


@register("structure_signature", SIMS + f" SELECT simulation_id, sig AS signature_hash, {FAMILY} AS family FROM sg")
def structure_signature(spark, sf):
    return sims(spark, sf).select("simulation_id", "signature_hash", S.behavior_family("path").alias("family"))


@register(
    "hash_split",
    SIMS + " SELECT simulation_id, CASE WHEN CAST('0x' || sig[1:8] AS BIGINT) % 100 < 80 THEN 'train' WHEN CAST('0x' || sig[1:8] AS BIGINT) % 100 < 90 THEN 'dev' ELSE 'held_out' END AS split FROM sg",
)
def split_by_hash(spark, sf):
    return sims(spark, sf).select("simulation_id", hash_split("signature_hash").alias("split"))


@register(
    "structure_split",
    SIMS
    + """, u AS (SELECT sig, row_number() OVER (ORDER BY sha256('split-v1:' || sig)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT sig FROM sg)),
     e AS (SELECT *, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS e FROM u) SELECT sig AS signature_hash, CASE WHEN n < 3 THEN 'train' WHEN rn <= e THEN 'dev' WHEN rn <= 2 * e THEN 'held_out' ELSE 'train' END AS split FROM e""",
)
def structure_split(spark, sf):
    return S.structure_splits(sims(spark, sf))


REASON = """CASE WHEN coalesce(reward, 0) <> 1 THEN 'official_reward_not_1' WHEN NOT coalesce(db_match, true) THEN 'db_mismatch' WHEN termination_reason NOT IN ('user_stop', 'agent_stop') THEN 'termination:' || termination_reason
  WHEN compliant IS NULL THEN 'missing_process_audit' WHEN NOT compliant THEN 'process_noncompliant' WHEN len(path) = 0 THEN 'no_tool_calls' END"""


def judged(spark, sf):
    s = sims(spark, sf).withColumn("conversion_reason", F.lit(None).cast("string")).withColumn("n_tool_calls", F.size("path"))
    return S.rejection_reasons(s, "doc_id")


@register("rejection_waterfall", SIMS + f" SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM sg) WHERE reason IS NOT NULL GROUP BY 1")
def rejection_waterfall(spark, sf):
    return S.rejection_histogram(judged(spark, sf))


@register(
    "duplicate_rejection",
    "SELECT simulation_id, ord, CASE WHEN ord <> min(ord) OVER (PARTITION BY simulation_id) THEN 'missing_or_duplicate_simulation_id' WHEN q <> 1 THEN 'official_reward_not_1' END AS reason FROM (SELECT 'S' || user_id AS simulation_id, event_id AS ord, event_id % 2 AS q FROM events)",
)
def duplicate_rejection(spark, sf):
    e = D.table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("simulation_id"), F.col("event_id").alias("ord"), F.lit("t").alias("task_id"),
        (F.col("event_id") % 2).cast("double").alias("reward"), F.lit(True).alias("db_match"), F.lit("user_stop").alias("termination_reason"), F.lit(True).alias("compliant"),
        F.lit(None).cast("string").alias("conversion_reason"), F.lit(1).alias("n_tool_calls"),
    )
    return S.rejection_reasons(e, "ord").select("simulation_id", "ord", "reason")


@register(
    "double_cap_nested",
    SIMS
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY doc_id) AS a FROM sg QUALIFY a <= 3) SELECT simulation_id, task_id FROM t QUALIFY row_number() OVER (PARTITION BY domain ORDER BY doc_id) <= 8""",
)
def double_cap_nested(spark, sf):
    s = sims(spark, sf).withColumn("signature_hash", F.col("domain"))  # one frozen structure per task
    return S.double_cap_nested(s, "doc_id").select("simulation_id", "task_id")


@register(
    "double_cap_general",
    SIMS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, o AS (SELECT simulation_id, task_id, sig, row_number() OVER (ORDER BY doc_id, simulation_id) AS n FROM sg),
     st AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS simulation_id, []::VARCHAR[] AS tasks, []::VARCHAR[] AS sigs, false AS kept
       UNION ALL SELECT n, simulation_id, CASE WHEN ok THEN list_append(tasks, task_id) ELSE tasks END, CASE WHEN ok THEN list_append(sigs, sig) ELSE sigs END, ok
       FROM (SELECT o.*, tasks, sigs, len(list_filter(tasks, lambda x: x = o.task_id)) < 3 AND len(list_filter(sigs, lambda x: x = o.sig)) < 8 AS ok FROM st JOIN o ON o.n = st.n + 1))
     SELECT o.simulation_id, o.task_id, o.sig AS signature_hash FROM st JOIN o USING (n) WHERE kept""",
)
def double_cap_general(spark, sf):
    return S.double_cap(sims(spark, sf), "doc_id").select("simulation_id", "task_id", "signature_hash")


@register(
    "components",
    SIMS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, ed AS (SELECT DISTINCT 'task:' || task_id AS a, 'structure:' || sig AS b FROM sg), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
     r(node, label) AS (SELECT a, a FROM bo UNION SELECT bo.b, r.label FROM r JOIN bo ON bo.a = r.node)
     SELECT node, min(label) AS component FROM r GROUP BY 1""",
)
def components(spark, sf):
    s = sims(spark, sf)
    return connected_components(
        s.select(F.concat(F.lit("task:"), "task_id").alias("a"), F.concat(F.lit("structure:"), "signature_hash").alias("b"))
    )


def isolated_records(spark, sf):
    """Simulations by family of their documents: every ten documents share tasks and structures among themselves only."""
    own = F.floor(F.col("doc_id") / (1 + F.col("doc_id") % 3) / 10).cast("string")
    return sims(spark, sf).select(
        "simulation_id", "doc_id", F.concat_ws("#", "task_id", own).alias("task_id"), F.concat_ws("#", "signature_hash", own).alias("signature_hash")
    )


ISOLATED = SIMS.replace("WITH ", "WITH RECURSIVE ", 1) + """, own AS (SELECT *, CAST(CAST(floor(doc_id / (1 + doc_id % 3) / 10) AS BIGINT) AS VARCHAR) AS g FROM sg),
     rec AS (SELECT simulation_id, doc_id, task_id || '#' || g AS task_id, sig || '#' || g AS sig FROM own),
     ed AS (SELECT DISTINCT 'task:' || task_id AS a, 'structure:' || sig AS b FROM rec), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
     r(node, label) AS (SELECT a, a FROM bo UNION SELECT bo.b, r.label FROM r JOIN bo ON bo.a = r.node),
     lab AS (SELECT node, min(label) AS component FROM r GROUP BY 1), pl AS (SELECT rec.*, component FROM rec JOIN lab ON node = 'task:' || task_id),
     sz AS (SELECT component, count(*) AS size, sha256('["' || string_agg(simulation_id, '","' ORDER BY simulation_id) || '"]') AS h FROM pl GROUP BY 1),
     od AS (SELECT component, row_number() OVER (ORDER BY abs(size - (SELECT greatest(1, round_even(count(*) * 0.1, 0)) FROM pl)), h) AS i, count(*) OVER () AS n FROM sz),
     spl AS (SELECT pl.*, CASE WHEN n < 3 OR i > 2 THEN 'train' WHEN i = 1 THEN 'dev' ELSE 'held_out' END AS split FROM pl JOIN od USING (component))"""


@register("isolated_split", ISOLATED + " SELECT simulation_id, component, split FROM spl")
def isolated_split(spark, sf):
    return S.isolated_splits(isolated_records(spark, sf).drop("doc_id"))


@register(
    "leakage_check",
    ISOLATED + """, moved AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN 'dev' ELSE split END AS split) FROM spl),
     k AS (SELECT split, 'task:' || task_id AS key FROM moved UNION ALL SELECT split, 'structure:' || sig FROM moved)
     SELECT key, count(DISTINCT split) AS splits FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def leakage_check(spark, sf):
    """The isolated splits with every fiftieth record moved to dev: what leaks by that."""
    s = isolated_records(spark, sf)
    placed = s.join(S.isolated_splits(s.drop("doc_id")).select("simulation_id", "split"), "simulation_id")
    return S.leaks(placed.withColumn("split", F.when(F.col("doc_id") % 50 == 0, "dev").otherwise(F.col("split"))))


@register(
    "leakage_found",
    SIMS + """, k AS (SELECT split, 'task:' || task_id AS key FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'dev' END AS split FROM sg) UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'dev' END, 'structure:' || sig FROM sg)
     SELECT key, count(DISTINCT split) AS splits FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def leakage_found(spark, sf):
    return S.leaks(sims(spark, sf).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("dev")))


@register(
    "dataset_manifest",
    SIMS + " SELECT split, count(*) AS records, count(DISTINCT task_id) AS tasks, count(DISTINCT sig) AS structures FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM sg) GROUP BY ROLLUP (split)",
)
def dataset_manifest(spark, sf):
    return S.manifest(sims(spark, sf).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "dev").otherwise("train")))


@register(
    "split_override",
    "SELECT doc_id, CASE WHEN source = 'src1' THEN 'held_out' WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents",
)
def split_override(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.col("source").alias("task_id"), F.when(F.col("doc_id") % 10 == 0, "dev").otherwise("train").alias("split"))
    fixed = d.where(F.col("task_id") == "src1").select("task_id").distinct().withColumn("split", F.lit("held_out"))
    return S.override_splits(d, fixed).select("doc_id", "split")


def conversations(spark, sf):
    """One row per conversation; a conversation of the table holds few turns and becomes one record."""
    c = D.table(spark, sf, "conversations")
    call = F.when(F.length("text") % 3 == 0, F.array(F.struct(F.lit("get_order").alias("name"), F.when(F.length("text") % 9 == 0, "[1]").otherwise('{"a": 1}').alias("arguments"))))
    content = F.when((F.col("role") == "assistant") & (F.length("text") % 3 == 0) & (F.length("text") % 2 == 0), "").otherwise(F.col("text"))
    return c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content"), F.lit(False).alias("error"), F.when(F.col("role") == "assistant", call).alias("tool_calls")))).alias("messages")
    )


@register(
    "conversion_reasons",
    """WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) % 3 = 0 AND (length(text) % 2 = 1 AND text <> '') THEN 'assistant_content_and_tool_call'
       WHEN role = 'assistant' AND length(text) % 3 = 0 AND length(text) % 9 = 0 THEN 'tool_arguments_not_object' WHEN role = 'assistant' AND text = '' THEN 'empty_assistant_message' END AS r FROM conversations)
     SELECT conv_id, arg_min(r, turn) FILTER (r IS NOT NULL) AS reason FROM b GROUP BY 1""",
)
def conversion_reasons(spark, sf):
    return conversations(spark, sf).select("conv_id", S.conversion_reason("messages").alias("reason"))


@register(
    "converted_roles",
    """SELECT conv_id, count(*) FILTER (role = 'user') AS users, CAST(sum(CASE WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tool_calls,
     CAST(sum(CASE WHEN role = 'assistant' AND NOT (length(text) % 3 = 0 AND length(text) % 2 = 0) AND text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS assistants FROM conversations GROUP BY 1""",
)
def converted_roles(spark, sf):
    m = conversations(spark, sf).select("conv_id", S.converted_messages("messages").alias("m"))

    def n(role):
        return F.size(F.filter("m", lambda x: x["role"] == role)).cast("bigint")

    return m.select("conv_id", n("user").alias("users"), n("tool_call").alias("tool_calls"), n("assistant").alias("assistants"))


@register(
    "record_validation",
    """SELECT problem, count(*) AS n FROM (SELECT conv_id, CASE WHEN arg_min(role, turn) <> 'system' THEN 'system_not_first' WHEN conv_id % 5 = 0 THEN 'no_tools' WHEN conv_id % 7 = 0 THEN 'split_mismatch' WHEN conv_id % 3 = 0 THEN 'reward_not_1' END AS problem FROM conversations GROUP BY 1) GROUP BY 1""",
)
def record_validation(spark, sf):
    c = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    k = F.col("conv_id")
    call, response = F.array(F.struct(F.lit("tool_call").alias("role"))), F.array(F.struct(F.lit("tool_response").alias("role")))
    r = c.select(
        "conv_id",
        F.concat(F.transform("m", lambda x: F.struct(x["role"].alias("role"))), call, response).alias("messages"),
        F.when(k % 5 == 0, "[]").otherwise('[{"name":"x"}]').alias("tools"),
        F.struct(
            F.when(k % 7 == 0, "dev").otherwise("train").alias("split"), F.when(k % 3 == 0, 0.0).otherwise(1.0).alias("official_reward"),
            F.lit("v1").alias("process_audit_version"), F.lit("h").alias("signature_hash"),
        ).alias("provenance"),
    )
    return r.select(S.record_problem("train").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@register(
    "loss_mask",
    "SELECT conv_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END) AS BIGINT) AS trained FROM conversations GROUP BY 1",
)
def loss_mask(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id", S.loss_mask(F.array(F.struct("role", F.split("text", " ", -1).alias("token_ids")))).alias("mask"))
    return c.groupBy("conv_id").agg(
        F.sum(F.size("mask")).cast("bigint").alias("tokens"), F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).cast("bigint").alias("trained")
    )
