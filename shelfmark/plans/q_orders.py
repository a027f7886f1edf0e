"""Registered order queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import order_log as L
from shelfmark.operators import orders as O
from shelfmark.operators import tool_schemas as TS
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


AS_OF = D.AS_OF
GUARD = "(CASE WHEN NOT regexp_full_match(c.verification_code, '[0-9]{6}') THEN 'verification_code_required' END)"
VUSER = "(CASE WHEN u.verification_code IS NULL OR u.verification_code <> c.verification_code THEN 'identity_verification_failed' END)"
VORDER = f"coalesce({VUSER}, CASE WHEN o.user_id IS NULL OR o.user_id <> c.user_id THEN 'order_ownership_mismatch' END)"
REASON = f"""(CASE WHEN o.status <> 'delivered' THEN 'order_not_delivered' WHEN o.quality_issue THEN 'quality_issue'
   WHEN DATE '{AS_OF}' - o.delivered_at <= 7 AND NOT o.opened THEN 'seven_day_return' ELSE 'return_window_expired_or_opened' END)"""
REFUSED = f"(CASE WHEN {REASON} NOT IN ('quality_issue', 'seven_day_return') THEN {REASON} END)"
UNCONF = "(CASE WHEN NOT c.confirmed THEN 'confirmation_required' END)"
JOINED = f"""j AS (SELECT c.*, o.status, o.return_status, o.payment_method_id AS order_payment, o.product_id, u.payment_methods,
  {REASON} AS rr, coalesce({GUARD}, CASE
    WHEN tool IN ('get_order', 'check_return_eligibility') THEN {VORDER}
    WHEN tool = 'modify_user_address' THEN coalesce({VUSER}, {UNCONF})
    WHEN tool IN ('create_return_request', 'return_delivered_order_items') THEN coalesce({VORDER}, {REFUSED}, {UNCONF})
    WHEN tool = 'cancel_pending_order' THEN coalesce({VORDER}, CASE WHEN c.reason NOT IN ('no longer needed', 'ordered by mistake') THEN 'invalid_cancel_reason' END, {UNCONF})
    WHEN tool LIKE 'modify_pending%' THEN coalesce({VORDER}, {UNCONF}, CASE WHEN o.status <> 'pending' THEN 'order_not_pending' END)
    WHEN tool LIKE 'exchange%' THEN coalesce({VORDER}, {UNCONF}, CASE WHEN o.status <> 'delivered' THEN 'order_not_delivered' END) END) AS static
  FROM dom_commands c LEFT JOIN dom_users u ON c.user_id = u.user_id LEFT JOIN dom_orders o ON c.order_id = o.order_id)"""
BASE = D.with_sql("dom_orders", "dom_commands", "dom_users", body="").rstrip() + ",\n" + JOINED
OUT = "error IS NULL AS ok, coalesce(changed AND error IS NULL, false) AS changed, coalesce(NOT changed AND error IS NULL, false) AS idempotent_replay, error"


def joined(spark, sf):
    return O.with_records(D.commands(spark, sf), D.orders(spark, sf), D.users(spark, sf))


@register(
    "identity_guard",
    D.with_sql("dom_orders", "dom_commands", body="SELECT tool, NOT regexp_full_match(verification_code, '[0-9]{6}') AS blocked, count(*) AS n FROM dom_commands GROUP BY 1, 2"),
)
def identity_guard(spark, sf):
    c = D.commands(spark, sf).withColumn("blocked", O.bad_code(F.col("tool"), F.col("verification_code")))
    return c.groupBy("tool", "blocked").agg(F.count(F.lit(1)).alias("n"))


@register("verified_order", BASE + f" SELECT c.seq, {VORDER} AS error, CASE WHEN {VORDER} IS NULL THEN o.status END AS status FROM dom_commands c LEFT JOIN dom_users u ON c.user_id = u.user_id LEFT JOIN dom_orders o ON c.order_id = o.order_id WHERE tool = 'get_order'")
def verified_order(spark, sf):
    e = O.verify_order()
    return joined(spark, sf).where(F.col("tool") == "get_order").select("seq", e.alias("error"), F.when(e.isNull(), F.col("status")).alias("status"))


@register("verified_user", BASE + f" SELECT c.seq, {VUSER} AS error FROM dom_commands c LEFT JOIN dom_users u ON c.user_id = u.user_id")
def verified_user(spark, sf):
    return joined(spark, sf).select("seq", O.verify_user().alias("error"))


@register(
    "return_eligibility",
    BASE
    + f""" SELECT c.seq, {VORDER} AS error, CASE WHEN {VORDER} IS NULL THEN {REASON} IN ('quality_issue', 'seven_day_return') ELSE false END AS eligible,
    CASE WHEN {VORDER} IS NULL THEN {REASON} END AS reason, CASE WHEN {VORDER} IS NULL AND o.status = 'delivered' THEN CAST(DATE '{AS_OF}' - o.delivered_at AS BIGINT) END AS days
    FROM dom_commands c LEFT JOIN dom_users u ON c.user_id = u.user_id LEFT JOIN dom_orders o ON c.order_id = o.order_id""",
)
def return_eligibility(spark, sf):
    return O.check_eligibility(joined(spark, sf), AS_OF).select(
        "seq", "error", "eligible", F.col("return_reason_code").alias("reason"), F.col("days_since_delivery").cast("bigint").alias("days")
    )


@register(
    "return_request_first_wins",
    BASE
    + f""", m AS (SELECT *, coalesce(static, CASE WHEN return_status <> 'requested' THEN 'return_status_conflict' END) AS error,
       return_status IS NULL AND row_number() OVER (PARTITION BY order_id, static IS NULL ORDER BY ts, seq) = 1 AS changed FROM j WHERE tool = 'create_return_request')
     SELECT seq, order_id, {OUT}, CASE WHEN error IS NULL THEN 'RR-' || order_id END AS request_id FROM m""",
)
def return_request_first_wins(spark, sf):
    return O.apply_returns(joined(spark, sf), AS_OF)


@register(
    "cancel_first_wins",
    BASE
    + f""", m AS (SELECT *, coalesce(static, CASE WHEN status NOT IN ('pending', 'cancelled') THEN 'order_not_pending' END) AS error,
       status = 'pending' AND row_number() OVER (PARTITION BY order_id, static IS NULL ORDER BY ts, seq) = 1 AS changed FROM j WHERE tool = 'cancel_pending_order')
     SELECT seq, order_id, {OUT} FROM m""",
)
def cancel_first_wins(spark, sf):
    return O.apply_cancels(joined(spark, sf), AS_OF)


@register(
    "exchange_first_wins",
    BASE
    + f""", m AS (SELECT *, CASE WHEN item_id <> product_id THEN 'item_not_found' WHEN NOT list_contains(payment_methods, payment_method_id) THEN 'payment_method_not_found' END AS ce FROM j WHERE tool = 'exchange_delivered_order_items'),
     f AS (SELECT order_id, min((ts, seq)) AS fa, arg_min(new_item_id, (ts, seq)) AS done FROM m WHERE static IS NULL AND ce IS NULL GROUP BY 1),
     r AS (SELECT m.*, coalesce(static, CASE WHEN fa < (ts, seq) AND done <> new_item_id THEN 'exchange_already_completed' END, CASE WHEN NOT coalesce(fa < (ts, seq), false) THEN ce END) AS error, coalesce(fa = (ts, seq), false) AS changed FROM m LEFT JOIN f USING (order_id))
     SELECT seq, order_id, {OUT} FROM r""",
)
def exchange_first_wins(spark, sf):
    return O.apply_exchanges(joined(spark, sf), AS_OF)


@register(
    "payment_change_replay",
    BASE
    + f""", fc AS (SELECT order_id, min((ts, seq)) AS fa FROM j WHERE tool = 'cancel_pending_order' AND static IS NULL AND status = 'pending' GROUP BY 1),
     m AS (SELECT j.*, coalesce(static, CASE WHEN fa < (ts, seq) THEN 'order_not_pending' END, CASE WHEN NOT list_contains(payment_methods, payment_method_id) THEN 'payment_method_not_found' END) AS error FROM j LEFT JOIN fc USING (order_id) WHERE tool = 'modify_pending_order_payment'),
     l AS (SELECT *, coalesce(lag(payment_method_id) OVER (PARTITION BY order_id, error IS NULL ORDER BY ts, seq), order_payment) <> payment_method_id AS changed FROM m)
     SELECT seq, order_id, {OUT} FROM l""",
)
def payment_change_replay(spark, sf):
    return O.apply_payment_changes(joined(spark, sf), AS_OF)


@register(
    "user_address_replay",
    BASE
    + f""", l AS (SELECT *, static AS error, lag(address) OVER (PARTITION BY user_id, static IS NULL ORDER BY ts, seq) IS DISTINCT FROM address AS changed FROM j WHERE tool = 'modify_user_address')
     SELECT seq, user_id, {OUT} FROM l""",
)
def user_address_replay(spark, sf):
    return O.apply_user_addresses(joined(spark, sf), AS_OF)


HELD = "len(list_filter(list_distinct(w.item_ids), lambda x: len(list_filter(w.item_ids, lambda y: y = x)) > len(list_filter(st.items, lambda z: z = x)))) = 0"
OWNED = "list_contains(w.payment_methods, w.payment_method_id)"
LENGTHS = "len(w.item_ids) = 0 OR len(w.item_ids) <> len(w.new_item_ids)"
RBASE = D.with_sql("dom_basket_commands", "dom_users", body="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + JOINED.replace(
    "o.product_id, u.payment_methods", "coalesce(o.items, [o.product_id]) AS items, o.shipping_address, o.exchange_status, u.payment_methods"
).replace("dom_commands c", "dom_basket_commands c").replace("dom_orders o", "dom_baskets o")
LOG_SQL = f""", w AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, seq) AS n FROM j WHERE static IS NULL
       AND tool NOT IN ('get_order', 'check_return_eligibility', 'modify_user_address')),
  st AS (
   SELECT order_id, 0 AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS tool, status, return_status, items, order_payment AS pay, shipping_address AS address, exchange_status AS exch, 0 AS version, false AS changed, CAST(NULL AS VARCHAR) AS error FROM w WHERE n = 1
   UNION ALL
   SELECT order_id, n, seq, tool,
     CASE WHEN chg AND tool = 'cancel_pending_order' THEN 'cancelled' ELSE s_status END,
     CASE WHEN chg AND tool IN ('create_return_request', 'return_delivered_order_items') THEN 'requested' ELSE s_return END,
     CASE WHEN chg AND tool IN ('modify_pending_order_items', 'exchange_delivered_order_items') THEN new_item_ids ELSE s_items END,
     CASE WHEN chg AND tool IN ('modify_pending_order_items', 'exchange_delivered_order_items', 'modify_pending_order_payment') THEN payment_method_id ELSE s_pay END,
     CASE WHEN chg AND tool = 'modify_pending_order_address' THEN address ELSE s_address END,
     CASE WHEN chg AND tool = 'exchange_delivered_order_items' THEN 'exchanged' ELSE s_exch END, s_version + CASE WHEN chg THEN 1 ELSE 0 END, chg, err
   FROM (SELECT *, err IS NULL AND CASE
        WHEN tool = 'cancel_pending_order' THEN s_status = 'pending'
        WHEN tool = 'modify_pending_order_address' THEN s_address IS DISTINCT FROM address
        WHEN tool = 'modify_pending_order_payment' THEN s_pay IS DISTINCT FROM payment_method_id
        WHEN tool IN ('create_return_request', 'return_delivered_order_items') THEN s_return IS NULL
        WHEN tool = 'modify_pending_order_items' THEN s_items <> new_item_ids OR s_pay IS DISTINCT FROM payment_method_id
        ELSE s_exch IS NULL END AS chg
      FROM (SELECT w.*, st.status AS s_status, st.return_status AS s_return, st.items AS s_items, st.pay AS s_pay, st.address AS s_address, st.exch AS s_exch, st.version AS s_version,
         CASE WHEN w.tool LIKE 'modify_pending%' AND st.status <> 'pending' THEN 'order_not_pending'
           WHEN w.tool = 'cancel_pending_order' AND st.status NOT IN ('pending', 'cancelled') THEN 'order_not_pending'
           WHEN w.tool = 'modify_pending_order_payment' AND NOT {OWNED} THEN 'payment_method_not_found'
           WHEN w.tool = 'return_delivered_order_items' AND (len(w.item_ids) = 0 OR NOT {HELD}) THEN 'item_not_found'
           WHEN w.tool = 'return_delivered_order_items' AND w.payment_method_id IS DISTINCT FROM st.pay AND NOT ({OWNED} AND starts_with(w.payment_method_id, 'gift_card_')) THEN 'payment_method_not_found'
           WHEN w.tool IN ('create_return_request', 'return_delivered_order_items') AND coalesce(st.return_status, 'requested') <> 'requested' THEN 'return_status_conflict'
           WHEN w.tool LIKE 'exchange%' AND st.exch IS NOT NULL THEN CASE WHEN st.items <> w.new_item_ids THEN 'exchange_already_completed' END
           WHEN w.tool IN ('modify_pending_order_items', 'exchange_delivered_order_items') AND ({LENGTHS}) THEN 'item_length_mismatch'
           WHEN w.tool IN ('modify_pending_order_items', 'exchange_delivered_order_items') AND NOT {HELD} THEN 'item_not_found'
           WHEN w.tool IN ('modify_pending_order_items', 'exchange_delivered_order_items') AND NOT {OWNED} THEN 'payment_method_not_found' END AS err
        FROM st JOIN w ON w.order_id = st.order_id AND w.n = st.n + 1)))"""
_STATE_SQL = "status, return_status, {pay} AS payment_method_id, array_to_string(items, ',') AS item_ids, {address} AS shipping_address, {exch} AS exchange_status, CAST({version} AS BIGINT) AS version"


def log_applied(spark, sf):
    return L.apply_log(D.basket_commands(spark, sf), D.order_baskets(spark, sf), D.users(spark, sf), AS_OF)


def state_columns():
    return [
        "status", "return_status", "payment_method_id", F.array_join("items", ",").alias("item_ids"), "shipping_address", "exchange_status",
        F.col("version").cast("bigint").alias("version"),
    ]


@register(
    "apply_command_log",
    RBASE
    + LOG_SQL
    + f""" SELECT seq, order_id, tool, error IS NULL AS ok, changed, error IS NULL AND NOT changed AS idempotent_replay, error, {_STATE_SQL.format(pay="pay", address="address", exch="exch", version="version")} FROM st WHERE n > 0
    UNION ALL SELECT seq, order_id, tool, false, false, false, static, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE static IS NOT NULL AND tool NOT IN ('get_order', 'check_return_eligibility', 'modify_user_address')""",
)
def apply_command_log(spark, sf):
    return log_applied(spark, sf).select("seq", "order_id", "tool", "ok", "changed", "idempotent_replay", "error", *state_columns())


@register(
    "orders_after_log",
    RBASE
    + LOG_SQL
    + f""", last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC) = 1)
    SELECT order_id, {_STATE_SQL.format(pay="pay", address="address", exch="exch", version="version")} FROM (
      SELECT order_id, status, return_status, items, pay, address, exch, version FROM last
      UNION ALL SELECT order_id, status, return_status, coalesce(items, [product_id]), payment_method_id, shipping_address, exchange_status, 0 FROM dom_baskets ANTI JOIN last USING (order_id))""",
)
def orders_after_log(spark, sf):
    orders = D.order_baskets(spark, sf)
    return L.final_orders(orders, log_applied(spark, sf)).select("order_id", *state_columns())


@register(
    "guardrail_counts",
    BASE + " SELECT tool, static AS reason, count(*) AS n FROM j WHERE static IS NOT NULL GROUP BY 1, 2",
)
def guardrail_counts(spark, sf):
    return O.guardrail_counts(joined(spark, sf).withColumn("error", O.static_error(AS_OF)))


@register(
    "items_multiset_check",
    """WITH w AS (SELECT l_orderkey AS o, l_partkey + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END AS i, count(*) AS nw FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
     h AS (SELECT l_orderkey AS o, l_partkey AS i, count(*) AS nh FROM lineitem GROUP BY 1, 2)
     SELECT printf('O%06d', o) AS order_id, bool_and(nw <= coalesce(nh, 0)) AS contained FROM w LEFT JOIN h USING (o, i) GROUP BY 1""",
)
def items_multiset_check(spark, sf):
    items = D.order_items(spark, sf)
    li = D.table(spark, sf, "lineitem").where(F.col("l_returnflag") != "N")
    wanted = li.select(
        F.format_string("O%06d", "l_orderkey").alias("request_id"),
        F.format_string("O%06d", "l_orderkey").alias("order_id"),
        F.format_string("P%05d", F.col("l_partkey") + (F.col("l_linenumber") > 5).cast("int")).alias("item_id"),
    )
    return O.multiset_contained(wanted, items, "request_id", "order_id", "item_id").withColumnRenamed("request_id", "order_id")


@register(
    "handoff_records",
    "SELECT event_id, 'H' || sha1('U' || user_id || ':None:' || event_type || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'))[1:10] AS handoff_id FROM events WHERE event_type = 'error'",
)
def handoff_records(spark, sf):
    e = D.table(spark, sf, "events").where(F.col("event_type") == "error")
    calls = e.select(
        "event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), F.lit(None).cast("string").alias("order_id"), F.col("event_type").alias("reason"), "ts"
    )
    return O.handoffs(calls, keep=["event_id"]).select("event_id", "handoff_id")


@register(
    "call_ids",
    "SELECT event_id, sha1(event_type || ':' || event_id || ':' || props)[1:12] AS call_id FROM events",
)
def call_ids(spark, sf):
    return D.table(spark, sf, "events").select("event_id", O.call_id(F.col("event_type"), F.col("event_id"), F.col("props")).alias("call_id"))


@register(
    "call_validation",
    D.with_sql(
        "dom_orders",
        "dom_commands",
        body="""SELECT CAST(seq AS VARCHAR) AS call_id, tool, CASE
      WHEN k % 9 = 0 THEN 'unknown tool: ' || tool
      WHEN tool IN ('modify_pending_order_address', 'modify_user_address') THEN 'missing: ' || CASE WHEN k % 9 = 1 AND tool <> 'modify_user_address' THEN 'order_id, ' ELSE '' END || 'address1, address2, city, state, country, zip'
      WHEN k % 9 = 1 AND tool <> 'modify_user_address' THEN 'missing: order_id'
      WHEN k % 9 = 2 THEN 'unknown: extra'
      WHEN NOT regexp_full_match(verification_code, '[0-9]{6}') THEN tool || '.verification_code: does not match [0-9]{6}'
      WHEN tool IN ('get_order', 'check_return_eligibility') THEN NULL
      WHEN k % 9 = 3 THEN tool || '.confirmed: expected boolean'
      WHEN tool = 'cancel_pending_order' AND reason = 'other' THEN tool || '.reason: not one of no longer needed, ordered by mistake'
      WHEN tool IN ('modify_pending_order_items', 'return_delivered_order_items', 'exchange_delivered_order_items') AND k % 9 = 4 THEN tool || '.item_ids: items must be string' END AS error
    FROM (SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 'drop_' || tool ELSE tool END AS tool) FROM dom_commands)""",
    ),
)
def call_validation(spark, sf):
    c = D.commands(spark, sf)
    k = F.col("k") % 9
    tool = F.when(k == 0, F.concat(F.lit("drop_"), "tool")).otherwise(F.col("tool"))
    base = F.col("tool")
    caller = F.struct(
        F.when((k != 1) & (base != "modify_user_address"), F.col("order_id")).alias("order_id"),
        "user_id",
        "verification_code",
        F.when(~base.isin("get_order", "check_return_eligibility"), F.when(k == 3, '"yes"').otherwise(F.col("confirmed").cast("string"))).alias("confirmed"),
        F.when(base == "cancel_pending_order", F.col("reason")).alias("reason"),
        F.when(base.isin("modify_pending_order_items", "return_delivered_order_items", "exchange_delivered_order_items"), F.when(k == 4, F.lit("[7]")).otherwise(F.to_json("item_ids"))).alias("item_ids"),
        F.when(base.isin("modify_pending_order_items", "exchange_delivered_order_items"), F.to_json("new_item_ids")).alias("new_item_ids"),
        F.when(base.isin("modify_pending_order_items", "return_delivered_order_items", "exchange_delivered_order_items", "modify_pending_order_payment"), F.col("payment_method_id")).alias("payment_method_id"),
        F.when(k == 2, F.lit("1")).alias("extra"),
    )
    raw = F.to_json(caller)
    # unquote the fields that are JSON already
    args = F.regexp_replace(raw, r'"confirmed":"\\"yes\\""', '"confirmed":"yes"')
    args = F.regexp_replace(args, r'"confirmed":"(true|false)"', '"confirmed":$1')
    args = F.regexp_replace(args, r'"(item_ids|new_item_ids)":"\[(\\"P[0-9]+\\"|7)\]"', r'"$1":[$2]')
    args = F.replace(args, F.lit('\\"'), F.lit('"'))
    calls = c.select(F.col("seq").cast("string").alias("call_id"), tool.alias("tool"), args.alias("arguments"))
    return TS.validate_calls(calls)


@register(
    "reset_orders",
    """SELECT printf('O%06d', o_orderkey) AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'requested' WHEN o_orderkey % 29 = 0 THEN 'closed' END AS return_status,
      CASE WHEN o_orderkey % 3 = 0 THEN true ELSE o_orderkey % 5 = 0 END AS opened FROM orders""",
)
def reset_orders(spark, sf):
    o = D.orders(spark, sf)
    overlay = o.where(F.col("order_key") % 3 == 0).select(
        "order_id", F.create_map(F.lit("return_status"), F.lit(None).cast("string"), F.lit("opened"), F.lit("true"), F.lit("user_id"), F.lit("X")).alias("fields")
    )
    return O.reset_orders(o, overlay).select("order_id", "return_status", "opened")


@register(
    "refund_rule_replay",
    D.with_sql(
        "dom_orders",
        "dom_commands",
        "dom_users",
        body="""SELECT decision, quality, count(*) AS n FROM (SELECT c.seq, c.k % 2 AS quality, CASE WHEN r.payment = c.payment_method_id THEN 'allowed'
      WHEN list_contains(m.methods, c.payment_method_id) AND starts_with(c.payment_method_id, 'gift_card_') THEN 'allowed' WHEN r.payment IS NULL OR m.methods IS NULL THEN 'indeterminate' ELSE 'blocked' END AS decision
     FROM (SELECT *, strftime(ts, '%Y-%m') || substr(order_id, 2, 3) AS sim FROM dom_commands WHERE tool IN ('return_delivered_order_items', 'create_return_request')) c
     ASOF LEFT JOIN (SELECT strftime(ts, '%Y-%m') || substr(order_id, 2, 3) AS sim, seq, order_id, o.payment_method_id AS payment FROM dom_commands JOIN dom_orders o USING (order_id) WHERE tool IN ('get_order', 'modify_pending_order_payment')) r
       ON r.sim = c.sim AND r.order_id = c.order_id AND r.seq < c.seq
     ASOF LEFT JOIN (SELECT strftime(ts, '%Y-%m') || substr(order_id, 2, 3) AS sim, seq, user_id, payment_methods AS methods FROM dom_commands JOIN dom_users USING (user_id) WHERE tool IN ('modify_user_address', 'cancel_pending_order')) m
       ON m.sim = c.sim AND m.user_id = c.user_id AND m.seq < c.seq) GROUP BY 1, 2""",
    ),
)
def refund_rule_replay(spark, sf):
    c = D.commands(spark, sf).withColumn("sim", F.concat(F.date_format("ts", "yyyy-MM"), F.substring("order_id", 2, 3))).withColumn("pos", F.col("seq"))
    calls = c.where(F.col("tool").isin("return_delivered_order_items", "create_return_request")).select("sim", "pos", "order_id", "user_id", "payment_method_id", (F.col("k") % 2).alias("quality"))
    pay = D.orders(spark, sf).select("order_id", F.col("payment_method_id").alias("payment"))
    reads = c.where(F.col("tool").isin("get_order", "modify_pending_order_payment")).select("sim", "pos", "order_id").join(pay, "order_id")
    methods = D.users(spark, sf).select("user_id", F.col("payment_methods").alias("methods"))
    ureads = c.where(F.col("tool").isin("modify_user_address", "cancel_pending_order")).select("sim", "pos", "user_id").join(methods, "user_id")
    return O.replay_refund_rule(calls, reads, ureads).groupBy("decision", "quality").agg(F.count(F.lit(1)).alias("n"))
