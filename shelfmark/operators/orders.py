"""Order rules and commands, evaluated over tables of commands.

A command that fails a check depending only on itself and on fixed order fields
is settled by expressions. What depends on earlier commands of the same order is
settled by aggregates where the first accepted command wins and by running windows
where the last one wins; a whole log, where both meet, is applied in ``order_log``.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.canon import short_sha1
from shelfmark.functions.scale import running

RETURN_TOOLS = ["create_return_request", "return_delivered_order_items"]
PENDING_TOOLS = ["modify_pending_order_address", "modify_pending_order_items", "modify_pending_order_payment"]
WRITE_TOOLS = [*RETURN_TOOLS, "cancel_pending_order", *PENDING_TOOLS, "exchange_delivered_order_items"]


def bad_code(tool: Column, code: Column) -> Column:
    """True when an identity-guarded call lacks a literal six-digit code."""
    guarded = tool.isin(fv.IDENTITY_GUARDED_TOOLS)
    return guarded & ~F.coalesce(code.rlike(f"^{fv.VERIFICATION_CODE_PATTERN}$"), F.lit(False))


def with_records(commands: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """Commands with their order and user. Both joins are on ids; AQE splits a hot one."""
    o = orders.select(
        "order_id",
        F.col("user_id").alias("owner"),
        F.col("payment_method_id").alias("order_payment"),
        *[c for c in orders.columns if c not in ("order_id", "user_id", "payment_method_id")],
    )
    u = users.select("user_id", F.col("verification_code").alias("user_code"), "payment_methods")
    return commands.join(u, "user_id", "left").join(o, "order_id", "left")


def verify_user() -> Column:
    return F.when(~F.coalesce(F.col("user_code") == F.col("verification_code"), F.lit(False)), "identity_verification_failed")


def verify_order() -> Column:
    """Error of the caller's claim on the order: identity first, then ownership."""
    return F.coalesce(
        verify_user(),
        F.when(~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)), "order_ownership_mismatch"),
    )


def return_days(as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col("delivered_at"))


def return_reason(as_of: str) -> Column:
    """Why an order may or may not be returned on ``as_of``."""
    fresh = (return_days(as_of) <= 7) & ~F.col("opened")
    return (
        F.when(F.col("status") != "delivered", "order_not_delivered")
        .when(F.col("quality_issue"), "quality_issue")
        .when(fresh, "seven_day_return")
        .otherwise("return_window_expired_or_opened")
    )


def is_eligible(reason: Column) -> Column:
    return reason.isin("quality_issue", "seven_day_return")


def check_eligibility(joined: DataFrame, as_of: str) -> DataFrame:
    """Verification error, or eligibility with reason and days since delivery."""
    error = verify_order()
    reason = return_reason(as_of)
    return joined.select(
        "*",
        error.alias("error"),
        F.when(error.isNull(), is_eligible(reason)).otherwise(False).alias("eligible"),
        F.when(error.isNull(), reason).alias("return_reason_code"),
        F.when(error.isNull() & (F.col("status") == "delivered"), return_days(as_of)).alias("days_since_delivery"),
    )


def multiset_contained(wanted: DataFrame, have: DataFrame, request: str, owner: str, item: str) -> DataFrame:
    """Per request: is every item wanted at most as often as its owner has it?

    ``wanted(request, owner, item)`` and ``have(owner, item)`` stay as rows; both
    are counted map-side before the join, so no item list is ever gathered.
    """
    w = wanted.groupBy(request, owner, item).agg(F.count(F.lit(1)).alias("n_wanted"))
    h = have.groupBy(owner, item).agg(F.count(F.lit(1)).alias("n_have"))
    return w.join(h, [owner, item], "left").groupBy(request).agg(
        F.bool_and(F.col("n_wanted") <= F.coalesce("n_have", F.lit(0))).alias("contained")
    )


def static_error(as_of: str) -> Column:
    """First failed check that needs no earlier command, in each tool's own order."""
    tool = F.col("tool")
    unconfirmed = F.when(~F.col("confirmed"), "confirmation_required")
    reason = return_reason(as_of)
    refused = F.when(~is_eligible(reason), reason)
    guard = F.when(bad_code(tool, F.col("verification_code")), "verification_code_required")
    per_tool = (
        F.when(tool.isin("get_order", "check_return_eligibility"), verify_order())
        .when(tool == "modify_user_address", F.coalesce(verify_user(), unconfirmed))
        .when(tool.isin(RETURN_TOOLS), F.coalesce(verify_order(), refused, unconfirmed))
        .when(
            tool == "cancel_pending_order",
            F.coalesce(
                verify_order(),
                F.when(~F.col("reason").isin(fv.CANCEL_REASONS), "invalid_cancel_reason"),
                unconfirmed,
            ),
        )
        .when(
            tool.isin(PENDING_TOOLS),
            F.coalesce(
                verify_order(), unconfirmed, F.when(~F.col("status").isin("pending"), "order_not_pending")
            ),
        )
        .when(
            tool == "exchange_delivered_order_items",
            F.coalesce(
                verify_order(), unconfirmed, F.when(F.col("status") != "delivered", "order_not_delivered")
            ),
        )
        .otherwise(F.concat(F.lit("unknown tool: "), tool))
    )
    return F.coalesce(guard, per_tool)


def at() -> Column:
    return F.struct("ts", "seq")


def _outcome(changed: Column, replay: Column, error: Column) -> list[Column]:
    return [
        error.isNull().alias("ok"),
        F.coalesce(changed & error.isNull(), F.lit(False)).alias("changed"),
        F.coalesce(replay & error.isNull(), F.lit(False)).alias("idempotent_replay"),
        error.alias("error"),
    ]


def _first_per_order(valid: DataFrame) -> DataFrame:
    """Earliest valid command per order: one partial row per task and order is shuffled."""
    return valid.groupBy("order_id").agg(F.min(at()).alias("first_at"))


def apply_returns(joined: DataFrame, as_of: str) -> DataFrame:
    """``create_return_request``: first accepted changes, later ones replay, other states conflict."""
    mine = joined.where(F.col("tool") == "create_return_request").withColumn("static", static_error(as_of))
    first = _first_per_order(mine.where(F.col("static").isNull() & F.col("return_status").isNull()))
    d = mine.join(first, "order_id", "left")
    conflict = F.when(
        F.col("return_status").isNotNull() & (F.col("return_status") != "requested"), "return_status_conflict"
    )
    changed = F.col("return_status").isNull() & (at() == F.col("first_at"))
    return d.select(
        "seq",
        "order_id",
        *_outcome(changed, ~changed, F.coalesce("static", conflict)),
        F.when(F.coalesce("static", conflict).isNull(), F.concat(F.lit("RR-"), "order_id")).alias("request_id"),
    )


def apply_cancels(joined: DataFrame, as_of: str) -> DataFrame:
    mine = joined.where(F.col("tool") == "cancel_pending_order").withColumn("static", static_error(as_of))
    valid = mine.where(F.col("static").isNull() & (F.col("status") == "pending"))
    d = mine.join(_first_per_order(valid), "order_id", "left")
    state = F.when(~F.col("status").isin("pending", "cancelled"), "order_not_pending")
    changed = (F.col("status") == "pending") & (at() == F.col("first_at"))
    return d.select("seq", "order_id", *_outcome(changed, ~changed, F.coalesce("static", state)))


def apply_exchanges(joined: DataFrame, as_of: str) -> DataFrame:
    """One exchange per order; a later command with the same new items replays."""
    mine = joined.where(F.col("tool") == "exchange_delivered_order_items").withColumn("static", static_error(as_of))
    lengths = F.when(
        (F.size("item_ids") == 0) | (F.size("item_ids") != F.size("new_item_ids")), "item_length_mismatch"
    )
    absent = F.when(
        F.size(F.array_except("item_ids", F.array("product_id"))) + F.size("item_ids") - F.size(F.array_distinct("item_ids")) > 0,
        "item_not_found",
    )
    no_method = F.when(~F.array_contains("payment_methods", F.col("payment_method_id")), "payment_method_not_found")
    mine = mine.withColumn("content_error", F.coalesce(lengths, absent, no_method))
    valid = mine.where(F.coalesce("static", "content_error").isNull())
    first = valid.groupBy("order_id").agg(
        F.min(at()).alias("first_at"), F.min_by("new_item_ids", at()).alias("done_items")
    )
    d = mine.join(first, "order_id", "left")
    after = F.coalesce(F.col("first_at") < at(), F.lit(False))
    error = F.coalesce(
        F.col("static"),
        F.when(after & (F.col("done_items") != F.col("new_item_ids")), "exchange_already_completed"),
        F.when(~after, F.col("content_error")),
    )
    return d.select("seq", "order_id", *_outcome(at() == F.col("first_at"), after, error))


def apply_payment_changes(joined: DataFrame, as_of: str) -> DataFrame:
    """Pending payment changes in a log without item changes.

    After a valid command the order's method is the one it asked for, so a command
    replays exactly when it asks for what the valid command before it asked for.
    """
    mine = joined.where(F.col("tool") == "modify_pending_order_payment").withColumn("static", static_error(as_of))
    cancels = joined.where(F.col("tool") == "cancel_pending_order").withColumn("static", static_error(as_of))
    first_cancel = _first_per_order(cancels.where(F.col("static").isNull() & (F.col("status") == "pending")))
    d = mine.join(first_cancel, "order_id", "left")
    error = F.coalesce(
        F.col("static"),
        F.when(F.col("first_at") < at(), "order_not_pending"),
        F.when(~F.array_contains("payment_methods", F.col("payment_method_id")), "payment_method_not_found"),
    )
    d = d.withColumn("error_code", error)
    return _last_wins(d, "order_id", F.col("payment_method_id"), F.col("order_payment"))


def apply_user_addresses(joined: DataFrame, as_of: str, current: Column | None = None) -> DataFrame:
    mine = joined.where(F.col("tool") == "modify_user_address").withColumn("error_code", static_error(as_of))
    return _last_wins(mine, "user_id", F.col("address"), current if current is not None else F.lit(None).cast("string"))


def _last_wins(d: DataFrame, key: str, asked: Column, initial: Column) -> DataFrame:
    live = d.withColumn("asked", F.when(F.col("error_code").isNull(), asked)).withColumn("initial", initial)
    seen = running(
        live.select("seq", "ts", key, "asked", "initial", "error_code"),
        [key],
        ["ts", "seq"],
        F.unix_seconds(F.date_trunc("hour", "ts")),
        lasts={"previous": F.col("asked")},
        before_only=True,
    )
    same = F.coalesce("previous", "initial").eqNullSafe(F.col("asked"))
    return seen.select("seq", key, *_outcome(~same, same, F.col("error_code")))


# --- one order, one command after another (streams; the whole log is in order_log) ----------
class OrderState(NamedTuple):
    status: str
    return_status: str | None
    exchanged: bool
    items: tuple[str, ...]
    payment: str | None
    address: str | None
    version: int


def open_order(row: Any) -> OrderState:
    """State of an order before its first command, from its snapshot columns."""
    items = getattr(row, "items", None)
    return OrderState(
        row.status, row.return_status, getattr(row, "exchange_status", None) is not None,
        tuple(items) if items is not None else (row.product_id,), row.order_payment, getattr(row, "shipping_address", None), 0,
    )


def _contains(have: tuple[str, ...], wanted: list[str]) -> bool:
    return all(list(wanted).count(i) <= have.count(i) for i in wanted)


def apply_one(state: OrderState, row: Any) -> tuple[OrderState, bool, str | None]:
    """``(next state, changed, error)`` of one command whose static checks passed."""
    tool, items, new_items = row.tool, list(row.item_ids), list(row.new_item_ids)
    methods = list(row.payment_methods)
    change: dict[str, Any] = {}
    if tool in PENDING_TOOLS and state.status != "pending":
        return state, False, "order_not_pending"
    if tool == "cancel_pending_order":
        if state.status not in ("pending", "cancelled"):
            return state, False, "order_not_pending"
        change = {"status": "cancelled"} if state.status == "pending" else {}
    elif tool == "modify_pending_order_address":
        change = {"address": row.address} if state.address != row.address else {}
    elif tool == "modify_pending_order_payment":
        if row.payment_method_id not in methods:
            return state, False, "payment_method_not_found"
        change = {"payment": row.payment_method_id} if state.payment != row.payment_method_id else {}
    elif tool == "create_return_request" or tool == "return_delivered_order_items":
        if tool == "return_delivered_order_items":
            if not items or not _contains(state.items, items):
                return state, False, "item_not_found"
            gift = row.payment_method_id in methods and row.payment_method_id.startswith("gift_card_")
            if row.payment_method_id != state.payment and not gift:
                return state, False, "payment_method_not_found"
        if state.return_status not in (None, "requested"):
            return state, False, "return_status_conflict"
        change = {"return_status": "requested"} if state.return_status is None else {}
    elif tool in ("modify_pending_order_items", "exchange_delivered_order_items"):
        swap = tool == "exchange_delivered_order_items"
        if swap and state.exchanged:
            same = list(state.items) == new_items
            return state, False, None if same else "exchange_already_completed"
        if not items or len(items) != len(new_items):
            return state, False, "item_length_mismatch"
        if not _contains(state.items, items):
            return state, False, "item_not_found"
        if row.payment_method_id not in methods:
            return state, False, "payment_method_not_found"
        if swap or list(state.items) != new_items or state.payment != row.payment_method_id:
            change = {"items": tuple(new_items), "payment": row.payment_method_id}
            if swap:
                change["exchanged"] = True
    if not change:
        return state, False, None
    return state._replace(version=state.version + 1, **change), True, None


# --- hand-offs, logs, validation -------------------------------------------------------
def handoffs(calls: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Hand-off records; the id is a hash of user, order, reason and time."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    order = F.coalesce("order_id", F.lit("None"))
    return calls.select(
        *(keep or []),
        F.concat(F.lit("H"), short_sha1(F.col("user_id"), order, F.col("reason"), stamp, digits=10)).alias("handoff_id"),
        "user_id",
        "order_id",
        "reason",
        F.col("ts").alias("created_at"),
    )


def call_id(name: Column, seq: Column, arguments_json: Column) -> Column:
    return short_sha1(name, seq.cast("string"), arguments_json, digits=12)


def guardrail_counts(results: DataFrame) -> DataFrame:
    blocked = results.where(F.col("error").isNotNull())
    return blocked.groupBy("tool", F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reset_orders(orders: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay a task's initial state. ``overlay(order_id, fields map)``; a key present with null clears."""
    o = orders.join(overlay, "order_id", "left")
    f = F.col("fields")

    def field(name: str, kind: str) -> Column:
        has = F.coalesce(F.map_contains_key(f, F.lit(name)), F.lit(False))
        return F.when(has, F.try_element_at(f, F.lit(name)).try_cast(kind)).otherwise(F.col(name)).alias(name)

    allowed = {"status": "string", "return_status": "string", "version": "int", "opened": "boolean", "quality_issue": "boolean"}
    return o.select(*[field(c, allowed[c]) if c in allowed else F.col(c) for c in orders.columns])


def replay_refund_rule(calls: DataFrame, order_reads: DataFrame, user_reads: DataFrame) -> DataFrame:
    """Allowed, blocked or indeterminate per recorded refund call.

    ``calls(sim, pos, order_id, user_id, payment_method_id, …)``; the reads give
    ``(sim, pos, order_id, payment)`` and ``(sim, pos, user_id, methods)``. Each call
    takes the latest read before it, found by one running window per (sim, entity)
    in which reads and calls are merged.
    """

    def latest(events: DataFrame, reads: DataFrame, entity: str, value: str) -> DataFrame:
        rows = events.withColumn(value, F.lit(None).cast(reads.schema[value].dataType)).withColumn("is_call", F.lit(True))
        tagged = rows.unionByName(
            reads.select("sim", "pos", entity, value).withColumn("is_call", F.lit(False)), allowMissingColumns=True
        )
        out = running(
            tagged, ["sim", entity], ["pos"], F.floor(F.col("pos") / 4096), lasts={f"seen_{value}": F.col(value)}, before_only=True
        )
        return out.where("is_call").drop("is_call", value)

    c = latest(calls, order_reads, "order_id", "payment")
    c = latest(c, user_reads, "user_id", "methods")
    pm = F.col("payment_method_id")
    gift = F.array_contains("seen_methods", pm) & pm.startswith("gift_card_")
    decision = (
        F.when(F.col("seen_payment") == pm, "allowed")
        .when(gift, "allowed")
        .when(F.col("seen_payment").isNull() | F.col("seen_methods").isNull(), "indeterminate")
        .otherwise("blocked")
    )
    return c.withColumn("decision", decision)
