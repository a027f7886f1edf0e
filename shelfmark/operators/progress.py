"""Return-task progress of conversations, action contracts and intents.

The facts of a conversation are running "last value" signals, so they are windows
over blocks of each conversation rather than one fold per conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import running
from shelfmark.functions.text import contains_any, found, strip


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, fv.REFUSAL_STRIP_PATTERN, ""))


def reason_refused(text: Column) -> Column:
    return _plain(text).isin(fv.REASON_REFUSALS) | _plain(text).rlike(fv.REASON_REFUSAL_PATTERN)


def code_refused(text: Column) -> Column:
    return _plain(text).isin(fv.VERIFICATION_REFUSALS) | _plain(text).rlike(fv.CODE_REFUSAL_PATTERN)


READS = ("get_order", "check_return_eligibility")
LASTS = (
    "order_id", "verification", "identity", "loaded", "eligibility", "reason", "confirmed", "created", "blocked_value",
    "blocked_at", "code_at", "reason_at",
)
MAXIMA = ("intent", "handed_off")


def event_marks() -> dict[str, Column]:
    """What an event says about later ones by itself: the order it names and the input it asks for."""
    user = F.col("role") == "user"
    return {
        "named_order": F.when(user, F.upper(found(F.coalesce("content", F.lit("")), fv.ORDER_ID_PATTERN))),
        "asked": F.when(F.col("role") == "assistant", F.coalesce("requested_input_type", F.lit("none"))).when(user, "none"),
    }


def signals(asked: Column, switched: Column, order: str) -> dict[str, Column]:
    """Signals of an event, null where it has none; the latest of each kind (``LASTS``) and the largest (``MAXIMA``) make the facts.

    ``asked`` is the input the assistant last asked for, ``switched`` whether the
    event names another order than the one before it.
    """
    user = F.col("role") == "user"
    t = F.coalesce("content", F.lit(""))
    requested, normalized = F.when(user, asked), F.lower(strip(t))
    has_code, matched_reason = user & t.rlike(fv.CODE_IN_TEXT_PATTERN), user & t.rlike(fv.STATED_REASON_PATTERN)
    stated = F.when(user, F.nullif(strip(F.regexp_extract(t, fv.STATED_REASON_PATTERN, 1)), F.lit("")))
    bare_reason = (requested == "return_reason") & ~matched_reason
    refused_code = F.coalesce((requested == "verification_code") & code_refused(t) & ~has_code, F.lit(False))
    refused_reason = F.coalesce(reason_refused(stated), F.lit(False)) | F.coalesce(bare_reason & reason_refused(t), F.lit(False))
    given = F.when(stated.isNotNull() & ~refused_reason, stated).when(bare_reason & ~refused_reason & ~normalized.isin(fv.NEGATIVE), t)
    tool, ok = F.col("tool"), F.coalesce("ok", F.lit(False))
    read, confirm = tool.isin(*READS), requested == "confirmation"
    lost = F.when(read & ~ok & F.col("error").isin("identity_verification_failed", "order_ownership_mismatch"), F.col("error"))
    blocked = F.coalesce(F.when(refused_code, "verification_code_refused"), F.when(refused_reason, "return_reason_refused"), lost)
    pos, cleared = F.col(order), F.when(switched, "none")
    return {
        "order_id": event_marks()["named_order"],
        "verification": F.when(has_code, "true").when(refused_code | switched, "false"),
        "identity": F.when(read & ok, "true").when(switched, "false"),
        "loaded": F.when(read & ok, F.coalesce("has_order", F.lit(False)).cast("string")).when(switched, "false"),
        "eligibility": F.when((tool == READS[1]) & ok, F.coalesce("eligible", F.lit(False)).cast("string")).otherwise(cleared),
        "reason": F.coalesce(given, F.when(refused_reason, "")),
        "confirmed": F.when(confirm & normalized.isin(fv.AFFIRMATIVE), "true")
        .when(confirm & normalized.isin(fv.NEGATIVE), "false")
        .when(stated.isNotNull() | refused_reason, "none")
        .otherwise(cleared),
        "created": F.when((tool == "create_return_request") & ok, "true").when(switched, "false"),
        "blocked_value": blocked,
        "blocked_at": F.when(blocked.isNotNull(), pos),
        "code_at": F.when(has_code, pos),
        "reason_at": F.when(given.isNotNull(), pos),
        "intent": F.when(user & contains_any(F.lower(t), fv.RETURN_INTENT_TERMS), 1).otherwise(0),
        "handed_off": F.when((tool == "escalate_to_human") & ok, 1).otherwise(0),
    }


def facts_of(known: DataFrame, keys: list[str]) -> DataFrame:
    """Facts from the latest and largest signals so far (columns ``LASTS`` and ``MAXIMA``)."""
    still = ~(
        F.coalesce((F.col("blocked_value") == "verification_code_refused") & (F.col("code_at") > F.col("blocked_at")), F.lit(False))
        | F.coalesce((F.col("blocked_value") == "return_reason_refused") & (F.col("reason_at") > F.col("blocked_at")), F.lit(False))
    )

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c) == "true", F.lit(False))

    def tri(c: str) -> Column:
        return F.when(F.col(c) == "true", True).when(F.col(c) == "false", False)

    return known.select(
        *keys,
        (F.col("intent") == 1).alias("return_intent"),
        "order_id",
        flag("verification").alias("verification_available"),
        flag("identity").alias("identity_verified"),
        flag("loaded").alias("order_loaded"),
        tri("eligibility").alias("eligibility"),
        F.nullif("reason", F.lit("")).alias("return_reason"),
        tri("confirmed").alias("confirmation"),
        flag("created").alias("return_created"),
        F.when(still, F.col("blocked_value")).alias("blocked_by"),
        (F.col("handed_off") == 1).alias("handed_off"),
    )


def conversation_facts(events: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """Facts after every event.

    ``events(*keys, order, role, content, requested_input_type, tool, ok, error, has_order, eligible)``.
    ``order`` numbers events within a conversation; ``block`` never decreases with it.
    """
    marks = event_marks()
    before = running(
        events.withColumn("named_order", marks["named_order"]), keys, [order], block,
        lasts={"order_before": F.col("named_order"), "asked": marks["asked"]}, before_only=True,
    )
    switched = F.coalesce(F.col("named_order") != F.col("order_before"), F.lit(False))
    told = signals(F.coalesce("asked", F.lit("none")), switched, order)
    known = running(before, keys, [order], block, maxima={m: told[m] for m in MAXIMA}, lasts={c: told[c] for c in LASTS})
    return facts_of(known, [*keys, order])


def progress(facts: DataFrame) -> DataFrame:
    """Progress row of each facts row."""
    f = F.col

    def texts(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    done = F.array_compact(
        F.array(
            F.when(f("order_id").isNotNull(), "order_id_collected"),
            F.when(f("verification_available"), "verification_supplied"),
            F.when(f("identity_verified"), "identity_verified"),
            F.when(f("order_loaded"), "order_loaded"),
            F.when(f("eligibility").isNotNull(), "eligibility_checked"),
            F.when(f("return_reason").isNotNull(), "return_reason_collected"),
            F.when(f("confirmation"), "explicit_confirmation"),
            F.when(f("return_created"), "return_request_created"),
        )
    )
    state = (
        F.when(~f("return_intent"), "not_applicable")
        .when(f("handed_off"), "handed_off")
        .when(f("blocked_by").isNotNull(), "handoff_required")
        .when(f("order_id").isNull(), "read_only")
        .when(~f("verification_available"), "identity_required")
        .when(f("eligibility").isNull(), "identity_available")
        .when(~f("eligibility"), "ineligible")
        .when(f("return_reason").isNull(), "reason_required")
        .when(f("confirmation").isNull(), "confirmation_required")
        .when(~f("confirmation"), "cancelled")
        .when(~f("return_created"), "write_authorized")
        .otherwise("complete")
    )
    asks = {"read_only": "order_id", "identity_required": "verification_code", "reason_required": "return_reason", "confirmation_required": "confirmation"}
    asks_map = F.create_map(*[F.lit(x) for kv in asks.items() for x in kv])
    s = facts.withColumn("guard_state", state).withColumn("completed", F.when(f("return_intent"), done).otherwise(texts()))
    asked = F.try_element_at(asks_map, F.col("guard_state"))
    g = F.col("guard_state")
    allowed = (
        F.when(g == "not_applicable", texts())
        .when(g.isin("handed_off", "ineligible", "cancelled", "complete"), texts("final_answer"))
        .when(g == "handoff_required", texts("handoff"))
        .when(asked.isNotNull(), F.array(F.concat(F.lit("ask_user:"), asked)))
        .when(g == "identity_available", F.when(f("order_loaded"), texts("check_return_eligibility")).otherwise(texts("get_order", "check_return_eligibility")))
        .otherwise(texts("create_return_request"))
    )
    pending = (
        F.when(g == "read_only", "order_id")
        .when(g == "identity_required", "identity_verification")
        .when(g == "identity_available", "eligibility")
        .when(g == "reason_required", "return_reason")
        .when(g == "confirmation_required", "explicit_confirmation")
        .when(g == "write_authorized", "return_request")
    )
    return s.withColumns(
        {
            "workflow": F.when(g == "not_applicable", "unclassified").otherwise("return_resolution"),
            "pending": F.array_compact(F.array(pending)),
            "allowed_next_actions": allowed,
            "requested_input_type": asked,
            "blocked_by": F.when(g == "handoff_required", f("blocked_by")).when(asked.isNotNull(), "user_input"),
            "eligible": F.when(g == "ineligible", False).when(
                g.isin("reason_required", "cancelled", "confirmation_required", "write_authorized", "complete"), True
            ),
            "cancelled": g == "cancelled",
        }
    )


def asks_for_code(text: Column) -> Column:
    return contains_any(F.lower(text), fv.CODE_REQUEST_PHRASES) | text.rlike(fv.SIX_DIGIT_CODE_PATTERN)


def asks_for_reason(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in fv.REASON_REQUEST_PATTERNS])


def requested_input(text: Column, fallback: Column | None = None) -> Column:
    """What an assistant question asks the user for."""
    low = F.lower(text)
    return (
        F.when(asks_for_code(text), "verification_code")
        .when(asks_for_reason(text), "return_reason")
        .when(F.contains(low, F.lit("确认")) | F.contains(low, F.lit("confirm")), "confirmation")
        .when(F.contains(low, F.lit("订单号")) | F.contains(low, F.lit("order id")), "order_id")
        .otherwise(F.lit(None).cast("string") if fallback is None else fallback)
    )


def action_key(kind: Column, tool: Column, waits: Column, requested: Column) -> Column:
    return (
        F.when(kind == "tool_call", F.coalesce(F.nullif(tool, F.lit("")), F.lit("unknown_tool")))
        .when(kind == "handoff", "handoff")
        .when(waits, F.concat(F.lit("ask_user:"), F.coalesce(F.nullif(requested, F.lit("")), F.lit("unknown"))))
        .otherwise("final_answer")
    )


def contract(progress_rows: DataFrame) -> DataFrame:
    """Allowed, forbidden and preferred actions; null for unconstrained workflows."""
    known = F.array_sort(F.array(*[F.lit(k) for k in fv.KNOWN_ACTION_KEYS]))
    bound = F.col("workflow") == "return_resolution"
    allowed = F.col("allowed_next_actions")
    return progress_rows.withColumns(
        {
            "allowed_actions": F.when(bound, allowed),
            "forbidden_actions": F.when(bound, F.array_sort(F.array_except(known, allowed))),
            "terminal_allowed": F.when(bound, F.array_contains(allowed, "final_answer")),
            "preferred_action": F.when(bound & (F.size(allowed) == 1), allowed[0]),
        }
    )


def constrain(actions: DataFrame) -> DataFrame:
    """Pass, remap to the preferred action, or fail closed.

    ``actions`` hold ``action`` (key), ``content`` and the contract columns.
    """
    preferred = F.col("preferred_action")
    ask = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in fv.ASK_USER_TEMPLATES.items() for x in kv]), F.substring_index(preferred, ":", -1)
    )
    made = (
        F.when(F.startswith(preferred, F.lit("ask_user:")), ask)
        .when(preferred == "final_answer", fv.STEP_DONE_TEXT)
        .when(preferred == "handoff", F.coalesce("blocked_by", F.lit("progress_required_handoff")))
    )
    free = F.col("allowed_actions").isNull() | F.array_contains("allowed_actions", F.col("action"))
    free = F.coalesce(free, F.lit(True))
    remap = ~free & made.isNotNull()
    return actions.withColumns(
        {
            "accepted": free | remap,
            "remapped": remap,
            "fail_closed": ~free & ~remap,
            "reason": F.when(remap, "action_not_allowed_remapped_to_preferred").when(~free, "action_not_allowed_fail_closed"),
            "resulting_content": F.when(free, F.col("content")).when(remap, made).otherwise(fv.FAIL_CLOSED_TEXT),
        }
    )


# Words that route an utterance, in the order they are tried.
POLICY_WORDS = ["政策", "规定", "规则", "条款", "policy"]
ORDER_WORDS = ["订单", "物流", "order"]
RETURN_WORDS = ["退货", "退款", "return"]
COMPARE_WORDS = ["比较", "对比", "compare"]
LATE_POLICY_WORDS = ["政策", "保修", "发票", "换货", "policy"]
POLICY_LABELS = [("退换货", "return"), ("保修", "warranty"), ("物流", "shipping"), ("发票", "invoice"), ("退款", "refund")]


def intent(text: Column) -> Column:
    """Tool an utterance calls for; questions back are ``ask:order_id`` and ``ask:code``."""
    low = F.lower(text)
    order_id = found(text, r"O[0-9]{6}")
    code = found(text, fv.CODE_IN_TEXT_PATTERN)
    products = F.size(F.regexp_extract_all(text, F.lit(r"(?i)P[0-9]{5}"), F.lit(0)))
    is_order = order_id.isNotNull() | contains_any(low, ORDER_WORDS)
    return (
        F.when(contains_any(low, POLICY_WORDS) & order_id.isNull(), "get_policy")
        .when(is_order & order_id.isNull(), "ask:order_id")
        .when(is_order & code.isNull(), "ask:code")
        .when(is_order & contains_any(low, RETURN_WORDS), "check_return_eligibility")
        .when(is_order, "get_order")
        .when((products >= 2) | contains_any(low, COMPARE_WORDS), "compare_products")
        .when(contains_any(low, LATE_POLICY_WORDS), "get_policy")
        .otherwise("search_catalog")
    )


def policy_type(text: Column) -> Column:
    out = None
    for label, key in POLICY_LABELS:
        hit = F.contains(text, F.lit(label))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise("return")
