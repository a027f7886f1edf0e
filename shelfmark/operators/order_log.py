"""A whole log of order writes, applied in (ts, seq) order without replaying an order in one task.

Every transition of an order is a transfer that forgets what was before: a cancel or
a return holds from its first success, an address or a payment change replaces the
value, and an item change replaces the whole item list. So the state before a command
is found by first-success aggregates and by running windows over blocks. Only whether
an item change succeeds depends on the list the last successful one left. For that,
each block is summarised as a transfer (for every list of items asked for in it, the
list with which the block ends if that request is the first to succeed); the
transfers of an order's blocks are combined into what each block starts with, and
then all blocks are replayed side by side. Blocks are ranges of (order, time), so an
order with a third of all commands is spread over them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import broadcast_if_small, ordered_fold, ranged_blocks, running, settled
from shelfmark.operators.orders import PENDING_TOOLS, RETURN_TOOLS, WRITE_TOOLS, at, static_error, with_records

CHANGE_ITEMS, EXCHANGE, RETURN_ITEMS, CANCEL = "modify_pending_order_items", "exchange_delivered_order_items", "return_delivered_order_items", "cancel_pending_order"
_BLOCK = "__part"


def held(items: Column, have: Column) -> Column:
    """Is every item asked for at most as often as it is there?"""

    def count(of: Column, item: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == item))

    return F.forall(F.array_distinct(items), lambda i: count(items, i) <= count(have, i))


def _fits(asked: tuple[str, ...], have: tuple[str, ...]) -> bool:
    return all(asked.count(i) <= have.count(i) for i in asked)


def _owned() -> Column:
    return F.coalesce(F.array_contains("payment_methods", F.col("payment_method_id")), F.lit(False))


def _lengths_fit() -> Column:
    return (F.size("item_ids") > 0) & (F.size("item_ids") == F.size("new_item_ids"))


def _by_block(live: DataFrame, marks: DataFrame) -> DataFrame:
    """``live`` with its order's row of ``marks``; joined per block, so that a hot order stays spread."""
    blocks = live.select("order_id", _BLOCK).distinct().join(marks, "order_id")
    return live.join(broadcast_if_small(settled(blocks)), ["order_id", _BLOCK], "left")


# --- item changes --------------------------------------------------------------------
def block_transfers(candidates: DataFrame) -> DataFrame:
    """order_id, block, asked, first_at, ends_with: each block as a transfer of item lists.

    Read backwards: what the block ends with after a row follows from the first later
    request that fits the row's new list. One row per distinct request of a block.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast(candidates.schema["ts"].dataType)
    back = candidates.withColumn("back_ts", -F.timestamp_diff("MICROSECOND", epoch, "ts")).withColumn("back_seq", -F.col("seq"))

    def step(later: dict, row: Any) -> tuple[dict, dict[str, Any]]:
        asked, new = tuple(row.item_ids), tuple(row.new_item_ids)
        fitting = [v for k, v in later.items() if _fits(k, new)]
        ends = min(fitting)[2] if fitting else new
        later[asked] = (-row.back_ts, -row.back_seq, ends)
        return later, {"order_id": row.order_id, _BLOCK: getattr(row, "block_no"), "asked": list(asked), "ts_micros": -row.back_ts, "seq": -row.back_seq, "ends_with": list(ends)}

    rows = ordered_fold(
        back.withColumn("block_no", F.col(_BLOCK)).select("order_id", "block_no", "back_ts", "back_seq", "item_ids", "new_item_ids"),
        ["order_id", "block_no"], ["back_ts", "back_seq"], lambda row: {}, step,
        f"order_id string, {_BLOCK} int, asked array<string>, ts_micros bigint, seq bigint, ends_with array<string>",
    )
    when = F.struct("ts_micros", "seq")
    return rows.groupBy("order_id", _BLOCK, "asked").agg(F.min(when).alias("first_at"), F.min_by("ends_with", when).alias("ends_with"))


def block_entries(transfers: DataFrame, first: DataFrame) -> DataFrame:
    """order_id, block, entry: the item list each block starts with. ``first`` has each order's own list (order_id, items)."""

    def start(row: Any) -> dict:
        return {"value": tuple(row.items), "block": None, "done": False}

    def step(state: dict, row: Any) -> tuple[dict, dict[str, Any]]:
        if row.block_no != state["block"]:
            state = {"value": state["value"], "entry": state["value"], "block": row.block_no, "done": False}
        if not state["done"] and _fits(tuple(row.asked), state["entry"]):
            state["value"], state["done"] = tuple(row.ends_with), True
        return state, {"order_id": row.order_id, _BLOCK: row.block_no, "entry": list(state["entry"])}

    rows = transfers.join(first, "order_id").select(
        "order_id", F.col(_BLOCK).alias("block_no"), F.col("first_at.ts_micros").alias("ts_micros"), F.col("first_at.seq").alias("seq"), "asked", "ends_with", "items"
    )
    told = ordered_fold(rows, ["order_id"], ["block_no", "ts_micros", "seq"], start, step, f"order_id string, {_BLOCK} int, entry array<string>")
    return told.groupBy("order_id", _BLOCK).agg(F.first("entry").alias("entry"))


def item_changes(candidates: DataFrame) -> DataFrame:
    """order_id, block, seq of the item changes whose request fits the list at its turn.

    ``candidates`` (order_id, block, ts, seq, items, item_ids, new_item_ids) have passed every other check.
    """
    blocks = candidates.select("order_id", _BLOCK).distinct()
    several = settled(blocks.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("order_id"))
    begun = candidates.withColumn("entry", F.col("items"))
    if not several.isEmpty():
        split = candidates.join(broadcast_if_small(several), "order_id", "left_semi")
        entries = settled(block_entries(block_transfers(split), split.groupBy("order_id").agg(F.first("items").alias("items"))))
        begun = candidates.join(broadcast_if_small(entries), ["order_id", _BLOCK], "left").withColumn("entry", F.coalesce("entry", "items"))

    def step(have: tuple, row: Any) -> tuple[tuple, dict[str, Any]]:
        ok = _fits(tuple(row.item_ids), have)
        return (tuple(row.new_item_ids) if ok else have), {"order_id": row.order_id, _BLOCK: row.block_no, "seq": row.seq, "fits": ok}

    rows = begun.withColumn("block_no", F.col(_BLOCK)).select("order_id", "block_no", "ts", "seq", "entry", "item_ids", "new_item_ids")
    flags = ordered_fold(rows, ["order_id", "block_no"], ["ts", "seq"], lambda row: tuple(row.entry), step, f"order_id string, {_BLOCK} int, seq bigint, fits boolean")
    return flags.where("fits").select("order_id", _BLOCK, "seq", "fits")


# --- the log -----------------------------------------------------------------------------
def opened(orders: DataFrame) -> DataFrame:
    """Orders with the fields the log writes; an order without a list of items has its product as the only one."""
    have = set(orders.columns)
    items = F.coalesce("items", F.array("product_id")) if "items" in have else F.array("product_id")
    none = F.lit(None).cast("string")
    return orders.withColumns({
        "items": items,
        "shipping_address": F.col("shipping_address") if "shipping_address" in have else none,
        "exchange_status": F.col("exchange_status") if "exchange_status" in have else none,
    })


def apply_log(commands: DataFrame, orders: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Every write command with its outcome and the order's state after it.

    ``commands`` (seq unique, ts, tool, order_id, …) ask for ``item_ids``,
    ``new_item_ids``, ``payment_method_id`` and ``address`` (canonical text).
    ``orders`` may carry items (array), shipping_address and exchange_status. Commands
    that a check of their own settles have no state columns.
    """
    joined = with_records(commands.where(F.col("tool").isin(WRITE_TOOLS)), opened(orders), users).withColumn("static", static_error(as_of))
    keep = [
        "order_id", "ts", "seq", "tool", "status", "return_status", "exchange_status", "items", "shipping_address", "order_payment",
        "payment_methods", "payment_method_id", "item_ids", "new_item_ids", "address",
    ]
    live = ranged_blocks(joined.where(F.col("static").isNull()).select(*keep), ["order_id"], ["ts", "seq"], _BLOCK)
    tool = F.col("tool")

    cancels = (tool == CANCEL) & (F.col("status") == "pending")
    swaps = (tool == EXCHANGE) & F.col("exchange_status").isNull() & _lengths_fit() & held(F.col("item_ids"), F.col("items")) & _owned()
    marks = live.groupBy("order_id").agg(
        F.min(F.when(cancels, at())).alias("cancel_at"),
        F.min(F.when(swaps, at())).alias("swap_at"),
        F.min_by(F.struct("new_item_ids", "payment_method_id"), F.when(swaps, at())).alias("swap"),
    ).where("cancel_at is not null or swap_at is not null")
    rows = _by_block(live, marks)
    open_ = F.col("cancel_at").isNull() | (at() < F.col("cancel_at"))
    turns = rows.where((tool == CHANGE_ITEMS) & open_ & _lengths_fit() & _owned())
    changed_items = item_changes(turns.select("order_id", _BLOCK, "ts", "seq", "items", "item_ids", "new_item_ids"))
    rows = settled(rows.join(broadcast_if_small(settled(changed_items)), ["order_id", _BLOCK, "seq"], "left").withColumn("fits", F.coalesce("fits", F.lit(False))))

    sets_pay = F.col("fits") | ((tool == "modify_pending_order_payment") & open_ & _owned())
    sets_address = (tool == "modify_pending_order_address") & open_
    before = running(
        rows, ["order_id"], ["ts", "seq"], F.col(_BLOCK), before_only=True,
        lasts={
            "items_set": F.when(F.col("fits"), F.col("new_item_ids")),
            "pay_set": F.when(sets_pay, F.col("payment_method_id")),
            # a change to no address is a change too
            "address_set": F.when(sets_address, F.struct(F.col("address").alias("to"))),
        },
    )
    swapped = F.coalesce(F.col("swap_at") < at(), F.lit(False))
    now = before.withColumns({
        "items_now": F.when(swapped, F.col("swap.new_item_ids")).otherwise(F.coalesce("items_set", "items")),
        "pay_now": F.when(swapped, F.col("swap.payment_method_id")).otherwise(F.coalesce("pay_set", "order_payment")),
        "address_now": F.when(F.col("address_set").isNotNull(), F.col("address_set.to")).otherwise(F.col("shipping_address")),
        "was_swapped": swapped | F.col("exchange_status").isNotNull(),
        "cancelled": ~open_,
    })
    asks_held = F.col("fits") | held(F.col("item_ids"), F.col("items_now"))
    no_method = F.when(~_owned(), "payment_method_not_found")
    gift = _owned() & F.col("payment_method_id").startswith("gift_card_")
    content = F.coalesce(F.when(~_lengths_fit(), "item_length_mismatch"), F.when(~asks_held, "item_not_found"), no_method)
    refund = F.when(tool == RETURN_ITEMS, F.coalesce(
        F.when((F.size("item_ids") == 0) | ~asks_held, "item_not_found"),
        F.when(~F.col("payment_method_id").eqNullSafe(F.col("pay_now")) & ~gift, "payment_method_not_found"),
    ))
    error = (
        F.when(tool == CANCEL, F.when(~F.col("status").isin("pending", "cancelled"), "order_not_pending"))
        .when(tool.isin(PENDING_TOOLS) & F.col("cancelled"), "order_not_pending")
        .when(tool == "modify_pending_order_payment", no_method)
        .when(tool == CHANGE_ITEMS, content)
        .when(tool.isin(RETURN_TOOLS), F.coalesce(refund, F.when(F.col("return_status") != "requested", "return_status_conflict")))
        .when(
            tool == EXCHANGE,
            F.when(F.col("was_swapped"), F.when(F.col("items_now") != F.col("new_item_ids"), "exchange_already_completed")).otherwise(content),
        )
    )
    now = settled(now.withColumn("error", error))
    asks_return = tool.isin(RETURN_TOOLS) & F.col("error").isNull() & F.col("return_status").isNull()
    returns = now.groupBy("order_id").agg(F.min(F.when(asks_return, at())).alias("return_at")).where("return_at is not null")
    now = _by_block(now, returns)

    pay_differs = ~F.col("pay_now").eqNullSafe(F.col("payment_method_id"))
    change = (
        F.when(F.col("error").isNotNull(), False)
        .when(tool == CANCEL, (F.col("status") == "pending") & (at() == F.col("cancel_at")))
        .when(tool == "modify_pending_order_address", ~F.col("address_now").eqNullSafe(F.col("address")))
        .when(tool == "modify_pending_order_payment", pay_differs)
        .when(tool == CHANGE_ITEMS, pay_differs | (F.col("items_now") != F.col("new_item_ids")))
        .when(tool == EXCHANGE, ~F.col("was_swapped"))
        .otherwise(F.coalesce(F.col("return_at") == at(), F.lit(False)))
    )
    now = settled(now.withColumn("changed", F.coalesce(change, F.lit(False))))
    counted = running(now, ["order_id"], ["ts", "seq"], F.col(_BLOCK), sums={"version": F.col("changed").cast("int")})
    passed = F.col("error").isNull()
    moved = passed & tool.isin(CHANGE_ITEMS, EXCHANGE)
    applied = counted.select(
        "seq", "ts", "order_id", "tool",
        passed.alias("ok"), "changed", (passed & ~F.col("changed")).alias("idempotent_replay"), "error",
        F.when((F.col("cancel_at") <= at()) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(F.col("return_at") <= at(), "requested").otherwise(F.col("return_status")).alias("return_status"),
        F.when(moved & ~(F.col("was_swapped") & (tool == EXCHANGE)) | (passed & (tool == "modify_pending_order_payment")), F.col("payment_method_id"))
        .otherwise(F.col("pay_now")).alias("payment_method_id"),
        F.when(moved, F.col("new_item_ids")).otherwise(F.col("items_now")).alias("items"),
        F.when(passed & (tool == "modify_pending_order_address"), F.col("address")).otherwise(F.col("address_now")).alias("shipping_address"),
        F.when(F.col("exchange_status").isNull() & (F.col("was_swapped") | (moved & (tool == EXCHANGE))), "exchanged").otherwise(F.col("exchange_status")).alias("exchange_status"),
        F.col("version").cast("int").alias("version"),
    )
    blocked = joined.where(F.col("static").isNotNull()).select(
        "seq", "ts", "order_id", "tool", F.lit(False).alias("ok"), F.lit(False).alias("changed"), F.lit(False).alias("idempotent_replay"), F.col("static").alias("error"),
    )
    return applied.unionByName(blocked, allowMissingColumns=True)


STATE = ["status", "return_status", "payment_method_id", "items", "shipping_address", "exchange_status"]


def final_orders(orders: DataFrame, applied: DataFrame) -> DataFrame:
    """Orders after the log, by one aggregate of the last state per order; untouched ones as they were."""
    last = applied.where(F.col("version").isNotNull()).groupBy("order_id").agg(F.max_by(F.struct(*STATE, "version"), at()).alias("s"))
    o = opened(orders).join(last, "order_id", "left")
    return o.select(
        "order_id",
        *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in STATE],
        F.coalesce("s.version", F.lit(0)).alias("version"),
    )
