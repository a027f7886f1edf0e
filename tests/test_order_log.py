"""The composed order log against one command after another."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import order_log as L
from shelfmark.operators import orders as O

AS_OF = "2024-01-10"
ORDERS = "order_id string, user_id string, status string, return_status string, exchange_status string, payment_method_id string, product_id string, items array<string>, shipping_address string, delivered_at date, opened boolean, quality_issue boolean"
COMMANDS = "seq bigint, ts timestamp, tool string, order_id string, user_id string, verification_code string, confirmed boolean, reason string, payment_method_id string, item_ids array<string>, new_item_ids array<string>, address string"


def made(n, hot, seed=5):
    rng = random.Random(seed)
    orders = []
    for i in range(12):
        status = ["pending", "pending", "delivered"][i % 3]
        orders.append((f"o{i}", "u", status, rng.choice([None, None, "requested", "closed"]), rng.choice([None, None, "exchanged"]), "card", "a", rng.choice([["a", "b"], ["a", "a", "c"], None]), rng.choice([None, "x"]), "2024-01-08", False, True))
    orders += [("hot", "u", "pending", None, None, "card", "a", ["a", "b"], None, None, False, False)]
    lists = [["a"], ["b"], ["a", "b"], ["a", "a"], ["c", "c"], ["b", "c"], ["d"], []]
    commands = []
    for seq in range(n):
        order = "hot" if rng.random() < hot else rng.choice(orders)[0]
        tool = "modify_pending_order_items" if order == "hot" and rng.random() < 0.7 else rng.choice(L.WRITE_TOOLS)
        if order == "hot" and tool == "cancel_pending_order" and seq < 0.9 * n:
            tool = "modify_pending_order_address"
        asked = rng.choice(lists)
        new = rng.choice([x for x in lists if len(x) == len(asked)]) if rng.random() < 0.9 else ["a", "b", "c"]
        commands.append((seq, f"2024-01-0{1 + seq * 3 // n} 00:00:00", tool, order, "u", "123456" if rng.random() < 0.95 else "1", rng.random() < 0.95, "no longer needed", rng.choice(["card", "gift_card_1", "other"]), asked, new, rng.choice(["x", "y", None])))
    return orders, commands


def frames(spark, orders, commands):
    o = spark.createDataFrame(orders, ORDERS.replace("delivered_at date", "delivered_at string")).withColumn("delivered_at", F.to_date("delivered_at"))
    c = spark.createDataFrame(commands, COMMANDS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    return o, c, spark.createDataFrame([("u", "123456", ["card", "gift_card_1"])], "user_id string, verification_code string, payment_methods array<string>")


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_composed_log_equals_one_after_another(spark, hot):
    orders, commands = made(400, hot)
    o, c, u = frames(spark, orders, commands)
    live = {r.seq: r for r in O.with_records(c, L.opened(o), u).withColumn("static", O.static_error(AS_OF)).where("static is null").collect()}
    state, want = {}, {}
    for seq in sorted(live):  # ts never decreases in seq
        r = live[seq]
        before = state.get(r.order_id) or O.open_order(r)
        state[r.order_id], changed, error = O.apply_one(before, SimpleNamespace(**r.asDict()))
        s = state[r.order_id]
        want[seq] = (changed, error, s.status, s.return_status, s.payment, list(s.items), s.address, s.exchanged, s.version)
    applied = L.apply_log(c, o, u, AS_OF)
    got = {r.seq: (r.changed, r.error, r.status, r.return_status, r.payment_method_id, r["items"], r.shipping_address, r.exchange_status is not None, r.version) for r in applied.collect() if r.version is not None}
    assert got == want and applied.count() == len(commands)
    final = {r.order_id: (r.status, r["items"], r.shipping_address, r.version) for r in L.final_orders(o, applied).collect()}
    for oid, s in state.items():
        assert final[oid] == (s.status, list(s.items), s.address, s.version)
    assert len(final) == len(orders)


def test_hot_order_is_spread_over_blocks(spark):
    from shelfmark.functions.scale import ranged_blocks

    _, commands = made(400, 0.5)
    df = spark.createDataFrame(commands, COMMANDS.replace("ts timestamp", "ts string"))
    blocks = ranged_blocks(df, ["order_id"], ["ts", "seq"], "part").where("order_id = 'hot'").groupBy("part").count().collect()
    assert len(blocks) > 1 and max(r["count"] for r in blocks) <= 0.35 * len(commands)


def test_empty_log_leaves_orders_as_they_are(spark):
    orders, commands = made(3, 0.0)
    o, c, u = frames(spark, orders, commands)
    out = L.final_orders(o, L.apply_log(c.limit(0), o, u, AS_OF)).collect()
    assert len(out) == len(orders) and all(r.version == 0 for r in out)
