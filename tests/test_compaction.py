import json

from pyspark.sql import functions as F

from shelfmark.operators import compaction as K


def compacted(spark, rows):
    df = spark.createDataFrame([(i, t, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, (t, r) in enumerate(rows)], "i int, tool string, result string")
    return {r["i"]: r["c"] for r in df.select("i", K.compact_payload(F.col("tool"), F.col("result")).alias("c")).collect()}


ITEM = {"item_id": "i1", "product_id": "p1", "name": "n", "price": 5, "memo": 1, "options": {"size": "L"}, "available": None}
KEPT = {"item_id": "i1", "product_id": "p1", "name": "n", "price": 5, "options": {"size": "L"}}
ORDER = {
    "order_id": "O1", "status": "delivered", "memo": "x", "items": [ITEM] * 14 + ["no object"],
    "payment_history": [{"transaction_type": "payment", "amount": i, "payment_method_id": "c", "memo": 1} for i in range(6)],
    "fulfillments": [{"tracking_id": ["t"], "item_ids": ["i1"], "memo": 1}, 7],
    "exchange_items": ["i1"],
}


def test_payloads_keep_what_decides(spark):
    order = {
        "order_id": "O1", "status": "delivered", "exchange_items": ["i1"], "items": [KEPT] * 12,
        "payment_history": [{"transaction_type": "payment", "amount": i, "payment_method_id": "c"} for i in range(2, 6)],
        "fulfillments": [{"tracking_id": ["t"], "item_ids": ["i1"]}],
    }
    product = {"product_id": "P", "title": "t", "memo": 1, "variants": {f"v{i:02}": {"item_id": f"v{i:02}", "memo": 1} for i in range(30)} | {"bad": 1}}
    small = {"product_id": "P", "title": "t", "variants": {f"v{i:02}": {"item_id": f"v{i:02}"} for i in range(23)}}
    cases = [
        ("get_policy", {"ok": True, "policies": [{"doc_id": "p", "title": "t", "text": "x" * 900, "extra": 1}, 3] * 4}, {"ok": True, "policies": [{"doc_id": "p", "title": "t", "text": "x" * 800}] * 2}),
        ("get_policy", {"ok": True}, {"ok": True, "policies": []}),
        ("compare_products", {"ok": True, "products": [{"ok": True, "product": {"product_id": "P1", "memo": 1}}, {"product_id": "P2"}, 4]}, {"ok": True, "products": [{"ok": True, "product": {"product_id": "P1"}}, {"ok": None, "product": {"product_id": "P2"}}]}),
        ("search_catalog", {"items": [{"product_id": i, "memo": 1} for i in range(13)]}, {"items": [{"product_id": i} for i in range(12)]}),
        ("search_catalog", {"items": [5]}, {"items": [{}]}),
        ("get_product", {"ok": True, "product": product, "evidence": ["y" * 700, "b", "c", "d"]}, {"ok": True, "product": small, "evidence": ["y" * 600, "b", "c"]}),
        ("get_product", {"product_id": "P9", "memo": 1}, {"product": {"product_id": "P9"}}),
        ("get_product_details", product, small),
        ("get_order", {"ok": True, "order": ORDER}, {"ok": True, "order": order}),
        ("get_order", {"ok": False, "error": "order_not_found"}, {"ok": False, "error": "order_not_found", "order": {}}),
        ("get_order_details", ORDER, order),
        ("cancel_pending_order", {"ok": True, "status": "cancelled", "items": None}, {"ok": True, "status": "cancelled", "items": []}),
        ("get_user_details", {"user_id": "U", "name": {"first": "é"}, "memo": 1}, {"user_id": "U", "name": {"first": "é"}}),
        ("other_tool", {"ok": True, "items": [1], "order": None, "memo": 2}, {"ok": True, "order": None, "items": [1]}),
        ("other_tool", {"memo": {"a": [1, {"b": None}]}}, {"memo": {"a": [1, {"b": None}]}}),
        ("get_order", [1, 2], [1, 2]),
    ]
    got = compacted(spark, [(t, r) for t, r, _ in cases] + [("get_order", 'plain "text"'), ("get_order", "")])
    for i, (tool, _, want) in enumerate(cases):
        assert json.loads(got[i]) == want, (tool, got[i])
        if isinstance(want, dict) and tool.startswith(("get_order", "get_p")) and tool != "get_order_details":
            assert list(json.loads(got[i])) == list(want), tool
    assert got[len(cases)] == json.dumps('plain "text"') and got[len(cases) + 1] == '""'
    recorded = spark.createDataFrame([("get_order_details", json.dumps(ORDER))], "tool string, result string")
    old = recorded.select(K.compact_payload(F.col("tool"), F.col("result"), ["order_id"]).alias("c")).first().c
    assert "exchange_items" not in old


def test_placeholder_has_the_reads_own_ok(spark):
    rows = [(1, 1, "tool", "get_order_details", json.dumps({"ok": False, "order_id": "O1"})), (1, 2, "tool", "get_order_details", json.dumps({"order_id": 'O"1'})),
            (1, 3, "tool", "get_order_details", json.dumps({"order_id": "O1"})), (1, 4, "tool", "get_order_details", json.dumps({"order_id": 'O"1'})), (1, 5, "user", None, "hello")]
    out = {r["pos"]: r for r in K.compact_history(spark.createDataFrame(rows, "conv int, pos int, role string, tool string, content string")).collect()}
    assert json.loads(out[1]["compact"]) == {"ok": False, "superseded_by_later_read": True, "order_id": "O1"}
    assert json.loads(out[2]["compact"]) == {"ok": True, "superseded_by_later_read": True, "order_id": 'O"1'}
    assert not out[3]["superseded"] and out[5]["compact"] == "hello"


def test_losses_by_value_and_subfield(spark):
    raw = {"order_id": "O1", "items": [{"item_id": i, "memo": i} for i in range(14)], "deep": {"a": {"b": [1, [2, 3]]}}, "none": None, "empty": []}
    df = spark.createDataFrame([(1, 1, "tool", "get_order_details", json.dumps(raw)), (1, 2, "user", None, "x")], "conv int, pos int, role string, tool string, content string")
    got = {r["field"]: (r["n"], r["lost"]) for r in K.field_losses(K.compact_history(df)).collect()}
    assert got == {"order_id": (1, 0), "items.item_id": (14, 2), "items.memo": (14, 14), "deep.a.b": (1, 1), "deep.a.b.": (2, 2)}
    by = K.subfield_losses(K.compact_history(df))
    assert {r["tool"]: (r["results"], r["lost"]) for r in K.loss_summary(by, "tool").collect()} == {"get_order_details": (1, 19)}


def test_losses_store_and_shuffle_no_leaf(spark, tmp_path):
    texts = [('{"a":1.00,"b":[{"c":"x"},{"c":"x"},[true,null]],"d":{}}', '{"a":1,"b":[{"c":"x"}]}'), ("[1]", "[1]"), ('{"a":1,"a":2}', "{}"), (None, None)]
    rows = [("c", i, "tool", "t", False, raw, small) for i, (raw, small) in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv string, pos int, role string, tool string, superseded boolean, content string, compact string")
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    lost = K.field_losses(df)
    assert {(r["field"], r["n"], r["lost"]) for r in lost.collect()} == {("a", 1, 0), ("b.c", 2, 1), ("b.", 1, 1)}
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # leaves are compared in their row
    assert str(spark.sparkContext._jsc.sc().getCheckpointDir()) == str(before)
    keyless = K.field_losses(df.where("pos = 0").withColumn("conv", F.lit(None).cast("string")))
    assert {(r["field"], r["n"], r["lost"]) for r in keyless.collect()} == {("a", 1, 1), ("b.c", 2, 2), ("b.", 1, 1)}


def test_payload_is_written_by_one_to_json_per_shape(spark):
    df = spark.createDataFrame([("get_order_details", "{}")], "tool string, result string")
    plan = df.select(K.compact_payload(F.col("tool"), F.col("result")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("to_json(") < 20  # one per shape of a result, none per field and list element


def test_payload_parts_without_values(spark):
    cases = [
        ("get_order_details", '{"order_id":"O1","payment_history":[],"items":null,"fulfillments":null}', '{"order_id":"O1","items":[],"payment_history":[]}'),
        ("get_order_details", '{"status":null,"items":[null,{"item_id":null,"price":1.50},{},"x"]}', '{"items":[{"price":1.5},{}]}'),
        ("get_order_details", '{"order_id":"nullable","payment_history":{"amount":1}}', '{"order_id":"nullable"}'),
        ("get_product_details", '{"variants":{"b":{"price":null,"name":"n"},"a":null}}', '{"variants":{"b":{"name":"n"}}}'),
        ("search_catalog", '{"items":[null,1,{"title":"é\\n"}]}', '{"items":[{},{},{"title":"é\\n"}]}'),
        ("get_product", '{"product":{"memo":1},"price":2}', '{"product":{}}'),
        ("get_order", '{"order":{"memo":1}}', '{"order":{}}'),
        ("other_tool", '{"order":null,"memo":1}', '{"order":null}'),
    ]
    got = compacted(spark, [(t, r) for t, r, _ in cases])
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_order_lines_are_gathered_once(spark, sf):
    from shelfmark.plans import q_runs

    plan = q_runs.payloads(spark, sf).where("tool = 'get_order_details'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
