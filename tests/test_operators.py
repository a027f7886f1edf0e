"""Operators on small fixtures, against brute force where SQL gives no check."""

from __future__ import annotations

import fnmatch
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scale
from shelfmark.functions.text import answer_sentences, facts, glob_to_regex, parse_price, redact_json, replace_first
from shelfmark.operators import audit as A
from shelfmark.operators import corpus as C
from shelfmark.operators import dataset as S
from shelfmark.operators import evidence as V
from shelfmark.operators import grading as G
from shelfmark.operators import orders as O
from shelfmark.operators import postings as X
from shelfmark.operators import progress as P
from shelfmark.operators import retrieval as R
from shelfmark.operators.components import connected_components
from shelfmark.plans import domain as D
from shelfmark.plans import q_trajectories as Q
from shelfmark.operators.traces import block_end
from shelfmark.sources import readers, sinks, synthetic


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_helpers(spark):
    assert one(spark, parse_price("p"), p="US$ 1,299.50 each") == 1299.5
    assert one(spark, parse_price("p"), p="n/a") is None
    assert one(spark, replace_first("t", "o", "0"), t="foo boo") == "f0o boo"
    assert one(spark, F.rlike(F.lit("return.eligible"), glob_to_regex("g")), g="return.*") is True
    assert one(spark, F.rlike(F.lit("returnXeligible"), glob_to_regex("g")), g="return.*") is False
    assert json.loads(one(spark, redact_json("j"), j='{"verification_code": 123456, "t": "654321 O000001"}')) == {
        "verification_code": "[REDACTED]", "t": "[REDACTED] O000001"
    }
    assert one(spark, answer_sentences("t"), t="商品价格是 899 元。[E2]退货需要 7 天。") == ["商品价格是 899 元[E2]。", "退货需要 7 天。"]
    got = one(spark, facts("t"), t="订单 O000123 于 2026年7月1日 已送达，价格 899 元，不可退货")
    assert set(got) == {"O000123", "2026-07-01", "899 元", "已送达", "不可退货"}


def test_blocked_dense_and_lexical_equal_unblocked(spark, sf, tmp_path):
    e = D.table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = R.dense_topk(v, q, k=3, exclude_self=True)
    parts = R.dense_topk(v, q, k=3, exclude_self=True, limit_bytes=100_000)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert whole.where(F.col("chunk_id") == F.col("query_id")).count() == 0
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    qs = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    parts = R.dense_topk(v.repartition(5), q, k=3, exclude_self=True, query_tile=7, vector_tile=11)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    want = sorted(map(str, R.bm25_topk(docs, qs, k=4).collect()))
    index, terms = X.build_index(docs.repartition(7), str(tmp_path / "index")), R.query_terms(qs)
    again = X.open_index(spark, str(tmp_path / "index"))
    table = X.inverted(again, str(tmp_path / "inverted"), buckets=8)
    assert sorted(map(str, X.topk(index, terms, 4, direct_pairs=0).collect())) == want
    assert sorted(map(str, X.topk(again, terms, 4, table=table).collect())) == want
    assert sorted(map(str, X.topk(again, terms, 4, table=table, direct_pairs=0).collect())) == want
    few = docs.where("chunk_id < 3").unionByName(spark.createDataFrame([(-1, None), (-2, "")], docs.schema))
    small = X.build_index(few)
    assert sorted(map(str, X.topk(small, terms, 4, direct_pairs=0).collect())) == sorted(map(str, X.topk(small, terms, 4).collect()))
    assert X.topk(X.build_index(docs.limit(0)), terms, 4).count() == 0


def test_globs_meet_a_dictionary_of_fields(spark):
    fields = ["order.status", "order.id", "return.eligible", "product.evidence.1", "product.evidence.12", "product.price", "", "order"]
    globs = ["order.*", "*.status", "*", "product.evidence.?", "product.[ep]*", "product.[!e]*", "none.*", "order*"]
    got = V.glob_fields(spark.createDataFrame([(g,) for g in globs], "need string"), spark.createDataFrame([(f,) for f in fields], "field string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((g, f) for g in globs for f in fields if fnmatch.fnmatchcase(f, g))
    rows = spark.createDataFrame([("a", f"E{i}", "s", "order.status", "shipped", "shipped") for i in range(5)] + [("a", "E9", "s", "order.id", "O1", "O1"), ("b", "E1", "s", "order.id", "O2", "O2")],
                                 "trajectory_id string, evidence_id string, source_id string, field string, value string, text string")
    asked = spark.createDataFrame([("a", "it is shipped", ["order.*", "order.id", "none.*"]), ("b", "nothing", ["order.*"]), ("c", "x", ["*"])], "trajectory_id string, answer string, required array<string>")
    assert sorted((r["trajectory_id"], r["covered"], r["required"], r["omitted"]) for r in V.required_coverage(asked, rows).collect()) == [
        ("a", 1, 3, ["none.*", "order.id"]), ("b", 0, 1, ["order.*"]), ("c", 0, 1, ["*"])]


def test_filters_come_after_fusion(spark):
    chunks = spark.createDataFrame(
        [(i, f"d{i}", "product", "accessories" if i > 2 else "phones", f"t{i}") for i in range(1, 6)],
        "chunk_id long, doc_id string, source_type string, category string, text string",
    )
    q = spark.createDataFrame([(1, "case")], "query_id long, text string")
    lex = spark.createDataFrame([(1, i, 1.0, i) for i in (1, 2, 3)], "query_id long, chunk_id long, score double, rank int")
    out = R.hybrid_search(lex, lex.limit(0), chunks, q, top_k=5, category="ACCESS")
    assert [r["doc_id"] for r in out.collect()] == ["d3"]  # d4 and d5 were outside the channel


def test_running_blocks_agree_with_one_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos long, v int")
    out = scale.running(df, ["k"], ["pos"], F.floor(F.col("pos") / 17), sums={"s": F.coalesce("v", F.lit(0))}, maxima={"m": F.col("v")}, lasts={"l": F.col("v")})
    state = defaultdict(lambda: [0, None, None])
    want = {}
    for k, pos, v in rows:
        s = state[k]
        if v is not None:
            s[0], s[1], s[2] = s[0] + v, v if s[1] is None else max(s[1], v), v
        want[pos] = tuple(s)
    assert {r["pos"]: (r["s"], r["m"], r["l"]) for r in out.collect()} == want


def test_exact_ranks_with_skew(spark):
    rng = random.Random(3)
    vals = [("hot", float(rng.randint(0, 5))) for _ in range(500)] + [("cold", float(rng.random())) for _ in range(41)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {r["g"]: r for r in scale.exact_ranks(df, ["g"], "v", {"med": ("inclusive", 0.5), "near": ("nearest", 0.95), "low": ("floor", 0.95), "up": ("upper_median", 0.5)}, buckets=8).collect()}
    for g in ("hot", "cold"):
        xs = sorted(v for k, v in vals if k == g)
        n = len(xs)
        at = (n - 1) * 0.5
        assert got[g]["med"] == pytest.approx(xs[int(at)] * (1 - at % 1) + xs[min(n - 1, int(at) + 1)] * (at % 1))
        assert got[g]["near"] == xs[max(0, int(n * 0.95 + 0.999999) - 1)]
        assert got[g]["low"] == xs[max(0, int(n * 0.95) - 1)]
        assert got[g]["up"] == xs[n // 2]


def taken_in_turn(rows):
    used, kept = Counter(), set()
    for sim, t, h, _ in rows:
        if used[t] < 3 and used[h] < 8:
            used[t] += 1
            used[h] += 1
            kept.add(sim)
    return kept


def test_components_and_double_cap_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"s{i}", f"t{rng.randint(0, 12)}", f"h{rng.randint(0, 9)}" if rng.random() < 0.7 else "hot", i) for i in range(160)]
    df = spark.createDataFrame(rows, "simulation_id string, task_id string, signature_hash string, ord long")
    used, kept = Counter(), set()
    for sim, t, h, _ in rows:
        if used[t] < 3 and used[h] < 8:
            used[t] += 1
            used[h] += 1
            kept.add(sim)
    assert {r[0] for r in S.double_cap(df, "ord").select("simulation_id").collect()} == kept
    assert {r[0] for r in S.double_cap(df.withColumn("ord", F.lit(0)), "ord").select("simulation_id").collect()} == taken_in_turn(sorted(rows))
    hot = [(f"s{i:03}", "one task" if i % 3 == 0 else f"t{i}", f"h{i // 40}", i) for i in range(240)]
    hot_df = spark.createDataFrame(hot, df.schema)
    assert {r[0] for r in S.double_cap(hot_df, "ord", rounds=8).select("simulation_id").collect()} == taken_in_turn(hot)
    assert S.double_cap(df.limit(0), "ord").count() == 0
    edges = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("z1", "z2")]
    comp = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(comp.values()) == {"a0", "z1"}


def test_isolated_splits_do_not_leak(spark, sf):
    s = Q.sims(spark, sf).select("simulation_id", "task_id", "signature_hash")
    splits = S.isolated_splits(s)
    placed = s.join(splits.select("simulation_id", "split"), "simulation_id")
    assert placed.count() == s.count()
    assert S.leaks(placed).count() == 0


def test_audit_contract(spark):
    ok = [("s", 1, "assistant", None, False, [("find_user_id_by_email", {"email": "x"})]), ("s", 2, "tool", "{}", False, None),
          ("s", 3, "assistant", None, False, [("get_order_details", {"order_id": "W1"})]), ("s", 4, "tool", "{}", False, None),
          ("s", 5, "assistant", "Please confirm cancelling W1", False, None), ("s", 6, "user", "yes", False, None),
          ("s", 7, "assistant", None, False, [("cancel_pending_order", {"order_id": "W1", "reason": "no longer needed"})]), ("s", 8, "tool", "{}", False, None),
          ("s", 9, "assistant", "Done.", False, None)]
    schema = "sim string, pos long, role string, content string, error boolean, calls array<struct<name:string,args:map<string,string>>>"
    m = spark.createDataFrame(ok, schema)
    cs = "sim string, expected_termination string, confirmation_requirement string, expected array<struct<name:string,args:map<string,string>>>"
    good = spark.createDataFrame([("s", "success_write", "explicit", [("cancel_pending_order", {"order_id": "W1"})])], cs)
    assert A.audit(m, contracts=good).count() == 0
    twice = spark.createDataFrame([("s", "refuse_no_write", "x", [("cancel_pending_order", {"order_id": "W1"})] * 2)], cs)
    found = {r["violation"] for r in A.audit(m, contracts=twice).collect()}
    assert found == {"missing_successful_expected_action:cancel_pending_order", "write_for_no_write_contract", "required_refusal_or_no_change_not_stated"}


def test_evidence_rules(spark):
    led = spark.createDataFrame(
        [("a", "E1", "policy:POL001", "policy.text", "退款 3-5 个工作日到账，7 天无理由", "退款 3-5 个工作日到账，7 天无理由"), ("a", "E2", "product:P00001", "product.price", "899.0", "899.0"), ("a", "E3", "product:P00001", "product.discontinued", "false", "false")],
        "trajectory_id string, evidence_id string, source_id string, field string, value string, text string",
    ).withColumn("scope", F.col("trajectory_id"))

    def contradiction(text):
        st = spark.createDataFrame([("a", 0, text)], "scope string, sentence_no int, sentence string")
        rows = V.contradictions(st, led, V.row_keys(led)).collect()
        return [(r["rule"], r["claim"]) for r in rows]

    assert contradiction("商品价格 899 元") == []
    assert contradiction("商品价格 999 元") == [(1, "999元")]
    assert contradiction("预算不超过 500 元") == []
    assert contradiction("该商品已停产") == [(4, "已停产")]
    assert contradiction("退款需要 9 天") == [(6, "9 天")]
    assert contradiction("7 天无理由退货") == []


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "products.jsonl"
    p.write_text('{"id":"P001","title":"Air Pro","description":"d","attributes":{"z":"1","a":"2"}}\n\n', encoding="utf-8")
    prods = readers.read_products(spark, str(p))
    chunks = C.product_chunks(prods, C.ordered_attributes("attributes"))
    rows = {r["chunk_id"]: r["text"] for r in chunks.collect()}
    assert rows == {"product:P001:desc:0": "Air Pro：d", "product:P001:attr:0": "Air Pro specification: z 1", "product:P001:attr:1": "Air Pro specification: a 2"}
    vec = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    parents = C.product_parents(prods, C.ordered_attributes("attributes"))
    sinks.write_corpus(chunks, parents, vec, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus" / "postings")).count() > 0
    with pytest.raises(ValueError):
        sinks.write_corpus(chunks, parents, vec.limit(1), str(tmp_path / "bad"))
    bad = tmp_path / "raw.jsonl"
    bad.write_text('{"asin":"A","title":"t"}\n{oops\n', encoding="utf-8")
    assert readers.count_malformed(spark, str(bad), "asin string").first().asDict() == {"lines": 2, "malformed": 1}
    audits = tmp_path / "audits.jsonl"
    audits.write_text('{"simulation_id":"s1","process_compliant":true}\n{"simulation_id":"s1"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="duplicate simulation_id"):
        spark.read.schema("simulation_id string, process_compliant boolean").json(str(audits)).transform(lambda d: readers.require_unique(d, "simulation_id")).collect()
    n = spark.range(1, 101).withColumnRenamed("id", "i")
    a, b = (synthetic.seed_orders(n, 20, 50, "2026-07-20", 1).collect() for _ in range(2))
    assert a == b and a[0]["status"] == "pending" and a[4]["opened"] is True
    assert synthetic.seed_users(n, 1).where("user_id = 'U0002'").first()["verification_code"] == "015838"


def test_probe_grid_and_order_steps(spark):
    grid = G.probe_grid(None, spark.range(1, 57).withColumnRenamed("id", "i"))
    assert grid.count() == 56 and G.thin_classes(grid).count() == 0
    assert grid.where("task_id = 'p1_verif_cancel_pending_order_01'").first()["user_goal"] == "请帮我取消待处理订单，订单号 O000001。"
    said = spark.createDataFrame([("不提供。", "拒绝提供验证码")], "a string, b string")
    assert said.select(P.reason_refused(F.col("a")), P.code_refused(F.col("b"))).first() == (True, True)


def test_order_step_replays_and_guards():
    class Row:
        tool, item_ids, new_item_ids = "exchange_delivered_order_items", ["P1"], ["P2"]
        payment_methods, payment_method_id, address = ["gift_card_U1"], "gift_card_U1", None

    start = O.OrderState("delivered", None, False, ("P1",), "card", None, 0)
    done, changed, error = O.apply_one(start, Row)
    assert (changed, error, done.items, done.version) == (True, None, ("P2",), 1)
    assert O.apply_one(done, Row)[1:] == (False, None)
    Row.new_item_ids = ["P3"]
    assert O.apply_one(done, Row)[2] == "exchange_already_completed"


def test_block_end_skips_braces_inside_strings(spark):
    cases = [
        ("", 0), ("no brace }", 0), ("{", -1), ("{}", 2), ("é {} {}", 4), ('x {"a":"}"} y', 11), ('{"a":"\\"}"}', 11), ('{"a":"\\\\"}', 10), ('{"a":"', -1),
        ("{{}", -1), ("{{}}}", 4), ('" { "}" }', 9), ("{\\}", 3), ('{"' + "a" * 50000 + '"}', 50004), ("{" * 3000 + "}" * 3000, 6000),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", block_end(F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_readers_refuse_what_they_cannot_use(spark, tmp_path):
    def lines(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    good = '{"id":"P1","title":"t"}\n\n  \n{"id":"P2","attributes":"{}"}\n'
    assert [r.id for r in readers.read_products(spark, lines("good.jsonl", good)).collect()] == ["P1", "P2"]
    for i, bad in enumerate(['{"id":"P1"', '{"title":"no id"}', '{"id":""}', "[1]"]):
        with pytest.raises(Exception, match="not a usable record"):
            readers.read_products(spark, lines(f"bad{i}.jsonl", good + bad + "\n")).collect()
    with pytest.raises(Exception, match="not a usable record"):
        readers.read_audits(spark, lines("audits.jsonl", '{"simulation_id":"s1"}\n{"reviewer":"r"}\n')).collect()
    with pytest.raises(Exception, match="not a usable record"):
        readers.read_tasks(spark, lines("tasks.jsonl", '{"category":"c"}\n')).collect()


def test_blank_simulation_ids_are_rejected_and_not_lost(spark):
    rows = [(None, 1), ("", 2), ("a", 3), ("a", 4), (None, 5)]
    sims = spark.createDataFrame(rows, "simulation_id string, seq int").withColumns({
        "task_id": F.lit("t"), "reward": F.lit(1.0), "db_match": F.lit(True), "termination_reason": F.lit("user_stop"),
        "compliant": F.lit(True), "conversion_reason": F.lit(None).cast("string"), "n_tool_calls": F.lit(1),
    })
    got = {r.seq: r.reason for r in S.rejection_reasons(sims, "seq").collect()}
    lost = "missing_or_duplicate_simulation_id"
    assert got == {1: lost, 2: lost, 3: None, 4: lost, 5: lost}


def test_ranks_with_an_outlier_and_numbers_over_many_blocks(spark):
    rows = spark.range(20000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") == 5, 1e12).otherwise((F.col("id") * 37 % 5003).cast("double")).alias("v"))
    wanted = {"median": ("upper_median", 0.5), "p95": ("nearest", 0.95), "q1": ("inclusive", 0.25)}
    got = {r.g: r for r in scale.exact_ranks(rows, ["g"], "v", wanted).collect()}
    by = defaultdict(list)
    for r in rows.collect():
        by[r.g].append(r.v)
    for g, values in by.items():
        values.sort()
        at = 0.25 * (len(values) - 1)
        low = int(at)
        q1 = values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])
        assert (got[g].median, got[g].p95) == (values[len(values) // 2], values[-(-95 * len(values) // 100) - 1]) and abs(got[g].q1 - q1) < 1e-9
    many = spark.range(50000).select((F.col("id") * 3).alias("k"))
    numbered = scale.dense_numbers(many, ["k"], F.floor(F.col("k") / 5), "n")
    assert numbered.where("n <> k / 3 + 1").count() == 0 and numbered.count() == 50000


def test_structure_splits_by_leading_bits(spark):
    import hashlib

    sigs = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("signature_hash"))
    got = {r.signature_hash: r.split for r in S.structure_splits(sigs).collect()}
    order = sorted(got, key=lambda h: hashlib.sha256(f"split-v1:{h}".encode()).hexdigest())
    assert [got[h] for h in order] == ["dev"] * 500 + ["held_out"] * 500 + ["train"] * 4000


def test_ledger_stores_no_payloads_and_coverage_reads_needed_fields(spark):
    from shelfmark.operators import evidence as V

    calls = spark.createDataFrame(
        [("t", i, f"c{i}", "get_product", '{"product_id":"P1"}', f'{{"ok":true,"product":{{"product_id":"P1","title":"T{i}","price":{i}}},"evidence":["x"]}}') for i in range(3)]
        + [("t", 3, "c3", "get_policy", '{"policy_type":"returns"}', '{"ok":true,"policies":[{"policy_id":"POL001","title":"R"}]}')],
        "trajectory_id string, call_seq bigint, call_id string, tool string, arguments string, result string",
    )
    ledger = V.ledger(V.convert_calls(calls), F.lit(0))
    plan = ledger._jdf.queryExecution().toString()
    assert "arguments#" not in plan and "result#" not in plan  # what is stored holds the rows, not the texts they come from
    assert ("policy.category", "returns") in {(r["field"], r["value"]) for r in ledger.collect()}
    answers = spark.createDataFrame([("t", "price 2", ["product.price", "product.t*", "nothing"])], "trajectory_id string, answer string, required array<string>")
    out = V.required_coverage(answers, ledger)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 4  # the ledger's rows are unpacked once
    assert [(r["required"], r["covered"], r["omitted"]) for r in out.collect()] == [(3, 1, ["nothing", "product.t*"])]
