"""Registered evidence, answer and freshness queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.scale import spread
from shelfmark.functions.text import facts, normalized_dates, split_sentences
from shelfmark.operators import evidence as V
from shelfmark.operators import freshness as H
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


# One trajectory per order: it reads the order, checks eligibility, then looks up each item.
def tool_calls(spark, sf):
    o = spread(D.orders(spark, sf))
    k = F.col("order_key")
    base = [F.col("order_id").alias("trajectory_id")]
    no_args = F.to_json(F.struct("order_id"))
    order_json = F.struct(
        "order_id", "product_id", "status", F.col("ordered_at").cast("string").alias("ordered_at"),
        F.col("delivered_at").cast("string").alias("delivered_at"), "opened", "quality_issue", "inventory_status", "return_status",
    )
    read = o.select(
        *base, F.lit(0).cast("bigint").alias("call_seq"), F.lit("get_order").alias("tool"), no_args.alias("arguments"),
        F.to_json(F.struct((k % 13 != 0).alias("ok"), order_json.alias("order"))).alias("result"),
    )
    days = F.datediff(F.lit(D.AS_OF).cast("date"), "delivered_at")
    check = o.select(
        *base, F.lit(1).cast("bigint").alias("call_seq"), F.lit("check_return_eligibility").alias("tool"), no_args.alias("arguments"),
        F.to_json(
            F.struct(
                F.lit(True).alias("ok"), F.coalesce("quality_issue", F.lit(False)).alias("eligible"), F.when(k % 4 == 2, "checked").alias("reason"),
                days.alias("days_since_delivery"),
            )
        ).alias("result"),
    )
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    p = D.products(spark, sf)
    # what a call says of a product depends on the product alone
    said = p.select(
        "line_no",
        F.to_json(F.struct("product_id")).alias("arguments"),
        F.to_json(
            F.struct(
                F.lit(True).alias("ok"),
                F.struct("product_id", "title", "category", "price", "inventory", F.lit("2026-07-01").alias("updated_at")).alias("product"),
                F.array("brand", "size", "brand").alias("evidence"),
            )
        ).alias("result"),
    )
    look = li.join(said, F.col("l_partkey") == F.col("line_no")).select(
        F.format_string("O%06d", "l_orderkey").alias("trajectory_id"),
        (F.col("l_linenumber") * 1099511627776 + F.col("l_partkey") + 2).alias("call_seq"),
        F.lit("get_product").alias("tool"),
        "arguments",
        "result",
    )
    every = read.unionByName(check).unionByName(look)
    return every.withColumn("call_id", F.concat_ws("-", "trajectory_id", F.col("call_seq").cast("string")))


def ledger(spark, sf, numbers=True):
    return V.ledger(V.convert_calls(tool_calls(spark, sf)), F.floor(F.col("call_seq") / 1099511627776), calls=False, numbers=numbers)


_O = [
    ("order_id", "order_id"), ("product_id", "product_id"), ("status", "status"), ("ordered_at", "CAST(ordered_at AS VARCHAR)"),
    ("delivered_at", "CAST(delivered_at AS VARCHAR)"), ("opened", "CAST(opened AS VARCHAR)"), ("quality_issue", "CAST(quality_issue AS VARCHAR)"),
    ("inventory_status", "inventory_status"), ("return_status", "return_status"),
]
_P = [("product_id", "product_id"), ("title", "title"), ("category", "category"), ("price", "CAST(price AS VARCHAR)"), ("inventory", "inventory"), ("updated_at", "'2026-07-01'")]
_IT = "(SELECT printf('O%06d', l_orderkey) AS t, l_linenumber * 1099511627776 + l_partkey + 2 AS s, p.* FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) JOIN dom_products p ON l_partkey = p.line_no)"
RAW = " UNION ALL ".join(
    [f"SELECT order_id AS t, 0 AS s, {i} AS pos, 'order:' || order_id AS src, 'order.{f}' AS field, {e} AS value, NULL AS upd FROM dom_orders WHERE order_key % 13 <> 0" for i, (f, e) in enumerate(_O)]
    + [
        "SELECT order_id, 1, 0, 'order:' || order_id, 'return.eligible', CAST(quality_issue AS VARCHAR), NULL FROM dom_orders",
        "SELECT order_id, 1, 1, 'order:' || order_id, 'return.reason', CASE WHEN order_key % 4 = 2 THEN 'checked' END, NULL FROM dom_orders",
        f"SELECT order_id, 1, 2, 'order:' || order_id, 'return.days_since_delivery', CAST(DATE '{D.AS_OF}' - delivered_at AS VARCHAR), NULL FROM dom_orders",
    ]
    + [f"SELECT t, s, {i}, 'product:' || product_id, 'product.{f}', {e}, '2026-07-01' FROM {_IT}" for i, (f, e) in enumerate(_P)]
    + [f"SELECT t, s, {6 + i}, 'product:' || product_id, 'product.evidence.{i + 1}', {e}, NULL FROM {_IT}" for i, e in enumerate(["brand", "size", "brand"])]
)
EV = D.with_sql("dom_orders", "dom_products", body="").rstrip() + f""",
  raw AS MATERIALIZED (SELECT * FROM ({RAW}) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, s, src, field, value ORDER BY pos) = 1),
  ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s, pos) AS no FROM raw)"""


@register("evidence_rows", EV + " SELECT t AS trajectory_id, 'E' || no AS evidence_id, src AS source_id, field, value, upd AS updated_at FROM ev")
def evidence_rows(spark, sf):
    return ledger(spark, sf).select("trajectory_id", "evidence_id", "source_id", "field", "value", "updated_at")


@register(
    "conversion_spans",
    D.with_sql(
        "dom_orders",
        body="""SELECT tool_name, status, count(*) AS calls, CAST(sum(src) AS BIGINT) AS source_items, CAST(sum(n) AS BIGINT) AS evidence_items FROM (
     SELECT 'get_order' AS tool_name, CASE WHEN order_key % 13 = 0 THEN 'tool_failed' ELSE 'converted' END AS status, 1 AS src,
       CASE WHEN order_key % 13 = 0 THEN 0 ELSE 7 + CASE WHEN delivered_at IS NULL THEN 0 ELSE 1 END + CASE WHEN return_status IS NULL THEN 0 ELSE 1 END END AS n FROM dom_orders
     UNION ALL SELECT 'check_return_eligibility', 'converted', 1, 1 + CASE WHEN order_key % 4 = 2 THEN 2 ELSE 0 END FROM dom_orders
     UNION ALL SELECT 'get_product', 'converted', 1, 9 FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)) GROUP BY 1, 2""",
    ),
)
def conversion_spans(spark, sf):
    c = V.convert_calls(tool_calls(spark, sf))
    return c.groupBy(F.col("tool").alias("tool_name"), "status").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("source_item_count").cast("bigint").alias("source_items"),
        F.sum("evidence_item_count").cast("bigint").alias("evidence_items"),
    )


@register(
    "ledger_text",
    EV
    + """, l AS (SELECT t, string_agg('[E' || no || '] source=' || src || ' field=' || field || ' value=' || value || ' text=' || value, chr(10) ORDER BY no) AS x FROM ev GROUP BY 1)
   SELECT t AS trajectory_id, md5(CASE WHEN length(x) <= 2000 THEN x ELSE x[1:2000] || '…[evidence truncated]' END) AS digest FROM l""",
)
def ledger_text(spark, sf):
    return V.ledger_text(ledger(spark, sf), max_chars=2000).select("trajectory_id", F.md5("ledger").alias("digest"))


# Answers built from claims that are right for some orders and wrong for others.
def answers(spark, sf):
    o = spread(D.orders(spark, sf))
    k = F.col("order_key")
    status = F.when(k % 6 == 0, "processed").otherwise(F.col("status"))
    text = F.concat(
        F.lit("订单 "), "order_id", F.lit(" 当前状态为 "), status, F.lit("[E3]。"),
        F.format_string("预算不超过 50 元，商品价格 %.1f 元。", 900 + (k % 40) / 10),
        F.format_string("距今已有 %d 天。", F.coalesce(F.datediff(F.lit(D.AS_OF).cast("date"), "delivered_at"), F.lit(3)) + (k % 3 == 0).cast("int")),
        F.lit("下单日期是 "), F.when(k % 8 == 0, "1990-01-01").otherwise(F.col("ordered_at").cast("string")), F.lit("。"),
        F.when(k % 5 == 0, "该订单符合退货条件。").otherwise("该订单不符合退货条件。"),
        F.when(k % 10 == 0, "更多说明请参考证据[E9999]。").otherwise(""),
    )
    return o.select(
        F.col("order_id").alias("trajectory_id"),
        text.alias("answer"),
        F.array(F.lit("order.status"), F.lit("return.*"), F.lit("product.discontinued")).alias("required"),
        F.create_map(F.lit("order.status"), F.array(F.lit("1990-01-01"))).alias("forbidden"),
        "order_key",
    )


CLAIMS = f""", cl AS (SELECT order_id AS t, order_key AS k, CASE WHEN order_key % 6 = 0 THEN 'processed' ELSE status END AS c_status,
   round(900 + (order_key % 40) / 10, 1) AS c_price, coalesce(DATE '{D.AS_OF}' - delivered_at, 3) + CASE WHEN order_key % 3 = 0 THEN 1 ELSE 0 END AS c_days,
   CASE WHEN order_key % 8 = 0 THEN '1990-01-01' ELSE CAST(ordered_at AS VARCHAR) END AS c_date, CASE WHEN order_key % 5 = 0 THEN 'true' ELSE 'false' END AS c_elig FROM dom_orders),
  pv AS (SELECT t, list(TRY_CAST(value AS DOUBLE)) FILTER (field = 'product.price') AS prices, max(TRY_CAST(CASE WHEN field = 'return.days_since_delivery' THEN value END AS BIGINT)) AS days,
    list(value) FILTER (field LIKE '%\\_at' ESCAPE '\\') AS dates, max(CASE WHEN field = 'return.eligible' THEN value END) AS elig, max(CASE WHEN field = 'order.status' THEN value END) AS st FROM ev GROUP BY 1),
  con AS (SELECT t, 0 AS n, 5 AS rule, c_status AS claim FROM cl JOIN pv USING (t) WHERE st <> c_status
    UNION ALL SELECT t, 1, 1, printf('%.1f', c_price) || '元' FROM cl JOIN pv USING (t) WHERE len(prices) > 0 AND NOT list_contains(prices, c_price)
    UNION ALL SELECT t, 2, 2, CAST(c_days AS VARCHAR) || '天' FROM cl JOIN pv USING (t) WHERE days IS NOT NULL AND days <> abs(c_days)
    UNION ALL SELECT t, 3, 3, c_date FROM cl JOIN pv USING (t) WHERE len(dates) > 0 AND NOT list_contains(dates, c_date)
    UNION ALL SELECT t, 4, 4, CASE WHEN c_elig = 'true' THEN '符合退货条件' ELSE '不符合退货条件' END FROM cl JOIN pv USING (t) WHERE elig <> c_elig)"""


@register(
    "contradictions",
    EV + CLAIMS + " SELECT t AS trajectory_id, CAST(n AS BIGINT) AS sentence_no, rule, CASE WHEN rule = 2 THEN replace(claim, '-', '') ELSE claim END AS claim FROM con",
)
def contradictions(spark, sf):
    ev = V.typed_rows(ledger(spark, sf, numbers=False)).withColumn("scope", F.col("trajectory_id"))
    stated = V.sentences(answers(spark, sf)).withColumn("scope", F.col("trajectory_id"))
    out = V.contradictions(stated, None, V.row_keys(ev, substrings=False, needs=True))
    return out.select(F.col("scope").alias("trajectory_id"), F.col("sentence_no").cast("bigint").alias("sentence_no"), "rule", "claim")


@register(
    "invalid_citations",
    EV
    + """, ct AS (SELECT order_id AS t, 3 AS no FROM dom_orders UNION ALL SELECT order_id, 9999 FROM dom_orders WHERE order_key % 10 = 0)
   SELECT t AS trajectory_id, 'E' || no AS evidence_id FROM ct WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.t = ct.t AND ev.no = ct.no)""",
)
def invalid_citations(spark, sf):
    _, invalid = V.cited_rows(V.sentences(answers(spark, sf)), ledger(spark, sf))
    return invalid.select("trajectory_id", "evidence_id")


@register(
    "required_coverage",
    EV
    + """, h AS (SELECT cl.t, bool_or(field = 'order.status' AND (value = c_status)) AS a,
      bool_or(field LIKE 'return.%' AND (contains(lower(txt), lower(value)) OR (value = 'true') OR (value = 'false' AND k % 5 <> 0))) AS b
     FROM (SELECT *, '订单 ' || t || ' 当前状态为 ' || c_status || '[E3]。' || printf('预算不超过 50 元，商品价格 %.1f 元。', c_price) || '距今已有 ' || c_days || ' 天。下单日期是 ' || c_date || '。' || CASE WHEN k % 5 = 0 THEN '该订单符合退货条件。' ELSE '该订单不符合退货条件。' END || CASE WHEN k % 10 = 0 THEN '更多说明请参考证据[E9999]。' ELSE '' END AS txt FROM cl) cl JOIN ev ON ev.t = cl.t GROUP BY 1)
   SELECT t AS trajectory_id, CAST(CAST(a AS INTEGER) + CAST(b AS INTEGER) AS BIGINT) AS covered, round((CAST(a AS INTEGER) + CAST(b AS INTEGER)) / 3, 6) AS coverage FROM h""".replace(", h AS", CLAIMS + ", h AS"),
)
def required_coverage(spark, sf):
    out = V.required_coverage(answers(spark, sf), ledger(spark, sf))
    return out.select("trajectory_id", "covered", F.round("coverage", 6).alias("coverage"))


@register("forbidden_values", D.with_sql("dom_orders", body="SELECT order_id AS trajectory_id, CAST(CASE WHEN order_key % 8 = 0 OR ordered_at = DATE '1990-01-01' THEN 1 ELSE 0 END AS BIGINT) AS hits FROM dom_orders"))
def forbidden_values(spark, sf):
    return answers(spark, sf).select("trajectory_id", F.size(V.forbidden_hits(F.col("answer"), F.col("forbidden"))).cast("bigint").alias("hits"))


@register(
    "unsupported_facts",
    EV
    + CLAIMS
    + f""", f AS (SELECT t, k, unnest([t, c_status, '50 元', printf('%.1f 元', c_price), CAST(abs(c_days) AS VARCHAR) || ' 天', c_date, CASE WHEN c_elig = 'true' THEN '符合退货条件' ELSE '不符合退货条件' END]) AS fact, unnest([1, 2, 3, 4, 5, 6, 7]) AS i, c_price, c_days, c_elig FROM cl),
     tx AS (SELECT t, replace(string_agg(src || ' ' || field || ' ' || value || ' ' || value, chr(10)), ' ', '') AS corpus FROM ev GROUP BY 1),
     j AS (SELECT f.t, i, f.fact, contains(lower(corpus), lower(replace(f.fact, ' ', '')))
        OR (i = 4 AND coalesce(list_contains(prices, c_price), false)) OR (i = 5 AND coalesce(days = abs(c_days), false)) OR (i = 7 AND contains(lower(corpus), c_elig)) AS ok FROM f JOIN tx USING (t) JOIN pv USING (t))
     SELECT t AS trajectory_id, fact FROM j WHERE NOT ok""",
)
def unsupported_facts(spark, sf):
    ev = ledger(spark, sf, numbers=False).withColumn("scope", F.col("trajectory_id"))
    stated = V.sentences(answers(spark, sf)).withColumn("scope", F.col("trajectory_id"))
    return V.unsupported_facts(stated, V.row_keys(ev)).select(F.col("scope").alias("trajectory_id"), "fact")


@register(
    "verify_answers",
    EV
    + CLAIMS
    + """, ct AS (SELECT order_id AS t, count(*) AS n FROM (SELECT order_id, 3 AS no FROM dom_orders UNION ALL SELECT order_id, 9999 FROM dom_orders WHERE order_key % 10 = 0) c
        WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.t = c.order_id AND ev.no = c.no) GROUP BY 1),
     cn AS (SELECT t, count(*) AS n FROM con GROUP BY 1),
     e3 AS (SELECT t, field, value FROM ev WHERE no = 3)
     SELECT cl.t AS trajectory_id, coalesce(cn.n, 0) + CASE WHEN k % 8 = 0 OR c_date = '1990-01-01' THEN 1 ELSE 0 END AS contradicted_claims, coalesce(ct.n, 0) AS invalid_citations,
       CAST(coalesce(e3.field = 'order.status' AND e3.value <> c_status, false) AS BIGINT) AS citation_oppositions,
       coalesce(cn.n, 0) + CASE WHEN k % 8 = 0 OR c_date = '1990-01-01' THEN 1 ELSE 0 END + coalesce(ct.n, 0) = 0 AND NOT coalesce(e3.field = 'order.status' AND e3.value <> c_status, false) AS hard_verification_pass
     FROM cl LEFT JOIN cn USING (t) LEFT JOIN ct USING (t) LEFT JOIN e3 USING (t)""",
)
def verify_answers(spark, sf):
    out = V.verify_answers(answers(spark, sf), ledger(spark, sf), require_citations=True)
    return out.select("trajectory_id", "contradicted_claims", "invalid_citations", "citation_oppositions", "hard_verification_pass")


# --- text rules over whole documents and conversations -----------------------------------------
@register(
    "sentence_split",
    r"""SELECT doc_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_replace(u, '^[ \n\t\-•]+|[ \n\t\-•]+$', '', 'g') AS x
     FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([。！？?\n])', '\1' || chr(1), 'g'), chr(1))) AS u FROM documents)) WHERE length(x) >= 6 GROUP BY 1""",
)
def sentence_split(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.explode(split_sentences("text")).alias("s"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).cast("bigint").alias("chars"))


@register(
    "date_normalisation",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS zh, strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS en FROM orders""",
)
def date_normalisation(spark, sf):
    d = F.to_date("o_orderdate")
    z, e = F.date_add(d, 1), F.date_add(d, 2)
    text = F.concat(
        F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" then "), F.year(z).cast("string"), F.lit("年"), F.month(z).cast("string"), F.lit("月"),
        F.day(z).cast("string"), F.lit("日 and "), F.date_format(e, "MMMM d, yyyy"), F.lit("."),
    )
    n = normalized_dates(text)
    return D.table(spark, sf, "orders").select("o_orderkey", n[0].alias("iso"), n[1].alias("zh"), n[2].alias("en"))


@register(
    "fact_extraction",
    D.with_sql("dom_orders", body="""SELECT order_id, array_to_string(list_sort([order_id, CAST(ordered_at AS VARCHAR), CAST(order_key % 90 AS VARCHAR) || ' 天', status] || CASE WHEN inventory_status = 'out_of_stock' THEN ['out_of_stock'] ELSE [] END), '|') AS facts FROM dom_orders"""),
)
def fact_extraction(spark, sf):
    o = D.orders(spark, sf)
    text = F.concat(
        F.lit("Order "), "order_id", F.lit(" placed "), F.col("ordered_at").cast("string"), F.lit(" is "), "status", F.lit(" after "), (F.col("order_key") % 90).cast("string"), F.lit(" 天; stock "), "inventory_status"
    )
    return o.select("order_id", F.array_join(F.array_sort(facts(text)), "|").alias("facts"))


@register(
    "user_context",
    """SELECT 'u' || user_id AS trajectory_id, kind, value FROM (
      SELECT DISTINCT user_id, 'budget' AS kind, CAST(CAST(event_id % 500 AS DOUBLE) AS VARCHAR) AS value FROM events WHERE event_type = 'view'
      UNION SELECT DISTINCT user_id, 'identifier', printf('O%06d', event_id) FROM events WHERE event_type = 'click'
      UNION SELECT DISTINCT user_id, 'code', lpad(CAST(event_id AS VARCHAR), 6, '0') FROM events WHERE event_type = 'signup'
      UNION SELECT DISTINCT user_id, 'confirmation', '我确认' FROM events WHERE event_type = 'purchase')""",
)
def user_context(spark, sf):
    e = F.col("event_id")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.format_string("预算 %d 元左右", e % 500))
        .when(kind == "click", F.format_string("查一下 O%06d 吧", e))
        .when(kind == "signup", F.format_string("验证码是 %06d", e))
        .when(kind == "purchase", "我确认")
        .otherwise("号码 123456")
    )
    m = D.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trajectory_id"), F.lit("user").alias("role"), text.alias("content"))
    return V.user_context(m)


# --- freshness ---------------------------------------------------------------------------------
@register(
    "claim_detection",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'inventory' WHEN 2 THEN 'policy|price' ELSE '' END AS claims FROM customer""",
)
def claim_detection(spark, sf):
    text = D.pick(["售价 20 元", "现货", "退款运费 3元", "hello"], F.col("c_custkey"))
    return D.table(spark, sf, "customer").select("c_custkey", F.array_join(H.detect_claims(text), "|").alias("claims"))


FRESH_STATUS = "CASE WHEN l_linenumber = 7 THEN 2 WHEN CAST(floor(date_diff('second', l_shipdate, TIMESTAMP '1998-07-20') / 86400.0) AS BIGINT) > 30 THEN 3 ELSE 1 END"


@register(
    "freshness_status",
    f"""WITH w AS (SELECT l_orderkey AS o, max({FRESH_STATUS}) FILTER (l_linenumber % 2 = 1) AS pw, max({FRESH_STATUS}) FILTER (l_linenumber % 2 = 0) AS ow FROM lineitem GROUP BY 1),
     a AS (SELECT o_orderkey, o_orderkey % 4 AS c, pw, ow FROM orders LEFT JOIN w ON o = o_orderkey),
     u AS (SELECT o_orderkey, c, coalesce(CASE c WHEN 0 THEN pw WHEN 1 THEN pw WHEN 2 THEN greatest(pw, ow) END, 2) AS used FROM a)
     SELECT o_orderkey AS answer_id, CASE WHEN c = 3 THEN 'n/a' WHEN used = 3 THEN 'stale' WHEN used = 2 THEN 'unverified' ELSE 'fresh' END AS status, c <> 3 AND used >= 2 AS downgrade FROM u""",
)
def freshness_status(spark, sf):
    a = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("answer_id"), D.pick(["售价 20 元", "现货", "退款运费 3元", "hello"], F.col("o_orderkey")).alias("answer")
    )
    items = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "product").otherwise("policy").alias("kind"),
        F.when(F.col("l_linenumber") != 7, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("updated_at"),
    )
    return H.assess(a, items, F.lit("1998-07-20 00:00:00").cast("timestamp")).select("answer_id", "status", "downgrade")


@register(
    "ledger_freshness_items",
    EV + " SELECT t AS answer_id, src AS source_id, max(upd) AS updated_at FROM ev WHERE src LIKE 'product:%' GROUP BY 1, 2",
)
def ledger_freshness_items(spark, sf):
    return H.items_from_ledger(ledger(spark, sf)).select("answer_id", "source_id", "updated_at")


@register(
    "freshness_notes",
    "SELECT c_custkey, '提示：' || CASE c_custkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'inventory' WHEN 2 THEN 'policy/price' ELSE '价格/库存/政策' END || '信息可能变动，请以商品页实时信息为准；如需精确确认可转人工客服。' AS note FROM customer",
)
def freshness_notes(spark, sf):
    text = D.pick(["售价 20 元", "现货", "退款运费 3元", "hello"], F.col("c_custkey"))
    return D.table(spark, sf, "customer").select("c_custkey", H.note(H.detect_claims(text)).alias("note"))
