"""Domain tables derived from the given parquet tables, with the same views as SQL.

Each function returns a DataFrame; ``CTE`` holds the matching SQL text used by
the oracle queries. Nothing is sampled: every view reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.canon import canonical_address
from shelfmark.functions.scale import spread
from shelfmark.functions.text import found


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_sql(*names: str, body: str) -> str:
    """SQL text: the named views (and what they need) followed by ``body``."""
    needed: list[str] = []

    def visit(n: str) -> None:
        for dep in DEPENDS.get(n, []):
            visit(dep)
        if n not in needed:
            needed.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in needed) + "\n" + body


DEPENDS = {
    "dom_orders": [],
    "dom_commands": ["dom_orders"],
    "dom_baskets": ["dom_orders"],
    "dom_basket_commands": ["dom_commands", "dom_baskets"],
    "dom_calls": [],
    "dom_sims": [],
    "dom_paths": ["dom_lines"],
    "dom_messages": [],
    "dom_lines": [],
    "dom_runs": ["dom_calls"],
}
CTE: dict[str, str] = {}


# --- products ------------------------------------------------------------
def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.format_string("P%05d", "p_partkey").alias("product_id"),
        F.col("p_partkey").alias("line_no"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") % 7 == 0, "out_of_stock").otherwise("available").alias("inventory"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"),
        F.concat(F.lit("MDL-"), (F.col("p_partkey") * 37 % 1201).cast("string")).alias("model"),
    )


CTE["dom_products"] = """
SELECT printf('P%05d', p_partkey) AS product_id, p_partkey AS line_no, p_name AS title, p_type AS category,
  p_retailprice AS price, CASE WHEN p_size % 7 = 0 THEN 'out_of_stock' ELSE 'available' END AS inventory,
  p_brand AS brand, 'size ' || CAST(p_size AS VARCHAR) AS size,
  'MDL-' || CAST(p_partkey * 37 % 1201 AS VARCHAR) AS model
FROM part"""


def product_attributes(p: DataFrame) -> DataFrame:
    """One row per attribute, in source order."""
    return p.select(
        "product_id",
        "line_no",
        "title",
        "category",
        "price",
        F.posexplode(
            F.array(
                F.struct(F.lit("brand_or_store").alias("key"), F.col("brand").alias("value")),
                F.struct(F.lit("model").alias("key"), F.col("model").alias("value")),
                F.struct(F.lit("size").alias("key"), F.col("size").alias("value")),
            )
        ).alias("pos", "attr"),
    ).select("*", "attr.*").drop("attr")


CTE["dom_attributes"] = """
SELECT product_id, line_no, title, category, price, 0 AS pos, 'brand_or_store' AS key, brand AS value FROM dom_products
UNION ALL SELECT product_id, line_no, title, category, price, 1, 'model', model FROM dom_products
UNION ALL SELECT product_id, line_no, title, category, price, 2, 'size', size FROM dom_products"""
DEPENDS["dom_attributes"] = ["dom_products"]


# --- users and orders ----------------------------------------------------
def users(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    uid = F.format_string("U%04d", "c_custkey")
    return c.select(
        uid.alias("user_id"),
        F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("verification_code"),
        F.when(
            F.col("c_custkey") % 2 == 0,
            F.array(F.concat(F.lit("gift_card_"), uid), F.concat(F.lit("credit_card_"), uid)),
        )
        .otherwise(F.array(F.concat(F.lit("credit_card_"), uid)))
        .alias("payment_methods"),
    )


CTE["dom_users"] = """
SELECT printf('U%04d', c_custkey) AS user_id,
  lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS verification_code,
  CASE WHEN c_custkey % 2 = 0 THEN ['gift_card_' || printf('U%04d', c_custkey), 'credit_card_' || printf('U%04d', c_custkey)]
       ELSE ['credit_card_' || printf('U%04d', c_custkey)] END AS payment_methods
FROM customer"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("pending", "processed", "delivered", "cancelled")]), (k % 4 + 1).cast("int")
    )
    ordered = F.to_date("o_orderdate")
    uid = F.format_string("U%04d", "o_custkey")
    return table(spark, sf, "orders").select(
        F.format_string("O%06d", k).alias("order_id"),
        uid.alias("user_id"),
        state.alias("status"),
        ordered.alias("ordered_at"),
        F.when(k % 4 == 2, F.date_add(ordered, (k % 5 + 1).cast("int"))).alias("delivered_at"),
        (k % 5 == 0).alias("opened"),
        (k % 11 == 0).alias("quality_issue"),
        F.when(k % 17 == 0, "out_of_stock").otherwise("available").alias("inventory_status"),
        F.when(k % 23 == 0, "requested").when(k % 29 == 0, "closed").alias("return_status"),
        F.concat(F.lit("credit_card_"), uid).alias("payment_method_id"),
        F.format_string("P%05d", k % 1000).alias("product_id"),
        k.alias("order_key"),
    )


CTE["dom_orders"] = """
SELECT printf('O%06d', o_orderkey) AS order_id, printf('U%04d', o_custkey) AS user_id,
  ['pending', 'processed', 'delivered', 'cancelled'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS status,
  CAST(o_orderdate AS DATE) AS ordered_at,
  CASE WHEN o_orderkey % 4 = 2 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 + 1 AS INTEGER) END AS delivered_at,
  o_orderkey % 5 = 0 AS opened, o_orderkey % 11 = 0 AS quality_issue,
  CASE WHEN o_orderkey % 17 = 0 THEN 'out_of_stock' ELSE 'available' END AS inventory_status,
  CASE WHEN o_orderkey % 23 = 0 THEN 'requested' WHEN o_orderkey % 29 = 0 THEN 'closed' END AS return_status,
  'credit_card_' || printf('U%04d', o_custkey) AS payment_method_id, printf('P%05d', o_orderkey % 1000) AS product_id, o_orderkey AS order_key
FROM orders"""

AS_OF = "1998-07-20"


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.format_string("O%06d", "l_orderkey").alias("order_id"),
        F.format_string("P%05d", "l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supp"),
    )


CTE["dom_items"] = """
SELECT printf('O%06d', l_orderkey) AS order_id, printf('P%05d', l_partkey) AS item_id,
  l_linenumber AS line_no, l_returnflag AS flag, l_suppkey AS supp FROM lineitem"""


def order_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with all their items in line order, a canonical shipping address for every second one, and some exchanged before."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.format_string("P%05d", x["l_partkey"])).alias("items")
    )
    o = orders(spark, sf)
    joined = o.join(lines, o.order_key == F.col("l_orderkey"), "left").drop("l_orderkey")
    return joined.withColumns({
        "shipping_address": F.when(F.col("order_key") % 2 == 0, canonical_address(address_fields(F.lit(0), F.lit(False)))),
        "exchange_status": F.when(F.col("order_key") % 31 == 0, "exchanged"),
    })


def address_fields(k: Column, backwards: Column) -> Column:
    """Address of a command as given: the same fields, named in one order or the other."""
    one = [F.lit("address1"), F.concat(F.lit("street "), k.cast("string")), F.lit("city"), F.lit("Town"), F.lit("zip"), F.format_string("%05d", k)]
    return F.when(backwards, F.create_map(*one[4:], *one[2:4], *one[:2])).otherwise(F.create_map(*one))


CTE["dom_baskets"] = """
SELECT o.*, l.items, CASE WHEN order_key % 2 = 0 THEN '{"address1":"street 0","city":"Town","zip":"00000"}' END AS shipping_address,
  CASE WHEN order_key % 31 = 0 THEN 'exchanged' END AS exchange_status
FROM dom_orders o LEFT JOIN (SELECT l_orderkey, list(printf('P%05d', l_partkey) ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1) l ON l_orderkey = order_key"""


# --- commands: one row per event ----------------------------------------
def event_k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("bigint")


COMMAND_TOOLS = {
    "purchase": ["create_return_request"],
    "error": ["cancel_pending_order"],
    "click": ["modify_pending_order_payment", "modify_pending_order_address", "modify_pending_order_items"],
    "view": ["get_order", "check_return_eligibility", "modify_user_address"],
    "signup": ["return_delivered_order_items", "exchange_delivered_order_items"],
}


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """Tool commands against orders; most carry the owner's id and right code."""
    k = event_k()
    tool = None
    for kind, tools in COMMAND_TOOLS.items():
        hit = F.col("event_type") == kind
        tool = F.when(hit, pick(tools, k)) if tool is None else tool.when(hit, pick(tools, k))
    e = spread(table(spark, sf, "events")).select(
        F.col("event_id").alias("seq"),
        "ts",
        F.format_string("O%06d", F.col("user_id") * 100 + k - k % 10).alias("order_id"),
        F.col("user_id").alias("actor"),
        tool.alias("tool"),
        k.alias("k"),
    )
    owner = orders(spark, sf).select("order_id", F.col("user_id").alias("owner"), "product_id")
    joined = e.join(owner, "order_id", "left")
    uid = F.when(F.col("seq") % 7 == 0, F.format_string("U%04d", "actor")).otherwise(
        F.coalesce("owner", F.format_string("U%04d", "actor"))
    )
    num = F.regexp_extract(uid, "[0-9]+", 0).cast("bigint")
    code = (
        F.when(F.col("seq") % 11 == 0, "000000")
        .when(F.col("seq") % 13 == 0, " 12345")
        .otherwise(F.lpad((num * 7919 % 1000000).cast("string"), 6, "0"))
    )
    return joined.select(
        "seq",
        "ts",
        "tool",
        "order_id",
        uid.alias("user_id"),
        code.alias("verification_code"),
        (F.col("seq") % 3 != 0).alias("confirmed"),
        pick(["no longer needed", "ordered by mistake", "other"], F.col("seq") % 5).alias("reason"),
        F.concat(F.when(F.col("k") % 3 == 0, "gift_card_").otherwise("credit_card_"), uid).alias("payment_method_id"),
        F.array(F.when(F.col("k") % 5 == 4, "P99999").otherwise(F.coalesce("product_id", F.lit("P00000")))).alias("item_ids"),
        F.array(F.format_string("P%05d", F.col("seq") % 2)).alias("new_item_ids"),
        F.concat(F.lit("street "), (F.col("seq") % 2).cast("string")).alias("address"),
        "k",
    )


def basket_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The same commands asking for one, two or no items of their order, for lists other commands have set, or for one too often."""
    c = commands(spark, sf)
    baskets = order_baskets(spark, sf).select("order_id", "items")
    seq = F.col("seq")
    first = F.coalesce(F.get("items", F.lit(0)), F.lit("P00000"))
    two = F.coalesce(F.slice("items", 1, 2), F.array(first))
    turn = F.col("k") % 11
    asked = (
        F.when(seq % 23 == 0, F.array().cast("array<string>"))
        .when(turn == 5, F.array(first)).when(turn == 6, two).when(turn == 8, F.array(F.lit("P00001"), F.lit("P00000")))
        .when(turn == 9, F.array(F.lit("P99999"))).when(turn == 10, F.array(first, first)).otherwise(F.array(F.lit("P00000")))
    )
    new = F.transform("item_ids", lambda x, i: F.format_string("P%05d", (seq + i) % 2))
    return c.join(baskets, "order_id", "left").withColumn("item_ids", asked).withColumn(
        "new_item_ids", F.when(seq % 17 == 0, F.concat(new, F.array(F.lit("P00002")))).otherwise(new)
    ).withColumn("address", canonical_address(address_fields(seq % 2, seq % 4 > 1))).drop("items")


CTE["dom_basket_commands"] = """
SELECT * EXCLUDE (item_id, new_item_id, address, items, asked, first), asked AS item_ids,
  CASE WHEN seq % 17 = 0 THEN list_append(fresh, 'P00002') ELSE fresh END AS new_item_ids,
  '{"address1":"street ' || (seq % 2) || '","city":"Town","zip":"0000' || (seq % 2) || '"}' AS address
FROM (SELECT *, CASE WHEN len(asked) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, len(asked) + 1), lambda i: printf('P%05d', (seq + i - 1) % 2)) END AS fresh
 FROM (SELECT *, CASE WHEN seq % 23 = 0 THEN []::VARCHAR[] ELSE CASE k % 11 WHEN 6 THEN coalesce(items[1:2], [first]) WHEN 8 THEN ['P00001', 'P00000'] WHEN 9 THEN ['P99999']
    WHEN 10 THEN [first, first] WHEN 5 THEN [first] ELSE ['P00000'] END END AS asked
   FROM (SELECT c.*, b.items, coalesce(b.items[1], 'P00000') AS first FROM dom_commands c LEFT JOIN dom_baskets b USING (order_id))))"""

CTE["dom_commands"] = """
SELECT seq, ts, tool, order_id, user_id,
  CASE WHEN seq % 11 = 0 THEN '000000' WHEN seq % 13 = 0 THEN ' 12345'
       ELSE lpad(CAST(CAST(regexp_extract(user_id, '[0-9]+') AS BIGINT) * 7919 % 1000000 AS VARCHAR), 6, '0') END AS verification_code,
  seq % 3 <> 0 AS confirmed,
  ['no longer needed', 'ordered by mistake', 'other'][CAST(seq % 5 % 3 + 1 AS INTEGER)] AS reason,
  CASE WHEN k % 3 = 0 THEN 'gift_card_' ELSE 'credit_card_' END || user_id AS payment_method_id,
  CASE WHEN k % 5 = 4 THEN 'P99999' ELSE coalesce(product_id, 'P00000') END AS item_id, printf('P%05d', seq % 2) AS new_item_id,
  'street ' || CAST(seq % 2 AS VARCHAR) AS address, k
FROM (SELECT e.*, o.product_id, CASE WHEN seq % 7 = 0 OR o.user_id IS NULL THEN printf('U%04d', actor) ELSE o.user_id END AS user_id
      FROM (SELECT event_id AS seq, ts, user_id AS actor, k, printf('O%06d', user_id * 100 + k - k % 10) AS order_id,
              CASE event_type WHEN 'purchase' THEN 'create_return_request' WHEN 'error' THEN 'cancel_pending_order'
                WHEN 'click' THEN ['modify_pending_order_payment', 'modify_pending_order_address', 'modify_pending_order_items'][CAST(k % 3 + 1 AS INTEGER)]
                WHEN 'view' THEN ['get_order', 'check_return_eligibility', 'modify_user_address'][CAST(k % 3 + 1 AS INTEGER)]
                WHEN 'signup' THEN ['return_delivered_order_items', 'exchange_delivered_order_items'][CAST(k % 2 + 1 AS INTEGER)] END AS tool
            FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)) e
      LEFT JOIN dom_orders o USING (order_id))"""


# --- call log: one row per event, trajectory = user and day ---------------
CALL_TOOLS = {
    "view": "search_catalog",
    "click": "get_product",
    "signup": "get_order",
    "purchase": "create_return_request",
    "error": "escalate_to_human",
}


def calls(spark: SparkSession, sf: str) -> DataFrame:
    k = event_k()
    tool = F.element_at(
        F.create_map(*[F.lit(x) for pair in CALL_TOOLS.items() for x in pair]), F.col("event_type")
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias(
            "trajectory_id"
        ),
        F.concat(F.lit("task"), (F.col("user_id") % 40).cast("string")).alias("task_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("started_at"),
        tool.alias("tool"),
        (k % 4 != 0).alias("ok"),
        (k % 3 == 0).alias("changed"),
        F.col("value").alias("latency_ms"),
        F.format_string("P%05d", k % 20).alias("item"),
        k.alias("k"),
        "user_id",
    )


CTE["dom_calls"] = """
SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS trajectory_id,
  'task' || CAST(user_id % 40 AS VARCHAR) AS task_id, event_id AS seq, ts AS started_at,
  CASE event_type WHEN 'view' THEN 'search_catalog' WHEN 'click' THEN 'get_product' WHEN 'signup' THEN 'get_order'
    WHEN 'purchase' THEN 'create_return_request' WHEN 'error' THEN 'escalate_to_human' END AS tool,
  k % 4 <> 0 AS ok, k % 3 = 0 AS changed, value AS latency_ms, printf('P%05d', k % 20) AS item, k, user_id
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


# --- documents as lines, simulations and tool paths -----------------------
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per non-blank line of a document."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    return d.select(
        "doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    ).where(F.length(F.trim("line")) > 0)


CTE["dom_lines"] = """
SELECT doc_id, source, lang, i - 1 AS line_no, parts[i] AS line
FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts,
        unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
WHERE length(trim(parts[i])) > 0"""

PATH_TOOLS = [
    "get_order_details",
    "cancel_pending_order",
    "get_user_details",
    "transfer_to_human_agents",
    "find_user_id_by_email",
    "return_delivered_order_items",
]


def simulations(spark: SparkSession, sf: str) -> DataFrame:
    """One simulation per document: its lines are tool calls, its labels reward and violation."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    tools = F.array(*[F.lit(t) for t in PATH_TOOLS])
    return d.join(lab, "doc_id", "left").select(
        F.format_string("S%08d", "doc_id").alias("simulation_id"),
        F.concat(F.lit("T"), F.col("source"), F.lit("-"), F.col("lang"), F.lit("-"), (F.col("n_chars") % 5).cast("string")).alias("task_id"),
        F.col("source").alias("domain"),
        F.col("doc_id"),
        F.col("quality").cast("double").alias("reward"),
        F.when(F.col("toxic").isNotNull(), F.col("toxic") == 0).alias("compliant"),
        F.element_at(
            F.array(F.lit("user_stop"), F.lit("agent_stop"), F.lit("max_steps")),
            (F.col("n_chars") % 3 + 1).cast("int"),
        ).alias("termination_reason"),
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 11 != 0).alias("db_match"),
        F.transform(
            F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0),
            lambda x: F.element_at(tools, (F.length(x) % len(PATH_TOOLS) + 1).cast("int")),
        ).alias("path"),
        "n_chars",
    )


_PATH_LIST = "[" + ", ".join(f"'{t}'" for t in PATH_TOOLS) + "]"
CTE["dom_sims"] = f"""
SELECT printf('S%08d', d.doc_id) AS simulation_id,
  'T' || source || '-' || lang || '-' || CAST(n_chars % 5 AS VARCHAR) AS task_id, source AS domain, d.doc_id,
  CAST(quality AS DOUBLE) AS reward, CASE WHEN toxic IS NOT NULL THEN toxic = 0 END AS compliant,
  ['user_stop', 'agent_stop', 'max_steps'][CAST(n_chars % 3 + 1 AS INTEGER)] AS termination_reason,
  CASE WHEN n_chars % 7 <> 0 THEN n_chars % 11 <> 0 END AS db_match,
  [{_PATH_LIST}[CAST(length(x) % {len(PATH_TOOLS)} + 1 AS INTEGER)] FOR x IN string_split(text, chr(10)) IF length(trim(x)) > 0] AS path,
  n_chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


# --- conversation messages -------------------------------------------------
def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


CTE["dom_messages"] = "SELECT conv_id, turn, role, text AS content FROM conversations"


# --- two graded runs over the same tasks -----------------------------------
def grades(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of runs A and B per user, summarised from the call log."""
    c = calls(spark, sf).select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("task_id"),
        F.when(F.col("seq") % 2 == 0, "A").otherwise("B").alias("config"),
        "tool",
        "ok",
        "changed",
        "latency_ms",
    )
    is_esc = F.col("tool") == "escalate_to_human"
    writes = F.count_if((F.col("tool") == "create_return_request") & F.col("ok") & F.col("changed"))
    return c.groupBy("task_id", "config").agg(
        (F.avg(F.col("ok").cast("int")) >= 0.7).alias("success"),
        (writes > 8).alias("illegal_state_change"),
        (F.count_if(is_esc & F.col("ok")) > 9).alias("inappropriate_handoff"),
        (F.count_if(F.col("changed")) % 3 != 0).alias("terminal_state_accurate"),
        (F.count_if(is_esc & ~F.col("ok")) > 8).alias("protocol_error"),
        F.greatest(F.lit(0), writes - 7).cast("bigint").alias("duplicate_writes"),
        F.count(F.lit(1)).alias("decision_steps"),
        F.count_if(~F.col("ok")).alias("semantic_retries"),
        (F.count_if(~F.col("ok")) > 6).alias("correction_eligible"),
        F.max("latency_ms").alias("elapsed_ms"),
    )


CTE["dom_grades"] = """
SELECT 'm' || CAST(user_id AS VARCHAR) AS task_id, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS config,
  avg(CAST(ok AS INTEGER)) >= 0.7 AS success,
  count(*) FILTER (tool = 'create_return_request' AND ok AND changed) > 8 AS illegal_state_change,
  count(*) FILTER (tool = 'escalate_to_human' AND ok) > 9 AS inappropriate_handoff,
  count(*) FILTER (changed) % 3 <> 0 AS terminal_state_accurate,
  count(*) FILTER (tool = 'escalate_to_human' AND NOT ok) > 8 AS protocol_error,
  greatest(0, count(*) FILTER (tool = 'create_return_request' AND ok AND changed) - 7) AS duplicate_writes,
  count(*) AS decision_steps, count(*) FILTER (NOT ok) AS semantic_retries,
  count(*) FILTER (NOT ok) > 6 AS correction_eligible, max(latency_ms) AS elapsed_ms
FROM dom_calls GROUP BY 1, 2"""
DEPENDS["dom_grades"] = ["dom_calls"]


def first_number(c: str) -> Column:
    return found(c, "[0-9]+").cast("bigint")
