"""Registered corpus, source and sink queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import clean, parse_price
from shelfmark.operators import corpus as C
from shelfmark.plans import domain as D
from shelfmark.sources import sinks as K

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


# Raw catalogue rows from part: polymorphic keys, prices as text, repeated ids.
def raw_catalogue(spark, sf):
    k = F.col("p_partkey")
    asin = F.format_string("B%07d", k - k % 3)  # runs of three share an id
    return D.table(spark, sf, "part").select(
        F.lit(0).alias("file_ord"),
        k.alias("line_no"),
        F.when(k % 4 != 0, asin).alias("parent_asin"),
        F.when(k % 4 == 0, asin).when(k % 50 == 1, "").alias("asin"),
        F.when(k % 41 == 0, "  ").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("title"),
        F.when(k % 5 == 0, "").otherwise(F.concat("p_name", F.lit("\n by "), "p_brand")).alias("description"),
        F.when(k % 10 == 0, F.array(F.lit("light"), F.col("p_type"))).alias("features"),
        F.when(k % 6 != 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"))).alias("details"),
        F.when(k % 3 == 0, F.array(F.lit("Headphones"), F.col("p_type"))).alias("categories"),
        F.when(k % 3 == 1, F.lit("Home & Kitchen")).alias("main_category"),
        F.col("p_type").alias("category"),
        F.when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit("$1,"), F.col("p_size").cast("string"), F.lit(".50 each"))).alias("price"),
        F.when(k % 2 == 0, F.col("p_brand")).alias("store"),
    )


RAW = """
SELECT 0 AS file_ord, p_partkey AS line_no, printf('B%07d', p_partkey - p_partkey % 3) AS source_asin,
  CASE WHEN p_partkey % 41 = 0 THEN '' ELSE p_name END AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' by ' || p_brand WHEN p_partkey % 10 = 0 THEN 'light ' || p_type ELSE '' END AS description,
  p_partkey % 6 <> 0 AS has_details, p_size,
  CASE WHEN p_partkey % 3 = 0 THEN 'Headphones ' || p_type WHEN p_partkey % 3 = 1 THEN 'Home & Kitchen' ELSE p_type END AS category,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST('1' || p_size || '.50' AS DOUBLE) END AS price,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS store
FROM part"""
NORM = f"""
SELECT *, CASE WHEN category LIKE 'Headphones%' THEN ['耳机', '蓝牙耳机'] WHEN category = 'Home & Kitchen' THEN ['厨房', '家居', '家用电器'] ELSE [] END AS aliases
FROM ({RAW}) WHERE title <> '' AND (description <> '' OR has_details)"""


@register(
    "normalize_catalogue",
    f"""SELECT line_no, source_asin, title, category, array_to_string(aliases, '|') AS aliases, price, description,
     CASE WHEN has_details THEN CAST(p_size AS VARCHAR) END AS size, store AS brand, CASE WHEN len(aliases) > 0 THEN array_to_string(aliases, ', ') END AS zh FROM ({NORM})""",
)
def normalize_catalogue(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    a = F.col("attributes")
    return n.select(
        "line_no", "source_asin", "title", "category", F.array_join("category_aliases_zh", "|").alias("aliases"), "price", "description",
        F.try_element_at(a, F.lit("size")).alias("size"),
        F.try_element_at(a, F.lit("brand_or_store")).alias("brand"),
        F.try_element_at(a, F.lit("zh_aliases")).alias("zh"),
    )


@register(
    "clean_pages",
    r"SELECT page_id, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS n_chars FROM pages",
)
def clean_pages(spark, sf):
    c = clean("html")
    return D.table(spark, sf, "pages").select("page_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("n_chars"))


@register(
    "parse_price",
    "SELECT c_custkey, round(abs(c_acctbal), 2) AS price FROM customer",
)
def price_text(spark, sf):
    text = F.concat(F.lit("US$ "), F.format_string("%,.2f", F.abs("c_acctbal")), F.lit(" (incl.)"))
    return D.table(spark, sf, "customer").select("c_custkey", parse_price(text).alias("price"))


@register(
    "first_wins_dedup",
    f"SELECT source_asin, line_no, title FROM ({NORM}) QUALIFY row_number() OVER (PARTITION BY source_asin ORDER BY file_ord, line_no) = 1",
)
def first_wins_dedup(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    return C.first_wins(n, ["source_asin"], ["file_ord", "line_no"]).select("source_asin", "line_no", "title")


@register("hash_sample", "SELECT doc_id, source FROM documents ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark, sf):
    return C.hash_sample(D.table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100)


def raw_reviews(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        F.format_string("B%07d", F.col("l_partkey") - F.col("l_partkey") % 3).alias("source_asin"),
        F.col("l_quantity").cast("int").alias("helpful_vote"),
        F.concat(F.lit("review  of order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" "), F.repeat(F.col("l_returnflag"), F.col("l_linenumber"))).alias("body"),
        F.col("l_orderkey").alias("file_ord"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
    )


REV = f"""r AS (SELECT * FROM (SELECT printf('B%07d', l_partkey - l_partkey % 3) AS source_asin, CAST(l_quantity AS INTEGER) AS v,
  'review of order ' || l_orderkey || ' line ' || l_linenumber || ' ' || repeat(l_returnflag, l_linenumber) AS body, l_orderkey, l_linenumber, l_partkey FROM lineitem)
  WHERE length(body) >= 30 AND source_asin IN (SELECT source_asin FROM ({NORM})))"""


@register(
    "reviews_attached",
    f"WITH {REV} SELECT source_asin, count(*) AS n FROM r GROUP BY 1",
)
def reviews_attached(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    return C.usable_reviews(raw_reviews(spark, sf), n).groupBy("source_asin").agg(F.count(F.lit(1)).alias("n"))


@register(
    "reviews_top5",
    f"WITH {REV}, t AS (SELECT *, row_number() OVER (PARTITION BY source_asin ORDER BY v DESC, least(length(body), 2000) DESC, body DESC) AS n FROM r QUALIFY n <= 5) SELECT source_asin, string_agg(body, '|' ORDER BY n) AS reviews FROM t GROUP BY 1",
)
def reviews_top5(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    return C.top_reviews(C.usable_reviews(raw_reviews(spark, sf), n)).select("source_asin", F.array_join("reviews", "|").alias("reviews"))


@register(
    "reviews_first5",
    f"WITH {REV}, t AS (SELECT *, row_number() OVER (PARTITION BY source_asin ORDER BY l_orderkey, l_linenumber, l_partkey, v) AS n FROM r QUALIFY n <= 5) SELECT source_asin, string_agg(body, '|' ORDER BY n) AS reviews FROM t GROUP BY 1",
)
def reviews_first5(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    r = C.usable_reviews(raw_reviews(spark, sf), n)
    return C.first_reviews(r, ["file_ord", "line_no", "part_no", "helpful_vote"]).select("source_asin", F.array_join("reviews", "|").alias("reviews"))


@register(
    "sequential_ids",
    f"SELECT source_asin, line_no, printf('P%05d', row_number() OVER (ORDER BY line_no)) AS id FROM ({NORM})",
)
def sequential_ids(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf)).select("source_asin", "line_no")
    return C.sequential_ids(n, ["line_no"], F.floor(F.col("line_no") / 256))


@register(
    "quota_per_group",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25",
)
def quota_per_group(spark, sf):
    return C.first_n_per(D.table(spark, sf, "documents").select("doc_id", "source"), "source", [F.asc("doc_id")], 25)


@register(
    "bounded_scan",
    "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 500",
)
def bounded_scan(spark, sf):
    from shelfmark.sources.readers import bounded_scan as scan

    return scan(D.table(spark, sf, "events").select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], 500).select("event_type", "event_id")


@register(
    "stratified_slice",
    """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
     n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
     SELECT doc_id, source FROM n JOIN s USING (source) WHERE n <= 130 // k + CASE WHEN i < 130 % k THEN 1 ELSE 0 END""",
)
def stratified_slice(spark, sf):
    return C.stratified_slice(D.table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 130)


def full_products(spark, sf):
    n = C.normalize_catalogue(raw_catalogue(spark, sf))
    r = C.top_reviews(C.usable_reviews(raw_reviews(spark, sf), n))
    p = C.attach_reviews(n, r)
    return p.withColumn("id", F.format_string("P%05d", "line_no")).withColumn(
        "qa",
        F.when(
            F.col("line_no") % 4 == 0,
            F.array(F.struct(F.lit("size?").alias("q"), F.coalesce(F.try_element_at("attributes", F.lit("size")), F.lit("?")).alias("a"))),
        ).otherwise(F.array().cast("array<struct<q:string,a:string>>")),
    ).withColumn("price", F.col("price").cast("int"))


def attrs():
    """Attributes in a fixed order: size, brand, aliases."""
    a = F.col("attributes")
    keys = F.filter(F.array(F.lit("size"), F.lit("brand_or_store"), F.lit("zh_aliases")), lambda k: F.map_contains_key(a, k))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(a, k).alias("value")))


PROD = f"""{REV}, t5 AS (SELECT source_asin, list(body ORDER BY n) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY source_asin ORDER BY v DESC, least(length(body), 2000) DESC, body DESC) AS n FROM r QUALIFY n <= 5) GROUP BY 1),
  p AS (SELECT nn.*, printf('P%05d', line_no) AS id, coalesce(reviews, []) AS reviews, CASE WHEN line_no % 4 = 0 THEN CASE WHEN has_details THEN CAST(p_size AS VARCHAR) ELSE '?' END END AS qa_a,
    list_concat(list_concat(CASE WHEN has_details THEN [{{'k': 'size', 'v': CAST(p_size AS VARCHAR)}}] ELSE [] END, CASE WHEN store IS NOT NULL THEN [{{'k': 'brand_or_store', 'v': store}}] ELSE [] END),
      CASE WHEN len(aliases) > 0 THEN [{{'k': 'zh_aliases', 'v': array_to_string(aliases, ', ')}}] ELSE [] END) AS attrs
   FROM ({NORM}) nn LEFT JOIN t5 USING (source_asin))"""


@register(
    "corpus_stats",
    f"WITH {PROD} SELECT category, count(*) AS products, count(price) AS with_price, count(*) FILTER (len(reviews) > 0) AS with_reviews, CAST(sum(len(reviews)) AS BIGINT) AS reviews, count(DISTINCT category) AS categories FROM p GROUP BY ROLLUP (category)",
)
def corpus_stats(spark, sf):
    p = full_products(spark, sf).withColumn("category_name", F.col("category"))
    return C.catalogue_stats(p, ["category_name"]).withColumnRenamed("category_name", "category")


@register(
    "product_cards",
    f"""WITH {PROD} SELECT 'product:' || id AS doc_id, concat_ws(chr(10), '商品：' || title || '（' || category || '）', '价格：' || CAST(CAST(floor(price) AS INTEGER) AS VARCHAR) || ' 元', '库存：unknown',
      CASE WHEN len(attrs) > 0 THEN '规格：' || array_to_string([a.k || ': ' || a.v FOR a IN attrs], '；') END,
      CASE WHEN description <> '' THEN '描述：' || description END, CASE WHEN len(reviews) > 0 THEN '用户评价：' || array_to_string(reviews, ' ') END,
      CASE WHEN qa_a IS NOT NULL THEN '常见问答：问：size? 答：' || qa_a END) AS card FROM p""",
)
def product_cards(spark, sf):
    return C.product_parents(full_products(spark, sf), attrs())


@register(
    "chunk_fanout",
    f"""WITH {PROD}, c AS (
      SELECT id, 'desc' AS chunk_type, 0 AS i, title || '：' || description AS text FROM p WHERE description <> ''
      UNION ALL SELECT id, 'attr', i - 1, title || ' specification: ' || attrs[i].k || ' ' || attrs[i].v FROM (SELECT *, unnest(generate_series(1, least(8, len(attrs)))) AS i FROM p)
      UNION ALL SELECT id, 'qa', 0, title || ' 问：size? 答：' || qa_a FROM p WHERE qa_a IS NOT NULL
      UNION ALL SELECT id, 'review', i - 1, title || ' user review: ' || reviews[i] FROM (SELECT *, unnest(generate_series(1, least(5, len(reviews)))) AS i FROM p))
      SELECT 'product:' || id || ':' || chunk_type || ':' || i AS chunk_id, 'product:' || id AS doc_id, chunk_type, text FROM c""",
)
def chunk_fanout(spark, sf):
    return C.product_chunks(full_products(spark, sf), attrs()).select("chunk_id", "doc_id", "chunk_type", "text")


def policies(spark, sf):
    s = D.table(spark, sf, "supplier")
    return s.select(
        F.format_string("POL%03d", "s_suppkey").alias("id"),
        F.col("s_name").alias("title"),
        F.when(F.col("s_nationkey") % 2 == 0, "退换货").otherwise("物流").alias("policy_type"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("all orders").alias("scope"),
        F.format_string("within %d days", "s_nationkey").alias("content"),
        F.lit("2026-07-01").alias("updated_at"),
    )


POL = """pol AS (SELECT printf('POL%03d', s_suppkey) AS id, s_name AS title, CASE WHEN s_nationkey % 2 = 0 THEN '退换货' ELSE '物流' END AS policy_type,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'all orders' END AS scope, printf('within %d days', s_nationkey) AS content FROM supplier)"""


@register(
    "policy_chunks",
    f"WITH {POL} SELECT 'policy:' || id || ':body:0' AS chunk_id, policy_type AS category, concat_ws(chr(10), '政策：' || title || '（' || policy_type || '）', CASE WHEN scope <> '' THEN '适用范围：' || scope END, '内容：' || content) AS text FROM pol",
)
def policy_chunks(spark, sf):
    return C.policy_chunks(policies(spark, sf)).select("chunk_id", "category", "text")


@register(
    "chunk_counts",
    f"""WITH {PROD} SELECT 'product' AS source_type, CAST(sum((CASE WHEN description <> '' THEN 1 ELSE 0 END) + least(8, len(attrs)) + (CASE WHEN qa_a IS NOT NULL THEN 1 ELSE 0 END) + least(5, len(reviews))) AS BIGINT) AS chunks FROM p
     UNION ALL SELECT 'policy', count(*) FROM supplier""",
)
def chunk_counts(spark, sf):
    return C.chunk_counts(C.all_chunks(C.product_chunks(full_products(spark, sf), attrs()), C.policy_chunks(policies(spark, sf))))


# --- sinks --------------------------------------------------------------------------
@register(
    "upsert_latest",
    "SELECT user_id AS trajectory_id, event_id AS version, event_type AS task_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def upsert_latest(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("trajectory_id"), F.col("event_id").alias("version"), F.col("event_type").alias("task_id"), "value")
    half = F.col("version") % 2 == 0
    return K.upsert_latest(e.where(half), e.where(~half))


@register(
    "orders_snapshot",
    D.with_sql("dom_orders", "dom_commands", body="SELECT order_id, status, return_status FROM dom_orders WHERE order_id IN (SELECT order_id FROM dom_commands) ORDER BY order_id"),
)
def orders_snapshot(spark, sf):
    return K.orders_snapshot(D.orders(spark, sf), D.commands(spark, sf)).select("order_id", "status", "return_status")


@register(
    "step_quarantine",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'run_id_mismatch' WHEN value - 5 < 0 THEN 'bad_timing' ELSE 'accepted' END AS reason FROM events) GROUP BY 1",
)
def step_quarantine(spark, sf):
    rows = D.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "other").otherwise("run-1").alias("run_id"), (F.col("value") - 5).alias("rollout_seconds")
    )
    good, bad = K.split_step_rows(rows, "run-1", ["rollout_seconds"])
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.groupBy(F.lit("accepted").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "review_sheet",
    "SELECT CAST(doc_id AS VARCHAR) AS trajectory_id, CAST(quality AS VARCHAR) AS grader_reward, CASE WHEN toxic = 0 THEN 'true' ELSE 'false' END AS grader_policy_compliant, '' AS human_success, '' AS review_notes FROM labels",
)
def review_sheet(spark, sf):
    rows = D.table(spark, sf, "labels").select(
        F.col("doc_id").alias("trajectory_id"), F.col("quality").alias("grader_reward"), (F.col("toxic") == 0).alias("grader_policy_compliant")
    )
    return K.review_sheet(rows).select("trajectory_id", "grader_reward", "grader_policy_compliant", "human_success", "review_notes")
