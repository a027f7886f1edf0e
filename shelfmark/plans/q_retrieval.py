"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import quantiles as QS
from shelfmark.functions.scale import broadcast_if_small, settled, spread
from shelfmark.functions.text import replace_first
from shelfmark.operators import retrieval as R
from shelfmark.operators import retrieval_eval as E
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


TOK = "list_transform(regexp_extract_all({}, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x))"


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(D.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.lines(spark, sf).select(
        (F.col("doc_id") * 16777216 + F.col("line_no")).alias("chunk_id"),
        "doc_id",
        F.col("lang").alias("source_type"),
        F.col("source").alias("category"),
        F.col("line").alias("text"),
    )


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_ctes(chunks: str, k: int, queries: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
  q AS ({queries}),
  ch AS ({chunks}),
  tok AS (SELECT chunk_id, {TOK.format("text")} AS tokens FROM ch),
  st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
  tf AS (SELECT chunk_id, dl, token, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM tok) GROUP BY ALL),
  dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  qt AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest({TOK.format("text")}) AS token FROM q)),
  sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
         FROM qt JOIN dfr USING (token) JOIN tf USING (token) CROSS JOIN st GROUP BY query_id, chunk_id),
  lex AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= {k})"""


DOC_SQL = "SELECT doc_id AS chunk_id, text FROM documents"
LINE_SQL = "SELECT doc_id * 16777216 + line_no AS chunk_id, doc_id, lang AS source_type, source AS category, line AS text FROM dom_lines"
QVEC_SQL = "SELECT item_id AS query_id, embedding AS vector FROM benchmark JOIN embeddings ON item_id = vec_id"
DENSE_SQL = """
  dsc AS (SELECT query_id, c.chunk_id, round(list_inner_product(vector::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM qv CROSS JOIN cv c),
  den AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dsc QUALIFY rank <= 20)"""
HYBRID_SQL = """
  hits AS (SELECT query_id, chunk_id, doc_id, 1 AS channel, rank, NULL AS sim FROM lex JOIN ch USING (chunk_id)
     UNION ALL SELECT query_id, chunk_id, doc_id, 0, rank, score FROM den JOIN ch USING (chunk_id)),
  pd AS (SELECT query_id, doc_id, min(rank) FILTER (channel = 1) AS bf, min(rank) FILTER (channel = 0) AS dfst,
     coalesce(max(sim), 0) AS dense_sim, arg_min(chunk_id, channel * 1000 + rank) AS chunk_id FROM hits GROUP BY 1, 2),
  rk AS (SELECT *, CASE WHEN bf IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY bf NULLS LAST) END AS bm25_rank,
     CASE WHEN dfst IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY dfst NULLS LAST) END AS dense_rank FROM pd),
  fu AS (SELECT rk.*, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0)
       + CASE WHEN regexp_matches(q.text, '[A-Za-z0-9]') THEN 0 ELSE 0.03 END * greatest(0, dense_sim), 9) AS score FROM rk JOIN q USING (query_id)),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, doc_id) AS fused_rank FROM fu)"""


@register("bm25_topk", f"WITH {bm25_ctes(DOC_SQL, 5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex")
def bm25_topk(spark, sf):
    out = R.bm25_topk(doc_chunks(spark, sf), bench_queries(spark, sf), k=5)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(
    "tokenize_documents",
    f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)",
)
def tokenize_documents(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", R.tokenize("text").alias("t"))
    return d.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@register(
    "bm25_terms",
    f"WITH tok AS (SELECT doc_id, {TOK.format('text')} AS tokens FROM documents), st AS (SELECT count(*) AS n FROM tok), d AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS token FROM tok) GROUP BY 1) SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d CROSS JOIN st",
)
def bm25_terms(spark, sf):
    return R.term_table(doc_chunks(spark, sf)).select("token", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


@register(
    "bm25_postings",
    f"WITH tok AS (SELECT doc_id AS chunk_id, {TOK.format('text')} AS tokens FROM documents) SELECT chunk_id, dl, token, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM tok) GROUP BY ALL",
)
def bm25_postings(spark, sf):
    return R.postings(doc_chunks(spark, sf)).select("chunk_id", F.col("dl").cast("bigint").alias("dl"), "token", "tf")


def label_centroids(spark, sf):
    """Mean vector per label: a bounded set of query vectors read from the whole table."""
    e = D.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select(
        F.col("label").cast("bigint").alias("query_id"), F.transform("v", lambda s: s["m"]).alias("vector")
    )


@register(
    "dense_topk",
    """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
  qv AS (SELECT label AS query_id, list(m ORDER BY i) AS vector FROM m GROUP BY 1),
  s AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS chunk_id, round(list_inner_product(vector, embedding::DOUBLE[]), 9) AS score FROM qv CROSS JOIN embeddings)
  SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20""",
)
def dense_topk(spark, sf):
    v = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    out = R.dense_topk(v, label_centroids(spark, sf), k=20)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def query_vectors(spark, sf):
    b = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    e = D.table(spark, sf, "embeddings")
    return b.join(e, b.query_id == e.vec_id).select("query_id", F.col("embedding").alias("vector"))


def channels(spark, sf, chunks):
    q = bench_queries(spark, sf)
    lex = R.bm25_topk(chunks, q, k=20)
    vectors = D.table(spark, sf, "embeddings").select((F.col("vec_id") * 16777216).alias("chunk_id"), "embedding")
    den = R.dense_topk(vectors, query_vectors(spark, sf), k=20)
    return q, lex, den


CHANNEL_SQL = f"""{bm25_ctes(LINE_SQL, 20)},
  qv AS ({QVEC_SQL}), cv AS (SELECT vec_id * 16777216 AS chunk_id, embedding FROM embeddings), {DENSE_SQL}"""


def lines_with(body: str) -> str:
    return f"WITH dom_lines AS ({D.CTE['dom_lines']}), {body}"


@register(
    "parent_ranking",
    lines_with(
        CHANNEL_SQL
        + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT query_id, doc_id, min(rank) AS r FROM lex JOIN ch USING (chunk_id) GROUP BY 1, 2)"
    ),
)
def parent_ranking(spark, sf):
    chunks = line_chunks(spark, sf)
    lex = R.bm25_topk(chunks, bench_queries(spark, sf), k=20)
    return R.parent_ranking(lex, chunks.select("chunk_id", "doc_id")).withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "rrf_fusion",
    lines_with(
        CHANNEL_SQL
        + """, pr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT query_id, doc_id, min(rank) AS r FROM lex JOIN ch USING (chunk_id) GROUP BY 1, 2)
      UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) FROM (SELECT query_id, doc_id, min(rank) AS r FROM den JOIN ch USING (chunk_id) GROUP BY 1, 2))
      SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM pr GROUP BY 1, 2"""
    ),
)
def rrf_fusion(spark, sf):
    chunks = line_chunks(spark, sf)
    _, lex, den = channels(spark, sf, chunks)
    parents = chunks.select("chunk_id", "doc_id")
    fused = R.reciprocal_rank_fusion([R.parent_ranking(lex, parents), R.parent_ranking(den, parents)])
    return fused.select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"))


def hybrid(spark, sf, **kw):
    chunks = line_chunks(spark, sf)
    q, lex, den = channels(spark, sf, chunks)
    return R.hybrid_search(lex, den, chunks, q, **kw)


HYBRID_COLS = """query_id, doc_id, chunk_id, round(score, 6) AS score, round(dense_sim, 6) AS dense_sim, bm25_rank, dense_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank"""


def hybrid_out(df):
    return df.select(
        "query_id",
        "doc_id",
        "chunk_id",
        F.round("score", 6).alias("score"),
        F.round("dense_sim", 6).alias("dense_sim"),
        F.col("bm25_rank").cast("bigint").alias("bm25_rank"),
        F.col("dense_rank").cast("bigint").alias("dense_rank"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@register("hybrid_search", lines_with(f"{CHANNEL_SQL}, {HYBRID_SQL} SELECT {HYBRID_COLS} FROM fr QUALIFY rank <= 5"))
def hybrid_search(spark, sf):
    return hybrid_out(hybrid(spark, sf, top_k=5))


@register(
    "hybrid_filtered",
    lines_with(
        f"{CHANNEL_SQL}, {HYBRID_SQL} SELECT {HYBRID_COLS} FROM fr JOIN (SELECT chunk_id, source_type, category FROM ch) USING (chunk_id) WHERE source_type = 'en' AND contains(lower(category), 'src1') QUALIFY rank <= 5"
    ),
)
def hybrid_filtered(spark, sf):
    return hybrid_out(hybrid(spark, sf, top_k=5, source_type="en", category="SRC1"))


@register(
    "rerank_candidates",
    lines_with(
        f"""{CHANNEL_SQL}, {HYBRID_SQL},
   pool AS (SELECT query_id, doc_id, fused_rank FROM fr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) <= 20)
   SELECT query_id, doc_id, CAST(n_chars % 1009 AS DOUBLE) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CAST(n_chars % 1009 AS DOUBLE) DESC, fused_rank) AS rank
   FROM pool JOIN documents USING (doc_id) QUALIFY rank <= 5"""
    ),
)
def rerank_candidates(spark, sf):
    cands = hybrid(spark, sf, limit=20)
    scores = D.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 1009).cast("double").alias("rerank_score"))
    pairs = cands.select("query_id", "doc_id").join(scores, "doc_id")
    out = R.rerank(cands, pairs, top_k=5)
    return out.select("query_id", "doc_id", "rerank_score", F.col("rank").cast("bigint").alias("rank"))


@register(
    "context_block",
    lines_with(
        f"""{CHANNEL_SQL}, {HYBRID_SQL},
   res AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM fr QUALIFY rank <= 5)
   SELECT query_id, md5(string_agg('[资料' || CAST(rank AS VARCHAR) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest, sum(length(text)) AS parent_chars
   FROM res JOIN documents USING (doc_id) GROUP BY 1"""
    ),
)
def context_block(spark, sf):
    res = hybrid(spark, sf, top_k=5).select("query_id", "doc_id", "rank")
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("card"))
    ctx = R.format_context(res, docs).select("query_id", F.md5("context").alias("digest"))
    chars = res.join(docs, "doc_id").groupBy("query_id").agg(F.sum(F.length("card")).alias("parent_chars"))
    return ctx.join(chars, "query_id")


@register(
    "confidence_gate",
    lines_with(
        f"{CHANNEL_SQL} SELECT item_id AS query_id, round(max(score), 6) AS best_sim, coalesce(max(score) >= 0.35, false) AS confident FROM benchmark LEFT JOIN den ON den.query_id = item_id GROUP BY 1"
    ),
)
def confidence_gate(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    den = R.dense_topk(vectors, query_vectors(spark, sf), k=20)
    asked = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    best = asked.join(den, "query_id", "left").groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", F.round("best", 6).alias("best_sim"), F.coalesce(R.confident(F.col("best")), F.lit(False)).alias("confident"))


# --- catalogue: products searched by the customers' segments and nations -----------
def catalog_chunks(spark, sf):
    p = spread(D.products(spark, sf))
    return p.select(
        (F.col("line_no") + 0).alias("chunk_id"),
        F.concat(F.lit("product:"), "product_id").alias("doc_id"),
        F.lit("product").alias("source_type"),
        "product_id",
        "category",
        "title",
        F.when(F.col("line_no") % 10 == 0, F.lit(None)).when(F.col("line_no") % 10 == 1, 0.0).otherwise(F.col("price")).alias("price"),
        "inventory",
        F.concat_ws(" ", "title", "brand", "size", "model").alias("text"),
    )


CATALOG_SQL = """SELECT line_no AS chunk_id, 'product:' || product_id AS doc_id, 'product' AS source_type, product_id, category, title,
  CASE WHEN line_no % 10 = 0 THEN NULL WHEN line_no % 10 = 1 THEN 0.0 ELSE price END AS price, inventory,
  concat_ws(' ', title, brand, size, model) AS text FROM dom_products"""
CATALOG_Q = """SELECT ('0x' || md5(p_name || '|' || p_type)[1:15])::BIGINT AS query_id, p_name || ' Brand 7' AS text, p_type AS want,
  round(avg(p_retailprice), 2) AS ceiling FROM part GROUP BY p_name, p_type"""


def catalog_queries(spark, sf):
    """One query per product name and type: the type as category filter, its mean price as ceiling."""
    p = D.table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.round(F.avg("p_retailprice"), 2).alias("ceiling"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", "p_name", "p_type")), 1, 15), 16, 10).cast("bigint")
    return p.select(
        key.alias("query_id"),
        F.concat("p_name", F.lit(" Brand 7")).alias("text"),
        F.col("p_type").alias("want"),
        "ceiling",
    )


#: Products and queries take vectors of the embeddings table by their keys.
CATALOG_VECTORS, CATALOG_QUERY_VECTORS = 200, 199

CATALOG_SEARCH_SQL = f"""WITH dom_products AS ({D.CTE['dom_products']}), {bm25_ctes(CATALOG_SQL, 20, CATALOG_Q)},
  qv AS (SELECT query_id, embedding AS vector FROM q JOIN embeddings ON vec_id = query_id % {CATALOG_QUERY_VECTORS}),
  cv AS (SELECT chunk_id, embedding FROM ch JOIN embeddings ON vec_id = chunk_id % {CATALOG_VECTORS}), {DENSE_SQL}, {HYBRID_SQL},
  cand AS (SELECT fr.query_id, fr.doc_id, c.product_id, c.title, c.category, c.price, c.inventory, c.text, fr.score, row_number() OVER (PARTITION BY fr.query_id ORDER BY fused_rank) AS rank, q.ceiling
     FROM fr JOIN ch c USING (chunk_id) JOIN q USING (query_id) WHERE contains(lower(c.category), lower(q.want)) QUALIFY rank <= 15)"""


def catalog_vectors(spark, sf, rows, key, modulus, name):
    e = D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias(name))
    # rows stay where they are: by vec_id, copies of one vector would lie together, and few tasks would hold them all
    return rows.select(key).join(broadcast_if_small(e), F.col(key) % modulus == F.col("vec_id")).select(key, name)


def catalog_results(spark, sf, limit=15):
    """Catalogue hits of both channels, filtered by the wanted category after fusion."""
    chunks = catalog_chunks(spark, sf)
    q = catalog_queries(spark, sf)
    lex = R.bm25_topk(chunks, q, k=20)
    dense = R.dense_topk(
        catalog_vectors(spark, sf, chunks, "chunk_id", CATALOG_VECTORS, "embedding"), catalog_vectors(spark, sf, q, "query_id", CATALOG_QUERY_VECTORS, "vector"), k=20
    )
    fused = R.hybrid_search(lex, dense, chunks, q, limit=10**6)
    wanted = fused.drop("rank").join(q.select("query_id", "want", "ceiling"), "query_id")
    kept = wanted.where(F.contains(F.lower("category"), F.lower("want")))
    return q, R.top_per(kept, "query_id", [F.asc("fused_rank")], limit)


@register(
    "search_catalog",
    CATALOG_SEARCH_SQL
    + """ SELECT query_id, product_id, price, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM cand
     WHERE coalesce(nullif(price, 0), 1e300) <= ceiling QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cand.rank) <= 5""",
)
def search_catalog(spark, sf):
    _, res = catalog_results(spark, sf)
    out = R.search_catalog(res, 5, F.col("ceiling"))
    return out.select("query_id", "product_id", "price", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(
    "product_hits",
    CATALOG_SEARCH_SQL
    + """ SELECT query_id, product_id AS pid, round(sum(score), 6) AS score, count(*) AS n_passages, min(text) AS first_text FROM cand GROUP BY 1, 2""",
)
def product_hits(spark, sf):
    _, res = catalog_results(spark, sf)
    return R.product_hits(res).select(
        "query_id", "pid", F.round("score", 6).alias("score"), F.size("evidence").cast("bigint").alias("n_passages"),
        F.element_at("evidence", 1).alias("first_text"),
    )


@register(
    "recommendation_brief",
    CATALOG_SEARCH_SQL
    + """, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS i FROM cand QUALIFY i <= 3),
     l AS (SELECT query_id, string_agg(CAST(i AS VARCHAR) || '. ' || title || '（' || category || CASE WHEN price IS NOT NULL THEN '，价格 ' || CAST(price AS VARCHAR) || ' 元' ELSE '' END
       || '，库存 ' || inventory || '）：' || text[1:80] || ' [资料' || CAST(i AS VARCHAR) || ']', chr(10) ORDER BY i) AS lines FROM h GROUP BY 1)
     SELECT query_id, CASE WHEN lines IS NULL THEN '暂时没有找到足够匹配的商品，建议转人工客服。' ELSE '可以优先看这几款：' || chr(10) || lines || chr(10) || '如果你有预算、使用场景或品牌偏好，我可以继续收窄推荐。' END AS brief
     FROM q LEFT JOIN l USING (query_id)""",
)
def recommendation_brief(spark, sf):
    q, res = catalog_results(spark, sf)
    return R.recommendation_brief(q, res)


@register(
    "comparison_brief",
    CATALOG_SEARCH_SQL
    + """, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS i FROM cand QUALIFY i <= 3),
     l AS (SELECT query_id, count(*) AS n, string_agg(CAST(i AS VARCHAR) || '. ' || title || '：' || CASE WHEN price IS NOT NULL THEN CAST(price AS VARCHAR) || ' 元' ELSE '价格未注明' END
       || '，' || inventory || '。关键信息：' || text[1:120] || ' [资料' || CAST(i AS VARCHAR) || ']', chr(10) ORDER BY i) AS lines FROM h GROUP BY 1)
     SELECT query_id, CASE WHEN coalesce(n, 0) < 2 THEN '我只找到一个明确相关的商品，暂时无法做可靠对比。可以再提供另一款商品名。' ELSE '按当前资料，对比如下：' || chr(10) || lines || chr(10) || '如果要我给结论，请补充你更看重价格、续航、清洁力、便携性还是兼容性。' END AS brief
     FROM q LEFT JOIN l USING (query_id)""",
)
def comparison_brief(spark, sf):
    q, res = catalog_results(spark, sf)
    return R.comparison_brief(q, res)


# --- product lookups: every ordered item is a request -------------------------------
@register(
    "product_lookup",
    f"""WITH dom_products AS ({D.CTE['dom_products']}), pat AS (SELECT product_id, title, category, price, key || ' ' || value AS text, pos FROM ({D.CTE['dom_attributes']})),
     req AS (SELECT l_orderkey AS request_id, l_linenumber AS pos, printf('P%05d', l_partkey + CASE WHEN l_linenumber = 7 THEN 90000 ELSE 0 END) AS product_id FROM lineitem)
     SELECT request_id, req.pos AS pos, req.product_id AS product_id, c.product_id IS NOT NULL AS ok, CASE WHEN c.product_id IS NULL THEN 'product_not_found' END AS error, title, evidence
     FROM req LEFT JOIN (SELECT product_id, min(title) AS title, string_agg(text, '|' ORDER BY pos) AS evidence FROM pat GROUP BY 1) c ON c.product_id = req.product_id""",
)
def product_lookup(spark, sf):
    req = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("pos"),
        F.format_string("P%05d", F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 90000).otherwise(0)).alias("product_id"),
    )
    chunks = attribute_chunks(spark, sf)
    return R.get_product(req, chunks).select(
        "request_id", "pos", "product_id", "ok", "error", F.col("product.title").alias("title"), F.array_join("evidence", "|").alias("evidence")
    )


def attribute_chunks(spark, sf):
    return D.product_attributes(D.products(spark, sf)).select(
        "product_id", "title", "category", "price", F.concat_ws(" ", "key", "value").alias("text"), F.col("pos").alias("chunk_pos")
    )


@register(
    "product_compare",
    """SELECT s_suppkey AS request_id, count(p_partkey) = 3 AS ok, count(p_partkey) AS n_found, 3 AS n_asked
     FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey * 31 % 2500, s_nationkey]) AS k FROM supplier) LEFT JOIN part ON k = p_partkey GROUP BY 1""",
)
def product_compare(spark, sf):
    req = D.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.array(
            *[F.format_string("P%05d", c.cast("bigint")) for c in (F.col("s_suppkey"), F.col("s_suppkey") * 31 % 2500, F.col("s_nationkey"))]
        ).alias("product_ids"),
    )
    return R.compare_products(req, attribute_chunks(spark, sf)).select(
        "request_id", "ok", F.col("n_found").cast("bigint").alias("n_found"), F.col("n_asked").cast("int").alias("n_asked")
    )


@register(
    "policy_lookup",
    """WITH pol(pid, cat) AS (SELECT s_suppkey, ['退换货', '售后保修', '物流', '发票', '退款'][CAST(s_suppkey % 5 + 1 AS INTEGER)] FROM supplier),
     asks AS (SELECT c_custkey, ['return', '保修', 'shipping', 'gift'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS t FROM customer),
     al AS (SELECT *, CASE t WHEN 'return' THEN '退换货' WHEN '保修' THEN '售后保修' WHEN 'shipping' THEN '物流' END AS cat FROM asks),
     top AS (SELECT cat, pid, row_number() OVER (PARTITION BY cat ORDER BY pid) AS rank FROM pol QUALIFY rank <= 3)
     SELECT c_custkey AS request_id, t AS policy_type, CASE WHEN al.cat IS NULL THEN 'unknown_policy_type' END AS error, CAST(pid AS BIGINT) AS policy_id FROM al LEFT JOIN top USING (cat)""",
)
def policy_lookup(spark, sf):
    def pick(c, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))

    pol = D.table(spark, sf, "supplier").select(pick("s_suppkey", "退换货", "售后保修", "物流", "发票", "退款").alias("cat"), F.col("s_suppkey").alias("policy_id"))
    top = R.top_per(pol, "cat", [F.asc("policy_id")], 3).drop("rank")
    asks = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), pick("c_custkey", "return", "保修", "shipping", "gift").alias("policy_type"))
    al = asks.withColumn("cat", R.policy_category(F.col("policy_type")))
    # at most three policies per category and five categories
    return al.join(F.broadcast(top), "cat", "left").select(
        "request_id", "policy_type", F.when(F.col("cat").isNull(), "unknown_policy_type").alias("error"), "policy_id"
    )


# --- budgets and compounds read from generated questions ------------------------------
@register(
    "budget_filter",
    """SELECT o_orderkey AS query_id, floor(o_totalprice / 100) AS ceiling, count(*) FILTER (p_retailprice <= floor(o_totalprice / 100)) AS n_within, count(*) AS n_items
     FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def budget_filter(spark, sf):
    o = D.table(spark, sf, "orders").select(
        "o_orderkey", F.format_string("预算不超过 %.2f 元，找礼物", F.floor(F.col("o_totalprice") / 100).cast("double")).alias("question")
    ).select("o_orderkey", R.budget_ceiling("question").alias("ceiling"))
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = D.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("o_orderkey").alias("query_id"), "ceiling").agg(
        F.count_if(F.col("p_retailprice") <= F.col("ceiling")).alias("n_within"), F.count(F.lit(1)).alias("n_items")
    )


@register(
    "compound_split",
    """SELECT s_suppkey AS query_id, i AS part_no, CASE i WHEN 1 THEN s_name ELSE n_name END AS part FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([1, 2]) AS i)""",
)
def compound_split(spark, sf):
    s = D.table(spark, sf, "supplier")
    n = D.table(spark, sf, "nation")
    q = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("query_id"), F.concat("s_name", F.lit(" 和 "), "n_name").alias("question")
    )
    return q.select("query_id", F.posexplode(R.split_compound("question")).alias("pos", "part")).select(
        "query_id", (F.col("pos") + 1).alias("part_no"), "part"
    )


# --- metrics -------------------------------------------------------------------------
GOLD_SQL = "gold AS (SELECT item_id AS query_id, unnest([item_id, item_id + 1]) AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'any' END AS relevance_mode, CASE WHEN item_id % 3 = 0 THEN 'dev' ELSE 'locked' END AS split FROM benchmark)"


@register(
    "retrieval_metrics",
    lines_with(
        f"""{CHANNEL_SQL}, {HYBRID_SQL}, {GOLD_SQL},
   res AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM fr QUALIFY rank <= 5),
   g AS (SELECT query_id, split, any_value(relevance_mode) AS mode, count(*) AS n_gold, count(rank) AS hits, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM gold LEFT JOIN res USING (query_id, doc_id) GROUP BY 1, 2),
   m AS (SELECT split, CASE WHEN mode = 'any' THEN CAST(hits > 0 AS DOUBLE) ELSE hits / n_gold END AS recall, coalesce(1.0 / first, 0) AS rr, CAST(coalesce(first = 1, false) AS DOUBLE) AS hit1,
      CASE WHEN mode = 'any' THEN coalesce(1 / log2(first + 1), 0) ELSE dcg / (1 + CASE WHEN n_gold > 1 THEN 1 / log2(3) ELSE 0 END) END AS ndcg FROM g)
   SELECT split, count(*) AS n, round(avg(hit1), 6) AS hit_1, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1"""
    ),
)
def retrieval_metrics(spark, sf):
    res = hybrid(spark, sf, top_k=5).select("query_id", "doc_id", "rank")
    gold = D.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.explode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("doc_id"),
        F.when(F.col("item_id") % 2 == 0, "any").alias("relevance_mode"),
        F.when(F.col("item_id") % 3 == 0, "dev").otherwise("locked").alias("split"),
    )
    m = E.metrics(E.per_query_scores(gold, res, k=5, by=["split"]), ["split"])
    return m.select("split", "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "recall", "mrr", "ndcg")])


@register(
    "no_answer_accuracy",
    lines_with(
        f"""{CHANNEL_SQL}, b AS (SELECT query_id, max(score) AS s FROM den GROUP BY 1)
   SELECT abst AS abstention_expected, count(*) AS n, round(avg(CAST((coalesce(s, 0) < 0.35) = abst AS INTEGER)), 6) AS accuracy FROM (SELECT item_id AS query_id, item_id % 5 = 0 AS abst FROM benchmark) LEFT JOIN b USING (query_id) GROUP BY 1"""
    ),
)
def no_answer_accuracy(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    den = R.dense_topk(vectors, query_vectors(spark, sf), k=20)
    bench = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 == 0).alias("abstention_expected"))
    out = E.no_answer_accuracy(bench, den, by=["abstention_expected"])
    return out.select("abstention_expected", "n", F.round("accuracy", 6).alias("accuracy"))


@register(
    "latency_quantiles",
    """SELECT event_type AS channel, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.95) AS nearest_p95,
     list_sort(list(value))[CAST(greatest(1, floor(count(*) * 0.95)) AS INTEGER)] AS floor_p95, list_sort(list(value))[CAST(floor(count(*) / 2) + 1 AS INTEGER)] AS upper_median FROM events GROUP BY 1""",
)
def latency_quantiles(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("channel"), "value")
    q = E.latency_report(e, ["channel"], "value")
    return q.select("channel", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "nearest_p95", "floor_p95", "upper_median")


@register(
    "latency_sketches",
    "SELECT event_type AS channel, count(value) AS n, count(DISTINCT CAST(ts AS DATE)) AS runs, true AS p50_inside, true AS p95_inside FROM events GROUP BY 1",
)
def latency_sketches(spark, sf):
    """Sketches per channel and day, merged over days; each estimate's exact rank against three times the stated error."""
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.to_date("ts").alias("run"), "value")
    wanted = {"p50": 0.5, "p95": 0.95}
    merged = settled(QS.quantiles(QS.merge_runs(QS.sketch_runs(e, ["channel", "run"], "value"), ["channel"]), wanted))
    inside = QS.within(e, ["channel"], "value", merged, wanted, slack=3.0)
    return merged.join(inside.withColumnsRenamed({n: f"{n}_inside" for n in wanted}), "channel").select("channel", "n", "runs", "p50_inside", "p95_inside")


@register(
    "scale_sweep",
    f"""WITH tok AS (SELECT doc_id, lang, {TOK.format('text')} AS tokens FROM documents),
   scales AS (SELECT unnest(['small', 'medium', 'full']) AS scale),
   corp AS (SELECT scale, doc_id, tokens FROM tok, scales WHERE scale = 'full' OR (scale = 'medium' AND lang IN ('en', 'fr')) OR lang = 'en'),
   st AS (SELECT scale, count(*) AS n, avg(len(tokens)) AS avgdl FROM corp GROUP BY 1),
   tf AS (SELECT scale, doc_id, dl, token, count(*) AS tf FROM (SELECT scale, doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM corp) GROUP BY ALL),
   dfr AS (SELECT scale, token, count(*) AS df FROM tf GROUP BY 1, 2),
   qt AS (SELECT DISTINCT query_id, token FROM (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS token FROM benchmark)),
   sc AS (SELECT scale, query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
         FROM qt JOIN dfr USING (token) JOIN tf USING (scale, token) JOIN st USING (scale) GROUP BY 1, 2, 3),
   top AS (SELECT *, row_number() OVER (PARTITION BY scale, query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5)
   SELECT scale, count(*) AS hits, round(avg(score), 6) AS mean_score FROM top GROUP BY 1""",
)
def scale_sweep(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    corpora = {"small": d.where(F.col("lang") == "en"), "medium": d.where(F.col("lang").isin("en", "fr")), "full": d}
    out = E.scale_sweep(corpora, bench_queries(spark, sf), k=5)
    return out.groupBy("scale").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("score"), 6).alias("mean_score"))


# --- benchmark generation ----------------------------------------------------------------
DA = f"WITH dom_products AS ({D.CTE['dom_products']}), dom_attributes AS ({D.CTE['dom_attributes']})"


@register(
    "eval_attribute_queries",
    DA
    + """ SELECT product_id, key, value, '找一款' || category || '，要求 ' || key || ' 是 ' || value || '，商品名是 ' || title AS question FROM dom_attributes QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(value) DESC, key) <= 2""",
)
def eval_attribute_queries(spark, sf):
    return E.attribute_queries(D.product_attributes(D.products(spark, sf)), per_product=2).select("product_id", "key", "value", "question")


@register(
    "eval_hard_kinds",
    f"""WITH dom_products AS ({D.CTE['dom_products']}), n AS (SELECT *, line_no AS i, lead(title) OVER (ORDER BY line_no) AS other FROM dom_products)
    SELECT product_id, ['compound', 'budget', 'typo', 'near_sku', 'no_answer'][CAST(i % 5 + 1 AS INTEGER)] AS kind,
     CASE i % 5 WHEN 0 THEN '比较 ' || title || ' 和 ' || coalesce(other, title) WHEN 1 THEN '预算不超过 ' || printf('%.2f', price) || '，想买 ' || title
       WHEN 2 THEN CASE WHEN instr(title, 'o') > 0 THEN title[1:instr(title, 'o') - 1] || '0' || title[instr(title, 'o') + 1:] ELSE title END
       WHEN 3 THEN title || ' 与同类近似型号有什么差异' ELSE '寻找不存在的量子悬浮版本 ' || CAST(i AS VARCHAR) END AS question FROM n""",
)
def eval_hard_kinds(spark, sf):
    p = D.products(spark, sf).withColumn("i", F.col("line_no"))
    return E.hard_queries(p).select("product_id", "kind", "question")


@register(
    "unique_signatures",
    DA
    + """, f AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(key)), lower(trim(value))) AS c FROM dom_attributes)
    SELECT product_id, key, value FROM f WHERE c = 1 AND length(trim(value)) >= 4
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN regexp_matches(lower(key), 'model|part|upc|dimensions') THEN 0 ELSE 1 END, length(value) DESC, pos) = 1""",
)
def unique_signatures(spark, sf):
    return E.unique_signatures(D.product_attributes(D.products(spark, sf))).select("product_id", "key", "value")


@register(
    "partial_names",
    "SELECT s_suppkey, CASE WHEN len([t FOR t IN toks IF length(t) >= 4]) > 0 THEN array_to_string([t FOR t IN toks IF length(t) >= 4][1:2], ' ') ELSE array_to_string(toks[1:2], ' ') END AS clue FROM (SELECT s_suppkey, regexp_extract_all(s_name || ' mk-2 x', '[A-Za-z0-9][A-Za-z0-9+._-]*') AS toks FROM supplier)",
)
def partial_names(spark, sf):
    from shelfmark.functions.text import partial_name

    return D.table(spark, sf, "supplier").select("s_suppkey", partial_name(F.concat("s_name", F.lit(" mk-2 x"))).alias("clue"))


@register(
    "eval_multi_constraint",
    f"""WITH dom_products AS ({D.CTE['dom_products']}) SELECT product_id, floor((price + greatest(1, price * 0.05)) * 100 + 0.5) / 100 AS ceiling,
    '预算不超过 ' || printf('%.2f', floor((price + greatest(1, price * 0.05)) * 100 + 0.5) / 100) || '，想买 ' || brand || ' 的' || category || '，关键词 ' ||
    CASE WHEN len([t FOR t IN toks IF length(t) >= 4]) > 0 THEN array_to_string([t FOR t IN toks IF length(t) >= 4][1:2], ' ') ELSE array_to_string(toks[1:2], ' ') END AS question
    FROM (SELECT *, regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9+._-]*') AS toks FROM dom_products) WHERE price > 0""",
)
def eval_multi_constraint(spark, sf):
    return E.multi_constraint(D.products(spark, sf)).select("product_id", "ceiling", "question")


def _first(c: str, a: str, b: str) -> str:
    return f"CASE WHEN instr({c}, '{a}') > 0 THEN {c}[1:instr({c}, '{a}') - 1] || '{b}' || {c}[instr({c}, '{a}') + 1:] ELSE {c} END"


@register(
    "typo_injection",
    f"SELECT p_partkey, z AS typo FROM (SELECT p_partkey, {_first('y', 'e', '3')} AS z FROM (SELECT p_partkey, {_first('x', 'i', '1')} AS y FROM (SELECT p_partkey, {_first('p_name', 'o', '0')} AS x FROM part)))",
)
def typo_injection(spark, sf):
    c = F.col("p_name")
    return D.table(spark, sf, "part").select("p_partkey", replace_first(replace_first(replace_first(c, "o", "0"), "i", "1"), "e", "3").alias("typo"))


@register(
    "near_sku_pairs",
    f"""WITH dom_products AS ({D.CTE['dom_products']}), r AS (SELECT lower(brand) AS brand, lower(category) AS category, product_id, row_number() OVER (PARTITION BY lower(brand), lower(category) ORDER BY line_no) AS n FROM dom_products QUALIFY n <= 2)
    SELECT brand, category, min(product_id) AS left_id, max(product_id) AS right_id FROM r GROUP BY 1, 2 HAVING count(*) = 2""",
)
def near_sku_pairs(spark, sf):
    return E.near_sku_pairs(D.products(spark, sf)).select("brand", F.col("category_key").alias("category"), "left_id", "right_id")


@register(
    "holdout_exclusion",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def holdout_exclusion(spark, sf):
    used = D.table(spark, sf, "labels").select("doc_id")
    return E.exclude_used(D.table(spark, sf, "documents").select("doc_id", "source"), used, "doc_id")


@register(
    "mutual_exclusion",
    """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a)),
    c AS (SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b))
    SELECT doc_id, 'attribute' AS kind FROM a UNION ALL SELECT doc_id, 'typo' FROM b UNION ALL SELECT doc_id, 'near_sku' FROM c""",
)
def mutual_exclusion(spark, sf):
    d = D.table(spark, sf, "documents")
    stages = {
        "attribute": D.table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id"),
        "typo": d.where(F.col("lang") == "en").select("doc_id"),
        "near_sku": d.where(F.col("n_chars") > 500).select("doc_id"),
    }
    return E.staged_kinds(stages, "doc_id")


CLUE = "CASE WHEN len([t FOR t IN toks IF length(t) >= 4]) > 0 THEN array_to_string([t FOR t IN toks IF length(t) >= 4][1:2], ' ') ELSE array_to_string(toks[1:2], ' ') END"
ONCE = "CASE WHEN instr({0}, '{1}') > 0 THEN substr({0}, 1, instr({0}, '{1}') - 1) || '{2}' || substr({0}, instr({0}, '{1}') + 1) ELSE {0} END"


@register(
    "benchmark_quotas",
    DA
    + f""", p AS (SELECT *, md5('20260720' || product_id) AS place, {CLUE} AS clue, CASE WHEN line_no % 3 = 0 THEN '商品' ELSE 'alias ' || category END AS alias
       FROM (SELECT *, regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9+._-]*') AS toks FROM dom_products)),
     f AS (SELECT product_id, key, value, count(*) OVER (PARTITION BY lower(trim(key)), lower(trim(value))) AS c FROM dom_attributes),
     u AS (SELECT product_id, key, value FROM f WHERE c = 1 AND length(trim(value)) >= 4 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(value) DESC, key) = 1),
     k1 AS (SELECT 'attribute_no_title' AS kind, place, product_id, [product_id] AS ids, question FROM (SELECT *, '找' || alias || '，品牌线索是 ' || brand || '，属性 ' || key || ' 为 ' || value || '。' AS question FROM p JOIN u USING (product_id))
       WHERE NOT contains(lower(question), lower(title)) ORDER BY place, product_id LIMIT 80),
     p2 AS (SELECT * FROM p ANTI JOIN k1 USING (product_id)),
     k2 AS (SELECT 'multi_constraint', place, product_id, [product_id], '预算不超过 ' || printf('%.2f', floor((price * 1.05 + 1) * 100 + 0.5) / 100) || '，找 ' || brand || ' 的' || alias || '，名称线索 ' || clue FROM p2 WHERE price > 0 ORDER BY place, product_id LIMIT 20),
     p3 AS (SELECT * FROM p2 ANTI JOIN k2 USING (product_id)),
     t3 AS (SELECT *, {ONCE.format('a2', 'e', '3')} AS typo FROM (SELECT *, {ONCE.format('a1', 'i', '1')} AS a2 FROM (SELECT *, {ONCE.format('clue', 'o', '0')} AS a1 FROM p3))),
     k3 AS (SELECT 'alias_typo', place, product_id, [product_id], '有个' || alias || '好像叫 ' || typo || '，帮我定位准确商品' FROM t3 WHERE clue <> '' ORDER BY place, product_id LIMIT 20),
     p4 AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(brand)), array_to_string(string_split(lower(category), ' ')[1:3], ' ') ORDER BY place, product_id) AS i FROM p3 ANTI JOIN k3 USING (product_id) WHERE trim(brand) <> ''),
     k4 AS (SELECT 'near_sku_multi_gold', a.place, a.product_id, [a.product_id, b.product_id], '找 ' || a.brand || ' 的相近型号，线索是 ' || a.clue FROM p4 a JOIN p4 b ON lower(trim(a.brand)) = lower(trim(b.brand))
       AND array_to_string(string_split(lower(a.category), ' ')[1:3], ' ') = array_to_string(string_split(lower(b.category), ' ')[1:3], ' ') AND a.i = 1 AND b.i = 2 ORDER BY a.place, a.product_id LIMIT 15),
     every AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4)
     SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY place, product_id) AS n, question, array_to_string([printf('product:%s', x) FOR x IN ids], ',') AS gold_doc_ids FROM every""",
)
def benchmark_quotas(spark, sf):
    """Four kinds with quotas of 80, 20, 20 and 15; a report of fixed size over the whole catalogue."""
    p = D.products(spark, sf)
    products = p.select(
        "product_id", "title", "category", "price", "brand", F.md5(F.concat(F.lit("20260720"), "product_id")).alias("place"),
        F.when(F.col("line_no") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("alias "), "category"))).alias("aliases"),
    )
    kinds = [(E.attribute_without_title(D.product_attributes(p)), 80), (E.budget_and_clue, 20), (E.misspelt_clue, 20), (E.near_pairs, 15)]
    return E.with_quotas(products, kinds).withColumn("n", F.col("n").cast("bigint")).withColumn("gold_doc_ids", F.array_join("gold_doc_ids", ","))


@register(
    "title_leak_guard",
    "SELECT p_partkey, contains(lower('find ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' ' || upper(p_name) ELSE '' END), lower(p_name)) AS leaks FROM part",
)
def title_leak_guard(spark, sf):
    q = F.concat(F.lit("find "), "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(""))
    return D.table(spark, sf, "part").select("p_partkey", E.title_leaks(q, F.col("p_name")).alias("leaks"))


@register(
    "benchmark_census",
    "SELECT lang AS kind, CASE WHEN n_chars > 1000 THEN 'locked' ELSE 'dev' END AS split, count(*) AS n, grouping(kind) * 2 + grouping(split) AS level FROM documents GROUP BY CUBE (1, 2)".replace("grouping(kind) * 2 + grouping(split)", "CAST(grouping(lang) * 2 + grouping(CASE WHEN n_chars > 1000 THEN 'locked' ELSE 'dev' END) AS BIGINT)").replace("CUBE (1, 2)", "CUBE (lang, CASE WHEN n_chars > 1000 THEN 'locked' ELSE 'dev' END)"),
)
def benchmark_census(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("lang").alias("kind"), F.when(F.col("n_chars") > 1000, "locked").otherwise("dev").alias("split"))
    return E.census(d, ["kind", "split"])
