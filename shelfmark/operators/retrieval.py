"""Hybrid retrieval over a table of queries: BM25, exact dense search and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import BROADCAST_LIMIT_BYTES, payload_bytes
from shelfmark.functions.text import find_all, tokenize
from shelfmark.operators.postings import SCORE_DIGITS, build_index, topk


def top_per(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. The constant limit lets Spark prune before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# --- lexical index -----------------------------------------------------------
def postings(chunks: DataFrame) -> DataFrame:
    """``(token, chunk_id, tf, dl)``. One exchange on ``chunk_id`` serves every later group by."""
    tokens = chunks.select("chunk_id", tokenize("text").alias("tokens"))
    return (
        tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
        .repartition("chunk_id")
        .groupBy("chunk_id", "token", "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(chunks: DataFrame) -> DataFrame:
    """Distinct tokens per chunk are counted map-side, so a common token costs one row per task."""
    return (
        chunks.select(F.explode(F.array_distinct(tokenize("text"))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.avg(F.size(tokenize("text"))), F.lit(1e-9)).alias("avgdl"),
    )


def idf(df: Column, n: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_table(chunks: DataFrame) -> DataFrame:
    """``(token, df, idf)`` for the whole corpus."""
    one = corpus_stats(chunks).withColumn("j", F.lit(1))
    return (
        document_frequency(chunks)
        .withColumn("j", F.lit(1))
        .join(F.broadcast(one), "j")  # one row
        .select("token", "df", idf(F.col("df"), F.col("n")).alias("idf"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """Each query token once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("token"))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = fv.BM25_K, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
    """Top ``k`` chunks per query: ``(query_id, chunk_id, score, rank)``.

    The chunks are tokenised once, into an index in the shared folder. To ask one
    corpus again and again, build the index with a path and use ``postings.topk``.
    """
    return topk(build_index(chunks), query_terms(queries), k, k1, b)


# --- dense ---------------------------------------------------------------------
#: Rows of a tile of queries and of a tile of vectors: a task multiplies one by one and holds their score matrix.
QUERY_TILE, VECTOR_TILE = 1024, 4096


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fv.DENSE_K,
    exclude_self: bool = False,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    query_tile: int = QUERY_TILE,
    vector_tile: int = VECTOR_TILE,
) -> DataFrame:
    """Exact top ``k`` by inner product: ``(query_id, chunk_id, score, rank)``.

    Queries ``(query_id, vector)`` and ``vectors(chunk_id, embedding)`` are packed into
    tiles inside their partitions; rows without a vector take no part. Tiles of
    queries are broadcast behind a measured size, so that vectors stay where they are;
    more of them are joined with the vectors' tiles by a group number. A task holds one
    tile by one tile of scores (32 MB as set) and keeps ``k`` rows a query of each, equal
    scores by their id, so that copies of one vector are not all handed on; the exchange
    carries ``k`` rows per task and query.
    """
    asked = _tiles(queries, "query_id", "vector", query_tile).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    small = payload_bytes(asked) <= limit_bytes
    groups = 1 if small else vectors.sparkSession.sparkContext.defaultParallelism
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    packs = _tiles(vectors, "chunk_id", "embedding", vector_tile).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    query_type, chunk_type = queries.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    schema = f"query_id {query_type.simpleString()}, chunk_id {chunk_type.simpleString()}, score double"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = batch.column("query_ids")[i].values, batch.column("ids")[i].values
                q = np.frombuffer(batch.column("queries")[i].as_buffer()).reshape(len(mine), -1)
                m = np.frombuffer(batch.column("matrix")[i].as_buffer()).reshape(len(theirs), -1)
                scores = np.round(q @ m.T, SCORE_DIGITS)
                scores[np.isnan(scores)] = -np.inf
                if exclude_self:
                    scores[mine.to_numpy(zero_copy_only=False)[:, None] == theirs.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                # everything above the k-th score stays, and of those that tie with it the first by id, as in the final ranking
                kth = max(0, scores.shape[1] - k)
                floor = np.partition(scores, kth, axis=1)[:, kth]
                kept = (scores >= floor[:, None]) & np.isfinite(scores)
                many = np.flatnonzero(kept.sum(axis=1) > k)
                if len(many):
                    by_id = pc.sort_indices(theirs, null_placement="at_start").to_numpy()
                    ordered = scores[many][:, by_id]
                    ties = ordered == floor[many, None]
                    above = ordered > floor[many, None]
                    room = k - above.sum(axis=1, keepdims=True)
                    kept[many[:, None], by_id] = above | (ties & (np.cumsum(ties, axis=1) <= room))
                rows, cols = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(rows)), theirs.take(pa.array(cols)), pa.array(scores[rows, cols])], names=["query_id", "chunk_id", "score"])

    met = packs.join(F.broadcast(asked) if small else asked, "group").select("query_ids", "queries", "ids", "matrix")
    return top_per(met.mapInArrow(kernel, schema), "query_id", [F.desc("score"), F.asc("chunk_id")], k)


def _tiles(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows packed by ``size`` inside their partition: ids and the vectors, one after another, as bytes of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"]
                )

    kept = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    return kept.mapInArrow(pack, f"ids array<{rows.schema[key].dataType.simpleString()}>, matrix binary")


# --- fusion ----------------------------------------------------------------------
def parent_ranking(ranking: DataFrame, parents: DataFrame) -> DataFrame:
    """Collapse a chunk ranking to documents; a document keeps its best chunk's place."""
    docs = (
        ranking.join(parents, "chunk_id")
        .groupBy("query_id", "doc_id")
        .agg(F.min("rank").alias("first_rank"))
    )
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return docs.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "rank")


def reciprocal_rank_fusion(rankings: list[DataFrame], rrf_k: int = fv.RRF_K) -> DataFrame:
    """Sum of ``1/(k+rank)`` over the rankings each document appears in."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings])
    return both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf"))


def hybrid_search(
    lexical: DataFrame,
    dense: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = fv.TOP_K,
    source_type: str | None = None,
    category: str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Fuse both channels and rank documents.

    ``lexical`` and ``dense`` are chunk rankings already cut to their channel
    size. Filters are applied after fusion, as they must be: they never widen the
    channels. Ties are decided lexical-first.
    """
    meta_cols = [c for c in ("doc_id", "source_type", "category", "title", "price", "inventory", "product_id", "text") if c in chunks.columns]
    hits = lexical.select("query_id", "chunk_id", F.lit(1).alias("channel"), "rank", F.lit(None).cast("double").alias("sim")).unionByName(
        dense.select("query_id", "chunk_id", F.lit(0).alias("channel"), "rank", F.col("score").alias("sim"))
    )
    hits = hits.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    per_doc = hits.groupBy("query_id", "doc_id").agg(
        F.min(F.when(F.col("channel") == 1, F.col("rank"))).alias("bm25_first"),
        F.min(F.when(F.col("channel") == 0, F.col("rank"))).alias("dense_first"),
        F.coalesce(F.max("sim"), F.lit(0.0)).alias("dense_sim"),
        # dense first, then lexical
        F.min_by("chunk_id", F.struct("channel", "rank")).alias("chunk_id"),
    )

    def channel_rank(c: str) -> Column:
        w = Window.partitionBy("query_id").orderBy(F.col(c).asc_nulls_last())
        return F.when(F.col(c).isNotNull(), F.row_number().over(w))

    ranked = per_doc.withColumn("bm25_rank", channel_rank("bm25_first")).withColumn(
        "dense_rank", channel_rank("dense_first")
    )
    weight = F.when(F.col("text").rlike("[A-Za-z0-9]"), 0.0).otherwise(fv.DENSE_SCORE_WEIGHT)
    rrf = F.coalesce(1.0 / (fv.RRF_K + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(
        1.0 / (fv.RRF_K + F.col("dense_rank")), F.lit(0.0)
    )
    scored = ranked.join(queries.select("query_id", "text"), "query_id").withColumn(
        "score", F.round(rrf + weight * F.greatest(F.lit(0.0), F.col("dense_sim")), SCORE_DIGITS)
    ).drop("text")
    order = [
        F.desc("score"),
        F.col("bm25_rank").asc_nulls_last(),
        F.col("dense_rank").asc_nulls_last(),
        F.asc("doc_id"),
    ]
    fused = scored.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    out = fused.join(chunks.select("chunk_id", *[c for c in meta_cols if c != "doc_id"]), "chunk_id")
    if source_type is not None:
        out = out.where(F.col("source_type") == source_type)
    if category is not None:
        wanted = F.lit(category) if isinstance(category, str) else category
        out = out.where(F.contains(F.lower("category"), F.lower(wanted)))
    return top_per(out, "query_id", [F.asc("fused_rank")], limit or top_k)


def rerank(candidates: DataFrame, scores: DataFrame, top_k: int = fv.TOP_K, pool: int = fv.RERANK_CANDIDATES) -> DataFrame:
    """Re-order the best ``pool`` candidates by supplied scores and cut to ``top_k``."""
    pooled = candidates.where(F.col("rank") <= pool).drop("rank").join(scores, ["query_id", "doc_id"])
    return top_per(pooled, "query_id", [F.desc("rerank_score"), F.asc("fused_rank")], top_k)


def format_context(results: DataFrame, parents: DataFrame) -> DataFrame:
    """Numbered parent cards per query, in rank order (at most ``top_k`` per query)."""
    numbered = results.join(parents, "doc_id")
    return numbered.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "card"))).alias("cards")
    ).select(
        "query_id",
        F.array_join(
            F.transform("cards", lambda c, i: F.concat(F.lit("[资料"), (i + 1).cast("string"), F.lit("]\n"), c["card"])),
            "\n\n",
        ).alias("context"),
    )


# --- catalogue views ------------------------------------------------------------
def search_catalog(results: DataFrame, top_k: int | Column, max_price: Column | None = None) -> DataFrame:
    """Products under a price ceiling; a missing or zero price counts as infinite."""
    out = results.where((F.col("source_type") == "product") & F.col("product_id").isNotNull())
    if max_price is not None:
        price = F.when(F.col("price") != 0, F.col("price"))
        out = out.where(max_price.isNull() | (F.coalesce(price, F.lit(float("inf"))) <= max_price))
    first = out.groupBy("query_id", "product_id").agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("query_id", "product_id")]), "rank").alias("r"))
    flat = first.select("query_id", "product_id", "r.*").drop("rank")
    return top_per(flat, "query_id", [F.asc("fused_rank")], top_k)


def get_product(requests: DataFrame, chunks: DataFrame, passages: int = 5) -> DataFrame:
    """Product fields and its first passages, or ``product_not_found``.

    Only the first ``passages`` chunks of a product are collected.
    """
    first = top_per(chunks, "product_id", [F.asc("chunk_pos")], passages, rank="n")
    cards = first.groupBy("product_id").agg(
        F.min_by(F.struct("title", "category", "price"), "n").alias("product"),
        F.array_sort(F.collect_list(F.struct("n", "text"))).alias("texts"),
    )
    return requests.join(cards, "product_id", "left").select(
        *requests.columns,
        F.col("product").isNotNull().alias("ok"),
        F.when(F.col("product").isNull(), "product_not_found").alias("error"),
        "product",
        F.transform("texts", lambda t: t["text"]).alias("evidence"),
    )


def compare_products(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``requests(request_id, product_ids)``: every product looked up, ok only when all are found."""
    each = requests.select("request_id", F.posexplode("product_ids").alias("pos", "product_id"))
    looked = get_product(each, chunks)
    return looked.groupBy("request_id").agg(
        F.bool_and("ok").alias("ok"),
        F.count_if("ok").alias("n_found"),
        F.count(F.lit(1)).alias("n_asked"),
    )


def policy_category(policy_type: Column) -> Column:
    """Canonical policy category of a requested type; null when unknown."""
    pairs = [F.lit(x) for kv in fv.POLICY_ALIASES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), policy_type)


def product_hits(results: DataFrame, passages: int = 3) -> DataFrame:
    """Score sum and first passages per (query, product)."""
    prods = results.where(F.col("source_type") == "product").withColumn(
        "pid", F.coalesce("product_id", "doc_id")
    )
    w = Window.partitionBy("query_id", "pid").orderBy("rank")
    n = prods.withColumn("n", F.row_number().over(w))
    return n.groupBy("query_id", "pid").agg(
        F.sum("score").alias("score"),
        F.min("rank").alias("first_rank"),
        F.min_by(F.struct("title", "category", "price", "inventory"), "rank").alias("product"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("n") <= passages, F.struct("n", "text")))), lambda t: t["text"]
        ).alias("evidence"),
    )


def _brief(results: DataFrame, limit: int, line: Column, order_by_score: bool = True) -> DataFrame:
    hits = product_hits(results)
    top = top_per(hits, "query_id", [F.desc("score"), F.asc("first_rank")], limit, rank="i")
    return top.withColumn("line", line).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n"
        ).alias("lines"),
    )


def recommendation_brief(queries: DataFrame, results: DataFrame, limit: int = 3) -> DataFrame:
    p = F.col("product")
    price = F.when(p["price"].isNotNull(), F.concat(F.lit("，价格 "), p["price"].cast("string"), F.lit(" 元"))).otherwise("")
    stock = F.when(F.coalesce(p["inventory"], F.lit("")) != "", F.concat(F.lit("，库存 "), p["inventory"])).otherwise("")
    reason = F.when(F.size("evidence") > 0, F.substring(F.element_at("evidence", 1), 1, 80)).otherwise("与需求匹配")
    i = F.col("i").cast("string")
    line = F.concat(i, F.lit(". "), p["title"], F.lit("（"), p["category"], price, stock, F.lit("）："), reason, F.lit(" [资料"), i, F.lit("]"))
    body = _brief(results, limit, line)
    return queries.select("query_id").join(body, "query_id", "left").select(
        "query_id",
        F.when(F.col("n").isNull(), "暂时没有找到足够匹配的商品，建议转人工客服。")
        .otherwise(
            F.concat_ws("\n", F.lit("可以优先看这几款："), "lines", F.lit("如果你有预算、使用场景或品牌偏好，我可以继续收窄推荐。"))
        )
        .alias("brief"),
    )


def comparison_brief(queries: DataFrame, results: DataFrame, limit: int = 3) -> DataFrame:
    p = F.col("product")
    price = F.when(p["price"].isNotNull(), F.concat(p["price"].cast("string"), F.lit(" 元"))).otherwise("价格未注明")
    stock = F.when(F.coalesce(p["inventory"], F.lit("")) != "", p["inventory"]).otherwise("库存未注明")
    evidence = F.substring(F.array_join("evidence", "；"), 1, 120)
    i = F.col("i").cast("string")
    line = F.concat(i, F.lit(". "), p["title"], F.lit("："), price, F.lit("，"), stock, F.lit("。关键信息："), evidence, F.lit(" [资料"), i, F.lit("]"))
    body = _brief(results, limit, line)
    return queries.select("query_id").join(body, "query_id", "left").select(
        "query_id",
        F.when(F.coalesce("n", F.lit(0)) < 2, "我只找到一个明确相关的商品，暂时无法做可靠对比。可以再提供另一款商品名。")
        .otherwise(
            F.concat_ws("\n", F.lit("按当前资料，对比如下："), "lines", F.lit("如果要我给结论，请补充你更看重价格、续航、清洁力、便携性还是兼容性。"))
        )
        .alias("brief"),
    )


# --- optional query handling -------------------------------------------------------
def confident(max_dense_sim: Column, threshold: float = fv.MIN_DENSE_SIM) -> Column:
    return F.coalesce(max_dense_sim, F.lit(0.0)) >= threshold


def budget_ceiling(text: Column | str) -> Column:
    """Lowest budget stated in a query, null when none."""
    stated = F.concat(*[find_all(text, p, 1) for p in fv.BUDGET_PATTERNS])
    return F.array_min(F.transform(stated, lambda x: x.cast("double")))


def split_compound(text: Column | str) -> Column:
    """``A 和 B`` as two sub-queries; other texts as one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, r"\s*和\s*"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
