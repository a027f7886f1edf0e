"""Benchmark generation and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import broadcast_if_small, exact_ranks, settled
from shelfmark.functions.text import cents, partial_name, replace_first
from shelfmark.operators.retrieval import bm25_topk, top_per


# --- metrics -------------------------------------------------------------------
def per_query_scores(gold: DataFrame, ranked: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Recall, reciprocal rank, hit@1 and nDCG per query.

    ``gold(query_id, doc_id, relevance_mode, *by)``; with mode ``any`` one gold
    document is enough.
    """
    hits = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    g = gold.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id", *by).agg(
        F.any_value("relevance_mode").alias("mode"),
        F.count(F.lit(1)).alias("n_gold"),
        F.count("rank").alias("n_hit"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
    )
    any_mode = F.coalesce(F.col("mode") == "any", F.lit(False))
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n_gold"), F.lit(k).cast("bigint"))),
        F.lit(0.0),
        lambda acc, r: acc + 1 / F.log2(r + 1),
    )
    return g.select(
        "query_id",
        *by,
        F.when(any_mode, (F.col("n_hit") > 0).cast("double")).otherwise(F.col("n_hit") / F.col("n_gold")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("hit"),
        F.when(any_mode, F.coalesce(1 / F.log2(F.col("first") + 1), F.lit(0.0))).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("hit").alias("hit_1"),
        F.avg("recall").alias("recall"),
        F.avg("rr").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )


def no_answer_accuracy(
    bench: DataFrame, dense: DataFrame, by: list[str], threshold: float = fv.MIN_DENSE_SIM
) -> DataFrame:
    """How often abstaining below ``threshold`` agrees with ``abstention_expected``."""
    best = dense.groupBy("query_id").agg(F.max("score").alias("best"))
    abstains = F.coalesce("best", F.lit(0.0)) < threshold
    return bench.join(best, "query_id", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((abstains == F.col("abstention_expected")).cast("int")).alias("accuracy"),
    )


def latency_report(timings: DataFrame, by: list[str], value: str) -> DataFrame:
    """The four quantile rules in use, each exact."""
    ranks = exact_ranks(
        timings,
        by,
        value,
        {
            "p50": ("inclusive", 0.5),
            "p95": ("inclusive", 0.95),
            "nearest_p95": ("nearest", 0.95),
            "floor_p95": ("floor", 0.95),
            "upper_median": ("upper_median", 0.5),
        },
    )
    counts = timings.groupBy(*by).agg(F.count(value).alias("n"))
    return counts.join(ranks, by)


def scale_sweep(corpora: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """The same queries over corpora of growing size."""
    runs = [bm25_topk(c, queries, k=k).withColumn("scale", F.lit(name)) for name, c in corpora.items()]
    return reduce(DataFrame.unionByName, runs)


# --- generation -------------------------------------------------------------------
def attribute_queries(attributes: DataFrame, per_product: int = 5, limit: int | None = None) -> DataFrame:
    """The longest attributes of each product as questions that name the product."""
    best = top_per(attributes, "product_id", [F.desc(F.length("value")), F.asc("key")], per_product, rank="n")
    out = best.withColumn(
        "question",
        F.concat(
            F.lit("找一款"), "category", F.lit("，要求 "), "key", F.lit(" 是 "), "value", F.lit("，商品名是 "), "title"
        ),
    )
    return out if limit is None else out.orderBy(F.xxhash64("product_id"), "n").limit(limit)


def hard_queries(products: DataFrame) -> DataFrame:
    """Five hard kinds by ``i % 5``; a compound question needs the next product by ``i``."""
    following = products.select((F.col("i") - 1).alias("i"), F.col("title").alias("other"))
    p = products.join(following, "i", "left")
    mode = F.col("i") % 5
    kinds = F.array(*[F.lit(x) for x in ("compound", "budget", "typo", "near_sku", "no_answer")])
    question = (
        F.when(mode == 0, F.concat(F.lit("比较 "), "title", F.lit(" 和 "), F.coalesce("other", "title")))
        .when(mode == 1, F.concat(F.lit("预算不超过 "), F.format_string("%.2f", "price"), F.lit("，想买 "), "title"))
        .when(mode == 2, replace_first("title", "o", "0"))
        .when(mode == 3, F.concat("title", F.lit(" 与同类近似型号有什么差异")))
        .otherwise(F.concat(F.lit("寻找不存在的量子悬浮版本 "), F.col("i").cast("string")))
    )
    return p.select("*", F.element_at(kinds, (mode + 1).cast("int")).alias("kind"), question.alias("question"))


def unique_signatures(attributes: DataFrame, min_chars: int = 4) -> DataFrame:
    """Per product the best attribute whose key and value occur once in the corpus.

    Occurrences are counted map-side and the few repeated signatures are joined
    back, so a value shared by a third of the products does not gather in one task.
    """
    signed = attributes.select(
        "*", F.lower(F.trim("key")).alias("k"), F.lower(F.trim("value")).alias("v")
    )
    single = signed.groupBy("k", "v").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("product_id", "pos", "key", "value")).alias("only")
    ).where(F.col("c") == 1)
    usable = single.select("only.*").where(F.length(F.trim("value")) >= min_chars)
    priority = F.when(F.lower("key").rlike("model|part|upc|dimensions"), 0).otherwise(1)
    return top_per(usable, "product_id", [priority.asc(), F.desc(F.length("value")), F.asc("pos")], 1, rank="n")


def multi_constraint(products: DataFrame, brand: str = "brand") -> DataFrame:
    ceiling = cents(F.col("price") + F.greatest(F.lit(1.0), F.col("price") * 0.05))
    return products.where(F.col("price") > 0).withColumn("ceiling", ceiling).withColumn(
        "question",
        F.concat(
            F.lit("预算不超过 "), F.format_string("%.2f", "ceiling"), F.lit("，想买 "), brand, F.lit(" 的"), "category",
            F.lit("，关键词 "), partial_name("title"),
        ),
    )


def near_sku_pairs(products: DataFrame) -> DataFrame:
    """First two products of each (brand, first three category words)."""
    keyed = products.where(F.trim("brand") != "").select(
        F.lower(F.trim("brand")).alias("brand"),
        F.lower(F.array_join(F.slice(F.split(F.trim("category"), r"\s+"), 1, 3), " ")).alias("category_key"),
        "product_id",
        "line_no",
    )
    # two smallest per group by two partial aggregates; no group is gathered
    first = keyed.groupBy("brand", "category_key").agg(F.min(F.struct("line_no", "product_id")).alias("a"))
    rest = keyed.join(first, ["brand", "category_key"]).where(F.col("line_no") > F.col("a.line_no"))
    second = rest.groupBy("brand", "category_key").agg(F.min(F.struct("line_no", "product_id")).alias("b"))
    return first.join(second, ["brand", "category_key"]).select(
        "brand", "category_key", F.col("a.product_id").alias("left_id"), F.col("b.product_id").alias("right_id")
    )


def exclude_used(candidates: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return candidates.join(used.select(key), key, "left_anti")


def staged_kinds(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Each stage takes what no earlier stage used: the first stage of a key wins."""
    staged = reduce(
        DataFrame.unionByName,
        [
            df.select(key, F.lit(i).alias("stage"), F.lit(kind).alias("kind"))
            for i, (kind, df) in enumerate(stages.items())
        ],
    )
    return staged.groupBy(key).agg(F.min_by("kind", "stage").alias("kind"))


# --- hold-out with quotas -----------------------------------------------------------
def first_alias() -> Column:
    return F.coalesce(F.get("aliases", F.lit(0)), F.lit(fv.NO_ALIAS))


def _asked(rows: DataFrame, kind: str, question: Column, ids: Column, order: list[str]) -> DataFrame:
    """Candidates of a kind: question, the gold product ids and the place that decides who comes first."""
    return rows.select(F.lit(kind).alias("kind"), question.alias("question"), ids.alias("ids"), F.struct(*order).alias("place"))


def attribute_without_title(attributes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Questions by the longest attribute that occurs once in the whole catalogue, without the product's title."""
    signed = attributes.select("product_id", "key", "value", F.lower(F.trim("key")).alias("k"), F.lower(F.trim("value")).alias("v"))
    once = signed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("product_id", "key", "value")).alias("only")).where("c = 1")
    usable = once.select("only.*").where(F.length(F.trim("value")) >= 4)
    best = top_per(usable, "product_id", [F.desc(F.length("value")), F.asc("key")], 1, rank="n").drop("n")

    def make(open_: DataFrame) -> DataFrame:
        rows = open_.join(best, "product_id")
        question = F.concat(F.lit("找"), first_alias(), F.lit("，品牌线索是 "), "brand", F.lit("，属性 "), "key", F.lit(" 为 "), "value", F.lit("。"))
        return _asked(rows.where(~title_leaks(question, F.col("title"))), "attribute_no_title", question, F.array("product_id"), ["place", "product_id"])

    return make


def budget_and_clue(open_: DataFrame) -> DataFrame:
    ceiling = cents(F.col("price") * 1.05 + 1)
    question = F.concat(
        F.lit("预算不超过 "), F.format_string("%.2f", ceiling), F.lit("，找 "), "brand", F.lit(" 的"), first_alias(), F.lit("，名称线索 "), partial_name("title")
    )
    return _asked(open_.where(F.col("price") > 0), "multi_constraint", question, F.array("product_id"), ["place", "product_id"])


def misspelt_clue(open_: DataFrame) -> DataFrame:
    clue = partial_name("title")
    typo = replace_first(replace_first(replace_first(clue, "o", "0"), "i", "1"), "e", "3")
    question = F.concat(F.lit("有个"), first_alias(), F.lit("好像叫 "), typo, F.lit("，帮我定位准确商品"))
    return _asked(open_.where(clue != ""), "alias_typo", question, F.array("product_id"), ["place", "product_id"])


def near_pairs(open_: DataFrame) -> DataFrame:
    """The first two open products of each (brand, first three category words): pairs share no product."""
    keyed = open_.where(F.trim("brand") != "").withColumns(
        {"b": F.lower(F.trim("brand")), "c": F.array_join(F.slice(F.split(F.lower("category"), r"\s+"), 1, 3), " ")}
    )
    row = F.struct("place", "product_id", "brand", "title")
    first = keyed.groupBy("b", "c").agg(F.min(row).alias("one"))
    rest = keyed.join(first, ["b", "c"]).where(F.struct("place", "product_id") > F.struct("one.place", "one.product_id"))
    second = rest.groupBy("b", "c").agg(F.min(F.struct("place", "product_id")).alias("two"), F.first("one").alias("one"))
    question = F.concat(F.lit("找 "), "one.brand", F.lit(" 的相近型号，线索是 "), partial_name("one.title"))
    rows = second.select(question.alias("question"), F.array("one.product_id", "two.product_id").alias("ids"), F.col("one.place").alias("place"), F.col("one.product_id").alias("product_id"))
    return _asked(rows, "near_sku_multi_gold", F.col("question"), F.col("ids"), ["place", "product_id"])


def with_quotas(products: DataFrame, kinds: list[tuple[Callable[[DataFrame], DataFrame], int]]) -> DataFrame:
    """kind, n (place within the kind), question, gold_doc_ids: each kind takes its quota of products no earlier kind took.

    ``products`` (product_id, title, category, price, brand, aliases, place); ``place`` is
    the seeded order. What a kind leaves, because its quota is full or a product does not
    fit it, stays for the later ones. A quota is a constant limit: each task sends at most
    that many rows. A kind with fewer candidates than its quota takes them all.
    """
    open_, parts = products, []
    for make, quota in kinds:
        taken = settled(make(open_).orderBy("place").limit(quota))
        parts.append(taken)
        used = taken.select(F.explode("ids").alias("product_id"))
        open_ = open_.join(broadcast_if_small(used), "product_id", "left_anti")
    every = reduce(DataFrame.unionByName, parts)
    numbered = every.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("place")))
    return numbered.select("kind", "n", "question", F.transform("ids", lambda i: F.concat(F.lit("product:"), i)).alias("gold_doc_ids"))


def title_leaks(question: Column, title: Column) -> Column:
    return F.contains(F.lower(question), F.lower(title))


def census(bench: DataFrame, by: list[str]) -> DataFrame:
    return bench.cube(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
