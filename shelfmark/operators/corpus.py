"""Catalogue ETL: normalise raw rows, attach reviews, render cards, fan out chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import dense_numbers
from shelfmark.functions.text import clean, clean_list, clean_map, first_non_blank, parse_price, strip


def category_aliases(category: Column | str) -> Column:
    """Sorted distinct aliases of every alias key contained in the category."""
    c = F.lower(F.col(category) if isinstance(category, str) else category)
    none = F.array().cast("array<string>")
    parts = [
        F.when(F.contains(c, F.lit(key.lower())), F.array(*[F.lit(a) for a in names])).otherwise(none)
        for key, names in fv.CATEGORY_ALIASES.items()
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def attribute_map(details: Column, store: Column, aliases: Column) -> Column:
    """Details plus ``brand_or_store`` (unless present) and ``zh_aliases`` (replacing)."""
    none = F.create_map().cast("map<string,string>")
    base = F.coalesce(details, none)
    brand = F.when(
        (F.coalesce(store, F.lit("")) != "") & ~F.map_contains_key(base, F.lit("brand_or_store")),
        F.create_map(F.lit("brand_or_store"), clean(store)),
    ).otherwise(none)
    zh = F.when(F.size(aliases) > 0, F.create_map(F.lit("zh_aliases"), F.array_join(aliases, ", "))).otherwise(none)
    kept = F.when(
        F.size(aliases) > 0, F.map_filter(base, lambda k, v: k != "zh_aliases")
    ).otherwise(base)
    return F.map_concat(kept, brand, zh)


def normalize_catalogue(raw: DataFrame, updated_at: str = "2026-07-20") -> DataFrame:
    """Raw catalogue rows to products; rows without id, title or any description are dropped.

    ``raw``: parent_asin, asin, title, description, features[], details{}, categories[],
    main_category, category, price, store and whatever ordering columns it carries.
    """
    extra = [c for c in ("file_ord", "line_no") if c in raw.columns]
    out = raw.select(
        *extra,
        first_non_blank("parent_asin", "asin").alias("source_asin"),
        F.nullif(clean("title"), F.lit("")).alias("title"),
        F.coalesce(F.coalesce(first_non_blank("description"), F.nullif(clean_list("features"), F.lit(""))), F.lit("")).alias("description"),
        F.coalesce(
            F.nullif(clean_list("categories"), F.lit("")), first_non_blank("main_category", "category"), F.lit("")
        ).alias("category"),
        parse_price("price").alias("price"),
        "details",
        "store",
    )
    valid = out.where(
        F.col("source_asin").isNotNull()
        & F.col("title").isNotNull()
        & ((F.col("description") != "") | (F.coalesce(F.size("details"), F.lit(0)) > 0))
    )
    aliased = valid.withColumn("category_aliases_zh", category_aliases("category"))
    return aliased.withColumn(
        "attributes", attribute_map(F.col("details"), F.col("store"), F.col("category_aliases_zh"))
    ).select(
        *extra,
        "source_asin",
        "title",
        "category",
        "category_aliases_zh",
        "price",
        F.lit("unknown").alias("inventory"),
        "attributes",
        "description",
        F.lit(updated_at).alias("updated_at"),
    )


def details_text(details: Column) -> Column:
    return clean_map(details)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key. A partial ``min_by`` keeps one row per task and key before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__r")
    )
    return best.select(*key, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def latest_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__r")
    )
    return best.select(*key, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def hash_sample(df: DataFrame, key: str, n: int, strict: bool = True) -> DataFrame:
    """First ``n`` rows by ``sha1(key)``; with ``strict`` too few rows is an error."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return df.orderBy(F.sha1(F.col(key).cast("string")), key).limit(n)


def first_n_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def usable_reviews(reviews: DataFrame, products: DataFrame, min_chars: int = 30) -> DataFrame:
    """Reviews of chosen products with a body of ``min_chars`` or more."""
    bodies = reviews.withColumn("body", clean("body")).where(F.length("body") >= min_chars)
    return bodies.join(products.select("source_asin").distinct(), "source_asin", "left_semi")


def top_reviews(reviews: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` reviews per product by votes, capped length, then text; all descending."""
    order = [F.desc(F.coalesce("helpful_vote", F.lit(0))), F.desc(F.least(F.length("body"), F.lit(2000))), F.desc("body")]
    w = Window.partitionBy("source_asin").orderBy(*order)
    best = reviews.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return best.groupBy("source_asin").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda r: r["body"]).alias("reviews")
    )


def first_reviews(reviews: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    w = Window.partitionBy("source_asin").orderBy(*order)
    kept = reviews.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return kept.groupBy("source_asin").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda r: r["body"]).alias("reviews")
    )


def attach_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return products.join(reviews, "source_asin", "left").withColumn(
        "reviews", F.coalesce("reviews", F.array().cast("array<string>"))
    )


def sequential_ids(products: DataFrame, order: list[str], block: Column) -> DataFrame:
    """``P00001`` ids in ``order``; ``block`` is any expression that never decreases in that order."""
    return dense_numbers(products, order, block).withColumn("id", F.format_string("P%05d", "n")).drop("n")


def stratified_slice(df: DataFrame, stratum: str, order: list[str], limit: int) -> DataFrame:
    """``limit // k`` rows per stratum and one more for the first strata in sorted order."""
    named = df.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")))
    w = Window.partitionBy("__s").orderBy(*order)
    # no stratum can ever give more than ``limit`` rows, and the constant prunes before the shuffle
    first = named.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    strata = named.groupBy("__s").agg(F.count(F.lit(1)).alias("__c"))
    all_rows = Window.partitionBy(F.lit(1))
    quotas = strata.select(
        "__s",
        (F.row_number().over(all_rows.orderBy("__s")) - 1).alias("__i"),
        F.count(F.lit(1)).over(all_rows).alias("__k"),
    ).select(
        "__s",
        (F.floor(F.lit(limit) / F.col("__k")) + (F.col("__i") < F.lit(limit) % F.col("__k")).cast("int")).alias("__q"),
    )
    return first.join(quotas, "__s").where(F.col("__n") <= F.col("__q")).drop("__s", "__n", "__q")


def catalogue_stats(products: DataFrame, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Totals and, with ``by``, one row per group (rollup)."""
    distinct = F.approx_count_distinct("category") if approximate else F.count_distinct("category")
    grouped = products.rollup(*by) if by else products.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("products"),
        F.count("price").alias("with_price"),
        F.count_if(F.size("reviews") > 0).alias("with_reviews"),
        F.sum(F.size("reviews")).cast("bigint").alias("reviews"),
        distinct.alias("categories"),
    )


# --- cards and chunks -------------------------------------------------------------
def _line(label: str, value: Column, show: Column) -> Column:
    return F.when(show, F.concat(F.lit(label), value))


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def number_text(c: str) -> Column:
    return F.col(c).cast("string")


def product_card(attributes: Column) -> Column:
    """Card text; ``attributes`` is an array of (key, value) in source order. Blank lines are skipped."""
    spec = F.array_join(F.transform(attributes, lambda a: F.concat(a["key"], F.lit(": "), a["value"])), "；")
    reviews = F.array_join("reviews", " ")
    qa = F.array_join(
        F.transform("qa", lambda x: F.concat(F.lit("问："), x["q"], F.lit(" 答："), x["a"])), " "
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("商品："), "title", F.lit("（"), F.coalesce("category", F.lit("")), F.lit("）")),
        _line("价格：", F.concat(number_text("price"), F.lit(" 元")), F.col("price").isNotNull()),
        _line("库存：", F.col("inventory"), _present("inventory")),
        _line("规格：", spec, spec != ""),
        _line("描述：", F.col("description"), _present("description")),
        _line("用户评价：", reviews, F.coalesce(F.size("reviews"), F.lit(0)) > 0),
        _line("常见问答：", qa, F.coalesce(F.size("qa"), F.lit(0)) > 0),
    )


def policy_card() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("政策："), "title", F.lit("（"), F.coalesce("policy_type", F.lit("")), F.lit("）")),
        _line("适用范围：", F.col("scope"), _present("scope")),
        F.concat(F.lit("内容："), F.coalesce("content", F.lit(""))),
    )


def ordered_attributes(json_text: Column | str) -> Column:
    """Attributes kept as JSON text, as an array of (key, value) in source order."""
    c = F.col(json_text) if isinstance(json_text, str) else json_text
    values = F.from_json(c, "map<string,string>")
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(values, k).alias("value")))


def product_chunks(products: DataFrame, attributes: Column, max_attributes: int = 8, max_reviews: int = 5) -> DataFrame:
    """Description, attribute, question and review chunks of each product, without leaving the row."""
    title = F.col("title")

    def chunk(kind: str, i: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), i.cast("int").alias("chunk_index"), strip(text).alias("text"))

    none = F.array().cast("array<struct<chunk_type:string,chunk_index:int,text:string>>")
    parts = [
        F.when(
            _present("description"), F.array(chunk("desc", F.lit(0), F.concat(title, F.lit("："), "description")))
        ).otherwise(none),
        F.transform(
            F.slice(attributes, 1, max_attributes),
            lambda a, i: chunk("attr", i, F.concat(title, F.lit(" specification: "), a["key"], F.lit(" "), a["value"])),
        ),
        F.coalesce(
            F.transform(
                "qa", lambda x, i: chunk("qa", i, F.concat(title, F.lit(" 问："), x["q"], F.lit(" 答："), x["a"]))
            ),
            none,
        ),
        F.coalesce(
            F.transform(
                F.slice(F.col("reviews"), 1, max_reviews),
                lambda r, i: chunk("review", i, F.concat(title, F.lit(" user review: "), r)),
            ),
            none,
        ),
    ]
    doc = F.concat(F.lit("product:"), "id")
    base = products.select(
        doc.alias("doc_id"),
        F.lit("product").alias("source_type"),
        F.col("id").alias("product_id"),
        "title",
        F.coalesce("category", F.lit("")).alias("category"),
        "price",
        F.coalesce("inventory", F.lit("")).alias("inventory"),
        "updated_at",
        F.explode(F.concat(*parts)).alias("c"),
    )
    flat = base.select("*", "c.*").drop("c").where(F.col("text") != "")
    return flat.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_type", F.col("chunk_index").cast("string"))).drop("chunk_index")


def product_parents(products: DataFrame, attributes: Column) -> DataFrame:
    return products.select(F.concat(F.lit("product:"), "id").alias("doc_id"), product_card(attributes).alias("card"))


def policy_chunks(policies: DataFrame) -> DataFrame:
    doc = F.concat(F.lit("policy:"), "id")
    return policies.select(
        F.concat(doc, F.lit(":body:0")).alias("chunk_id"),
        doc.alias("doc_id"),
        F.lit("policy").alias("source_type"),
        F.col("id").alias("policy_id"),
        "title",
        F.coalesce("policy_type", F.lit("")).alias("category"),
        F.lit(None).cast("double").alias("price"),
        F.lit("").alias("inventory"),
        F.lit("policy").alias("chunk_type"),
        policy_card().alias("text"),
        "updated_at",
    )


def policy_parents(policies: DataFrame) -> DataFrame:
    return policies.select(F.concat(F.lit("policy:"), "id").alias("doc_id"), policy_card().alias("card"))


def all_chunks(product: DataFrame, policy: DataFrame) -> DataFrame:
    return product.unionByName(policy, allowMissingColumns=True)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"))
