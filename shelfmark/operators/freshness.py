"""Freshness of the items behind an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.text import contains_any


def detect_claims(answer: Column | str) -> Column:
    """Sorted claim types made by an answer: inventory, policy, price."""
    c = F.col(answer) if isinstance(answer, str) else answer
    text = F.coalesce(c, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(contains_any(text, fv.INVENTORY_TERMS), "inventory"),
            F.when(contains_any(text, fv.POLICY_TERMS), "policy"),
            F.when(text.rlike(fv.PRICE_CLAIM_PATTERN), "price"),
        )
    )


def parse_stamp(c: Column | str) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(v), F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")))


def item_status(updated_at: Column | str, now: Column, max_age_days: int = fv.FRESHNESS_MAX_AGE_DAYS) -> Column:
    stamp = parse_stamp(updated_at)
    age_days = F.floor((F.unix_seconds(now) - F.unix_seconds(stamp)) / 86400)
    return F.when(stamp.isNull(), "unverified").when(age_days > max_age_days, "stale").otherwise("fresh")


def assess(answers: DataFrame, items: DataFrame, now: Column, max_age_days: int = fv.FRESHNESS_MAX_AGE_DAYS) -> DataFrame:
    """Worst status of the items each answer's claims rest on.

    ``answers(answer_id, answer)``, ``items(answer_id, kind, updated_at)`` with kind
    ``product`` or ``policy``. Items are reduced to one worst severity per answer
    and kind map-side, so an answer with very many items costs two rows.
    """
    severity = F.when(item_status("updated_at", now, max_age_days) == "stale", 3).when(
        item_status("updated_at", now, max_age_days) == "unverified", 2
    ).otherwise(1)
    worst = items.groupBy("answer_id").agg(
        F.max(F.when(F.col("kind") == "product", severity)).alias("product_worst"),
        F.max(F.when(F.col("kind") == "policy", severity)).alias("policy_worst"),
    )
    a = answers.withColumn("claims", detect_claims("answer")).join(worst, "answer_id", "left")
    goods = F.array_contains("claims", "price") | F.array_contains("claims", "inventory")
    used = F.coalesce(
        F.greatest(
            F.when(goods, F.col("product_worst")),
            F.when(F.array_contains("claims", "policy"), F.col("policy_worst")),
        ),
        F.lit(2),
    )
    status = (
        F.when(F.size("claims") == 0, "n/a").when(used == 3, "stale").when(used == 2, "unverified").otherwise("fresh")
    )
    return a.select("answer_id", "claims", status.alias("status"), should_downgrade(status).alias("downgrade"))


def should_downgrade(status: Column) -> Column:
    return status.isin("stale", "unverified")


def note(claims: Column) -> Column:
    kinds = F.when(F.size(claims) > 0, F.array_join(claims, "/")).otherwise("价格/库存/政策")
    return F.concat(F.lit("提示："), kinds, F.lit("信息可能变动，请以商品页实时信息为准；如需精确确认可转人工客服。"))


def items_from_ledger(evidence: DataFrame) -> DataFrame:
    """Latest non-null ``updated_at`` of each product and policy source in a ledger."""
    kind = F.when(F.startswith("source_id", F.lit("policy:")), "policy").when(
        F.startswith("source_id", F.lit("product:")), "product"
    )
    return (
        evidence.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .groupBy(F.col("trajectory_id").alias("answer_id"), "kind", "source_id")
        .agg(F.max_by("updated_at", F.when(F.coalesce("updated_at", F.lit("")) != "", F.col("evidence_no"))).alias("updated_at"))
    )
