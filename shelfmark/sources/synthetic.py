"""Reproducible store rows from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_STATES = ["pending", "processed", "delivered", "cancelled"]


def _draw(i: Column, seed: int, salt: str, n: int) -> Column:
    """1..n, a pure function of row number and seed."""
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(n)) + 1


def seed_users(numbers: DataFrame, seed: int) -> DataFrame:
    """``numbers(i)`` to user rows."""
    uid = F.format_string("U%04d", "i")
    return numbers.select(
        uid.alias("user_id"),
        F.format_string("User %d", "i").alias("name"),
        F.lpad((F.col("i") * 7919 % 1000000).cast("string"), 6, "0").alias("verification_code"),
        F.to_json(F.array(F.concat(F.lit("gift_card_"), uid), F.concat(F.lit("credit_card_"), uid))).alias("payment_methods"),
    )


def seed_orders(numbers: DataFrame, users: int, products: int, today: str, seed: int) -> DataFrame:
    """``numbers(i)`` to order rows; the drawn columns depend on ``seed`` only."""
    i = F.col("i")
    uid = F.format_string("U%04d", _draw(i, seed, "user", users))
    pid = F.format_string("P%05d", _draw(i, seed, "product", products))
    state = F.element_at(F.array(*[F.lit(s) for s in ORDER_STATES]), ((i - 1) % 4 + 1).cast("int"))
    ordered = F.date_sub(F.lit(today).cast("date"), _draw(i, seed, "ordered", 90).cast("int"))
    base = numbers.select(
        F.format_string("O%06d", i).alias("order_id"),
        uid.alias("user_id"),
        pid.alias("product_id"),
        state.alias("status"),
        ordered.alias("ordered_at"),
        _draw(i, seed, "transit", 5).cast("int").alias("transit"),
        (i % 5 == 0).alias("opened"),
        (i % 11 == 0).alias("quality_issue"),
        F.when(i % 17 == 0, "out_of_stock").otherwise("available").alias("inventory_status"),
    )
    return base.select(
        "order_id", "user_id", "product_id", "status", "ordered_at",
        F.when(F.col("status") == "delivered", F.date_add("ordered_at", F.col("transit"))).alias("delivered_at"),
        "opened", "quality_issue", "inventory_status",
        F.lit(None).cast("string").alias("return_status"),
        F.lit(0).alias("version"),
        F.concat(F.lit("credit_card_"), "user_id").alias("payment_method_id"),
        F.to_json(F.array("product_id")).alias("item_ids"),
    )
