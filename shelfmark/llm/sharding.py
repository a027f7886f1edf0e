"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

A row's shard depends on its key and the number of shards alone. When a shard is
appended, a row either stays or moves to the new shard, and only the necessary
fraction 1/(n+1) moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.llm.common import written

#: Order blocks per shard (leading bits of the key) and pieces of a block (leading bits of the text's sum).
BLOCK_BITS, PIECE_BITS = 8, 4
REPEATS_PER_CHUNK = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: follow the key's own random jumps until one passes the last shard."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    live = np.flatnonzero(target < shards)
    while len(live):
        shard[live] = target[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        target[live] = ((shard[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[target[live] < shards]
    return shard.astype(np.int32)


def key_number(key: Column) -> Column:
    """64-bit number of a stable key of any type: the leading half of its MD5 (a null key counts as an empty one)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("bigint")


def shard_of(key: Column, shards: int) -> Column:
    """Shard (from 0) of a stable key among ``shards`` shards; no shuffle, no table."""

    @F.pandas_udf(T.IntegerType())
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(jump(numbers.to_numpy(np.int64).view(np.uint64), shards))

    return shard(key_number(key))


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with its shard, whole rows, nothing shuffled. A column of that name is replaced."""
    return df.withColumn(name, shard_of(F.col(f"`{key}`"), shards))


def write_shards(df: DataFrame, key: str, shards: int, path: str, pieces: int = 16) -> None:
    """Write whole rows to one folder per shard, each dealt over ``pieces`` tasks by the row's hash."""
    placed = with_shard(df, key, shards)
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(pieces))
    placed.repartition(shards * pieces, "shard", piece).write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_manifest(docs: DataFrame, shards: int) -> DataFrame:
    """Place of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 8 (a null text has none, and the checksum
    of no bytes). Slots number each shard's rows from 0 without gaps, in order of
    the leading bits of the key's number, then checksum, number, size and doc_id,
    so they are reproducible.
    A null doc_id is one key like any other. Rows alike in all these columns get
    neighbouring slots; an empty table gives no rows. Other columns are ignored.

    Texts never leave their task. Like rows are counted before the shuffle, and a
    shard's order is cut into blocks by leading bits of key and checksum: a key
    with a third of all rows is spread over blocks or is one counted row.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    number = key_number(F.col("doc_id"))
    block = F.shiftrightunsigned("number", 64 - BLOCK_BITS) * (1 << PIECE_BITS) + F.shiftright("text_crc32", 32 - PIECE_BITS)
    placed = written(
        counted.withColumn("number", number)
        .withColumn("shard", shard_of(F.col("doc_id"), shards))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
        .withColumn("block", block)
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").agg(F.sum("n").alias("rows")).select(
        "shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "block").orderBy("text_crc32", "number", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "block"])
    first = first.withColumn("start", F.col("offset") + F.col("inside"))
    chunks = first.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(REPEATS_PER_CHUNK).cast("bigint"))))
    last = F.least(F.col("chunk") + REPEATS_PER_CHUNK, F.col("n")) - 1
    return chunks.withColumn("step", F.explode(F.sequence(F.col("chunk"), last))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("step")).alias("slot"), "grown_shard",
    )
