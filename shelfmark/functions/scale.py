"""Building blocks that keep operators balanced when one key holds much of the data."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def payload_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, measured by one aggregate over its columns."""
    width: Column = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            width = width + 16
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint behind a measured size; otherwise the join shuffles as usual."""
    return F.broadcast(df) if payload_bytes(df) <= limit else df


def block_count(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> int:
    """Number of blocks so that each block of ``df`` stays under ``limit``."""
    return 1 + payload_bytes(df) // limit


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set one only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="shelfmark-ckpt-")
    sc.setCheckpointDir(named)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on a table of fewer files than cores; larger tables are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read to the shared checkpoint folder, once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def exchanged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` once: every branch reads the files of that one exchange, and nothing else is stored.

    Like ``settled`` it ends the plan, so no branch computes ``df`` again or asks for other columns of it; unlike it, rows
    are not written a second time. The branches know the partitioning.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm

    def module(name: str) -> Any:
        return getattr(getattr(jvm, f"{name}$"), "MODULE$")

    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    run = dealt._jdf.queryExecution()
    found = module("org.apache.spark.sql.execution.LogicalRDD").fromDataset(run.toRdd(), dealt._jdf, False)
    ran = run.executedPlan()
    if ran.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        ran = ran.executedPlan()  # as it ran in the end; the adaptive plan itself does not say how its rows are dealt
    none = module("scala.None")
    scan = module("org.apache.spark.sql.execution.LogicalRDD").apply(
        found.output(), found.rdd(), ran.outputPartitioning(), found.outputOrdering(), False, none, spark._jsparkSession, none, none
    )
    return DataFrame(module("org.apache.spark.sql.classic.Dataset").ofRows(spark._jsparkSession, scan), spark)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before_only: bool = False,
    once: bool = False,
) -> DataFrame:
    """Running aggregates per key, computed block by block.

    ``block`` must be non-decreasing in ``order``. Rows are windowed only inside
    their block and joined with the carry of all earlier blocks, so a key that
    holds a third of the table is spread over its blocks instead of one task.
    ``lasts`` keeps the latest non-null value. ``before_only`` leaves out the
    current row. With ``once`` the rows are computed and dealt by key and block once,
    and a null block holds all rows of its key, which need no carry; the block comes out as
    ``block``, so that what follows knows how the rows lie. Without, both the blocks'
    totals and the rows compute ``df``, so a dear one should be settled.
    """
    sums, maxima, lasts = sums or {}, maxima or {}, lasts or {}
    src = df.withColumn("__block", block)
    for name, c in {**sums, **maxima, **lasts}.items():
        src = src.withColumn(f"__v_{name}", c)
    if once:
        src = exchanged(src, *keys, "__block")
    at = F.struct(*[F.col(o) for o in order])
    totals = (src.where(F.col("__block").isNotNull()) if once else src).groupBy(*keys, "__block").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxima],
        *[
            F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__t_{n}")
            for n in lasts
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "__block",
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in maxima],
        *[F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in lasts],
    )
    upto = -1 if before_only else 0
    inside = (
        Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    )
    local = src
    for n in sums:
        local = local.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(inside))
    for n in maxima:
        local = local.withColumn(f"__l_{n}", F.max(f"__v_{n}").over(inside))
    for n in lasts:
        local = local.withColumn(f"__l_{n}", F.last(f"__v_{n}", ignorenulls=True).over(inside))
    joined = local.join(carry, [*keys, "__block"], "left")
    out = [F.col(f"`{c}`") for c in df.columns]
    if once:
        out.append(F.col("__block").alias("block"))
    for n in sums:
        out.append(
            (F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__l_{n}", F.lit(0))).alias(n)
        )
    for n in maxima:
        out.append(F.greatest(f"__c_{n}", f"__l_{n}").alias(n))
    for n in lasts:
        out.append(F.coalesce(f"__l_{n}", f"__c_{n}").alias(n))
    return joined.select(*out)


def ranged_blocks(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a block number that never decreases in (``keys``, ``order``), stored in the shared folder.

    Blocks are ranges of the whole sort key of about equal size, so neither a hot key
    nor a burst at one moment fills one block; ``order`` should tell rows of a key apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id())
    return settled(ranged)


_SUPER = 4096


def dense_numbers(df: DataFrame, order: list[str], block: Column, name: str = "n") -> DataFrame:
    """Dense 1-based numbering in ``order`` without one global window.

    ``block`` is a whole number that never decreases in ``order``. Rows are
    numbered inside their block, blocks are summed inside groups of ``_SUPER`` block
    numbers, and only the groups' sums meet in one place.
    """
    src = df.withColumn("__block", block.cast("bigint"))
    counts = src.groupBy("__block").agg(F.count(F.lit(1)).alias("__n")).withColumn("__super", F.floor(F.col("__block") / _SUPER))
    earlier = Window.partitionBy("__super").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(1)).orderBy("__super").rowsBetween(Window.unboundedPreceding, -1)
    supers = counts.groupBy("__super").agg(F.sum("__n").alias("__n")).select("__super", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__far"))
    offsets = counts.withColumn("__near", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(supers, "__super").select(
        "__block", (F.col("__near") + F.col("__far")).alias("__offset")
    )
    inside = Window.partitionBy("__block").orderBy(*order)
    numbered = src.withColumn("__row", F.row_number().over(inside)).join(offsets, "__block")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__offset") + F.col("__row")).cast("bigint").alias(name))


def exact_ranks(
    df: DataFrame,
    groups: list[str],
    value: str,
    wanted: dict[str, tuple[str, float]],
    buckets: int = 128,
) -> DataFrame:
    """Exact order statistics per group: ``{name: (rule, fraction)}``.

    Rules: ``inclusive`` (linear interpolation between neighbours), ``nearest``
    (rank ceil(p*n)), ``floor`` (rank max(1, floor(p*n))) and ``upper_median``
    (rank floor(n/2)+1). Values are counted first and cut into buckets at
    approximate quantiles of the distinct values, so that an outlier does not crowd
    the others together; then only the buckets that hold a wanted rank are ordered,
    and no group is sorted whole.
    """
    keyed = df.where(F.col(value).isNotNull())
    if not groups:
        keyed = keyed.withColumn("__all", F.lit(1))
    keys = groups or ["__all"]
    counts = keyed.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    span = counts.groupBy(*keys).agg(
        F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__edges"), F.sum("__n").alias("__total")
    )
    bucket = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    binned = counts.join(span, keys).select(*keys, "__v", "__n", bucket.alias("__b"))
    w = Window.partitionBy(*keys).orderBy("__b")
    bins = (
        binned.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .withColumn("__upto", F.sum("__bn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__before", F.col("__upto") - F.col("__bn"))
    )
    total = F.col("__total")
    ranks = []
    for name, (rule, p) in wanted.items():
        if rule == "inclusive":
            at = (total - 1) * F.lit(p)
            ranks.append((name, "lo", F.floor(at) + 1, F.lit(1.0) - (at - F.floor(at))))
            ranks.append((name, "hi", F.ceil(at) + 1, at - F.floor(at)))
        elif rule == "nearest":
            r = F.greatest(F.lit(1), F.floor(total * F.lit(p) + 0.999999))
            ranks.append((name, "lo", r, F.lit(1.0)))
        elif rule == "floor":
            ranks.append((name, "lo", F.greatest(F.lit(1), F.floor(total * F.lit(p))), F.lit(1.0)))
        elif rule == "upper_median":
            ranks.append((name, "lo", F.floor(total / 2) + 1, F.lit(1.0)))
        else:
            raise ValueError(f"unknown rank rule: {rule}")
    specs = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(side).alias("side"),
                r.cast("bigint").alias("rank"),
                wt.cast("double").alias("weight"),
            )
            for n, side, r, wt in ranks
        ]
    )
    targets = span.select(*keys, F.explode(specs).alias("s")).select(*keys, "s.*")
    placed = (
        targets.join(bins, keys)
        .where((F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__upto")))
        .select(*keys, "__b", "name", "side", "rank", "weight", "__before")
    )
    inside = (
        Window.partitionBy(*keys, "__b", "name", "side")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = (
        placed.join(binned, [*keys, "__b"])
        .withColumn("__cum", F.col("__before") + F.sum("__n").over(inside))
        .where((F.col("rank") <= F.col("__cum")) & (F.col("rank") > F.col("__cum") - F.col("__n")))
    )
    out = hits.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("name") == n, F.col("__v") * F.col("weight"))).alias(n) for n in wanted]
    )
    return out if groups else out.drop("__all")


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[Any], Any],
    step: Callable[[Any, Any], tuple[Any, dict[str, Any]]],
    schema: str,
) -> DataFrame:
    """Fold each key's rows in order, one output row per input row.

    Rows are hash-partitioned by key and sorted inside the partition, then
    streamed in Arrow batches with the state of the current key carried along: a
    large key is never held in memory. Use it only where a step truly needs the
    result of the one before, and filter rows that cannot change the state first.
    """
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.strip().split(" ")[0] for f in _split_schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start(row)
                state, emitted = step(state, row)
                out.append(emitted)
            yield pd.DataFrame(out, columns=names)

    return sorted_rows.mapInPandas(run, schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]
