"""Mergeable quantile sketches: the approximate option beside ``scale.exact_ranks``.

A sketch of a run is a few kilobytes whatever the run's size; sketches of runs are
stored and merged over any set of runs without reading their rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import broadcast_if_small

#: Size parameter of a sketch, 8 to 65535; the error falls almost in proportion.
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error that an estimate keeps with 99 per cent probability (the published fit for KLL sketches)."""
    return 2.296 / k**0.9021


def sketch_runs(rows: DataFrame, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``by``, n, sketch: one sketch per group, built map-side; nulls are left out. No rows, no sketches."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_runs(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, runs, sketch: sketches of several runs as one."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, fractions: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """The sketches' groups with an estimate per fraction and ``rank_error``, in place of the sketch."""

    def at(p: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(p))

    return sketches.select("*", *[at(p).alias(name) for name, p in fractions.items()], F.lit(rank_error(k)).alias("rank_error")).drop("sketch")


def within(rows: DataFrame, by: list[str], value: str, estimates: DataFrame, fractions: dict[str, float], slack: float = 1.0) -> DataFrame:
    """``by`` and, per fraction, whether its estimate's exact rank lies within ``slack`` times the stated error."""
    low = {n: F.sum((F.col(value) < F.col(n)).cast("bigint")) / F.count(value) for n in fractions}
    high = {n: F.sum((F.col(value) <= F.col(n)).cast("bigint")) / F.count(value) for n in fractions}
    room = slack * F.first("rank_error")
    joined = rows.join(broadcast_if_small(estimates.select(*by, *fractions, "rank_error")), by)
    return joined.groupBy(*by).agg(*[((low[n] <= p + room) & (high[n] >= p - room)).alias(n) for n, p in fractions.items()])
