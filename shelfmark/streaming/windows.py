"""Windowed call metrics and sessions; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def call_metrics(calls: DataFrame, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Calls, error rate and latency per window and tool; late rows beyond the watermark are dropped."""
    src = calls.withWatermark("started_at", watermark) if watermark else calls
    win = F.window("started_at", size, slide) if slide else F.window("started_at", size)
    return src.groupBy(win.alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg((~F.col("ok")).cast("int")).alias("error_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.percentile_approx("latency_ms", [0.5, 0.95]).alias("latency_quantiles"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "error_rate", "mean_latency_ms", "latency_quantiles")


def sessions(calls: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Sessions of a key separated by ``gap``: turns, tools used and whether the last call succeeded."""
    src = calls.withWatermark("started_at", watermark) if watermark else calls
    return src.groupBy(F.session_window("started_at", gap).alias("s"), key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.max_by("ok", F.struct("started_at", "seq")).alias("last_ok"),
    ).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "turns", "tools", "last_ok")


class DroppedRows:
    """Rows that the watermark dropped, by batch, as the query's own progress reports tell.

    Spark keeps the last hundred reports (``spark.sql.streaming.numRecentProgressUpdates``):
    call ``read`` more often than that. Rows are counted where they reach the state, so
    late rows of one window and key that arrive together in a task count once.
    """

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}

    def read(self, query: StreamingQuery) -> int:
        """Take in the reports of ``query`` (running or ended); returns all rows dropped so far."""
        for report in query.recentProgress:
            dropped = sum(op["numRowsDroppedByWatermark"] for op in report["stateOperators"])
            self.by_batch[str(report["runId"]), report["batchId"]] = dropped
        return sum(self.by_batch.values())
