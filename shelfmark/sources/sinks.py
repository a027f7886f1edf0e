"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import retrieval as R
from shelfmark.operators.corpus import latest_wins


def write_corpus(chunks: DataFrame, parents: DataFrame, vectors: DataFrame, path: str) -> None:
    """Persist a retrieval corpus as keyed Parquet; every chunk must have exactly one vector."""
    # one shuffled join finds both kinds of orphans; only two counts reach the driver
    paired = chunks.select("chunk_id", F.lit(1).alias("c")).join(
        vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "full"
    )
    bad = paired.agg(F.count_if(F.col("c").isNull() | F.col("v").isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} chunks and vectors do not line up")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    parents.write.mode("overwrite").parquet(f"{path}/parents")
    vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
    R.postings(chunks).write.mode("overwrite").parquet(f"{path}/postings")
    R.term_table(chunks).write.mode("overwrite").parquet(f"{path}/terms")
    R.corpus_stats(chunks).write.mode("overwrite").parquet(f"{path}/doc_stats")


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str = "trajectory_id", version: str = "version") -> DataFrame:
    """Union of both, the highest version of each key."""
    return latest_wins(existing.unionByName(incoming), [key], [version])


def merge_trajectories(spark: SparkSession, path: str, incoming: DataFrame, next_path: str) -> None:
    """Write the merged store to ``next_path``; the current one stays readable meanwhile."""
    upsert_latest(spark.read.parquet(path), incoming).write.mode("overwrite").parquet(next_path)


def trajectory(store: DataFrame, trajectory_id: str) -> DataFrame:
    return store.where(F.col("trajectory_id") == trajectory_id)


def orders_snapshot(orders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Orders named in ``wanted(order_id)``, by id."""
    return orders.join(wanted.select("order_id").distinct(), "order_id", "left_semi").orderBy("order_id")


def write_splits(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("split").json(path)


def write_audit(audits: DataFrame, summary: DataFrame, path: str) -> None:
    audits.write.mode("overwrite").json(f"{path}/audit")
    summary.write.mode("overwrite").json(f"{path}/summary")


REVIEW_COLUMNS = [
    "trajectory_id", "task_id", "split", "seed", "user_request", "tool_calls_json", "guardrails_json",
    "final_answer", "terminal_state_match", "state_diff_json", "grader_success", "grader_policy_compliant",
    "grader_reward", "failure_type", "human_success", "human_policy_compliant", "review_notes",
]


def review_sheet(rows: DataFrame) -> DataFrame:
    """The reviewer's 17 columns; what is missing, and every human column, is blank."""
    have = set(rows.columns)
    return rows.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
            for c in REVIEW_COLUMNS
        ]
    )


def write_review_sheet(rows: DataFrame, path: str) -> None:
    review_sheet(rows).write.mode("overwrite").option("header", True).csv(path)


def bad_timing(*timings: Column) -> Column:
    bad = F.lit(False)
    for t in timings:
        bad = bad | F.isnan(t) | (F.abs(t) == float("inf")) | (t < 0)
    return F.coalesce(bad, F.lit(False))


def split_step_rows(rows: DataFrame, run_id: str, timings: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)`` step rows with the reason of the latter."""
    reason = F.when(~F.col("run_id").eqNullSafe(F.lit(run_id)), "run_id_mismatch").when(
        bad_timing(*[F.col(t) for t in timings]), "bad_timing"
    )
    checked = rows.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def append_step_rows(rows: DataFrame, run_id: str, timings: list[str], path: str) -> None:
    good, bad = split_step_rows(rows, run_id, timings)
    good.write.mode("append").json(f"{path}/steps")
    bad.write.mode("append").json(f"{path}/quarantine")
