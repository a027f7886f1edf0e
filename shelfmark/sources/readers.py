"""Readers. All schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.corpus import first_n_per
from shelfmark.sources import schemas as S


def _jsonl(spark: SparkSession, path: str | list[str], schema: str, *required: str) -> DataFrame:
    """JSON lines that must all decode and hold the ``required`` fields; only blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_lines(lines, schema, *required)


def parse_lines(lines: DataFrame, schema: str, *required: str) -> DataFrame:
    """Rows of JSON texts in ``value``; evaluation fails on one that cannot be decoded or lacks a ``required`` field."""
    shown = F.substring("value", 1, 200)
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    parsed = lines.select(row.alias("r"), shown.alias("shown"))
    lacking = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    for field in required:
        lacking |= F.coalesce(F.col(f"r.{field}").cast("string"), F.lit("")) == ""
    sound = F.when(lacking, F.raise_error(F.concat(F.lit("not a usable record: "), F.col("shown")))).otherwise(F.col("r"))
    return parsed.select(sound.alias("r")).select("r.*").drop("_corrupt_record")


def read_products(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Product JSONL; ``attributes`` stays JSON text so that its key order survives."""
    return _jsonl(spark, path, S.PRODUCT, "id")


def read_policies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _jsonl(spark, path, S.POLICY, "id")


def read_raw(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Raw JSONL, plain or gzipped; undecodable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_malformed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row: lines read and lines that could not be decoded."""
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = F.try_parse_json("value")
    return text.agg(F.count(F.lit(1)).alias("lines"), F.count_if(parsed.isNull()).alias("malformed"))


def bounded_scan(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group in arrival order."""
    return first_n_per(df, group, [F.asc(o) for o in order], n)


def read_store_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """Users, orders or hand-offs with the fixed schema; added columns are merged."""
    reader = spark.read.option("mergeSchema", "true") if format == "parquet" else spark.read
    return reader.schema(schema).format(format).load(path)


def read_simulations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Results documents expanded to one row per simulation, in document order."""
    doc = spark.read.schema(S.RESULTS).option("multiLine", "true").json(path)
    return doc.select(F.posexplode("simulations").alias("ord", "s")).select("ord", "s.*")


def read_audits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Process audits; a missing or repeated ``simulation_id`` fails the read."""
    rows = _jsonl(spark, path, S.AUDIT, "simulation_id")
    return require_unique(
        rows.select(
            "simulation_id",
            F.coalesce("process_compliant", F.lit(False)).alias("process_compliant"),
            F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
            F.coalesce("reviewer", F.lit("")).alias("reviewer"),
            F.coalesce("audit_version", F.lit("process-audit-v1")).alias("audit_version"),
        ),
        "simulation_id",
    )


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df``; evaluation fails on a blank or repeated key."""
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(*rest), F.lit(0)).alias("__r")
    )
    checked = (
        F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.lit(f"missing {key}")))
        .when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key))))
        .otherwise(F.col(key))
    )
    return grouped.select(checked.alias(key), *[F.col(f"__r.{c}").alias(c) for c in rest])


def read_tasks(spark: SparkSession, path: str | list[str], split: str | None = None) -> DataFrame:
    tasks = _jsonl(spark, path, S.TASK, "task_id")
    return tasks if split is None else tasks.where(F.col("split") == split)


def read_trajectories(spark: SparkSession, path: str, trajectory_schema: str, grade_schema: str) -> DataFrame:
    """Stored trajectories with their JSON columns parsed."""
    rows = spark.read.schema(S.TRAJECTORY_STORE).parquet(path)
    return rows.select(
        "trajectory_id",
        "task_id",
        "seed",
        F.from_json("trajectory_json", trajectory_schema).alias("trajectory"),
        F.from_json("grade_json", grade_schema).alias("grade"),
    )


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
