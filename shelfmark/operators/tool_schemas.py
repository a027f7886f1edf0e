"""Argument validation of a call log against the tool contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv


def parameter_table(spark: SparkSession) -> DataFrame:
    """One row per (tool, parameter): about a hundred rows, fixed."""
    rows = []
    for tool, spec in fv.TOOL_PARAMETERS.items():
        for required in (True, False):
            for name, kind in spec.get("required" if required else "optional", {}).items():
                pattern = fv.PARAMETER_PATTERNS.get(name) if tool in fv.PATTERN_TOOLS.get(name, []) else None
                rows.append((tool, len(rows), name, kind, required, pattern, fv.PARAMETER_ENUMS.get((tool, name))))
    return spark.createDataFrame(
        rows, "tool string, declared int, param string, type string, required boolean, pattern string, choices array<string>"
    )


def _variant_kind(schema: Column) -> Column:
    """JSON kind of a value from its variant schema name."""
    return (
        F.when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "BIGINT", "integer")
        .when(schema.startswith("DECIMAL") | (schema == "DOUBLE"), "number")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def _type_ok(kind: Column, spec: Column) -> Column:
    base = F.regexp_replace(spec, r"\|null$|<string>$", "")
    return (
        (kind == base)
        | ((base == "number") & (kind == "integer"))
        | ((kind == "null") & spec.endswith("|null"))
    )


def validate_calls(calls: DataFrame) -> DataFrame:
    """``calls(call_id, tool, arguments)`` with JSON arguments: first error per call, null when valid.

    Errors rank: unknown tool, not an object, missing, unknown argument, then per
    argument in the order given: type, pattern, enumeration, array items.
    """
    spark = calls.sparkSession
    params = parameter_table(spark)
    contract = params.groupBy("tool").agg(
        F.array_sort(F.collect_list("param")).alias("known"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("declared", "param")))), lambda p: p["param"]
        ).alias("needed"),
    )
    v = F.try_parse_json("arguments")
    keys = F.json_object_keys("arguments")
    parsed = calls.withColumn("v", v).withColumn("keys", keys)
    c = parsed.join(F.broadcast(contract), "tool", "left")  # fixed table, one row per tool
    missing = F.array_except("needed", "keys")
    unknown = F.array_except("keys", "known")
    head = (
        F.when(F.col("known").isNull(), F.concat(F.lit("unknown tool: "), "tool"))
        .when(F.col("keys").isNull(), F.lit("arguments must be an object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
    )
    c = c.withColumn("head_error", head)
    deep = c.where(F.col("head_error").isNull()).select("call_id", "tool", "arguments", F.posexplode("keys").alias("pos", "param"))
    fields = F.from_json("arguments", "map<string,variant>")
    value = F.try_element_at(fields, F.col("param"))
    text = F.try_variant_get(value, "$", "string")
    kind = _variant_kind(F.schema_of_variant(value))
    # item kinds come from the array itself; mixed arrays have no common string type
    items_ok = F.coalesce(F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) | (
        F.size(F.try_variant_get(value, "$", "array<variant>")) == 0
    )
    d = deep.join(F.broadcast(params), ["tool", "param"])  # fixed table
    where = F.concat("tool", F.lit("."), "param")
    issue = (
        F.when(~_type_ok(kind, F.col("type")), F.concat(where, F.lit(": expected "), "type"))
        .when(
            F.col("pattern").isNotNull() & ~F.coalesce(F.rlike(text, F.concat(F.lit("^"), "pattern", F.lit("$"))), F.lit(False)),
            F.concat(where, F.lit(": does not match "), "pattern"),
        )
        .when(F.col("choices").isNotNull() & ~F.array_contains("choices", text), F.concat(where, F.lit(": not one of "), F.array_join("choices", ", ")))
        .when((F.col("type") == "array<string>") & ~items_ok, F.concat(where, F.lit(": items must be string")))
    )
    first = (
        d.withColumn("issue", issue)
        .where(F.col("issue").isNotNull())
        .groupBy("call_id")
        .agg(F.min_by("issue", "pos").alias("issue"))
    )
    return c.join(first, "call_id", "left").select("call_id", "tool", F.coalesce("head_error", "issue").alias("error"))
