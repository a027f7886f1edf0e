"""Leak-free training splits from compliant trajectories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.canon import canonical_hash
from shelfmark.functions.scale import broadcast_if_small, settled
from shelfmark.operators.components import connected_components
from shelfmark.operators.retrieval import top_per

WRITES = fv.RETAIL_WRITE_TOOLS
HANDOFF = "transfer_to_human_agents"


def tool_path(messages: Column | str) -> Column:
    """Names of all assistant tool calls, in order; the conversation is one row, so nothing is gathered."""
    m = F.col(messages) if isinstance(messages, str) else messages
    calls = F.flatten(
        F.transform(
            F.filter(m, lambda x: x["role"] == "assistant"),
            lambda x: F.transform(
                F.coalesce(x["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>")),
                lambda c: F.coalesce(c["name"], F.lit("")),
            ),
        )
    )
    return F.filter(calls, lambda n: n != "")


def behavior_family(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    writes = F.filter(p, lambda n: n.isin(WRITES))
    return F.coalesce(
        F.try_element_at(writes, F.lit(-1)), F.when(F.array_contains(p, HANDOFF), "handoff").otherwise("read_or_clarify")
    )


def structure_signature(path: Column | str) -> Column:
    """SHA-256 of the canonical JSON of what a path does, free of entities."""
    p = F.col(path) if isinstance(path, str) else path
    return canonical_hash(
        behavior_family=behavior_family(p),
        tool_path=p,
        has_write=F.exists(p, lambda n: n.isin(WRITES)),
        has_handoff=F.array_contains(p, HANDOFF),
        tool_count=F.size(p),
    )


def structure_splits(signatures: DataFrame) -> DataFrame:
    """Whole structures to splits: the first tenth by salted hash is dev, the next held out.

    Hashes are even, so structures are counted by their leading 16 bits and only
    those whose leading bits hold a cut-off are ordered.
    """
    u = signatures.select("signature_hash").distinct().withColumn("h", F.sha2(F.concat(F.lit("split-v1:"), "signature_hash"), 256))
    u = u.withColumn("lead", F.substring("h", 1, 4))
    leads = sorted((r["lead"], r["n"]) for r in u.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,536 rows
    n = sum(c for _, c in leads)
    e = _eval_count(n)
    if n < 3 or e == 0:
        return u.select("signature_hash", F.lit("train").alias("split"))

    def cut(rank: int) -> str:
        before = 0
        for lead, count in leads:
            if before + count >= rank:
                return u.where(F.col("lead") == lead).orderBy("h").limit(rank - before).agg(F.max("h")).first()[0]
            before += count
        raise ValueError(rank)

    dev_cut, held_cut = cut(e), cut(2 * e)
    split = F.when(F.col("h") <= dev_cut, "dev").when(F.col("h") <= held_cut, "held_out").otherwise("train")
    return u.select("signature_hash", split.alias("split"))


def _eval_count(n: int) -> int:
    if n < 3:
        return 0
    e = max(1, round(n * 0.1))
    while 2 * e >= n:
        e -= 1
    return e


def isolated_splits(records: DataFrame) -> DataFrame:
    """Splits that share neither task nor structure: whole components of the task–structure graph.

    ``records(simulation_id, task_id, signature_hash)``. The component whose size is
    nearest a tenth is dev, the next nearest held out; ties go by the SHA-256 of the
    canonical JSON list of a component's sorted simulation ids. Only components that
    tie for one of the two places have their ids listed, in one cell each.
    """
    edges = records.select(
        F.concat(F.lit("task:"), "task_id").alias("a"), F.concat(F.lit("structure:"), "signature_hash").alias("b")
    ).distinct()
    comp = connected_components(edges)
    placed = settled(records.join(
        comp.select(F.col("node").alias("node"), "component"), F.concat(F.lit("task:"), "task_id") == F.col("node")
    ).drop("node"))
    sizes = settled(placed.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("records")).first()
    if total["n"] < 3:
        return placed.select("simulation_id", "component", F.lit("train").alias("split"))
    target = max(1, round(total["records"] * 0.1))
    away = sizes.withColumn("away", F.abs(F.col("size") - target))
    # the two smallest distances, counted with their ties, hold both places
    near = [r["away"] for r in away.orderBy("away").select("away").limit(2).collect()]
    tied = away.where(F.col("away").isin(near))
    ids = placed.join(broadcast_if_small(tied), "component").groupBy("component", "away").agg(F.array_sort(F.collect_list("simulation_id")).alias("ids"))
    chosen = ids.orderBy("away", F.sha2(F.to_json("ids"), 256), "component").select("component").limit(2).collect()
    split = F.when(F.col("component") == chosen[0]["component"], "dev").when(
        F.col("component") == chosen[1]["component"], "held_out"
    ).otherwise("train")
    return placed.select("simulation_id", "component", split.alias("split"))


def override_splits(splits: DataFrame, preassigned: DataFrame) -> DataFrame:
    """Task splits fixed beforehand win."""
    return splits.join(preassigned.select("task_id", F.col("split").alias("fixed")), "task_id", "left").withColumn(
        "split", F.coalesce("fixed", "split")
    ).drop("fixed")


# --- messages -----------------------------------------------------------------------
def conversion_reason(messages: Column | str) -> Column:
    """First reason a conversation cannot be converted, null when it can."""
    m = F.col(messages) if isinstance(messages, str) else messages

    def bad(x: Column) -> Column:
        content = F.coalesce(x["content"], F.lit("")) != ""
        n = F.coalesce(F.size(x["tool_calls"]), F.lit(0)) > 0
        args = F.transform(
            F.coalesce(x["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>")),
            lambda c: F.coalesce(F.nullif(c["arguments"], F.lit("")), F.lit("{}")),
        )
        first_bad = F.try_element_at(
            F.filter(
                F.transform(
                    args,
                    lambda a: F.when(F.try_parse_json(a).isNull(), "tool_arguments_json").when(
                        F.json_object_keys(a).isNull(), "tool_arguments_not_object"
                    ),
                ),
                lambda r: r.isNotNull(),
            ),
            F.lit(1),
        )
        return (
            F.when((x["role"] == "user") & n, "user_requestor_tool_call")
            .when((x["role"] == "assistant") & content & n, "assistant_content_and_tool_call")
            .when((x["role"] == "assistant") & ~content & ~n, "empty_assistant_message")
            .when(x["role"] == "assistant", first_bad)
            .when((x["role"] == "tool") & F.coalesce(x["error"], F.lit(False)), "tool_error_in_trajectory")
            .when(~F.coalesce(x["role"], F.lit("")).isin("user", "assistant", "tool", "system"), F.concat(F.lit("unknown_role:"), F.coalesce(x["role"], F.lit("None"))))
        )

    return F.try_element_at(F.filter(F.transform(m, bad), lambda r: r.isNotNull()), F.lit(1))


def converted_messages(messages: Column | str) -> Column:
    """Training messages: user, assistant, tool_call and tool_response, system turns dropped."""
    m = F.col(messages) if isinstance(messages, str) else messages

    def one(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    none = F.array().cast("array<struct<role:string,content:string>>")

    def convert(x: Column) -> Column:
        content = F.coalesce(x["content"], F.lit(""))
        calls = F.transform(
            F.coalesce(x["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>")),
            lambda c: one(
                "tool_call",
                F.concat(
                    F.lit('{"name":"'), c["name"], F.lit('","arguments":'),
                    F.to_json(F.try_parse_json(F.coalesce(F.nullif(c["arguments"], F.lit("")), F.lit("{}")))), F.lit("}"),
                ),
            ),
        )
        plain = F.coalesce(F.to_json(F.try_parse_json(content)), F.to_json(F.array(content)).substr(F.lit(2), F.length(F.to_json(F.array(content))) - 2))
        return (
            F.when(x["role"] == "user", F.array(one("user", content)))
            .when(x["role"] == "assistant", F.concat(F.when(content != "", F.array(one("assistant", content))).otherwise(none), calls))
            .when(x["role"] == "tool", F.array(one("tool_response", plain)))
            .otherwise(none)
        )

    return F.flatten(F.transform(m, convert))


# --- acceptance -------------------------------------------------------------------------
def source_gate(source_split: str, usage_rights: str, teacher: str) -> None:
    if source_split != "train":
        raise ValueError("records must come from the train split")
    if usage_rights not in fv.APPROVED_USAGE_RIGHTS:
        raise ValueError("teacher usage rights are not approved")
    if not teacher.strip():
        raise ValueError("a teacher name is required")


def rejection_reasons(
    sims: DataFrame, order: str, allowed: DataFrame | None = None, reserved: DataFrame | None = None, require_audit: bool = True
) -> DataFrame:
    """Every simulation with the first reason to reject it, null when accepted.

    ``sims(simulation_id, task_id, reward, db_match, termination_reason, compliant,
    conversion_reason, n_tool_calls, <order>)``. A repeated id is rejected wherever
    it is not the first, even when the first is rejected itself; a null or blank id
    is rejected and takes no part in the search for first ones.
    """
    named = F.nullif("simulation_id", F.lit(""))
    first = sims.where(named.isNotNull()).groupBy("simulation_id").agg(F.min(order).alias("__first"))
    blank = sims.where(named.isNull()).withColumn("__first", F.lit(None).cast(sims.schema[order].dataType))
    s = sims.where(named.isNotNull()).join(first, "simulation_id").unionByName(blank)
    known = F.lit(True)
    if allowed is not None:
        s = s.join(allowed.select("task_id").distinct().withColumn("__allowed", F.lit(True)), "task_id", "left")
        known = F.coalesce("__allowed", F.lit(False))
    held = F.lit(False)
    if reserved is not None:
        s = s.join(reserved.select("task_id").distinct().withColumn("__reserved", F.lit(True)), "task_id", "left")
        held = F.coalesce("__reserved", F.lit(False))
    reason = (
        F.when((F.coalesce("simulation_id", F.lit("")) == "") | (F.col(order) != F.col("__first")), "missing_or_duplicate_simulation_id")
        .when(~known, "task_not_in_frozen_train_split")
        .when(held, "reserved_task")
        .when(F.coalesce("reward", F.lit(0.0)) != 1.0, "official_reward_not_1")
        .when(~F.coalesce("db_match", F.lit(True)), "db_mismatch")
        .when(
            ~F.coalesce(F.col("termination_reason").isin(fv.ACCEPTED_TERMINATIONS), F.lit(False)),
            F.concat(F.lit("termination:"), F.coalesce("termination_reason", F.lit("None"))),
        )
        .when(F.lit(require_audit) & F.col("compliant").isNull(), "missing_process_audit")
        .when(~F.coalesce("compliant", F.lit(True)), "process_noncompliant")
        .when(F.col("conversion_reason").isNotNull(), F.col("conversion_reason"))
        .when(F.col("n_tool_calls") == 0, "no_tool_calls")
    )
    return s.withColumn("reason", reason).drop("__first", "__allowed", "__reserved")


def rejection_histogram(judged: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Counts per reason, plus ``violation:*`` rows of the non-compliant ones."""
    rows = judged.where(F.col("reason").isNotNull()).select("reason")
    if violations is not None:
        bad = judged.where(F.col("reason") == "process_noncompliant").select("simulation_id")
        rows = rows.unionByName(
            violations.join(bad, "simulation_id", "left_semi").select(F.concat(F.lit("violation:"), "violation").alias("reason"))
        )
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def double_cap_nested(accepted: DataFrame, order: str, per_task: int = 3, per_structure: int = 8) -> DataFrame:
    """Both caps where each task has one structure: two constant limits that prune before the shuffle."""
    first = top_per(accepted, "task_id", [F.asc(order)], per_task, rank="__t")
    return top_per(first, "signature_hash", [F.asc(order)], per_structure, rank="__s").drop("__t", "__s")


def double_cap(accepted: DataFrame, order: str, per_task: int = 3, per_structure: int = 8, rounds: int | None = None) -> DataFrame:
    """Both caps in (``order``, simulation_id) when tasks and structures cross; as if rows were taken one by one.

    Greedy matching in parallel rounds. An open row whose place among the open rows of
    its task and of its structure is within what both still admit is accepted, whatever
    becomes of the rows before it; where a task or structure is full, its open rows are
    refused (rows before an accepted one always keep a place, so these all come later).
    The first open row of all is settled in every round, most rounds settle far more. A
    round takes constant limits per key, which prune before the shuffle, so neither a
    component nor a hot key is one task. Of one (task, structure) pair only the first
    ``per_task`` can ever be accepted. ``rounds`` is a guard for tests; there is no limit.
    """
    by = [F.asc(order), F.asc("simulation_id")]
    pair = F.struct("task_id", "signature_hash")
    live = top_per(accepted.withColumn("__pair", pair), "__pair", by, min(per_task, per_structure), rank="__p")
    caps = {"task_id": per_task, "signature_hash": per_structure}
    open_ = settled(live.select("simulation_id", "task_id", "signature_hash", order, *[F.lit(n).alias(f"__cap_{k}") for k, n in caps.items()]))
    kept, turn = [], 0
    while not open_.isEmpty():
        if rounds is not None and turn >= rounds:
            raise RuntimeError("double cap did not settle in the rounds allowed")
        turn += 1
        admitted = {k: top_per(open_, k, by, n, rank="__r").where(F.col("__r") <= F.col(f"__cap_{k}")) for k, n in caps.items()}
        taken = admitted["task_id"].join(admitted["signature_hash"].select("simulation_id"), "simulation_id", "left_semi")
        taken = settled(taken.select("simulation_id", "task_id", "signature_hash"))
        kept.append(taken.select("simulation_id"))
        rest = open_.join(broadcast_if_small(taken.select("simulation_id")), "simulation_id", "left_anti")
        for k in caps:
            used = taken.groupBy(k).agg(F.count(F.lit(1)).alias("__used"))
            rest = rest.join(broadcast_if_small(used), k, "left").withColumn(f"__cap_{k}", F.col(f"__cap_{k}") - F.coalesce("__used", F.lit(0)).cast("int")).drop("__used").where(F.col(f"__cap_{k}") > 0)
        open_ = settled(rest)
    if not kept:
        return accepted.where(F.lit(False))
    return accepted.join(reduce(DataFrame.unionByName, kept), "simulation_id", "left_semi")


def provenance(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def leaks(records: DataFrame) -> DataFrame:
    """Tasks and structures found in more than one split; must be empty."""
    keys = records.select(
        "split",
        F.explode(
            F.array(F.concat(F.lit("task:"), "task_id"), F.concat(F.lit("structure:"), "signature_hash"))
        ).alias("key"),
    )
    return keys.groupBy("key").agg(F.count_distinct("split").alias("splits")).where(F.col("splits") > 1)


def manifest(records: DataFrame) -> DataFrame:
    """Records, tasks and structures per split, and in all."""
    return records.rollup("split").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("task_id").alias("tasks"),
        F.count_distinct("signature_hash").alias("structures"),
    )


def config_hash(config: dict[str, Any], prompt: str, tools: list[Any]) -> str:
    import hashlib
    import json

    text = json.dumps(
        {"config": config, "system_prompt": prompt, "tools": tools}, ensure_ascii=False, sort_keys=True, separators=(",", ":")
    )
    return hashlib.sha256(text.encode()).hexdigest()


def record_problem(split: str | Column) -> Column:
    """First problem of a finished record, null when valid.

    Columns: ``messages[]``, ``tools`` (JSON), ``provenance`` struct.
    """
    m, p = F.col("messages"), F.col("provenance")
    roles = F.transform(m, lambda x: x["role"])
    want = F.lit(split) if isinstance(split, str) else split
    return (
        F.when((F.coalesce(F.size(m), F.lit(0)) == 0) | (F.try_element_at(roles, F.lit(1)) != "system"), "system_not_first")
        .when(F.size(F.array_except(roles, F.array(*[F.lit(r) for r in fv.RECORD_ROLES]))) > 0, "invalid_roles")
        .when(~(F.array_contains(roles, "tool_call") & F.array_contains(roles, "tool_response")), "no_tool_interaction")
        .when(F.coalesce(F.json_array_length("tools"), F.lit(0)) == 0, "no_tools")
        .when(~p["split"].eqNullSafe(want), "split_mismatch")
        .when(F.coalesce(p["official_reward"], F.lit(0.0)) != 1.0, "reward_not_1")
        .when(F.coalesce(p["process_audit_version"], F.lit("")) == "", "audit_missing")
        .when(F.coalesce(p["signature_hash"], F.lit("")) == "", "signature_missing")
    )


def size_problems(counts: DataFrame, low: int = 400, high: int = 1200) -> DataFrame:
    """``counts(split, n)``: splits outside the bounds."""
    ok = F.when(F.col("split") == "train", F.col("n").between(low, high)).otherwise(F.col("n") > 0)
    return counts.where(~ok)


def loss_mask(segments: Column | str) -> Column:
    """1 for tokens of assistant segments, 0 elsewhere."""
    s = F.col(segments) if isinstance(segments, str) else segments
    return F.flatten(
        F.transform(s, lambda x: F.array_repeat((x["role"] == "assistant").cast("int"), F.size(x["token_ids"])))
    )


