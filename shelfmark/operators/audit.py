"""Process audit of recorded tool trajectories, by joins and running windows.

Results pair with calls first-in first-out. With ``C`` calls and ``R`` results so
far, the number of results that found nothing pending is the running maximum of
``R - C`` (at least zero), so the call a result belongs to is ``R`` minus that
number: no queue is replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import running, settled

ORDER_READ, USER_READ, HANDOFF = "get_order_details", "get_user_details", "transfer_to_human_agents"


def call_name(call: Column) -> Column:
    """Name of a call given as ``function{name, arguments}`` or flat."""
    return F.coalesce(call["function"]["name"], call["name"], F.lit(""))


def call_arguments(call: Column) -> Column:
    """Arguments as a JSON object text; anything else is an empty object."""
    raw = F.coalesce(call["function"]["arguments"], call["arguments"], F.lit("{}"))
    return F.when(F.json_object_keys(raw).isNotNull(), raw).otherwise("{}")


def contracts(tasks: DataFrame) -> DataFrame:
    """``tasks(task_id, provenance, criteria)`` with structs; tasks without actions and termination have none."""
    p, c = F.col("provenance"), F.col("criteria")
    termination = F.coalesce(F.nullif(p["expected_termination"], F.lit("")), c["expected_termination"], F.lit(""))
    confirmation = F.coalesce(F.nullif(p["confirmation_requirement"], F.lit("")), c["confirmation_requirement"], F.lit(""))
    return tasks.select(
        "task_id",
        F.coalesce(p["structure_id"], F.lit("")).alias("structure_id"),
        termination.alias("expected_termination"),
        confirmation.alias("confirmation_requirement"),
        c["actions"].alias("expected_actions"),
    ).where((F.coalesce(F.size("expected_actions"), F.lit(0)) > 0) | (F.col("expected_termination") != ""))


def audit(
    messages: DataFrame,
    block_size: int = 4096,
    contracts: DataFrame | None = None,
    order_id_pattern: str = r"#?[A-Z][0-9]+",
) -> DataFrame:
    """Violations ``(sim, pos, violation)``.

    ``messages(sim, pos, role, content, error, calls array<struct<name, args map>>)``.
    ``contracts(sim, expected_termination, confirmation_requirement, expected
    array<struct<name, args map>>)``.
    """
    m = messages.withColumn("n_calls", F.coalesce(F.size("calls"), F.lit(0))).withColumn(
        "content", F.coalesce("content", F.lit(""))
    )
    block = F.floor(F.col("pos") / block_size)
    is_result, is_call_msg = F.col("role") == "tool", F.col("role") == "assistant"
    counted = running(
        m.withColumn("calls_here", F.when(is_call_msg, F.col("n_calls")).otherwise(0)),
        ["sim"], ["pos"], block,
        sums={"c": F.col("calls_here").cast("bigint"), "r": is_result.cast("bigint")},
    )
    queue = running(counted, ["sim"], ["pos"], block, maxima={"lost": F.greatest(F.when(is_result, F.col("r") - F.col("c")), F.lit(0))})
    queue = settled(queue)
    calls = (
        queue.where(is_call_msg & (F.col("n_calls") > 0))
        .select("sim", "pos", (F.col("c") - F.col("n_calls")).alias("c0"), F.posexplode("calls").alias("i", "call"))
        .select("sim", "pos", "i", (F.col("c0") + F.col("i") + 1).alias("ordinal"), "call.*")
        .withColumn("target", F.coalesce(F.nullif(F.try_element_at("args", F.lit("order_id")), F.lit("")), F.nullif(F.try_element_at("args", F.lit("user_id")), F.lit("")), F.lit("unknown")))
    )
    results = queue.where(is_result).select("sim", F.col("pos").alias("result_pos"), "error", "r", "lost", (F.col("r") - F.col("lost")).alias("ordinal"))
    # a result is unmatched when it raises the running maximum, that is when r - c equals it and exceeds the one before
    prior = queue.where(is_result).groupBy("sim", "lost").agg(F.min("pos").alias("first_at"))
    unmatched = prior.where(F.col("lost") > 0).select("sim", F.col("first_at").alias("result_pos"))
    matched = results.join(unmatched, ["sim", "result_pos"], "left_anti")
    done = settled(calls.join(matched.select("sim", "ordinal", "result_pos", "error"), ["sim", "ordinal"]))
    good = done.where(~F.coalesce("error", F.lit(False)))

    def violations(df: DataFrame, name: str | Column, pos: str = "pos", sub: Column | int = 0) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.select("sim", F.col(pos).alias("pos"), (F.lit(sub) if isinstance(sub, int) else sub).alias("sub"), label.alias("violation"))

    parts = [
        violations(unmatched, "unmatched_tool_result", "result_pos"),
        violations(done.where(F.coalesce("error", F.lit(False))), "tool_error", "result_pos"),
        violations(queue.where(is_call_msg & (F.col("content") != "") & (F.col("n_calls") > 0)), "assistant_content_and_tool_call"),
        violations(queue.where(is_call_msg & (F.col("n_calls") > 1)), "parallel_tool_calls", sub=1),
    ]
    auth = good.where(F.col("name").isin(fv.AUTH_TOOLS)).groupBy("sim").agg(F.min("result_pos").alias("auth_at"))
    user_read = good.where(F.col("name") == USER_READ).groupBy("sim").agg(F.min("result_pos").alias("user_read_at"))
    reads = (
        good.where(F.col("name") == ORDER_READ)
        .groupBy("sim", F.coalesce(F.try_element_at("args", F.lit("order_id")), F.lit("")).alias("target"))
        .agg(F.min("result_pos").alias("read_at"))
    )
    private = calls.where(F.col("name").isin(ORDER_READ, USER_READ)).join(auth, "sim", "left")
    unauthenticated = F.coalesce(F.col("auth_at") > F.col("pos"), F.lit(True))
    parts.append(violations(private.where(unauthenticated), "private_read_before_successful_authentication", sub=F.col("i") * 10 + 2))

    # the target an assistant asks to confirm: the only order already read that the text names
    request = queue.where(is_call_msg & (F.col("content") != "") & F.col("content").rlike(fv.CONFIRMATION_REQUEST_PATTERN))
    named = request.select(
        "sim", "pos", F.explode_outer(F.array_distinct(F.regexp_extract_all("content", F.lit(order_id_pattern), F.lit(0)))).alias("target")
    ).join(reads, ["sim", "target"], "left")
    seen = F.col("read_at") < F.col("pos")
    asked = named.groupBy("sim", "pos").agg(
        F.when(F.count_if(seen) == 1, F.max(F.when(seen, F.col("target")))).otherwise("none").alias("asked_target")
    )
    said = (F.col("role") == "user") & (F.col("n_calls") == 0)
    yes = F.col("content").rlike(fv.CONFIRMATION_PATTERN)
    # a confirmation is only looked up at a write; messages that neither write, ask nor answer are not ordered
    wrote = calls.where(F.col("name").isin(fv.RETAIL_WRITE_TOOLS)).select("sim", "pos", F.lit(None).cast("string").alias("asked_target"))
    marked = asked.unionByName(wrote).groupBy("sim", "pos").agg(F.max("asked_target").alias("asked_target"), F.lit(True).alias("marked"))
    answered = F.coalesce((F.col("role") == "user") & (F.col("n_calls") == 0), F.lit(False))
    flow = queue.select("sim", "pos", "role", "content", "n_calls").join(marked, ["sim", "pos"], "left").where(answered | F.col("marked").isNotNull())
    pending = running(flow, ["sim"], ["pos"], block, lasts={"pending_target": F.col("asked_target")})
    confirmed = running(
        pending, ["sim"], ["pos"], block,
        lasts={
            "user_says_yes": F.when(said, yes),
            "bound_target": F.when(said & yes, F.coalesce("pending_target", F.lit("none"))),
        },
    ).select("sim", "pos", "user_says_yes", "bound_target")
    writes = (
        calls.where(F.col("name").isin(fv.RETAIL_WRITE_TOOLS))
        .join(auth, "sim", "left")
        .join(user_read, "sim", "left")
        .join(reads, ["sim", "target"], "left")
        .join(confirmed, ["sim", "pos"], "left")
    )
    first_write = writes.groupBy("sim", "name", "target").agg(F.min(F.struct("pos", "i")).alias("first_write"))
    writes = writes.join(first_write, ["sim", "name", "target"])
    address = F.col("name") == "modify_user_address"
    told = F.coalesce("user_says_yes", F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(unauthenticated, "write_before_successful_authentication"),
            F.when(address & F.coalesce(F.col("user_read_at") > F.col("pos"), F.lit(True)), "write_without_successful_required_read"),
            F.when(~address & F.coalesce(F.col("read_at") > F.col("pos"), F.lit(True)), "write_without_successful_target_read"),
            F.when(~told, "write_without_explicit_confirmation").when(
                ~F.coalesce(F.col("bound_target") == F.col("target"), F.lit(False)), "confirmation_not_bound_to_write_target"
            ),
            F.when(F.struct("pos", "i") != F.col("first_write"), "repeated_write_attempt"),
        )
    )
    each = writes.select("sim", "pos", "i", F.posexplode(issues).alias("j", "violation"))
    parts.append(violations(each, F.col("violation"), sub=F.col("i") * 10 + 2 + F.col("j")))
    end = F.lit(2**40).cast("bigint")
    totals = queue.groupBy("sim").agg(F.max("c").alias("c"), F.max(F.col("r") - F.col("lost")).alias("matched"))
    parts.append(violations(totals.where(F.col("c") > F.col("matched")).withColumn("pos", end), "missing_tool_result"))
    if contracts is not None:
        parts += _contract_violations(queue, good, contracts, violations, end)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _contract_violations(m: DataFrame, good: DataFrame, contracts: DataFrame, violations, end: Column) -> list[DataFrame]:
    """Expected actions each covered by their own successful call, and the agreed ending."""
    args_key = F.to_json(F.array_sort(F.map_entries("args")))
    succeeded = good.withColumn("args_key", args_key)
    totals = succeeded.groupBy("sim", "name", "args_key").agg(F.count(F.lit(1)).alias("available"))
    want = contracts.select("sim", F.posexplode("expected").alias("idx", "e")).select(
        "sim", "idx", F.col("e.name").alias("name"), F.col("e.args").alias("want_args")
    )
    covers = F.forall(F.map_entries("want_args"), lambda e: F.coalesce(F.try_element_at("args", e["key"]) == e["value"], F.lit(False)))
    hit = want.join(succeeded.select("sim", "name", "args", "args_key", "ordinal"), ["sim", "name"]).where(covers)
    chosen = hit.groupBy("sim", "idx", "name").agg(F.min_by("args_key", "ordinal").alias("args_key"))
    w = Window.partitionBy("sim", "name", "args_key").orderBy("idx")
    enough = chosen.withColumn("use", F.row_number().over(w)).join(totals, ["sim", "name", "args_key"]).where(
        F.col("use") <= F.col("available")
    )
    missing = want.join(enough, ["sim", "idx"], "left_anti").withColumn("pos", end + 1 + F.col("idx"))
    wrote = good.groupBy("sim").agg(
        F.bool_or(F.col("name").isin(fv.RETAIL_WRITE_TOOLS)).alias("wrote"), F.bool_or(F.col("name") == HANDOFF).alias("handed")
    )
    last = m.where((F.col("role") == "assistant") & (F.col("content") != "")).groupBy("sim").agg(F.max_by("content", "pos").alias("final_text"))
    ends = contracts.join(wrote, "sim", "left").join(last, "sim", "left").withColumn("final_text", F.coalesce("final_text", F.lit("")))
    t, text = F.col("expected_termination"), F.col("final_text")
    refusal = F.when(F.col("confirmation_requirement") == "refused_or_absent", text.rlike(fv.NO_CHANGE_PATTERN)).otherwise(text.rlike(fv.REFUSAL_PATTERN))
    rule = (
        F.when((t == "handoff") & ~F.coalesce("handed", F.lit(False)), "missing_successful_handoff")
        .when((t == "idempotent_done") & ~text.rlike(fv.IDEMPOTENT_PATTERN), "idempotent_outcome_not_stated")
        .when((t == "clarify_only") & ~F.contains(text, F.lit("?")), "required_clarification_not_asked")
        .when((t == "refuse_no_write") & ~refusal, "required_refusal_or_no_change_not_stated")
        .when((t == "success_read") & (F.trim(text) == ""), "read_outcome_not_reported")
    )
    unwanted = ends.where((t != "") & (t != "success_write") & F.coalesce("wrote", F.lit(False))).withColumn("pos", end + 10**6)
    badly = ends.withColumn("rule", rule).where(F.col("rule").isNotNull()).withColumn("pos", end + 10**6 + 1)
    return [
        violations(missing, F.concat(F.lit("missing_successful_expected_action:"), "name")),
        violations(unwanted, "write_for_no_write_contract"),
        violations(badly, F.col("rule")),
    ]


def verdicts(messages: DataFrame, found: DataFrame, version: str = "process-v2") -> DataFrame:
    """One row per simulation: distinct violations in first-seen order. There are few kinds, so lists stay short."""
    firsts = found.groupBy("sim", "violation").agg(F.min(F.struct("pos", "sub")).alias("at"))
    lists = firsts.groupBy("sim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "violation"))), lambda v: v["violation"]).alias("violations")
    )
    sims = messages.select("sim").distinct()
    return sims.join(lists, "sim", "left").select(
        F.col("sim").alias("simulation_id"),
        F.col("violations").isNull().alias("process_compliant"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
        F.lit("deterministic_task_aware_audit").alias("reviewer"),
        F.lit(version).alias("audit_version"),
    )


def audit_summary(audits: DataFrame) -> DataFrame:
    """Totals and one row per violation kind."""
    totals = audits.select(
        F.explode(
            F.array(F.lit("total"), F.when(F.col("process_compliant"), "process_compliant").otherwise("noncompliant"))
        ).alias("item")
    )
    kinds = audits.select(F.explode("violations").alias("v")).select(F.concat(F.lit("violation:"), "v").alias("item"))
    return totals.unionByName(kinds).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
