"""Paired gates between two graded runs: one row per check, and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """Full-outer pairing of two runs by task; duplicates show as a count above one."""
    cols = [c for c in base.columns if c not in ("task_id", "config")]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("task_id").agg(
            F.count(F.lit(1)).alias(f"{p}_n"), *[F.max(c).alias(f"{p}_{c}") for c in cols]
        )

    return side(base, "b").join(side(other, "o"), "task_id", "full")


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _checks(totals: DataFrame, checks: dict[str, Column], accept: str, hold: str) -> DataFrame:
    """One row per check with the overall decision; all come from a single aggregated row."""
    flags = totals.select(
        F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]).alias("cs")
    )
    return flags.select(F.explode("cs").alias("c"), F.forall("cs", lambda x: x["passed"]).alias("all")).select(
        "c.*", F.when(F.col("all"), accept).otherwise(hold).alias("decision")
    )


def _totals(p: DataFrame, *extra: Column) -> DataFrame:
    regressed = _yes("b_success") & ~_yes("o_success")
    new_handoff = _yes("b_success") & ~_yes("b_inappropriate_handoff") & _yes("o_inappropriate_handoff")
    return p.agg(
        F.count("b_n").alias("nb"),
        F.count("o_n").alias("no"),
        F.count_if((F.coalesce("b_n", F.lit(0)) != 1) | (F.coalesce("o_n", F.lit(0)) != 1)).alias("unpaired"),
        F.count_if(regressed).alias("regressions"),
        F.count_if(new_handoff).alias("new_handoffs"),
        F.count_if(_yes("b_success")).alias("b_success"),
        F.count_if(_yes("o_success")).alias("o_success"),
        F.count_if(_yes("b_illegal_state_change")).alias("b_illegal"),
        F.count_if(_yes("o_illegal_state_change")).alias("o_illegal"),
        F.count_if(_yes("b_inappropriate_handoff")).alias("b_handoff"),
        F.count_if(_yes("o_inappropriate_handoff")).alias("o_handoff"),
        F.count_if(_yes("b_terminal_state_accurate")).alias("b_terminal"),
        F.count_if(_yes("o_terminal_state_accurate")).alias("o_terminal"),
        F.count_if(_yes("o_protocol_error")).alias("o_protocol"),
        F.coalesce(F.sum("o_duplicate_writes"), F.lit(0)).alias("o_duplicates"),
        F.count_if(_yes("o_correction_eligible")).alias("o_eligible"),
        F.count_if(_yes("o_correction_eligible") & _yes("o_success")).alias("o_recovered"),
        *extra,
    )


def _rate(n: str, d: str) -> Column:
    return F.try_divide(F.col(n), F.col(d))


def progress_gate(base: DataFrame, other: DataFrame, tasks: int | None = None, derived: Column | None = None) -> DataFrame:
    """Seven checks; ``tasks`` fixes the number of tasks, else the paired count stands."""
    size = F.lit(True) if tasks is None else (F.col("nb") == tasks) & (F.col("no") == tasks)
    return _checks(
        _totals(paired(base, other)),
        {
            "derived_state_present": F.lit(True) if derived is None else derived,
            "paired_task_sets_match": (F.col("unpaired") == 0) & size,
            "baseline_successes_preserved": F.col("regressions") == 0,
            "success_not_below_baseline": _rate("o_success", "no") >= _rate("b_success", "nb"),
            "illegal_state_change_not_increased": F.col("o_illegal") <= F.col("b_illegal"),
            "no_new_inappropriate_handoff_on_baseline_success": F.col("new_handoffs") == 0,
            "protocol_errors_zero": F.col("o_protocol") == 0,
        },
        "allow_action_evaluator",
        "hold_for_progress_diagnosis",
    )


def action_evaluator_gate(
    base: DataFrame,
    other: DataFrame,
    tasks: int | None = None,
    refusals_safe: Column | None = None,
    rejected_executed: Column | None = None,
    challenge: tuple[int, int] = (0, 0),
) -> DataFrame:
    """Eleven checks; ``challenge`` adds (eligible, recovered) of a separate correction run."""
    size = F.lit(True) if tasks is None else (F.col("nb") == tasks) & (F.col("no") == tasks)
    eligible, recovered = F.col("o_eligible") + challenge[0], F.col("o_recovered") + challenge[1]
    return _checks(
        _totals(paired(base, other)),
        {
            "paired_task_sets_match": (F.col("unpaired") == 0) & size,
            "fixed_refusal_reducer_safe": F.lit(True) if refusals_safe is None else refusals_safe,
            "fixed_successes_preserved": F.col("regressions") == 0,
            "success_improves_by_at_least_one_task": F.col("o_success") >= F.col("b_success") + 1,
            "illegal_state_change_zero": F.col("o_illegal") == 0,
            "terminal_state_accuracy_not_decreased": _rate("o_terminal", "no") >= _rate("b_terminal", "nb"),
            "inappropriate_handoff_not_increased": F.col("o_handoff") <= F.col("b_handoff"),
            "protocol_errors_zero": F.col("o_protocol") == 0,
            "rejected_actions_never_executed": F.lit(True) if rejected_executed is None else ~rejected_executed,
            "correction_sample_size_at_least_ten": eligible >= 10,
            "correction_task_recovery_at_least_half": F.coalesce(F.try_divide(recovered, eligible) >= 0.5, F.lit(False)),
        },
        "allow_completion_evaluator",
        "hold_for_action_evaluator_diagnosis",
    )


def protocol_fix_gate(rows: DataFrame, named: DataFrame, tasks: int | None = None, locked_executed: bool = False) -> DataFrame:
    """Seven checks against ``named(task_id, role)`` with roles ``target`` and ``observe``."""
    per_task = rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("success").alias("success"), F.bool_or("illegal_state_change").alias("illegal"),
        F.bool_or("protocol_error").alias("protocol"), F.sum("duplicate_writes").alias("dup"),
    )
    j = per_task.join(named, "task_id", "full")
    t = j.agg(
        F.count("n").alias("nt"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if((F.col("role") == "target") & ~_yes("success")).alias("target_failures"),
        F.count_if(F.col("role").isNull() & ~_yes("success")).alias("regressions"),
        F.count_if(_yes("illegal")).alias("illegal"),
        F.count_if(_yes("protocol")).alias("protocol"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("dup"),
    )
    size = F.lit(True) if tasks is None else F.col("nt") == tasks
    return _checks(
        t,
        {
            "dev_task_count": size & (F.col("repeated") == 0),
            "locked_not_executed": F.lit(not locked_executed),
            "target_protocol_tasks_all_success": F.col("target_failures") == 0,
            "baseline_successes_preserved": F.col("regressions") == 0,
            "illegal_state_change_zero": F.col("illegal") == 0,
            "protocol_errors_zero": F.col("protocol") == 0,
            "duplicate_writes_zero": F.col("dup") == 0,
        },
        "accept_protocol_fix",
        "hold_for_protocol_fix_diagnosis",
    )


def action_constraint_gate(
    base: DataFrame, other: DataFrame, observed: DataFrame, spans: DataFrame, tasks: int | None = None, locked_executed: bool = False
) -> DataFrame:
    """Ten checks; ``observed(task_id, premature)``, ``spans(extra_calls, corrections)``."""
    j = paired(base, other).join(observed.withColumn("watch", F.lit(True)), "task_id", "left")
    t = _totals(
        j,
        F.count_if(_yes("watch") & ~_yes("b_success") & _yes("o_success")).alias("recovered"),
        F.count_if(_yes("watch") & _yes("premature")).alias("premature"),
    ).withColumn("j", F.lit(1))
    s = spans.agg(
        F.coalesce(F.sum("extra_calls"), F.lit(0)).alias("extra"), F.coalesce(F.sum("corrections"), F.lit(0)).alias("corrections")
    ).withColumn("j", F.lit(1))
    size = F.lit(True) if tasks is None else (F.col("nb") == tasks) & (F.col("no") == tasks)
    return _checks(
        t.join(s, "j"),
        {
            "paired_task_sets_match": (F.col("unpaired") == 0) & size,
            "locked_not_executed": F.lit(not locked_executed),
            "protocol_fixed_successes_preserved": F.col("regressions") == 0,
            "observe_policy_recovers_at_least_one": F.col("recovered") > 0,
            "no_observe_premature_final_migration": F.col("premature") == 0,
            "no_extra_constraint_llm_calls": F.col("extra") == 0,
            "no_action_evaluator_correction_spans": F.col("corrections") == 0,
            "illegal_state_change_zero": F.col("o_illegal") == 0,
            "protocol_errors_zero": F.col("o_protocol") == 0,
            "duplicate_writes_zero": F.col("o_duplicates") == 0,
        },
        "accept_action_constraint",
        "hold_for_action_constraint_diagnosis",
    )


def regressions(base: DataFrame, other: DataFrame) -> DataFrame:
    """Tasks the base run passed and the other did not, and newly inappropriate hand-offs on them."""
    p = paired(base, other).where(_yes("b_success"))
    return p.where(~_yes("o_success") | (~_yes("b_inappropriate_handoff") & _yes("o_inappropriate_handoff"))).select(
        "task_id", (~_yes("o_success")).alias("success_regression"),
        (~_yes("b_inappropriate_handoff") & _yes("o_inappropriate_handoff")).alias("new_inappropriate_handoff"),
    )
