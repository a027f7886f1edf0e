"""Reward groups, usage, cost, run checks and samples over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import dense_numbers, exact_ranks

USAGE = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens"]


# --- reward groups --------------------------------------------------------------------
def reward_groups(sims: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Successes, mean, population variance and class per group; a non-binary reward fails the job.

    With ``k`` a group of another size fails as well.
    """
    r = F.col("reward")
    binary = F.when(r.isin(0.0, 1.0), r).otherwise(F.raise_error(F.concat(F.lit("non-binary terminal reward: "), F.coalesce(r.cast("string"), F.lit("null")))).cast("double"))
    g = sims.select(by, binary.alias("reward")).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("reward").cast("bigint").alias("successes"),
        F.avg("reward").alias("mean_reward"),
        F.var_pop("reward").alias("variance"),
    )
    if k is not None:
        g = g.withColumn("n", F.when(F.col("n") == k, F.col("n")).otherwise(F.raise_error(F.lit(f"expected groups of {k}")).cast("bigint")))
    return g.withColumn(
        "class", F.when(F.col("successes") == 0, "all_fail").when(F.col("successes") == F.col("n"), "all_pass").otherwise("mixed")
    )


def class_census(groups: DataFrame) -> DataFrame:
    c = F.col("class")
    return groups.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("n").cast("bigint").alias("simulations"),
        F.count_if(c == "mixed").alias("mixed"),
        F.count_if(c == "all_fail").alias("all_fail"),
        F.count_if(c == "all_pass").alias("all_pass"),
        F.count_if(F.col("variance") > 0).alias("non_zero_variance"),
        F.count_if(c != "all_fail").alias("non_all_zero"),
    )


# --- usage and cost ---------------------------------------------------------------------
def _first_nonzero(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0)).cast("bigint")


def usage_per_simulation(sims: DataFrame, messages: DataFrame, model_prefix: str) -> DataFrame:
    """Token usage of one provider's messages per simulation; simulations without any keep a zero row.

    ``messages(sim, model, prompt_tokens, completion_tokens, raw_prompt_tokens,
    raw_completion_tokens, cache_hit, cache_miss)``; raw usage fills in for zero or absent.
    """
    mine = messages.where(F.startswith(F.lower("model"), F.lit(model_prefix.lower())))
    prompt = _first_nonzero(F.col("prompt_tokens"), F.col("raw_prompt_tokens"))
    completion = _first_nonzero(F.col("completion_tokens"), F.col("raw_completion_tokens"))
    agg = mine.groupBy("sim").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
        F.sum(prompt + completion).alias("total_tokens"),
        F.sum(_first_nonzero(F.col("cache_hit"))).alias("prompt_cache_hit_tokens"),
        F.sum(_first_nonzero(F.col("cache_miss"))).alias("prompt_cache_miss_tokens"),
    )
    return sims.select("sim").distinct().join(agg, "sim", "left").select(
        "sim", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in USAGE]
    )


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and inclusive P90 per group."""
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return means.join(exact_ranks(df, by, value, {"median": ("inclusive", 0.5), "p90": ("inclusive", 0.9)}), by)


def cost_usd(hit_price: float | None, miss_price: float | None, output_price: float | None) -> Column:
    """Cost of a usage row from prices per million tokens; null without prices."""
    if None in (hit_price, miss_price, output_price):
        return F.lit(None).cast("double")
    return (
        F.col("prompt_cache_hit_tokens") * hit_price
        + F.col("prompt_cache_miss_tokens") * miss_price
        + F.col("completion_tokens") * output_price
    ) / 1_000_000


def projected_cost(usage: DataFrame, cost: Column, rollouts: list[int]) -> DataFrame:
    t = usage.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("calls") > 0, cost)).alias("cost"))
    return t.select(F.explode(F.array(*[F.lit(r) for r in rollouts])).alias("rollouts"), "n", "cost").select(
        "rollouts", (F.col("cost") * F.col("rollouts") / F.col("n")).alias("cost_usd")
    )


def time_span(sims: DataFrame, start: str, end: str, per_step: int = 16) -> DataFrame:
    """First start, last end, seconds between, rate and projected step time."""
    t = sims.agg(F.min(F.col(start).cast("timestamp")).alias("first"), F.max(F.col(end).cast("timestamp")).alias("last"), F.count(F.lit(1)).alias("n"))
    secs = (F.unix_micros("last") - F.unix_micros("first")) / 1_000_000
    return t.select(
        "n", secs.alias("span_seconds"), F.try_divide(F.col("n"), secs).alias("per_second"), (secs * per_step / F.col("n")).alias("step_seconds")
    )


def run_summary(sims: DataFrame, checks: DataFrame) -> DataFrame:
    """Totals of a run; the mean reward divides by all simulations, also those without a reward."""
    n = F.count(F.lit(1))
    s = sims.agg(
        n.alias("num_simulations"),
        F.count_if(F.col("reward") == 1.0).alias("passed"),
        F.count_if(F.col("termination_reason") == "infrastructure_error").alias("infrastructure_errors"),
        (F.coalesce(F.sum("reward"), F.lit(0.0)) / n).alias("mean_reward"),
        F.count_if(~F.col("db_match")).alias("db_mismatches"),
    ).withColumn("j", F.lit(1))
    writes = F.col("tool_type") == "write"
    c = checks.agg(
        F.count_if(writes).alias("write_action_checks"), F.count_if(writes & ~F.coalesce("action_match", F.lit(False))).alias("failed_write_action_checks")
    ).withColumn("j", F.lit(1))
    return s.join(c, "j").drop("j")


def config_drift(requested: DataFrame, observed: DataFrame) -> DataFrame:
    """Settings whose recorded value differs or is missing, from (run, key, value) rows of both."""
    r = requested.select("run", "key", F.col("value").alias("requested"))
    o = observed.select("run", "key", F.col("value").alias("observed"))
    j = r.join(o, ["run", "key"], "full")
    return j.where(F.col("observed").isNull() | ~F.col("requested").eqNullSafe(F.col("observed")))


def incomplete_runs(sims: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs whose number of simulations is not ``tasks * trials``."""
    n = sims.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return expected.join(n, "run", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") != F.col("tasks") * F.col("trials"))


# --- samples and labels -----------------------------------------------------------------------
def systematic_sample(df: DataFrame, order: list[str], limit: int, block: Column) -> DataFrame:
    """Every n-th row in ``order`` so that about ``limit`` rows span it, then the first ``limit``."""
    n = df.count()
    stride = max(1, n // limit)
    return dense_numbers(df, order, block, "rn").where(((F.col("rn") - 1) % stride == 0) & ((F.col("rn") - 1) / stride < limit))


def agreement(human: DataFrame, auto: DataFrame, key: str, label: str) -> DataFrame:
    j = human.select(key, F.col(label).alias("h")).join(auto.select(key, F.col(label).alias("a")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("h") == F.col("a")).cast("int")).alias("agreement"))


def split_census(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """Per domain and split, and per domain in all: sizes, gates and reference actions."""
    t = tasks.join(splits, "task_id", "left")
    per_split = t.where(F.col("split").isNotNull())
    every = tasks.withColumn("split", F.lit("all"))
    both = per_split.select("domain", "split", "task_id", "judge_gated", "db_gated", "n_actions").unionByName(
        every.select("domain", "split", "task_id", "judge_gated", "db_gated", "n_actions")
    )
    return both.groupBy("domain", "split").agg(
        F.count(F.lit(1)).alias("num_tasks"),
        F.count_if("db_gated").alias("db_gated_tasks"),
        F.count_if("judge_gated").alias("judge_gated_tasks"),
        F.sum("n_actions").cast("bigint").alias("actions_total"),
        F.avg("n_actions").alias("actions_mean"),
        F.max("n_actions").cast("bigint").alias("actions_max"),
    )


def token_budget(census: DataFrame, k: int, arms: int, base: int, growth: float, multiplier: float, output: int, user_base: int, user_output: int, judge_output: int) -> DataFrame:
    """Prompt and output tokens per split: each turn resends the prefix, so prompts are an arithmetic series."""
    turns = F.col("actions_mean") * multiplier
    t = turns.cast("int")

    def series(start: int, n: Column) -> Column:
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, i: acc + F.lit(start) + (i * F.lit(growth)).cast("bigint"))

    user_turns = F.greatest(F.lit(1), (turns / 2).cast("int"))
    runs, judged = F.col("num_tasks") * k, F.col("judge_gated_tasks") * k
    judge = (F.lit(base) + (turns * growth).cast("bigint")) * judged
    prompt = series(base, t) * runs + series(user_base, user_turns) * runs + judge
    out = t * output * runs + user_turns * user_output * runs + judge_output * judged
    return census.select(
        "domain", "split", (prompt * arms).cast("bigint").alias("prompt_tokens"), (out * arms).cast("bigint").alias("output_tokens")
    )


# --- step logs and rewards -----------------------------------------------------------------------
def step_problems(steps: DataFrame, groups_per_step: int, k: int) -> DataFrame:
    """Problems per step row: order, group count, group size and version refresh.

    ``steps(run, step, n_groups, min_size, max_size, version_before, version_after)``.
    A step is contiguous when the step before it exists, which is an equi-join and
    not a window over the whole run.
    """
    prior = steps.select("run", (F.col("step") + 1).alias("step"), F.lit(True).alias("has_prior")).distinct()
    j = steps.join(prior, ["run", "step"], "left")
    reason = (
        F.when((F.col("step") != 1) & F.col("has_prior").isNull(), "not_contiguous")
        .when(F.col("n_groups") != groups_per_step, "group_count")
        .when((F.col("min_size") != k) | (F.col("max_size") != k), "group_size")
        .when(F.col("version_before").eqNullSafe(F.col("version_after")), "version_not_refreshed")
    )
    return j.withColumn("reason", reason).drop("has_prior")


def reward_problem() -> Column:
    """Why a terminal reward is refused, null when valid. Infrastructure failures are refused, never scored zero."""
    r = F.col("reward").try_cast("double")
    return (
        F.when(F.coalesce("truncated", F.lit(False)), "truncated")
        .when(~F.coalesce("terminated", F.lit(False)), "not_terminated")
        .when(F.coalesce("interaction_error", F.lit(False)), "interaction_error")
        .when(F.coalesce("evaluator_error", F.lit(False)), "evaluator_error")
        .when(~F.coalesce("run_complete", F.lit(False)), "incomplete")
        .when(~F.coalesce("evaluator_ok", F.lit(False)), "no_official_reward")
        .when(r.isNull(), "invalid_reward")
        .when(~r.isin(0.0, 1.0), "not_binary")
    )
