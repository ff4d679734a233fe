"""Agent run logs: timings, stalls, retries, outcomes and run state.

Marks: run_id, seq, step, stage, ts_ms, heap_mb. Actions: run_id, step, action, target_id, value. Patches: run_id, seq,
ts_ms, patch (JSON object).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.geometry import js_round

STALL_REPEATS = {1: 3, 2: 2, 3: 2}
CAPTURE_GAP_MS = 550
MAX_STEPS, MAX_ATTEMPTS, RETRY_BASE_MS, RETRY_BAND = 25, 3, 1000, 0.3
LATENCY_GATE_MS = 1000


def stage_deltas(marks: DataFrame) -> DataFrame:
    """marks with delta_ms to the mark before (null for the first) and since_start_ms, to one decimal."""
    w = Window.partitionBy("run_id").orderBy("seq")
    first = F.first("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("delta_ms", js_round(F.col("ts_ms") - F.lag("ts_ms").over(w), 1)).withColumn("since_start_ms", js_round(F.col("ts_ms") - first, 1))


def run_summary(marks: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(run_id, total_ms, total_steps, peak_heap_mb, memory_known, stages): stages in order; and outcome, if outcomes (run_id, outcome) are given."""
    out = marks.groupBy("run_id").agg(
        (F.max("ts_ms") - F.min("ts_ms")).alias("total_ms"), F.max("step").alias("total_steps"), F.max("heap_mb").alias("peak_heap_mb"),
        (F.count("heap_mb") > 0).alias("memory_known"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "stage"))), lambda s: s["stage"]).alias("stages"),
    )
    return out if outcomes is None else out.join(outcomes.select("run_id", "outcome"), "run_id", "left")


def count_kinds(rows: DataFrame, by: list[str], kinds: dict[str, Column]) -> DataFrame:
    """One row per group with the number of rows of each kind, zeros included."""
    return rows.groupBy(*by).agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in kinds.items()])


def latency_summary(timings: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, cold_ms, warm_runs, warm_median_ms, within_gate) of timings (by, seq, ms): the first is cold, the rest are warm."""
    rows = timings.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("seq")))
    warm = F.when(F.col("_n") > 1, F.col("ms"))
    df = rows.groupBy(by).agg(F.max(F.when(F.col("_n") == 1, F.col("ms"))).alias("cold_ms"), F.count(warm).alias("warm_runs"), F.median(warm).alias("warm_median_ms"))
    return df.withColumn("within_gate", F.coalesce(F.col("warm_median_ms") < LATENCY_GATE_MS, F.lit(False)))


def action_signature(action: Column, target: Column, value: Column) -> Column:
    return F.concat_ws(":", F.coalesce(action, F.lit("")), F.coalesce(target, F.lit("")), F.coalesce(value, F.lit("")))


def detect_stalls(actions: DataFrame, repeats: dict[int, int] | None = None) -> DataFrame:
    """(run_id, step, period): the first step at which a run's last actions are a repeated pattern; done actions do not count.

    repeats: how often a pattern of each length must stand at the end, shorter ones first.
    """
    repeats = repeats or STALL_REPEATS
    w = Window.partitionBy("run_id").orderBy("step")
    df = actions.where("action <> 'done'").withColumn("sig", action_signature(F.col("action"), F.col("target_id"), F.col("value")))
    period = F.lit(None).cast("int")
    for p, r in sorted(repeats.items(), reverse=True):
        same = F.lit(True)
        for i in range(p * (r - 1)):
            same = same & (F.lag("sig", i).over(w) == F.lag("sig", i + p).over(w)) if i else same & (F.col("sig") == F.lag("sig", p).over(w))
        period = F.when(same, p).otherwise(period)
    first = F.min(F.when(F.col("period").isNotNull(), F.struct("step", "period"))).alias("s")
    return df.withColumn("period", period).groupBy("run_id").agg(first).where("s is not null").select("run_id", "s.step", "s.period")


def recent_signatures(actions: DataFrame, n: int = 6) -> DataFrame:
    """(run_id, step, recent): the last n action signatures up to each step, oldest first."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(-(n - 1), 0)
    sig = action_signature(F.col("action"), F.col("target_id"), F.col("value"))
    return actions.select("run_id", "step", F.collect_list(sig).over(w).alias("recent"))


def rate_limit_audit(captures: DataFrame, gap_ms: int = CAPTURE_GAP_MS) -> DataFrame:
    """captures (run_id, ts_ms) with wait_ms that was still due and violation."""
    wait = F.greatest(F.lit(0), gap_ms - (F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("run_id").orderBy("ts_ms"))))
    return captures.withColumn("wait_ms", F.coalesce(wait, F.lit(0))).withColumn("violation", F.col("wait_ms") > 0)


def attempt_stats(sends: DataFrame) -> DataFrame:
    """(run_id, step, attempts, last_class, off_policy, gave_up, retried_final) of sends (run_id, step, attempt, ts_ms, error_class, retryable).

    off_policy counts gaps outside 1000 * 2 ** (attempt - 2) ms by more than 30 %; gave_up: the last of MAX_ATTEMPTS failed;
    retried_final: an attempt followed a failure that must not be retried.
    """
    w = Window.partitionBy("run_id", "step").orderBy("attempt")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    policy = RETRY_BASE_MS * F.pow(F.lit(2.0), F.col("attempt") - 2)
    df = sends.withColumn("_off", gap.isNotNull() & ~gap.between(policy * (1 - RETRY_BAND), policy * (1 + RETRY_BAND)))
    df = df.withColumn("_bad", F.lead("attempt").over(w).isNotNull() & F.col("error_class").isNotNull() & ~F.col("retryable"))
    return df.groupBy("run_id", "step").agg(
        F.max("attempt").alias("attempts"), F.max_by("error_class", "attempt").alias("last_class"), F.count_if("_off").alias("off_policy"),
        F.coalesce((F.max("attempt") >= MAX_ATTEMPTS) & F.max_by(F.col("error_class").isNotNull(), F.col("attempt")), F.lit(False)).alias("gave_up"), F.max("_bad").alias("retried_final"),
    )


def run_outcomes(steps: DataFrame) -> DataFrame:
    """(run_id, outcome, step): the first terminal outcome of step logs (run_id, step, stage_rank, outcome), else the step limit or none yet."""
    ended = F.min(F.when(F.col("outcome").isNotNull(), F.struct("step", "stage_rank", "outcome")))
    df = steps.groupBy("run_id").agg(ended.alias("e"), F.max("step").alias("last"))
    outcome = F.coalesce("e.outcome", F.when(F.col("last") >= MAX_STEPS, "max_steps_reached"))
    return df.select("run_id", outcome.alias("outcome"), F.coalesce("e.step", "last").alias("step"))


def fold_patches(patches: DataFrame) -> DataFrame:
    """(run_id, field, value): the last value that a patch set for each field; an absent key keeps it, an explicit null clears it."""
    keys = F.explode(F.json_object_keys("patch")).alias("field")
    long = patches.select("run_id", "seq", "patch", keys)
    value = F.expr("get_json_object(patch, concat('$.', field))")
    return long.groupBy("run_id", "field").agg(F.max_by(F.struct(value.alias("v")), "seq").alias("s")).select("run_id", "field", F.col("s.v").alias("value"))
