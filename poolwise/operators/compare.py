"""Comparisons of policies, scorers and runs, and joins that check one table against another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from poolwise.functions.scalars import change_cause, paired_outcome
from poolwise.operators.selection import pick_index, _flag, _slot_of


def policy_vs_baseline(picks: DataFrame, base: str = "verifier_ranked",
                       keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Each policy row against the base policy of the same task and K.

    Picks that were selected with ``base`` already carry it. For stored
    selections a window over (task, K) finds it; such a window holds one row per
    policy, so there is no self-join.
    """
    out = picks
    if "baseline_index" not in picks.columns:
        w = W.partitionBy(*keys, "k")
        is_base = F.col("policy") == base
        out = picks.select(
            "*",
            F.max(F.when(is_base, F.col("selected_index"))).over(w).alias("baseline_index"),
            F.max(F.when(is_base, F.col("selected_correct"))).over(w).alias("baseline_correct"))
    right, before = F.col("selected_correct"), F.col("baseline_correct")
    changed = ~F.col("selected_index").eqNullSafe(F.col("baseline_index"))
    return out.select(
        "*", changed.alias("changed"),
        (changed & right & ~before).alias("helped"),
        (changed & ~right & before).alias("hurt"),
        (changed & (right == before)).alias("tied_change"))


def helped_hurt(compared: DataFrame, by: Sequence[str] = ("k", "policy")) -> DataFrame:
    return compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("selected_correct").alias("equiv_count"),
        *[F.count_if(c).alias(c) for c in ("changed", "helped", "hurt", "tied_change")])


def changed_rows(compared: DataFrame, base: str = "verifier_ranked") -> DataFrame:
    """Rows where a policy changed the outcome, with both picks."""
    return compared.where((F.col("policy") != base) & (F.col("helped") | F.col("hurt"))).withColumn(
        "change", F.when(F.col("helped"), "helped").otherwise("hurt"))


def head_to_head(rates: DataFrame, base: str, candidate: str, rate: str = "equiv_rate",
                 tolerance: float = 0.0, run: str = "seed", by: Sequence[str] = ("k",)) -> DataFrame:
    """Wins, losses and ties of the candidate over runs, and the mean rate difference.

    ``rates`` has one row per run, K and verifier.
    """
    per_run = (rates.groupBy(run, *by).agg(
        F.max(F.when(F.col("verifier") == base, F.col(rate))).alias("base_rate"),
        F.max(F.when(F.col("verifier") == candidate, F.col(rate))).alias("candidate_rate"))
        .withColumn("delta", F.col("candidate_rate") - F.col("base_rate")))
    win, loss = F.col("delta") > tolerance, F.col("delta") < -tolerance
    return per_run.groupBy(*by).agg(
        F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        F.count_if(~win & ~loss).alias("ties"), F.avg("delta").alias("mean_delta"))


def model_deltas(rates: DataFrame) -> DataFrame:
    """Per model: mean over runs of verifier - prompt, repair - prompt and repair - verifier.

    ``rates`` has columns model, seed, prompt_rate, verifier_rate and repair_rate.
    """
    prompt, verifier, repair = F.col("prompt_rate"), F.col("verifier_rate"), F.col("repair_rate")
    return rates.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(verifier - prompt).alias("mean_verifier_minus_prompt"),
        F.avg(repair - prompt).alias("mean_repair_minus_prompt"),
        F.avg(repair - verifier).alias("mean_repair_minus_verifier"))


def snapshot(aggregates: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """What one run shows for a task and K: the pick, the pool and the best candidates."""
    slot = _slot_of(F.col("top"))
    correct = _flag(slot, "correct")
    margin = F.when(~correct, F.col("top_score") - F.col("best_correct_score"))
    return aggregates.select(
        *keys, "k", F.lit(True).alias("present"), pick_index("top").alias("selected_index"),
        correct.alias("selected_correct"), F.col("top_score").alias("selected_score"),
        "parseable_count", F.col("parseable_correct_count").alias("correct_count"),
        (F.col("parseable_correct_count") > 0).alias("oracle"),
        pick_index("best_correct").alias("best_correct_index"),
        pick_index("best_wrong").alias("best_wrong_index"), margin.alias("margin"))


def paired_runs(base: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Two runs matched on key and K; a run that lacks the task counts as all false."""
    on = [*keys, "k"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in on])

    joined = side(base, "base").join(side(candidate, "cand"), on, "full")

    def filled(name: str) -> Column:
        kind = dict(joined.dtypes)[name]
        if kind == "boolean":
            return F.coalesce(F.col(name), F.lit(False)).alias(name)
        if name.endswith("_count"):
            return F.coalesce(F.col(name), F.lit(0)).alias(name)
        return F.col(name)

    out = joined.select(*on, *[filled(c) for c in joined.columns if c not in on])
    out = out.withColumn("outcome", paired_outcome(F.col("base_selected_correct"), F.col("cand_selected_correct")))
    return out.withColumn("cause", change_cause(F.col("base_oracle"), F.col("cand_oracle"), F.col("outcome")))


def paired_changes(paired: DataFrame) -> DataFrame:
    return paired.where(F.col("outcome").isin("candidate_helped", "candidate_hurt")
                        | F.col("cause").isin("oracle_availability_gain", "oracle_availability_loss"))


def paired_replay(picks: DataFrame, base: str, candidate: str, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Two verifiers over the same pool: missing selection, same outcome, helped or hurt."""
    def at(name: str, column: str) -> Column:
        return F.max(F.when(F.col("verifier") == name, F.col(column)))
    wide = picks.groupBy(*keys, "k").agg(
        at(base, "selected_index").alias("base_index"), at(base, "selected_correct").alias("base_correct"),
        at(candidate, "selected_index").alias("cand_index"),
        at(candidate, "selected_correct").alias("cand_correct"))
    missing = F.col("base_index").isNull() | F.col("cand_index").isNull()
    direction = (F.when(missing, "missing_selection")
                 .when(F.col("base_correct") == F.col("cand_correct"), "same_outcome")
                 .when(F.col("cand_correct"), "helped").otherwise("hurt"))
    return wide.withColumn("direction", direction)


def reconcile_metrics(recomputed: DataFrame, saved: DataFrame, metrics: Sequence[str],
                      by: Sequence[str] = ("k", "policy"), tolerance: float = 1e-9) -> DataFrame:
    """Metrics that differ between a recomputed and a saved table, or exist on one side only."""
    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value))
                          for m in metrics])
        return df.select(*by, F.inline(pairs))
    joined = long(recomputed, "recomputed").join(long(saved, "saved"), [*by, "metric"], "full")
    same = F.abs(F.col("recomputed") - F.col("saved")) <= tolerance
    return joined.where(~F.coalesce(same, F.lit(False)))


def guarded(function: Callable, kind: str) -> Callable[[Column], Column]:
    """``function`` of one payload as an evaluator in Arrow batches whose failures are data: (value, error) per payload.

    ``kind`` is the type of the value. What the function raises becomes the error, its type and message, and the value
    is null; other payloads of the batch are not touched. Nulls are passed on to the function.
    """
    @F.pandas_udf(f"value {kind}, error string")
    def evaluate(payload: pd.Series) -> pd.DataFrame:
        rows = []
        for x in payload:
            try:
                rows.append((function(None if x is None or x is pd.NA else x), None))
            except Exception as problem:  # noqa: BLE001  the evaluator is the caller's
                rows.append((None, f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame({"value": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})
    return evaluate


def evaluate_distinct(rows: DataFrame, payload: str, evaluate: Callable[[Column], Column],
                      eligible: Column, name: str = "evaluated") -> DataFrame:
    """Run an expensive function once per distinct payload and join the result back.

    Rows that are not eligible get no value and the error 'parse_failed'; an evaluator that returns (value, error), see
    ``guarded``, gives other errors. A null payload is one like others. The flag is part of the join key, so such rows
    spread by payload and match nothing; a very frequent payload is a single row on the evaluated side, and AQE can
    split the other side.
    """
    flagged = rows.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    once = flagged.where("_eligible").select(F.col(payload).alias("_payload"), F.col("_eligible").alias("_asked")).distinct()
    once = once.withColumn("_result", evaluate(F.col("_payload")))
    pair = isinstance(once.schema["_result"].dataType, StructType) and once.schema["_result"].dataType.names == ["value", "error"]
    once = once.withColumn("_value", F.col("_result.value") if pair else F.col("_result"))
    once = once.withColumn("_problem", F.col("_result.error") if pair else F.lit(None).cast("string")).drop("_result")
    same = F.col(payload).eqNullSafe(F.col("_payload")) & (F.col("_eligible") == F.col("_asked"))
    joined = flagged.join(once, same, "left")
    error = F.when(~F.col("_eligible"), "parse_failed").otherwise(F.col("_problem"))
    return joined.select(*rows.columns, F.col("_value").alias(name), error.alias("eval_error"))


def join_task_text(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates with the text of their task; rows without a task are flagged, not lost."""
    text = tasks.select("task_id", "nl", "domain", F.lit(True).alias("_hit"))
    return (candidates.join(text, "task_id", "left")
            .withColumn("missing_source", F.col("_hit").isNull()).drop("_hit"))


def anti_keys(new: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``base``; long text keys are compared by hash first."""
    base_keys = base.select(*keys).distinct().withColumn("_h", F.xxhash64(*keys))
    on = ["_h", *keys]
    return new.withColumn("_h", F.xxhash64(*keys)).join(base_keys, on, "left_anti").drop("_h")


def leakage_guard(extra: DataFrame, validation: DataFrame, template: str = "template_id",
                  repeat: int = 1) -> DataFrame:
    """Extra rows whose template is not in validation, each repeated ``repeat`` times."""
    held_out = validation.select(template).distinct()
    return oversample(extra.join(held_out, template, "left_anti"), repeat)


def oversample(rows: DataFrame, repeat: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, repeat)))))


def hurt_key_flag(rows: DataFrame, hurt_keys: DataFrame, keys: Sequence[str] = ("template_id", "k")) -> DataFrame:
    """Marks rows whose key regressed in an earlier comparison."""
    marks = hurt_keys.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(marks, list(keys), "left").withColumn("hurt_key", F.col("_hit").isNotNull()).drop("_hit")
