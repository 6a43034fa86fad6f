"""Queries on joins and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.scalars import safe_rate
from poolwise.operators import compare, metrics, mining, repair, selection as sel, splits
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.plans.scalars import paired
from poolwise.session import work_path


@query("join_task_text")
def join_task_text(x: Inputs) -> DataFrame:
    """Candidates with the text of their task; those without a task in the table are reported missing."""
    return compare.join_task_text(x.candidates().select("task_id", "cand_idx", "payload"), x.tasks())


def _mined(x: Inputs) -> DataFrame:
    return mining.ranking_examples(x.members(ks=(8,)), negative_only=1)


def earlier_base(x: Inputs) -> DataFrame:
    """Base examples of an earlier run: the first four candidates of every task, labelled."""
    tasks = x.tasks().select("task_id", "nl", "template_id")
    return x.candidates(4).join(tasks, "task_id").select(
        "nl", "payload", F.when(F.col("correct"), 1).otherwise(0).alias("label"), "template_id", "parseable")


@query("anti_base_keys")
def anti_base_keys(x: Inputs) -> DataFrame:
    """Rows mined at K = 8 that the base of the run at K = 4 does not hold."""
    base = earlier_base(x).where("parseable")
    return compare.anti_keys(_mined(x), base, mining.EXAMPLE_KEY).select("task_id", "cand_idx", "label", "source", "template_id")


@query("leakage_guard")
def leakage_guard(x: Inputs) -> DataFrame:
    """Mined rows outside the validation templates of the task split, twice each."""
    validation = splits.split_by_template(x.tasks()).where("split = 'validation'")
    return compare.leakage_guard(_mined(x), validation, "template_id", 2).select(
        "task_id", "cand_idx", "label", "template_id", "copy")


def hurt_keys(x: Inputs) -> DataFrame:
    """Template and K where scorer B loses what scorer A had right."""
    both = {"scorer_a": sel.verifier_ranked(), "scorer_b": sel.second_scorer_ranked()}
    picks = x.picks(both, "template_id", ks=(4, 8)).withColumnRenamed("policy", "verifier")
    rows = compare.paired_replay(picks, "scorer_a", "scorer_b", ["task_id", "template_id"])
    return rows.where("direction = 'hurt'").select("template_id", "k")


@query("hurt_key_flag")
def hurt_key_flag(x: Inputs) -> DataFrame:
    pairs = mining.mine_pairs(x.members())
    return compare.hurt_key_flag(pairs, hurt_keys(x)).select("task_id", "k", "pair_no", "template_id", "hurt_key")


@query("paired_runs")
def paired_runs(x: Inputs) -> DataFrame:
    return paired(x).select(
        "task_id", "k", "base_present", "cand_present", F.col("base_selected_index").alias("base_index"),
        F.col("cand_selected_index").alias("cand_index"), "base_oracle", "cand_oracle", "base_parseable_count",
        "cand_parseable_count", "base_correct_count", "cand_correct_count", "base_best_correct_index",
        "cand_best_correct_index", "base_best_wrong_index", "cand_best_wrong_index", "base_margin", "cand_margin",
        "outcome", "cause")


@query("paired_replay")
def paired_replay(x: Inputs) -> DataFrame:
    both = {"scorer_a": sel.verifier_ranked(), "scorer_b": sel.second_scorer_ranked()}
    return compare.paired_replay(x.picks(both).withColumnRenamed("policy", "verifier"), "scorer_a", "scorer_b")


@query("policy_vs_baseline")
def policy_vs_baseline(x: Inputs) -> DataFrame:
    return compare.policy_vs_baseline(x.search()).select(
        "task_id", "k", "policy", "selected_index", "baseline_index", "changed", "helped", "hurt", "tied_change")


@query("reconcile_metrics")
def reconcile_metrics(x: Inputs) -> DataFrame:
    """Recomputed metrics and pool averages against a saved table that counts only errors the provider reported and
    averages over pools with a parseable candidate."""
    picks = x.basic(reasons=False)
    path = work_path(x.spark, "saved-metrics")
    summary = metrics.policy_summary(picks)
    own = picks.groupBy("k", "policy").agg(
        F.count_if("selected_has_error").alias("error_count"),
        (F.sum("parseable_count") / F.count_if(F.col("parseable_count") > 0)).alias("avg_parseable_candidates"))
    summary.drop("error_count", "avg_parseable_candidates").join(own, ["k", "policy"]).write.parquet(path)
    names = ["total", "parse_count", "equiv_count", "error_count", "parse_rate", "equiv_rate", "equiv_given_parse",
             "avg_parseable_candidates", "avg_equivalent_candidates", "oracle_bestofk_equiv_rate"]
    found = compare.reconcile_metrics(summary, x.spark.read.parquet(path), names)
    return found.select("k", "policy", "metric", *[F.round(c, 9).alias(c) for c in ("recomputed", "saved")])


def digit_sum_even(payload: str) -> bool:
    """A stand-in for an expensive evaluator: whether the digits of the payload add up to an even number."""
    total = sum(int(c) for c in payload if c.isdigit())
    if total % 7 == 0:
        raise ValueError("no answer")
    return total % 2 == 0


@query("evaluate_distinct")
def evaluate_distinct(x: Inputs) -> DataFrame:
    rows = x.candidates().select("task_id", "cand_idx", "parseable", "payload")
    out = compare.evaluate_distinct(rows, "payload", compare.guarded(digit_sum_even, "boolean"), F.col("parseable"))
    return out.select("task_id", "cand_idx", "evaluated", "eval_error")


@query("pos_neg_pairs")
def pos_neg_pairs(x: Inputs) -> DataFrame:
    return mining.pos_neg_pairs(x.members()).select(
        "task_id", "k", "pair_no", "positive_index", "negative_index", "positive_score", "negative_score")


@query("helped_hurt")
def helped_hurt(x: Inputs) -> DataFrame:
    return compare.helped_hurt(compare.policy_vs_baseline(x.replay(base="verifier_ranked", reasons=False)))


@query("changed_rows")
def changed_rows(x: Inputs) -> DataFrame:
    return compare.changed_rows(compare.policy_vs_baseline(x.replay(base="verifier_ranked", reasons=False))).select(
        "task_id", "k", "policy", "change", "selected_index", "selected_score", "baseline_index", "baseline_correct")


@query("paired_changes")
def paired_changes(x: Inputs) -> DataFrame:
    return compare.paired_changes(paired(x)).select("task_id", "k", "outcome", "cause")


@query("head_to_head")
def head_to_head(x: Inputs) -> DataFrame:
    out = compare.head_to_head(x.scorer_rates(), "scorer_a", "scorer_b", tolerance=1e-12)
    return out.withColumn("mean_delta", F.round("mean_delta", 9))


@query("model_deltas")
def model_deltas(x: Inputs) -> DataFrame:
    """Each generator model as its own pool: first candidate at K=1, ranked and repaired at K=8."""
    tasks, pools = x.model_pools()
    by = ["task_id", "model"]
    both = {"greedy_first": sel.greedy_first(), "verifier_ranked": sel.verifier_ranked()}
    picks = sel.select(sel.pool_aggregates(tasks, pools, (1, 8), by=by), both, ["task_id", "seed", "model"])
    # A repair of this model's pick succeeds as in the repairs view: by task number.
    t = F.col("task_id")
    repaired = F.when(F.col("selected_index").isNull(), False).when(
        t % 25 != 0, t % 4 != 0).otherwise(F.col("selected_correct"))

    def rate(k: int, policy: str, value: Column) -> Column:
        here = (F.col("k") == k) & (F.col("policy") == policy)
        return safe_rate(F.count_if(here & value), F.count_if(here))

    rates = picks.groupBy("model", "seed").agg(
        rate(1, "greedy_first", F.col("selected_correct")).alias("prompt_rate"),
        rate(8, "verifier_ranked", F.col("selected_correct")).alias("verifier_rate"),
        rate(8, "verifier_ranked", repaired).alias("repair_rate"))
    out = compare.model_deltas(rates)
    return out.select("model", "runs", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("mean_")])
