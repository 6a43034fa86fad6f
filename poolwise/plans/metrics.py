"""Queries on metrics, repairs, failure analysis and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.operators import calibration as cal, compare, failures, gates, metrics, ordering, repair, selection as sel
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.plans.scalars import cases, template_name

STYLE = ("domain", "init_is_abstract", "goal_is_abstract")


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Means of many doubles depend on the order of summation in the last digit; reports round them."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("batch_metrics")
def batch_metrics(x: Inputs) -> DataFrame:
    return metrics.batch_metrics(x.picks({"verifier_ranked": sel.verifier_ranked()}, reasons=False), ["k"])


@query("stratified_metrics")
def stratified_metrics(x: Inputs) -> DataFrame:
    return metrics.stratified_metrics(x.basic(*STYLE, reasons=False))


@query("policy_summary")
def policy_summary(x: Inputs) -> DataFrame:
    return metrics.policy_summary(x.basic(reasons=False))


@query("slice_metrics")
def slice_metrics(x: Inputs) -> DataFrame:
    """Breakdowns of the search policies by domain and by style."""
    picks = x.search("domain", "style", reasons=False)
    return metrics.slice_metrics(picks, ["domain", "style"])


@query("macro_mean")
def macro_mean(x: Inputs) -> DataFrame:
    out = metrics.macro_mean(metrics.run_rates(x.replay("seed", reasons=False)))
    return rounded(out, "mean_parse_rate", "mean_equiv_rate", "mean_equiv_given_parse")


@query("micro_rate")
def micro_rate(x: Inputs) -> DataFrame:
    return metrics.micro_rate(metrics.run_rates(x.search("seed", reasons=False)))


@query("latency_summary")
def latency_summary(x: Inputs) -> DataFrame:
    return rounded(metrics.latency_summary(x.loose_candidates()), "latency_total_sec", "latency_mean_sec", digits=6)


def diagnostics(x: Inputs) -> DataFrame:
    """Gap diagnostics of every pool with the bucket of its outcome."""
    agg = x.aggregates("domain", "style")
    slot = sel.pick_struct(F.col("top"), F.lit(""), F.col("top_score"), F.lit(None).cast("string"))
    gap = F.col("top_score")
    return agg.select(
        "task_id", "k", "domain", "style", (gap - F.col("second_score")).alias("top_second_gap"),
        (gap - F.col("first_score")).alias("top_first_gap"),
        failures.bucket(slot["correct"], F.col("oracle")).alias("bucket"))


@query("margin_quantiles")
def margin_quantiles(x: Inputs) -> DataFrame:
    gaps = F.array(*[F.struct(F.lit(n).alias("gap"), F.round(n, 9).alias("value")) for n in ("top_second_gap", "top_first_gap")])
    values = diagnostics(x).select("bucket", F.inline(gaps)).where("value IS NOT NULL")
    out = ordering.nearest_rank_quantiles(values, ["bucket", "gap"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return rounded(out, "mean", digits=6)


@query("bucket_counts")
def bucket_counts(x: Inputs) -> DataFrame:
    return failures.bucket_counts(diagnostics(x))


# ---------------------------------------------------------------- repairs

@query("repair_metrics")
def repair_metrics(x: Inputs) -> DataFrame:
    """Both policies, by domain."""
    return repair.repair_metrics(repair.apply_repairs(x.repairs(), [None, 0.05]), ["policy", "domain"])


@query("outcome_counts")
def outcome_counts(x: Inputs) -> DataFrame:
    return repair.outcome_counts(repair.apply_repair(x.repairs()))


@query("guard_sweep")
def guard_sweep(x: Inputs) -> DataFrame:
    """Overall, by domain and by style; the slices come from one count per (domain, style)."""
    cells = repair.guard_sweep(x.repairs(), by=["domain", "style"])
    names = ["repair_rows", "accepted", "parse_count", "final_equiv_count", "helped", "hurt", "both_success", "both_fail",
             "rejected", "tied"]
    slices = F.array(F.lit("all"), F.concat(F.lit("domain="), "domain"), F.concat(F.lit("style="), "style"))
    sums = (cells.select("margin", F.explode(slices).alias("slice"), *names).groupBy("margin", "slice")
            .agg(*[F.sum(n).alias(n) for n in names]))
    c = F.col
    return sums.select("*", (c("accepted") / c("repair_rows")).alias("accept_rate"),
                       (c("parse_count") / c("repair_rows")).alias("repair_parse_rate"),
                       (c("final_equiv_count") / c("repair_rows")).alias("final_equiv_rate"))


@query("guard_by_seed")
def guard_by_seed(x: Inputs) -> DataFrame:
    return rounded(repair.guard_by_seed(x.repairs(), x.seed_rates()), "delta")


@query("guard_means")
def guard_means(x: Inputs) -> DataFrame:
    out = repair.guard_means(repair.guard_by_seed(x.repairs(), x.seed_rates()))
    return rounded(out, "mean_baseline_rate", "mean_guarded_rate", "mean_delta")


@query("guard_choose")
def guard_choose(x: Inputs) -> DataFrame:
    means = rounded(repair.guard_means(repair.guard_by_seed(x.repairs(), x.seed_rates())),
                    "mean_baseline_rate", "mean_guarded_rate", "mean_delta")
    return repair.guard_choose(means).select("margin", "mean_guarded_rate", "total_helped", "total_hurt")


def pilot_rows(x: Inputs) -> DataFrame:
    """Repairs judged by themselves, without fallback to the original."""
    from poolwise.functions.scalars import repair_outcome
    rows = x.repairs().join(x.tasks().select("task_id", template_name().alias("template_name")), "task_id")
    return rows.withColumn("outcome", repair_outcome(F.col("original_correct"), F.col("repair_correct")))


def failure_repairs(x: Inputs) -> DataFrame:
    """Repairs of wrong picks only, as in a repair gate on fixed pools."""
    return pilot_rows(x).where(~F.col("original_correct"))


def augmented(x: Inputs) -> DataFrame:
    return repair.augmented_rate(x.seed_rates(), repair.repair_metrics(failure_repairs(x), ["seed"]))


@query("augmented_rate")
def augmented_rate(x: Inputs) -> DataFrame:
    return rounded(augmented(x), "augmented_rate", "delta")


@query("repair_cases")
def repair_cases(x: Inputs) -> DataFrame:
    keep = ["task_id", "seed", "domain", "style"]
    targets = sel.repair_targets(x.aggregates(*keep[1:], ks=(8,)), keep)
    return repair.repair_cases(targets, 50, "alpha", "abstract/abstract")


@query("fresh_repair_order")
def fresh_repair_order(x: Inputs) -> DataFrame:
    """First 30 repair targets of every seed, in reverse order of focus, score and name."""
    keep = ["task_id", "seed", "domain", "style", "template_id"]
    targets = sel.repair_targets(x.aggregates(*keep[1:], ks=(8,)), keep)
    order = [F.when(F.col("domain") == "alpha", 1).otherwise(0).desc(),
             F.when(F.col("style") == "abstract/abstract", 1).otherwise(0).desc(),
             F.col("selected_score").desc_nulls_last(), F.col("template_id").desc(), F.col("task_id").desc()]
    return ordering.top_per_group(targets, ["seed"], order, 30).select(
        "seed", "rn", "task_id", "domain", "style", "template_id", "selected_score")


# ---------------------------------------------------------------- failure analysis

@query("failure_cases")
def failure_cases(x: Inputs) -> DataFrame:
    c = F.col
    return cases(x).select(
        "task_id", "k", "oracle_available", "oracle_available_at_k4", "needs_extra_k", "parseable_count", "correct_count",
        "parseable_correct_count", "best_correct_index", "best_correct_score", "best_wrong_index", "best_wrong_score",
        "margin", c("greedy_first.selected_index").alias("greedy_index"), c("greedy_first.correct").alias("greedy_correct"),
        c("random_parseable.selected_index").alias("random_index"), c("random_parseable.correct").alias("random_correct"),
        c("verifier_ranked.selected_index").alias("ranked_index"), c("verifier_ranked.correct").alias("ranked_correct"),
        c("greedy_first.error").alias("greedy_error"), "miss_type", "gain_reason")


@query("miss_breakdown")
def miss_breakdown(x: Inputs) -> DataFrame:
    return failures.miss_breakdown(cases(x), ["domain", "style"])


DOMAINS, STYLES = ("alpha", "beta"), ("abstract/abstract", "explicit/explicit")


@query("recurrence")
def recurrence(x: Inputs) -> DataFrame:
    return failures.recurrence(cases(x), DOMAINS, STYLES)


@query("next_step_evidence")
def next_step_evidence(x: Inputs) -> DataFrame:
    rows = cases(x)
    return failures.next_step_evidence(rows, failures.recurrence(rows, DOMAINS, STYLES), *DOMAINS)


@query("high_value_misses")
def high_value_misses(x: Inputs) -> DataFrame:
    return failures.high_value_misses(cases(x)).select(
        "task_id", "k", "style", "parseable_correct_count", "margin", "miss_type")


# ---------------------------------------------------------------- gates

@query("gate_search")
def gate_search(x: Inputs) -> DataFrame:
    picks = x.search("seed", base="verifier_ranked", reasons=False)
    per_run = compare.helped_hurt(compare.policy_vs_baseline(picks), ["seed", "k", "policy"])
    return gates.gate_search(per_run.withColumn("equiv_rate", F.col("equiv_count") / F.col("total")))


def _h2h(x: Inputs, tolerance: float) -> DataFrame:
    out = compare.head_to_head(x.scorer_rates(), "scorer_a", "scorer_b", tolerance=tolerance)
    return rounded(out, "mean_delta")


@query("gate_multiseed")
def gate_multiseed(x: Inputs) -> DataFrame:
    return gates.gate_multiseed(_h2h(x, 1e-12))


@query("gate_fixed_pool")
def gate_fixed_pool(x: Inputs) -> DataFrame:
    return gates.gate_fixed_pool(_h2h(x, 0.0))


@query("gate_repair_pilot")
def gate_repair_pilot(x: Inputs) -> DataFrame:
    rows = pilot_rows(x)
    return gates.gate_repair_pilot(rows, repair.repair_metrics(rows).select(
        "total", "original_equiv_rate", "repair_equiv_rate", "repair_parse_rate", "helped", "hurt"))


@query("gate_domain_repair")
def gate_domain_repair(x: Inputs) -> DataFrame:
    metric = repair.repair_metrics(failure_repairs(x), ["domain"])
    return gates.gate_domain_repair(metric.select("domain", "total", "repair_parse_rate", "repair_equiv_rate", "helped", "hurt"))


@query("gate_fresh_repair")
def gate_fresh_repair(x: Inputs) -> DataFrame:
    return rounded(gates.gate_fresh_repair(augmented(x), repair.repair_metrics(failure_repairs(x))), "mean_delta")


@query("gate_final_repair")
def gate_final_repair(x: Inputs) -> DataFrame:
    """Guarded repair against ranked selection, with unguarded repair as the comparison policy."""
    rows = repair.apply_repairs(x.repairs(), [0.05, None])
    base = x.seed_rates().select("seed", "total", F.col("equiv_rate").alias("baseline_rate"))

    def sums(policy: str, prefix: str) -> list[Column]:
        here, hurt = F.col("policy") == policy, F.col("outcome") == "repair_hurt"
        return [
            F.count_if(here & F.col("final_correct")).alias(f"{prefix}correct"),
            (F.count_if(here & F.col("final_parseable")) / F.count_if(here)).alias(f"{prefix}repair_parse_rate"),
            F.count_if(here & (F.col("outcome") == "repair_helped")).alias(f"{prefix}helped"),
            F.count_if(here & hurt).alias(f"{prefix}hurt"),
            F.count_if(here & hurt & (F.col("domain") == "alpha")).alias(f"{prefix}focus_hurt")]

    per_seed = rows.groupBy("seed").agg(*sums("verifier_ranked_repair_guarded", ""),
                                        *sums("verifier_ranked_repair", "comparison_"))
    seeds = (base.join(per_seed, "seed")
             .withColumn("repair_rate", F.col("correct") / F.col("total"))
             .withColumn("comparison_rate", F.col("comparison_correct") / F.col("total")))
    out = gates.gate_final_repair(seeds, require_hurt_reduction=True)
    return rounded(out, "mean_delta", "worst_delta", "mean_parse_rate", "mean_repair_rate", "mean_comparison_rate")


@query("sweep_leaderboard")
def sweep_leaderboard(x: Inputs) -> DataFrame:
    """Every document language as a scored run, ranked by AUC and best F1."""
    hist = cal.histogram(x.examples(), by=["domain"])
    best = cal.best_threshold(cal.threshold_sweep(hist, by=["domain"]), ["domain"])
    runs = cal.auc(hist, ["domain"]).join(best, "domain").withColumnRenamed("domain", "run")
    return cal.sweep_leaderboard(runs)
