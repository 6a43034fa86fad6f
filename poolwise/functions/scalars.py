"""Row-level rules as Column expressions: flags, labels, guards and outcome classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Score and margin limits of the outcome classes.
NEAR_TIE_MARGIN = 0.03
MODERATE_GAP_MARGIN = 0.10
HIGH_SCORE = 0.8
LOW_SCORE = 0.4


def style_label(init_abs: Column, goal_abs: Column) -> Column:
    """'abstract/explicit' and so on; a missing flag counts as explicit."""
    def side(flag: Column) -> Column:
        return F.when(F.coalesce(flag, F.lit(0)) != 0, "abstract").otherwise("explicit")
    return F.concat(side(init_abs), F.lit("/"), side(goal_abs))


def style_filter(init_abstract: int | None = None, goal_abstract: int | None = None) -> Column:
    """Predicate on the style flags; an argument left out does not restrict."""
    keep = F.lit(True)
    if init_abstract is not None:
        keep = keep & (F.col("init_is_abstract") == init_abstract)
    if goal_abstract is not None:
        keep = keep & (F.col("goal_is_abstract") == goal_abstract)
    return keep


def eval_error(selected_index: Column, reason: Column, parseable: Column, error: Column) -> Column:
    """Error text of an evaluated pick.

    No pick: the selection reason. Otherwise the candidate's own error; an
    unparseable candidate without one gets 'parse_failed'.
    """
    own = F.when(F.length(error) > 0, error)
    return (F.when(selected_index.isNull(), reason)
            .when(~F.coalesce(parseable, F.lit(False)), F.coalesce(own, F.lit("parse_failed")))
            .otherwise(own))


def safe_rate(num: Column, den: Column) -> Column:
    """num / den, and 0.0 when the denominator is zero."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def repair_due(k: Column, selected_index: Column, parseable: Column, *, enabled: bool = True,
               repair_k: int = 8) -> Column:
    """Whether the pick of this row should be repaired."""
    return (F.lit(enabled) & (k == repair_k) & selected_index.isNotNull()
            & F.coalesce(parseable, F.lit(False)))


def repair_accept(repair_parseable: Column, original_score: Column, repair_score: Column,
                  margin: Column | float) -> Column:
    """Guard: the repair parses and does not fall below the original score by more than the margin.

    A missing score on either side rejects.
    """
    limit = margin if isinstance(margin, Column) else F.lit(float(margin))
    return (F.coalesce(repair_parseable, F.lit(False))
            & F.coalesce(repair_score >= original_score - limit, F.lit(False)))


def repair_source(repair_parseable: Column, accepted: Column | None = None) -> Column:
    """Where the final answer comes from; ``accepted`` given means the guarded policy."""
    if accepted is None:
        return F.when(repair_parseable, "repair").otherwise("original_fallback_repair_unparseable")
    return F.when(accepted, "repair_guard_accepted").otherwise("original_guard_rejected")


def repair_outcome(original_correct: Column, final_correct: Column) -> Column:
    return (F.when(final_correct & ~original_correct, "repair_helped")
            .when(original_correct & ~final_correct, "repair_hurt")
            .when(final_correct, "both_success")
            .otherwise("both_fail"))


def failure_type(solvable: Column, score: Column) -> Column:
    return (F.when(~solvable, "unsolvable_selected_candidate")
            .when(score >= HIGH_SCORE, "high_verifier_score_wrong_candidate")
            .when(score < LOW_SCORE, "low_verifier_score_wrong_candidate")
            .otherwise("solvable_non_equivalent_selected_candidate"))


def miss_type(oracle: Column, ranked_correct: Column, margin: Column) -> Column:
    return (F.when(~oracle, "no_equivalent_in_pool")
            .when(ranked_correct, "success")
            .when(margin <= NEAR_TIE_MARGIN, "near_tie_misranking")
            .otherwise("equivalent_in_pool_but_misranked"))


def gain_reason(greedy_parseable: Column, greedy_correct: Column, ranked_correct: Column,
                needs_extra_k: Column) -> Column:
    return (F.when(~ranked_correct, "none")
            .when(greedy_correct, "already_solved_by_greedy")
            .when(~greedy_parseable, "dominated_by_unparseable_first_greedy_behavior")
            .when(needs_extra_k, "requires_extra_k_candidates")
            .otherwise("within_pool_reranking"))


def paired_outcome(base_correct: Column, cand_correct: Column) -> Column:
    return (F.when(cand_correct & ~base_correct, "candidate_helped")
            .when(base_correct & ~cand_correct, "candidate_hurt")
            .when(base_correct, "both_success")
            .otherwise("both_fail"))


def change_cause(base_oracle: Column, cand_oracle: Column, outcome: Column) -> Column:
    """Whether a changed outcome comes from the pool (oracle) or from the selector."""
    return (F.when(cand_oracle & ~base_oracle, "oracle_availability_gain")
            .when(base_oracle & ~cand_oracle, "oracle_availability_loss")
            .when(~base_oracle, "both_no_oracle")
            .when(outcome == "candidate_helped", "selector_gain_with_oracle")
            .when(outcome == "candidate_hurt", "selector_loss_with_oracle")
            .otherwise("both_oracle_available_same_outcome"))


def template_family(name: Column) -> Column:
    """Second '_'-part of a template name, or the whole name if there is none."""
    return F.coalesce(F.get(F.split(name, "_"), F.lit(1)), name)


def md5_key(seed, *parts: Column) -> Column:
    """Seeded pseudo-random order key; the same on any partitioning and in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
