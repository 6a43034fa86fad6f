"""Selection policies: one candidate per task, prefix K and policy.

Plan shape: tasks and candidates meet in one join on the task key; ranks, the
explode over K and the aggregate per (task, K) all reuse that partitioning, so
every policy of every K comes out of the same shuffle. Only the first max(K)
candidates of a task enter, which bounds every group.

A row's rank, index and flags are packed into one long, so each pick is a plain
``min`` over longs and Spark can use hash aggregation. Columns a caller does not
use (ranks of other scorers, runner-up scores, ...) are pruned by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.functions.scalars import eval_error, md5_key

# Default sweep parameters.
K_VALUES = (1, 4, 8)
MARGINS = (0.02, 0.05, 0.10, 0.15)
ALPHAS = (0.0, 0.01, 0.03, 0.05)
TIE_MARGIN = 0.02
RANDOM_SEED = 42

_SLOT_BITS = 32          # rank << 32 | slot
_FLAG_BITS = 4           # slot = index << 4 | flags
_FLAGS = ("parseable", "correct", "solvable", "has_error")


def _slot() -> Column:
    flags = F.lit(0).cast("bigint")
    for bit, name in enumerate(_FLAGS):
        flags = flags + F.when(F.coalesce(F.col(name), F.lit(False)), 1 << bit).otherwise(0)
    return F.shiftleft(F.col("cand_idx").cast("bigint"), _FLAG_BITS) + flags


def _ranked(rank: Column) -> Column:
    return F.shiftleft(rank.cast("bigint"), _SLOT_BITS) + F.col("slot")


def _slot_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))


def _index(slot: Column) -> Column:
    return F.shiftright(slot, _FLAG_BITS).cast("int")


def _flag(slot: Column, name: str) -> Column:
    return F.coalesce(slot.bitwiseAND(F.lit(1 << _FLAGS.index(name))) != 0, F.lit(False))


def prefix_k(candidates: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """Each candidate once per K whose prefix contains it."""
    return (candidates.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .where(F.col("cand_idx") < F.col("k")))


def alpha_column(alpha: float) -> str:
    return f"penalty_{alpha:g}".replace(".", "_")


def pool_aggregates(tasks: DataFrame, candidates: DataFrame, ks: Sequence[int] = K_VALUES,
                    by: Sequence[str] = ("task_id",), alphas: Sequence[float] = (),
                    seed: int = RANDOM_SEED) -> DataFrame:
    """One row per (task, K) with the partial picks and scores all policies are built from.

    Tasks without candidates stay, with empty picks.
    """
    by = list(by)
    attrs = tasks.columns
    pool = candidates.where(F.col("cand_idx") < max(ks)).select(
        *by, "cand_idx", "parseable", "correct", "solvable", "score", "score_b", "error",
        (F.length(F.coalesce("error", F.lit(""))) > 0).alias("has_error"))
    rows = tasks.join(pool, by, "left").withColumn("slot", _slot())

    def order(expr: Column):
        return W.partitionBy(*by).orderBy(expr.desc_nulls_last(), "cand_idx")

    def next_in_prefix(k: int) -> Column:
        """Score of the next parseable candidate of the prefix in score order (same sort as the rank)."""
        member = F.col("parseable") & (F.col("cand_idx") < k)
        after = order(F.col("score")).rowsBetween(1, W.unboundedFollowing)
        return F.first(F.when(member, F.coalesce("score", F.lit(float("-inf")))), ignorenulls=True).over(after)

    rows = rows.select(
        "*", F.row_number().over(order(F.col("score"))).alias("_rank"),
        F.row_number().over(order(F.col("score_b"))).alias("_rank_b"),
        *[next_in_prefix(k).alias(f"_next_{k}") for k in ks],
        *[F.row_number().over(order(F.col("score") - F.lit(float(a)) * F.col("cand_idx"))).alias(f"_{alpha_column(a)}")
          for a in alphas if a])
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        _ranked(F.col("_rank")).alias("by_score"), _ranked(F.col("_rank_b")).alias("by_score_b"),
        *[_ranked(F.col(f"_{alpha_column(a)}" if a else "_rank")).alias(alpha_column(a)) for a in alphas],
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(f"_next_{k}", F.lit(float("-inf"))).alias("runner_up"))
                            for k in ks])).alias("_p")).select("*", "_p.*").drop("_p")

    inside = F.coalesce(F.col("cand_idx") < F.col("k"), F.lit(False))
    parse = inside & F.col("parseable")
    solve = parse & F.col("solvable")
    right, wrong = parse & F.col("correct"), parse & ~F.col("correct")
    draw = F.conv(F.substring(md5_key(seed, *[F.col(c) for c in by], F.col("k"), F.col("cand_idx")), 1, 15),
                  16, 10).cast("bigint")

    def pick(cond: Column, key: str = "slot") -> Column:
        return F.min(F.when(cond, F.col(key)))

    def score_at(cond: Column, key: str, what: str = "score") -> Column:
        return F.min_by(what, F.when(cond, F.col(key)))

    aggregates = [
        pick(inside).alias("first"),
        score_at(inside, "slot").alias("first_score"),
        pick(parse).alias("lowest"),
        score_at(parse, "slot").alias("lowest_score"),
        pick(parse, "by_score").alias("top"),
        score_at(parse, "by_score").alias("top_score"),
        score_at(parse, "by_score", "runner_up").alias("second_score"),
        pick(parse, "by_score_b").alias("top_b"),
        score_at(parse, "by_score_b", "score_b").alias("top_b_score"),
        pick(solve, "by_score").alias("solvable_top"),
        score_at(solve, "by_score").alias("solvable_top_score"),
        pick(solve).alias("solvable_lowest"),
        score_at(solve, "slot").alias("solvable_lowest_score"),
        F.min_by("slot", F.when(parse, draw)).alias("drawn"),
        F.min_by("score", F.when(parse, draw)).alias("drawn_score"),
        F.avg(F.when(parse, F.col("score"))).alias("score_mean"),
        F.stddev_pop(F.when(parse, F.col("score"))).alias("score_std"),
        F.min(F.when(parse, F.col("score"))).alias("score_min"),
        F.count(F.when(parse, F.col("score"))).alias("scored_count"),
        pick(right, "by_score").alias("best_correct"),
        score_at(right, "by_score").alias("best_correct_score"),
        pick(wrong, "by_score").alias("best_wrong"),
        score_at(wrong, "by_score").alias("best_wrong_score"),
        score_at(inside, "slot", "error").alias("first_error"),
        score_at(parse, "by_score", "error").alias("top_error"),
        F.min_by("error", F.when(parse, draw)).alias("drawn_error"),
        F.count_if(right).alias("parseable_correct_count"),
        F.count_if((F.col("cand_idx") < 4) & F.col("correct")).alias("correct_count_4"),
        F.count("cand_idx").alias("pool_size"),
        F.count_if(inside).alias("candidate_count"),
        F.count_if(parse).alias("parseable_count"),
        F.count_if(solve).alias("solvable_count"),
        F.count_if(inside & F.col("correct")).alias("correct_count"),
    ]
    for a in alphas:
        name = alpha_column(a)
        aggregates += [pick(parse, name).alias(name), score_at(parse, name).alias(f"{name}_score")]
    return (rows.groupBy(*attrs, "k").agg(*aggregates)
            .withColumn("oracle", F.col("correct_count") > 0))


# ---------------------------------------------------------------- policies

@dataclass(frozen=True)
class Policy:
    """A policy as expressions over the columns of ``pool_aggregates``."""
    slot: Column
    reason: Column
    score: Column


def _or_none(key: Column, none: str, reason: str | Column) -> Column:
    return F.when(key.isNull(), none).otherwise(reason)


NO_PARSE = "no_parseable_candidate"
NO_SOLVABLE = "no_parseable_solvable_candidate"


def greedy_first() -> Policy:
    c = F.col("first")
    return Policy(c, _or_none(c, "no_candidates", "first_candidate"), F.col("first_score"))


def random_parseable() -> Policy:
    c = F.col("drawn")
    return Policy(c, _or_none(c, NO_PARSE, "random_parseable"), F.col("drawn_score"))


def verifier_ranked() -> Policy:
    c = F.col("top")
    return Policy(_slot_of(c), _or_none(c, NO_PARSE, "highest_verifier_score"), F.col("top_score"))


def second_scorer_ranked() -> Policy:
    c = F.col("top_b")
    return Policy(_slot_of(c), _or_none(c, NO_PARSE, "highest_verifier_score"), F.col("top_b_score"))


def solvable_then_verifier() -> Policy:
    c = F.col("solvable_top")
    return Policy(_slot_of(c), _or_none(c, NO_SOLVABLE, "highest_verifier_score_among_solvable"),
                  F.col("solvable_top_score"))


def solvable_tiebreak(margin: float = TIE_MARGIN) -> Policy:
    """Best solvable candidate if its score is within the margin of the top score, else the top."""
    near = F.coalesce(F.col("top_score") - F.col("solvable_top_score") <= margin, F.lit(False))
    return Policy(
        F.when(near, _slot_of(F.col("solvable_top"))).otherwise(_slot_of(F.col("top"))),
        F.when(F.col("top").isNull(), NO_PARSE)
        .when(near, f"solvable_within_margin_{margin}").otherwise("no_solvable_near_top"),
        F.when(near, F.col("solvable_top_score")).otherwise(F.col("top_score")))


def first_solvable() -> Policy:
    c = F.col("solvable_lowest")
    return Policy(c, _or_none(c, NO_SOLVABLE, "first_parseable_solvable"), F.col("solvable_lowest_score"))


def _gap_text(high: Column, low: Column) -> Column:
    """Printed gap where a missing score stands for minus infinity."""
    return (F.when(high.isNull() & low.isNull(), "nan").when(low.isNull(), "inf").when(high.isNull(), "-inf")
            .otherwise(F.format_string("%.4f", high - low)))


def _beats(high: Column, low: Column, margin: float) -> Column:
    return high.isNotNull() & (low.isNull() | F.coalesce(high - low >= margin, F.lit(False)))


def margin_fallback(margin: float) -> Policy:
    """Top candidate if it beats the first candidate's score by the margin, else the first."""
    top, first = F.col("top_score"), F.col("first_score")
    take, gap = _beats(top, first, margin), _gap_text(top, first)
    none = F.col("top").isNull()
    return Policy(
        F.when(none, None).when(take, _slot_of(F.col("top"))).otherwise(F.col("first")),
        F.when(none, NO_PARSE).when(take, F.concat(F.lit("top_beats_greedy_by_"), gap))
        .otherwise(F.concat(F.lit("fallback_greedy_gap_"), gap)),
        F.when(none, None).when(take, top).otherwise(first))


def top_gap(margin: float) -> Policy:
    """Top candidate if it leads the runner-up by the margin (or is alone), else the first."""
    top, second = F.col("top_score"), F.col("second_score")
    alone = F.col("parseable_count") == 1
    take, gap = alone | _beats(top, second, margin), _gap_text(top, second)
    none = F.col("top").isNull()
    return Policy(
        F.when(none, None).when(take, _slot_of(F.col("top"))).otherwise(F.col("first")),
        F.when(none, NO_PARSE).when(alone, "single_parseable")
        .when(take, F.concat(F.lit("top_gap_"), gap))
        .otherwise(F.concat(F.lit("fallback_greedy_top_gap_"), gap)),
        F.when(none, None).when(take, top).otherwise(F.col("first_score")))


def scorer_agreement(fallback: str = "greedy") -> Policy:
    """The pick both scorers share; else the first, or the lowest parseable candidate."""
    a, b = _slot_of(F.col("top")), _slot_of(F.col("top_b"))
    none, same = F.col("top").isNull(), a == b
    lowest = fallback == "lowest_parseable"
    other, score = ("lowest", "lowest_score") if lowest else ("first", "first_score")
    return Policy(
        F.when(none, None).when(same, a).otherwise(F.col(other)),
        F.when(none, NO_PARSE).when(same, "scorers_agree")
        .otherwise("fallback_lowest_parseable" if lowest else "fallback_greedy_disagreement"),
        F.when(none, None).when(same, F.col("top_score")).otherwise(F.col(score)))


def score_normalized(method: str) -> Policy:
    """Highest normalised score. Both maps are increasing within a pool, so the top score wins."""
    c = F.col("top")
    return Policy(
        _slot_of(c),
        F.when(c.isNull(), NO_PARSE).when(F.col("scored_count") == 0, "no_finite_scores").otherwise(method),
        F.col("top_score"))


def normalized_value(method: str) -> Column:
    """Normalised score of the top candidate; a zero spread counts as one."""
    top = F.col("top_score")
    if method == "z":
        spread, base = F.col("score_std"), F.col("score_mean")
    else:
        spread, base = top - F.col("score_min"), F.col("score_min")
    return (top - base) / F.when(spread > 0, spread).otherwise(1.0)


def index_penalty(alpha: float) -> Policy:
    """Highest score minus alpha times index."""
    name = alpha_column(alpha)
    c = F.col(name)
    return Policy(_slot_of(c), _or_none(c, NO_PARSE, f"score_minus_{alpha:g}_index"), F.col(f"{name}_score"))


def basic_policies() -> dict[str, Policy]:
    return {"greedy_first": greedy_first(), "random_parseable": random_parseable(),
            "verifier_ranked": verifier_ranked()}


def search_policies(tie_margin: float = TIE_MARGIN) -> dict[str, Policy]:
    return {"verifier_ranked": verifier_ranked(), "solvable_then_verifier": solvable_then_verifier(),
            "verifier_then_solvable_tiebreak": solvable_tiebreak(tie_margin),
            "parse_solvable_index": first_solvable()}


def replay_policies(margins: Sequence[float] = MARGINS, alphas: Sequence[float] = ALPHAS) -> dict[str, Policy]:
    out = basic_policies()
    out["scorer_agreement_greedy"] = scorer_agreement("greedy")
    out["scorer_agreement_lowest_parseable"] = scorer_agreement("lowest_parseable")
    out["score_normalized_z"] = score_normalized("z")
    out["score_normalized_minmax"] = score_normalized("minmax")
    for m in margins:
        out[f"verifier_margin_fallback_m{m:g}"] = margin_fallback(m)
        out[f"verifier_top_gap_m{m:g}"] = top_gap(m)
    for a in alphas:
        out[f"hybrid_rank_index_penalty_a{a:g}"] = index_penalty(a)
    return out


# ---------------------------------------------------------------- results

def pick_struct(key: Column, reason: Column, score: Column, error: Column) -> Column:
    """A pick with its flags as one struct; ``key`` is any pick column of the aggregates."""
    slot = _slot_of(key)
    parseable = _flag(slot, "parseable")
    return F.struct(
        _index(slot).alias("selected_index"), reason.alias("reason"), parseable.alias("parseable"),
        _flag(slot, "correct").alias("correct"), score.alias("score"),
        eval_error(_index(slot), reason, parseable, error).alias("error"))


def pick_index(key: str) -> Column:
    return _index(_slot_of(F.col(key)))



def select(aggregates: DataFrame, policies: dict[str, Policy], keep: Sequence[str], *,
           base: str | None = None, reasons: bool = True) -> DataFrame:
    """Long form: one row per kept key, K and policy.

    ``base`` adds the pick of that policy of the same row, which later comparisons
    need. Summaries leave the reason texts out with ``reasons=False``.
    """
    picks = F.array(*[
        F.struct(F.lit(name).alias("policy"), p.slot.cast("bigint").alias("slot"),
                 *([p.reason.alias("reason")] if reasons else []), p.score.cast("double").alias("selected_score"))
        for name, p in policies.items()])
    stats = ["candidate_count", "parseable_count", "solvable_count", "correct_count", "oracle"]
    extra = []
    if base is not None:
        slot = policies[base].slot
        extra = [_index(slot).alias("baseline_index"), _flag(slot, "correct").alias("baseline_correct")]
    rows = aggregates.select(*keep, "k", *stats, *extra, F.explode(picks).alias("pick"))
    slot = F.col("pick.slot")
    return rows.select(
        *keep, "k", "pick.policy", _index(slot).alias("selected_index"), *(["pick.reason"] if reasons else []),
        *[_flag(slot, name).alias(f"selected_{name}") for name in _FLAGS],
        "pick.selected_score", *stats, *(["baseline_index", "baseline_correct"] if base else []))


def select_wide(aggregates: DataFrame, policies: dict[str, Policy], keep: Sequence[str]) -> DataFrame:
    """Wide form: the selected index of every policy as a column."""
    return aggregates.select(
        *keep, "k", *[_index(p.slot).alias(name.replace(".", "_")) for name, p in policies.items()])


def pool_oracle(aggregates: DataFrame, keep: Sequence[str]) -> DataFrame:
    return aggregates.select(*keep, "k", "parseable_count", "correct_count", "solvable_count", "oracle")


def score_gaps(aggregates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Top, second and first score with their gaps; a missing score gives a NULL gap."""
    return aggregates.select(
        *keep, "k", "top_score", "second_score", "first_score",
        (F.col("top_score") - F.col("second_score")).alias("top_second_gap"),
        (F.col("top_score") - F.col("first_score")).alias("top_first_gap"))


def repair_targets(aggregates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ranked pick where it is wrong; tasks without a pick or with a correct one drop out."""
    slot = _slot_of(F.col("top"))
    return (aggregates.where(F.col("top").isNotNull() & ~_flag(slot, "correct"))
            .select(*keep, "k", _index(slot).alias("selected_index"),
                    F.col("top_score").alias("selected_score"),
                    _flag(slot, "solvable").alias("selected_solvable")))
