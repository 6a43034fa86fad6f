"""Queries on selection policies and pool facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.operators import selection as sel
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query

COLUMNS = ("task_id", "k", "policy", "selected_index", "reason", "selected_parseable", "selected_correct",
           "selected_solvable", "selected_score")


def _picks(x: Inputs, policies: dict[str, sel.Policy], alphas=()) -> DataFrame:
    return x.picks(policies, alphas=alphas).select(*COLUMNS)


def _single(name: str, policy: str, make) -> None:
    @query(name)
    def build(x: Inputs) -> DataFrame:
        return _picks(x, {policy: make()})


_single("select_first", "greedy_first", sel.greedy_first)
_single("select_random", "random_parseable", sel.random_parseable)
_single("select_ranked", "verifier_ranked", sel.verifier_ranked)
_single("select_solvable_ranked", "solvable_then_verifier", sel.solvable_then_verifier)
_single("select_solvable_tiebreak", "verifier_then_solvable_tiebreak", sel.solvable_tiebreak)
_single("select_first_solvable", "parse_solvable_index", sel.first_solvable)


@query("select_margin_fallback")
def select_margin_fallback(x: Inputs) -> DataFrame:
    return _picks(x, {f"verifier_margin_fallback_m{m:g}": sel.margin_fallback(m) for m in sel.MARGINS})


@query("select_top_gap")
def select_top_gap(x: Inputs) -> DataFrame:
    return _picks(x, {f"verifier_top_gap_m{m:g}": sel.top_gap(m) for m in sel.MARGINS})


@query("select_agreement")
def select_agreement(x: Inputs) -> DataFrame:
    return _picks(x, {f"scorer_agreement_{f}": sel.scorer_agreement(f) for f in ("greedy", "lowest_parseable")})


def _normalized(x: Inputs, method: str) -> DataFrame:
    p = sel.score_normalized(method)
    return x.aggregates().select(
        "task_id", "k", sel.pick_index("top").alias("selected_index"), p.reason.alias("reason"),
        F.round(sel.normalized_value(method), 6).alias("normalized"))


@query("select_zscore")
def select_zscore(x: Inputs) -> DataFrame:
    return _normalized(x, "z")


@query("select_minmax")
def select_minmax(x: Inputs) -> DataFrame:
    return _normalized(x, "minmax")


@query("select_index_penalty")
def select_index_penalty(x: Inputs) -> DataFrame:
    return _picks(x, {f"hybrid_rank_index_penalty_a{a:g}": sel.index_penalty(a) for a in sel.ALPHAS}, sel.ALPHAS)


@query("select_repair_target")
def select_repair_target(x: Inputs) -> DataFrame:
    return sel.repair_targets(x.aggregates(ks=(8,)), ["task_id"])


@query("policy_sweep")
def policy_sweep(x: Inputs) -> DataFrame:
    """All policies, margins and alphas for every K, one column of picks per policy."""
    return sel.select_wide(x.aggregates(alphas=sel.ALPHAS), {**sel.replay_policies(), **sel.search_policies()}, ["task_id"])


@query("pool_oracle")
def pool_oracle(x: Inputs) -> DataFrame:
    return sel.pool_oracle(x.aggregates(), ["task_id"])


@query("score_gaps")
def score_gaps(x: Inputs) -> DataFrame:
    return sel.score_gaps(x.aggregates(), ["task_id"])
