"""Selection rules on hand-made pools."""

import pytest

from poolwise.operators import selection as sel


def picks(pools, rows, policy, k=8, tasks=None, alphas=()):
    t, c = pools(rows, tasks)
    agg = sel.pool_aggregates(t, c, (k,), alphas=alphas)
    out = sel.select(agg, {"p": policy}, ["task_id"]).collect()
    return {r.task_id: (r.selected_index, r.reason) for r in out}


def row(i, score, parseable=True, correct=False, solvable=False, score_b=None, task=1):
    return (task, i, parseable, correct, solvable, score, score_b)


def test_empty_pool_selects_nothing(pools):
    rows = [row(0, .5, task=2)]
    assert picks(pools, rows, sel.verifier_ranked(), tasks=[1, 2])[1] == (None, "no_parseable_candidate")
    assert picks(pools, rows, sel.greedy_first(), tasks=[1, 2])[1] == (None, "no_candidates")
    assert picks(pools, rows, sel.solvable_then_verifier(), tasks=[1])[1] == (None, "no_parseable_solvable_candidate")


def test_nothing_parseable(pools):
    rows = [row(0, .9, parseable=False)]
    assert picks(pools, rows, sel.verifier_ranked())[1][0] is None
    assert picks(pools, rows, sel.greedy_first())[1] == (0, "first_candidate")
    assert picks(pools, rows, sel.random_parseable())[1] == (None, "no_parseable_candidate")


def test_unparseable_high_score_is_ignored(pools):
    assert picks(pools, [row(0, .99, parseable=False), row(1, .2)], sel.verifier_ranked())[1][0] == 1


def test_solvable_is_required(pools):
    rows = [row(0, .9), row(1, .4, solvable=True)]
    assert picks(pools, rows, sel.solvable_then_verifier())[1][0] == 1


@pytest.mark.parametrize("second, want", [(.89, 1), (.70, 0)])
def test_solvable_tiebreak_only_inside_margin(pools, second, want):
    rows = [row(0, .90), row(1, second, solvable=True)]
    assert picks(pools, rows, sel.solvable_tiebreak(.02))[1][0] == want


def test_first_solvable_takes_lowest_index(pools):
    rows = [row(0, .1), row(1, .2, solvable=True), row(2, .9, solvable=True)]
    assert picks(pools, rows, sel.first_solvable())[1][0] == 1


def test_ties_take_the_lower_index(pools):
    assert picks(pools, [row(0, .1), row(1, .5), row(2, .5)], sel.verifier_ranked())[1][0] == 1


def test_missing_score_ranks_last_but_counts(pools):
    assert picks(pools, [row(0, None), row(1, -5.0)], sel.verifier_ranked())[1][0] == 1
    assert picks(pools, [row(0, None), row(1, None)], sel.verifier_ranked())[1][0] == 0
    assert picks(pools, [row(0, None)], sel.score_normalized("z"))[1] == (0, "no_finite_scores")


AGREE = [row(0, .2, score_b=.2), row(1, .9, correct=True, score_b=.8), row(2, None, parseable=False)]
DISAGREE = [row(0, .2, score_b=.9), row(1, .9, correct=True, score_b=.1)]


@pytest.mark.parametrize("rows, policy, want", [
    (AGREE, ("margin_fallback", .1), 1), (AGREE, ("margin_fallback", 1.0), 0), (AGREE, ("top_gap", .1), 1),
    (AGREE, ("scorer_agreement", "greedy"), 1), (DISAGREE, ("scorer_agreement", "greedy"), 0),
    (DISAGREE, ("scorer_agreement", "lowest_parseable"), 0), (DISAGREE, ("score_normalized", "z"), 1),
    (DISAGREE, ("index_penalty", 1.0), 0)])
def test_replay_policies(pools, rows, policy, want):
    make, argument = policy
    assert picks(pools, rows, getattr(sel, make)(argument), alphas=(1.0,))[1][0] == want


def test_margin_fallback_with_missing_scores(pools):
    both = picks(pools, [row(0, None), row(1, None)], sel.margin_fallback(.1))[1]
    assert both == (0, "fallback_greedy_gap_nan")
    first = picks(pools, [row(0, None, parseable=False), row(1, .1)], sel.margin_fallback(.5))[1]
    assert first == (1, "top_beats_greedy_by_inf")


def test_top_gap_cases(pools):
    assert picks(pools, [row(0, .3, parseable=False), row(1, .1)], sel.top_gap(.5))[1] == (1, "single_parseable")
    assert picks(pools, [row(0, .1), row(1, None), row(2, .2)], sel.top_gap(.5))[1] == (0, "fallback_greedy_top_gap_0.1000")
    assert picks(pools, [row(0, None), row(1, .2)], sel.top_gap(.5))[1] == (1, "top_gap_inf")


def test_prefix_limits_the_pool(pools):
    t, c = pools([row(0, .1), row(1, .2), row(4, .9), row(9, 1.0)])
    out = sel.select(sel.pool_aggregates(t, c, (1, 4, 8)), {"p": sel.verifier_ranked()}, ["task_id"]).collect()
    assert {r.k: r.selected_index for r in out} == {1: 0, 4: 1, 8: 4}


def test_second_score_respects_the_prefix(pools):
    t, c = pools([row(0, .9), row(1, .1), row(5, .8)])
    out = sel.score_gaps(sel.pool_aggregates(t, c, (4, 8)), ["task_id"]).collect()
    assert {r.k: r.second_score for r in out} == {4: .1, 8: .8}


def test_repair_target_only_for_wrong_picks(pools):
    t, c = pools([row(0, .9, correct=True), row(1, .1), row(0, .9, task=2), row(1, .1, correct=True, task=2)])
    out = sel.repair_targets(sel.pool_aggregates(t, c, (8,)), ["task_id"]).collect()
    assert [(r.task_id, r.selected_index) for r in out] == [(2, 0)]


def test_a_very_large_pool_gives_the_same_picks(pools):
    """Candidates beyond the prefix do not matter, however many a task has."""
    many = [row(i, (i * 37 % 101) / 100) for i in range(5000)]
    assert picks(pools, many, sel.verifier_ranked()) == picks(pools, many[:8], sel.verifier_ranked())


def test_policies_agree_where_they_must(spark, sf_dir):
    from poolwise.plans.inputs import Inputs
    wide = sel.select_wide(Inputs(spark, sf_dir).aggregates(alphas=(0.0,)), {
        "ranked": sel.verifier_ranked(), "z": sel.score_normalized("z"), "minmax": sel.score_normalized("minmax"),
        "alpha0": sel.index_penalty(0.0)}, ["task_id"])
    same = "ranked <=> z AND ranked <=> minmax AND ranked <=> alpha0"
    assert wide.where(f"NOT ({same})").count() == 0
