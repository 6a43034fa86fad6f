"""Expected results of the selection queries."""

from oracle import shared  # noqa: F401  (registers the shared views)
from oracle.views import q

SQL = {}
_COLS = """SELECT task_id, k, policy, selected_index, reason, parseable AS selected_parseable, correct AS selected_correct,
       solvable AS selected_solvable, score AS selected_score FROM {}"""

for _name, _view in {
        "select_first": "greedy", "select_random": "drawn", "select_ranked": "ranked",
        "select_solvable_ranked": "solvable_ranked", "select_solvable_tiebreak": "tiebreak",
        "select_first_solvable": "first_solvable", "select_margin_fallback": "margin_policies",
        "select_top_gap": "gap_policies", "select_agreement": "agreement", "select_index_penalty": "penalty"}.items():
    SQL[_name] = q(_COLS.format(_view), _view)

SQL["select_zscore"] = q("SELECT task_id, k, selected_index, reason, round(norm, 6) AS normalized FROM norm_z", "norm_z")
SQL["select_minmax"] = q("SELECT task_id, k, selected_index, reason, round(norm, 6) AS normalized FROM norm_minmax", "norm_minmax")
SQL["select_repair_target"] = q("""
SELECT task_id, k, selected_index, score AS selected_score, solvable AS selected_solvable
FROM ranked WHERE k = 8 AND selected_index IS NOT NULL AND NOT correct""", "ranked")

_NAMES = (["greedy_first", "random_parseable", "verifier_ranked", "scorer_agreement_greedy", "scorer_agreement_lowest_parseable",
           "score_normalized_z", "score_normalized_minmax"]
          + [f"verifier_{p}_m{m}" for p in ("margin_fallback", "top_gap") for m in ("0.02", "0.05", "0.1", "0.15")]
          + [f"hybrid_rank_index_penalty_a{a}" for a in ("0", "0.01", "0.03", "0.05")])
_SEARCH = ["solvable_then_verifier", "verifier_then_solvable_tiebreak", "parse_solvable_index"]
SQL["policy_sweep"] = q(
    "SELECT task_id, k, " + ", ".join(
        f"max(selected_index) FILTER (policy = '{n}') AS \"{n.replace('.', '_')}\"" for n in _NAMES + _SEARCH)
    + " FROM (SELECT task_id, k, policy, selected_index FROM replay UNION ALL"
      " SELECT task_id, k, policy, selected_index FROM search WHERE policy <> 'verifier_ranked') GROUP BY task_id, k",
    "replay", "search")
SQL["pool_oracle"] = q("SELECT task_id, k, parseable_count, correct_count, solvable_count, oracle FROM pool_stats", "pool_stats")
SQL["score_gaps"] = q("SELECT * FROM gaps", "gaps")
