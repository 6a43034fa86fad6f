"""Expected results of the metric, repair, failure and gate queries."""

from oracle.views import define, q

SQL = {}

COUNTS = """count(*) AS total, count_if(parseable) AS parse_count, count_if(solvable) AS solve_count,
  count_if(correct) AS equiv_count, count_if(has_error) AS error_count"""
RATES = """parse_count / total AS parse_rate, solve_count / total AS solve_rate, equiv_count / total AS equiv_rate,
  equiv_count / greatest(parse_count, 1) AS equiv_given_parse"""


def metrics(by: str, source: str) -> str:
    return f"SELECT *, {RATES} FROM (SELECT {by}, {COUNTS} FROM {source} GROUP BY {by})"


SQL["batch_metrics"] = q(metrics("k", "ranked"), "ranked")
define("strata", """
SELECT b.*, unnest(['all', concat('domain=', domain), concat('style=', style), concat('init=', split_part(style, '/', 1)),
                    concat('goal=', split_part(style, '/', 2))]) AS stratum
FROM basic b JOIN tasks USING (task_id)""", "basic", "tasks")
SQL["stratified_metrics"] = q(metrics("k, policy, stratum", "strata"), "strata")
SQL["policy_summary"] = q(f"""
SELECT *, {RATES} FROM (SELECT k, policy, {COUNTS}, sum(parseable_count) / count(*) AS avg_parseable_candidates,
  sum(correct_count) / count(*) AS avg_equivalent_candidates, count_if(oracle) / count(*) AS oracle_bestofk_equiv_rate
  FROM basic JOIN pool_stats USING (task_id, k) GROUP BY k, policy)""", "basic", "pool_stats")
SQL["slice_metrics"] = q(metrics("k, policy, slice", "(SELECT s.*, unnest([domain, style]) AS slice FROM search s JOIN tasks USING (task_id))"),
                         "search", "tasks")
define("replay_runs", """
SELECT seed, k, policy, count(*) AS total, count_if(parseable) AS parse_count, count_if(correct) AS equiv_count
FROM replay JOIN tasks USING (task_id) GROUP BY seed, k, policy""", "replay", "tasks")
define("search_runs", """
SELECT seed, k, policy, count(*) AS total, count_if(parseable) AS parse_count, count_if(correct) AS equiv_count,
       count_if(correct) / count(*) AS equiv_rate
FROM search JOIN tasks USING (task_id) GROUP BY seed, k, policy""", "search", "tasks")
SQL["macro_mean"] = q("""
SELECT k, policy, count(*) AS runs, round(avg(parse_count / total), 9) AS mean_parse_rate, round(avg(equiv_count / total), 9) AS mean_equiv_rate,
       round(avg(equiv_count / greatest(parse_count, 1)), 9) AS mean_equiv_given_parse
FROM replay_runs GROUP BY k, policy""", "replay_runs")
MICRO = """
SELECT k, policy, CAST(sum(total) AS BIGINT) AS total, CAST(sum(parse_count) AS BIGINT) AS parse_count, CAST(sum(equiv_count) AS BIGINT) AS equiv_count,
       sum(parse_count) / sum(total) AS parse_rate, sum(equiv_count) / sum(total) AS equiv_rate
FROM search_runs GROUP BY k, policy"""
SQL["micro_rate"] = q(MICRO, "search_runs")
SQL["latency_summary"] = q("""
SELECT model, count(*) AS calls, count(error) AS errors, round(sum(latency_sec), 6) AS latency_total_sec, round(avg(latency_sec), 6) AS latency_mean_sec
FROM candidates GROUP BY model""", "candidates")

define("diagnostics", """
SELECT g.task_id, g.k, t.domain, t.style, round(top_second_gap, 9) AS top_second_gap, round(top_first_gap, 9) AS top_first_gap,
       CASE WHEN r.correct THEN 'ranked_correct' WHEN s.oracle THEN 'oracle_positive_miss' ELSE 'no_equivalent_in_pool' END AS bucket
FROM gaps g JOIN ranked r USING (task_id, k) JOIN pool_stats s USING (task_id, k) JOIN tasks t USING (task_id)""",
       "gaps", "ranked", "pool_stats", "tasks")
SQL["margin_quantiles"] = q("""
SELECT bucket, gap, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min,
       max(value) FILTER (rn = CAST(round_even((n - 1) * 0.25::DOUBLE, 0) AS BIGINT)) AS p25,
       max(value) FILTER (rn = CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT)) AS median,
       max(value) FILTER (rn = CAST(round_even((n - 1) * 0.75::DOUBLE, 0) AS BIGINT)) AS p75, max(value) AS max
FROM (SELECT *, row_number() OVER (PARTITION BY bucket, gap ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY bucket, gap) AS n
      FROM (SELECT bucket, 'top_second_gap' AS gap, top_second_gap AS value FROM diagnostics UNION ALL
            SELECT bucket, 'top_first_gap', top_first_gap FROM diagnostics) WHERE value IS NOT NULL)
GROUP BY bucket, gap""", "diagnostics")
SQL["bucket_counts"] = q("""
SELECT facet, value, count(*) AS n FROM (SELECT 'bucket' AS facet, bucket AS value FROM diagnostics
  UNION ALL SELECT 'domain', concat(domain, ':', bucket) FROM diagnostics
  UNION ALL SELECT 'style', concat(style, ':', bucket) FROM diagnostics) GROUP BY facet, value""", "diagnostics")

# Repairs.
OUTCOME = """CASE WHEN {f} AND NOT original_correct THEN 'repair_helped' WHEN original_correct AND NOT {f} THEN 'repair_hurt'
  WHEN {f} THEN 'both_success' ELSE 'both_fail' END"""


def final(margin: float | None) -> str:
    ok = "repair_parseable" if margin is None else f"(repair_parseable AND coalesce(repair_score >= original_score - {margin}::DOUBLE, false))"
    return f"""SELECT *, {OUTCOME.format(f='fin')} AS outcome
      FROM (SELECT *, {ok} AS accepted, CASE WHEN {ok} THEN repair_correct ELSE original_correct END AS fin FROM repair_rows)"""


define("free_repair", final(None), "repair_rows")
define("guarded_repair", final(0.05), "repair_rows")
define("pilot", f"SELECT *, {OUTCOME.format(f='repair_correct')} AS outcome FROM repair_rows", "repair_rows")


def repair_metrics(by: str, source: str, parse: str, correct: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT *, total - helped - hurt AS tied, original_equiv_count / total AS original_equiv_rate, repair_parse_count / total AS repair_parse_rate,
      repair_solvable_count / total AS repair_solvable_rate, repair_equiv_count / total AS repair_equiv_rate,
      repair_equiv_count / greatest(repair_parse_count, 1) AS repair_equiv_given_parse
    FROM (SELECT {head}count(*) AS total, count_if(original_correct) AS original_equiv_count, count_if({parse}) AS repair_parse_count,
      count_if(repair_solvable) AS repair_solvable_count, count_if({correct}) AS repair_equiv_count,
      count_if(outcome = 'repair_helped') AS helped, count_if(outcome = 'repair_hurt') AS hurt FROM {source} {group})"""


SQL["repair_metrics"] = q(repair_metrics("policy, domain", """(SELECT 'verifier_ranked_repair' AS policy, * FROM free_repair
  UNION ALL SELECT 'verifier_ranked_repair_guarded', * FROM guarded_repair)""", "true", "fin"), "free_repair", "guarded_repair")
SQL["outcome_counts"] = q("SELECT outcome, domain, style, count(*) AS n FROM free_repair GROUP BY CUBE (outcome, domain, style)", "free_repair")

define("swept", f"""
SELECT *, {OUTCOME.format(f='fin')} AS outcome FROM (
  SELECT *, CASE WHEN ok THEN repair_correct ELSE original_correct END AS fin FROM (
    SELECT *, repair_parseable AND coalesce(repair_score >= original_score - margin, false) AS ok
    FROM (SELECT *, unnest([0.0, 0.01, 0.02, 0.05])::DOUBLE AS margin FROM repair_rows)))""", "repair_rows")
SQL["guard_sweep"] = q("""
SELECT *, repair_rows - accepted AS rejected, repair_rows - helped - hurt AS tied, accepted / repair_rows AS accept_rate,
       parse_count / repair_rows AS repair_parse_rate, final_equiv_count / repair_rows AS final_equiv_rate
FROM (SELECT margin, slice, count(*) AS repair_rows, count_if(ok) AS accepted, count_if(repair_parseable) AS parse_count, count_if(fin) AS final_equiv_count,
        count_if(outcome = 'repair_helped') AS helped, count_if(outcome = 'repair_hurt') AS hurt,
        count_if(outcome = 'both_success') AS both_success, count_if(outcome = 'both_fail') AS both_fail
      FROM (SELECT *, unnest(['all', concat('domain=', domain), concat('style=', style)]) AS slice FROM swept) GROUP BY margin, slice)""", "swept")

define("seed_rates", """
SELECT seed, count(*) AS total, count_if(correct) AS hits, count_if(correct) / count(*) AS equiv_rate
FROM ranked JOIN tasks USING (task_id) WHERE k = 8 GROUP BY seed""", "ranked", "tasks")
define("guard_seeds", """
SELECT margin, seed, helped, hurt, total, equiv_rate AS baseline_rate, (hits + helped - hurt) / total AS guarded_rate,
       (hits + helped - hurt) / total - equiv_rate AS delta
FROM (SELECT margin, seed, count_if(outcome = 'repair_helped') AS helped, count_if(outcome = 'repair_hurt') AS hurt FROM swept GROUP BY margin, seed)
JOIN seed_rates USING (seed)""", "swept", "seed_rates")
SQL["guard_by_seed"] = q("SELECT margin, seed, helped, hurt, total, baseline_rate, guarded_rate, round(delta, 9) AS delta FROM guard_seeds", "guard_seeds")
define("guard_mean", """
SELECT margin, round(avg(baseline_rate), 9) AS mean_baseline_rate, round(avg(guarded_rate), 9) AS mean_guarded_rate, round(avg(delta), 9) AS mean_delta,
       CAST(sum(helped) AS BIGINT) AS total_helped, CAST(sum(hurt) AS BIGINT) AS total_hurt FROM guard_seeds GROUP BY margin""", "guard_seeds")
SQL["guard_means"] = q("SELECT * FROM guard_mean", "guard_mean")
SQL["guard_choose"] = q("""SELECT margin, mean_guarded_rate, total_helped, total_hurt FROM guard_mean
ORDER BY mean_guarded_rate DESC, total_hurt, margin LIMIT 1""", "guard_mean")

define("augmented", """
SELECT seed, total, coalesce(helped, 0) AS helped, equiv_rate AS baseline_rate, (hits + coalesce(helped, 0)) / total AS augmented_rate,
       coalesce(helped, 0) / total AS delta
FROM seed_rates LEFT JOIN (SELECT seed, count_if(outcome = 'repair_helped') AS helped FROM pilot WHERE NOT original_correct GROUP BY seed) USING (seed)""",
       "seed_rates", "pilot")
SQL["augmented_rate"] = q("SELECT seed, total, helped, baseline_rate, round(augmented_rate, 9) AS augmented_rate, round(delta, 9) AS delta FROM augmented", "augmented")

define("targets", """
SELECT task_id, t.seed, t.domain, t.style, t.template_id, k, selected_index, score AS selected_score, solvable AS selected_solvable
FROM ranked JOIN tasks t USING (task_id) WHERE k = 8 AND selected_index IS NOT NULL AND NOT correct""", "ranked", "tasks")
SQL["repair_cases"] = q("""
SELECT * EXCLUDE (template_id) FROM targets ORDER BY domain <> 'alpha', style <> 'abstract/abstract', coalesce(selected_score, 0) DESC, seed, task_id LIMIT 50""",
                        "targets")
SQL["fresh_repair_order"] = q("""
SELECT seed, CAST(rn AS INT) AS rn, task_id, domain, style, template_id, selected_score FROM (SELECT *, row_number() OVER (PARTITION BY seed
  ORDER BY domain = 'alpha' DESC, style = 'abstract/abstract' DESC, selected_score DESC NULLS LAST, template_id DESC, task_id DESC) AS rn FROM targets)
WHERE rn <= 30""", "targets")

# Failure analysis.
SQL["failure_cases"] = q("""
SELECT c.task_id, c.k, oracle_available, oracle_available_at_k4, needs_extra_k, parseable_count, correct_count, parseable_correct_count,
       best_correct_index, best_correct_score, best_wrong_index, best_wrong_score, margin, greedy_index, greedy_correct, random_index, random_correct,
       ranked_index, ranked_correct, CASE WHEN greedy_index IS NULL THEN 'no_candidates' WHEN NOT greedy_parseable THEN coalesce(f.error, 'parse_failed') END AS greedy_error,
       miss_type, gain_reason
FROM cases c LEFT JOIN candidates f ON f.task_id = c.task_id AND f.cand_idx = c.greedy_index""", "cases", "candidates")
SQL["miss_breakdown"] = q("""
SELECT k, slice, count(*) AS rows, count_if(oracle_available) AS oracle_positive_rows, count_if(ranked_correct) AS verifier_hits,
       count_if(is_miss) AS verifier_oracle_misses
FROM (SELECT *, unnest([domain, style]) AS slice FROM cases) GROUP BY k, slice""", "cases")
define("recurring", """
SELECT seed, count_if(is_miss) AS misses, count_if(is_miss AND domain = 'alpha') AS domain_alpha_misses, count_if(is_miss AND domain = 'beta') AS domain_beta_misses,
       count_if(is_miss AND style = 'abstract/abstract') AS style_abstract_abstract_misses,
       count_if(is_miss AND style = 'explicit/explicit') AS style_explicit_explicit_misses
FROM cases WHERE k = 8 GROUP BY seed""", "cases")
SQL["recurrence"] = q("SELECT * FROM recurring", "recurring")
SQL["next_step_evidence"] = q("""
SELECT *, CASE WHEN domain_ratio >= 0.7 AND style_ratio >= 0.5 AND moderate_gap_ratio >= 0.6 AND recurrence_support THEN 'focused_mining'
  ELSE 'ranking_objective_change' END AS recommendation
FROM (SELECT count(*) AS miss_count, count_if(domain = 'alpha') / count(*) AS domain_ratio, count_if(style = 'abstract/abstract') / count(*) AS style_ratio,
        count_if(margin <= 0.1::DOUBLE) / count(*) AS moderate_gap_ratio FROM cases WHERE is_miss),
     (SELECT bool_or(domain_alpha_misses >= domain_beta_misses AND style_abstract_abstract_misses >= style_explicit_explicit_misses) AS recurrence_support FROM recurring)""",
                               "cases", "recurring")
SQL["high_value_misses"] = q("""
SELECT task_id, k, style, parseable_correct_count, margin, miss_type FROM cases WHERE is_miss
ORDER BY k <> 8, style <> 'abstract/abstract', parseable_correct_count DESC, coalesce(margin, 999), task_id, k LIMIT 8""", "cases")

# Gates.
SQL["gate_search"] = q("""
SELECT *, k8_better AND k4_ok AND more_helped AND several_pools AS accepted FROM (
SELECT p.policy, p.rate8, p.rate4, w.pool_wins, e.helped, e.hurt, b.rate8 AS base8, b.rate4 AS base4, p.rate8 > b.rate8 AS k8_better,
       p.rate4 >= b.rate4 - 0.01::DOUBLE AS k4_ok, e.helped > e.hurt AS more_helped, w.pool_wins > 1 AS several_pools
FROM rates p JOIN (SELECT * FROM rates WHERE policy = 'verifier_ranked') b ON p.policy <> b.policy
JOIN (SELECT a.policy, count_if(a.equiv_rate > b.equiv_rate) AS pool_wins FROM search_runs a JOIN search_runs b ON a.seed = b.seed AND a.k = 8 AND b.k = 8
      AND b.policy = 'verifier_ranked' GROUP BY a.policy) w ON w.policy = p.policy
JOIN (SELECT policy, count_if(helped) AS helped, count_if(hurt) AS hurt FROM search_vs WHERE k = 8 GROUP BY policy) e ON e.policy = p.policy)""",
    "search_runs", "search_vs",
    micro=MICRO, rates="SELECT policy, max(equiv_rate) FILTER (k = 8) AS rate8, max(equiv_rate) FILTER (k = 4) AS rate4 FROM micro GROUP BY policy")
H2H = """SELECT max(wins) FILTER (k = 4) AS wins4, max(losses) FILTER (k = 4) AS losses4, round(max(mean_delta) FILTER (k = 4), 9) AS mean_delta4,
  max(wins) FILTER (k = 8) AS wins8, max(losses) FILTER (k = 8) AS losses8, round(max(mean_delta) FILTER (k = 8), 9) AS mean_delta8 FROM h2h"""
SQL["gate_multiseed"] = q(f"""
SELECT *, k4_wins AND k4_delta AND k8_wins AND k8_delta AS accepted FROM (SELECT *, wins4 >= losses4 AS k4_wins, mean_delta4 > 0 AS k4_delta,
  wins8 >= losses8 AS k8_wins, mean_delta8 > 0 AS k8_delta FROM ({H2H}))""", "h2h")
SQL["gate_fixed_pool"] = q(f"""
SELECT *, k8_delta AND k4_delta AND k8_wins AS accepted FROM (SELECT *, mean_delta8 > 0 AS k8_delta, mean_delta4 >= -0.01 AS k4_delta,
  wins8 > losses8 AS k8_wins FROM ({H2H}))""", "h2h")
SQL["gate_repair_pilot"] = q(f"""
SELECT *, gain_ok AND more_helped AND parse_ok AND families_ok AS accepted FROM (
SELECT total, original_equiv_rate, repair_equiv_rate, repair_parse_rate, helped, hurt, helped_families,
       repair_equiv_rate - original_equiv_rate >= 0.1::DOUBLE AS gain_ok, helped > hurt AS more_helped, repair_parse_rate >= 0.8 AS parse_ok,
       helped >= 2 AND helped_families > 1 AS families_ok
FROM ({repair_metrics("", "pilot", "repair_parseable", "repair_correct")}),
     (SELECT count(DISTINCT CASE WHEN t.goal_is_abstract = 1 THEN concat('t', t.template_id) ELSE t.domain END) AS helped_families
      FROM pilot p JOIN tasks t USING (task_id) WHERE p.outcome = 'repair_helped'))""", "pilot", "tasks")
SQL["gate_domain_repair"] = q(f"""
SELECT *, parse_ok AND equiv_ok AND more_helped AS accepted FROM (SELECT domain, total, repair_parse_rate, repair_equiv_rate, helped, hurt,
  repair_parse_rate >= 0.8 AS parse_ok, repair_equiv_rate >= 0.15 AS equiv_ok, helped > hurt AS more_helped
  FROM ({repair_metrics("domain", "(SELECT * FROM pilot WHERE NOT original_correct)", "repair_parseable", "repair_correct")}))""", "pilot")
SQL["gate_fresh_repair"] = q(f"""
SELECT round(mean_delta, 9) AS mean_delta, positive_seeds, helped, hurt, repair_parse_rate, delta_ok, more_helped, parse_ok, seeds_ok,
       delta_ok AND more_helped AND parse_ok AND seeds_ok AS accepted FROM (
SELECT *, mean_delta >= 0.1 AS delta_ok, helped > hurt AS more_helped, repair_parse_rate >= 0.8 AS parse_ok, positive_seeds >= 2 AS seeds_ok
FROM (SELECT avg(delta) AS mean_delta, count_if(delta > 0) AS positive_seeds FROM augmented),
     (SELECT helped, hurt, repair_parse_rate FROM ({repair_metrics("", "(SELECT * FROM pilot WHERE NOT original_correct)", "repair_parseable", "repair_correct")})))""",
                              "augmented", "pilot")
SQL["gate_final_repair"] = q("""
SELECT round(mean_delta, 9) AS mean_delta, nonnegative_seeds, round(worst_delta, 9) AS worst_delta, helped, hurt, 1.0::DOUBLE AS mean_parse_rate,
       round(mean_repair_rate, 9) AS mean_repair_rate, round(mean_comparison_rate, 9) AS mean_comparison_rate, focus_hurt, comparison_focus_hurt,
       delta_ok, seeds_ok, worst_ok, more_helped, true AS parse_ok, comparison_ok, hurt_reduced,
       delta_ok AND seeds_ok AND worst_ok AND more_helped AND comparison_ok AND hurt_reduced AS accepted FROM (
SELECT *, mean_delta >= 0.1 AS delta_ok, nonnegative_seeds >= 4 AS seeds_ok, worst_delta >= -0.05 AS worst_ok, helped > hurt AS more_helped,
       mean_repair_rate >= mean_comparison_rate AS comparison_ok, focus_hurt < comparison_focus_hurt AS hurt_reduced FROM (
SELECT avg(g.c / total - equiv_rate) AS mean_delta, count_if(g.c / total - equiv_rate >= 0) AS nonnegative_seeds, min(g.c / total - equiv_rate) AS worst_delta,
       CAST(sum(g.helped) AS BIGINT) AS helped, CAST(sum(g.hurt) AS BIGINT) AS hurt, avg(g.c / total) AS mean_repair_rate, avg(f.c / total) AS mean_comparison_rate,
       CAST(sum(g.focus) AS BIGINT) AS focus_hurt, CAST(sum(f.focus) AS BIGINT) AS comparison_focus_hurt
FROM seed_rates
JOIN (SELECT seed, count_if(fin) AS c, count_if(outcome = 'repair_helped') AS helped, count_if(outcome = 'repair_hurt') AS hurt,
        count_if(outcome = 'repair_hurt' AND domain = 'alpha') AS focus FROM guarded_repair GROUP BY seed) g USING (seed)
JOIN (SELECT seed, count_if(fin) AS c, count_if(outcome = 'repair_hurt' AND domain = 'alpha') AS focus FROM free_repair GROUP BY seed) f USING (seed)))""",
                              "seed_rates", "guarded_repair", "free_repair")

# AUC by comparing all (positive, negative) pairs.
SQL["sweep_leaderboard"] = q("""
SELECT run, auc, threshold, f1, CAST(row_number() OVER (ORDER BY auc DESC, f1 DESC, run) AS INT) AS position
FROM (SELECT domain AS run, auc FROM auc_domain) JOIN (SELECT domain AS run, threshold, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, threshold) AS rn FROM sweep_domain) WHERE rn = 1) USING (run)""",
                              "auc_domain", "sweep_domain")
