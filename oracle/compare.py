"""Expected results of the join and comparison queries."""

from oracle import shared
from oracle.views import define, q

SQL = {}

SQL["join_task_text"] = q("""
SELECT c.task_id, c.cand_idx, c.payload, t.nl, t.domain, t.task_id IS NULL AS missing_source
FROM candidates c LEFT JOIN tasks t ON t.task_id = c.task_id""", "candidates", "tasks")

# Ranking examples: top 2 positives, top 4 negatives, one negative of pools without positives.
define("ranking_all", """
SELECT task_id, k, cand_idx, nl, payload, CAST(correct AS INT) AS label,
       CASE WHEN correct THEN 'bestofk_ranking_positive' WHEN n_pos = 0 THEN 'bestofk_ranking_negative_only' ELSE 'bestofk_ranking_negative' END AS source,
       model AS source_model, domain, style, seed, template_id
FROM (SELECT *, CASE WHEN correct OR n_pos = 0 THEN row_number() OVER (PARTITION BY task_id, k, correct ORDER BY s DESC, cand_idx)
        ELSE row_number() OVER (PARTITION BY task_id, k, correct ORDER BY picked DESC, (gap <= 0) DESC, s DESC, cand_idx) END AS rn FROM members)
WHERE rn <= CASE WHEN correct THEN 2 WHEN n_pos = 0 THEN 1 ELSE 4 END""", "members")
define("mined8", "SELECT * FROM ranking_all WHERE k = 8", "ranking_all")

SQL["anti_base_keys"] = q("""
SELECT task_id, cand_idx, label, source, template_id FROM mined8 m
WHERE NOT EXISTS (SELECT 1 FROM candidates c JOIN tasks t USING (task_id) WHERE c.cand_idx < 4 AND c.parseable
  AND t.nl = m.nl AND c.payload = m.payload AND CAST(c.correct AS INT) = m.label AND t.template_id = m.template_id)""",
                          "mined8", "candidates", "tasks")

define("template_order", """
SELECT template_id, n, sum(n) OVER (ORDER BY md5(concat_ws('|', '42', template_id)), template_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
       sum(n) OVER () AS total
FROM (SELECT template_id, count(*) AS n FROM tasks GROUP BY template_id)""", "tasks")
define("task_split", """
SELECT t.*, CASE WHEN coalesce(before, 0) < floor(total * 0.85::DOUBLE) THEN 'train' ELSE 'validation' END AS split
FROM tasks t JOIN template_order USING (template_id)""", "tasks", "template_order")

SQL["leakage_guard"] = q("""
SELECT task_id, cand_idx, label, template_id, c AS copy FROM mined8, (SELECT CAST(unnest([1, 2]) AS INT) AS c)
WHERE template_id NOT IN (SELECT template_id FROM task_split WHERE split = 'validation')""", "mined8", "task_split")

define("replayed", """
SELECT task_id, k, a.selected_index AS base_index, a.correct AS base_correct, b.selected_index AS cand_index, b.correct AS cand_correct,
       CASE WHEN a.selected_index IS NULL OR b.selected_index IS NULL THEN 'missing_selection' WHEN a.correct = b.correct THEN 'same_outcome'
            WHEN b.correct THEN 'helped' ELSE 'hurt' END AS direction
FROM ranked a JOIN ranked_b b USING (task_id, k)""", "ranked", "ranked_b")
define("hurt_keys", """
SELECT DISTINCT t.template_id, r.k FROM replayed r JOIN tasks t USING (task_id) WHERE direction = 'hurt' AND k IN (4, 8)""",
       "replayed", "tasks")

SQL["hurt_key_flag"] = q("""
SELECT p.task_id, p.k, p.pair_no, p.template_id, h.k IS NOT NULL AS hurt_key
FROM pairs p LEFT JOIN hurt_keys h ON h.template_id = p.template_id AND h.k = p.k""", "pairs", "hurt_keys")
SQL["paired_runs"] = q("SELECT * EXCLUDE (base_correct, cand_correct) FROM paired", "paired")
SQL["paired_replay"] = q("SELECT * FROM replayed", "replayed")
SQL["policy_vs_baseline"] = q("""
SELECT task_id, k, policy, selected_index, baseline_index, changed, helped, hurt, tied_change FROM search_vs""", "search_vs")

SQL["reconcile_metrics"] = q("""
SELECT k, policy, 'error_count' AS metric, CAST(count_if(has_error) AS DOUBLE) AS recomputed,
       CAST(count_if(b.selected_index IS NOT NULL AND c.error IS NOT NULL) AS DOUBLE) AS saved
FROM basic b LEFT JOIN candidates c ON c.task_id = b.task_id AND c.cand_idx = b.selected_index
GROUP BY k, policy HAVING recomputed <> saved
UNION ALL SELECT k, policy, 'avg_parseable_candidates', round(sum(parseable_count) / count(*), 9) AS recomputed,
       round(sum(parseable_count) / count_if(parseable_count > 0), 9) AS saved
FROM basic JOIN pool_stats USING (task_id, k) GROUP BY k, policy HAVING recomputed <> saved""", "basic", "candidates", "pool_stats")

SQL["evaluate_distinct"] = q("""
SELECT task_id, cand_idx, CASE WHEN parseable AND s % 7 <> 0 THEN s % 2 = 0 END AS evaluated,
       CASE WHEN NOT parseable THEN 'parse_failed' WHEN s % 7 = 0 THEN 'ValueError: no answer' END AS eval_error
FROM (SELECT *, list_sum(list_transform(list_filter(string_split(payload, ''), lambda c: c >= '0' AND c <= '9'), lambda c: CAST(c AS INT))) AS s FROM candidates)""",
                              "candidates")

SQL["pos_neg_pairs"] = q(f"""
SELECT task_id, k, pair_no, positive_index, negative_index, positive_score, negative_score FROM ({shared.pairs(4, "'x'", 8, "0")})""", "members")
SQL["helped_hurt"] = q("""
SELECT k, policy, count(*) AS total, count_if(correct) AS equiv_count, count_if(changed) AS changed, count_if(helped) AS helped, count_if(hurt) AS hurt,
       count_if(tied_change) AS tied_change FROM replay_vs GROUP BY k, policy""", "replay_vs")
SQL["changed_rows"] = q("""
SELECT task_id, k, policy, CASE WHEN helped THEN 'helped' ELSE 'hurt' END AS change, selected_index, score AS selected_score,
       baseline_index, baseline_correct FROM replay_vs WHERE policy <> 'verifier_ranked' AND (helped OR hurt)""", "replay_vs")
SQL["paired_changes"] = q("""
SELECT task_id, k, outcome, cause FROM paired WHERE outcome IN ('candidate_helped', 'candidate_hurt') OR cause LIKE 'oracle_availability%'""", "paired")

define("scorer_rates", """
SELECT seed, k, verifier, avg(CAST(correct AS INT)) AS rate, count(*) AS n, count_if(correct) AS hits FROM (
  SELECT t.seed, r.k, 'a' AS verifier, r.correct FROM ranked r JOIN tasks t USING (task_id)
  UNION ALL SELECT t.seed, r.k, 'b', r.correct FROM ranked_b r JOIN tasks t USING (task_id)) GROUP BY ALL""",
       "ranked", "ranked_b", "tasks")
define("h2h", """
SELECT k, count_if(d > 0) AS wins, count_if(d < 0) AS losses, count_if(d = 0) AS ties, avg(d) AS mean_delta
FROM (SELECT a.k, b.hits / b.n - a.hits / a.n AS d FROM scorer_rates a JOIN scorer_rates b USING (seed, k) WHERE a.verifier = 'a' AND b.verifier = 'b')
GROUP BY k""", "scorer_rates")
SQL["head_to_head"] = q("SELECT k, wins, losses, ties, round(mean_delta, 9) AS mean_delta FROM h2h", "h2h")

SQL["model_deltas"] = q("""
SELECT model, count(*) AS runs, round(avg(v - p), 9) AS mean_verifier_minus_prompt, round(avg(r - p), 9) AS mean_repair_minus_prompt,
       round(avg(r - v), 9) AS mean_repair_minus_verifier
FROM (SELECT model, seed, avg(CAST(coalesce(f.correct, false) AS INT)) AS p, avg(CAST(coalesce(b.correct, false) AS INT)) AS v,
        avg(CAST(CASE WHEN b.task_id IS NULL THEN false WHEN t.task_id % 25 <> 0 THEN t.task_id % 4 <> 0 ELSE b.correct END AS INT)) AS r
      FROM (SELECT task_id, seed, unnest(['model_0', 'model_1', 'model_2']) AS model FROM tasks) t
      LEFT JOIN (SELECT * FROM own WHERE i = 1) f USING (task_id, model)
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, model ORDER BY score DESC NULLS LAST, i) AS rn
                   FROM own WHERE parseable AND i <= 8) WHERE rn = 1) b USING (task_id, model)
      GROUP BY model, seed) GROUP BY model""", "tasks", "candidates",
    own="SELECT *, row_number() OVER (PARTITION BY task_id, model ORDER BY cand_idx) AS i FROM candidates")
