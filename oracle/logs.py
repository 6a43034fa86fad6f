"""Expected results of the reader and writer queries."""

from oracle.views import q

SQL = {}

SQL["read_candidates"] = q("""
SELECT c.task_id, t.domain, t.style, c.cand_idx AS candidate_index, c.parseable, c.correct, c.solvable, c.score,
       c.error, c.model, c.payload
FROM candidates c JOIN tasks t USING (task_id)""", "tasks", "candidates")

SQL["read_selections"] = q("""
SELECT p.task_id, t.domain, p.k, p.policy, p.selected_index, p.reason AS selection_reason
FROM basic p JOIN tasks t USING (task_id)""", "basic", "tasks")

SQL["write_pool_log"] = q("""
SELECT t.seed, kind, count(*) AS n, count(cand) AS candidates, count(picked) AS selected
FROM (SELECT task_id, 'candidate' AS kind, cand_idx AS cand, NULL::INT AS picked FROM candidates
      UNION ALL SELECT task_id, policy, NULL, selected_index FROM basic) r JOIN tasks t USING (task_id)
GROUP BY t.seed, kind""", "basic", "tasks", "candidates")

SQL["read_replay"] = q("""
SELECT 'scorer_a' AS verifier, p.task_id, p.k, p.selected_index, p.reason AS selection_reason,
       c.score AS replay_score, c.correct
FROM ranked p LEFT JOIN candidates c ON c.task_id = p.task_id AND c.cand_idx = p.selected_index
UNION ALL
SELECT 'scorer_b', p.task_id, p.k, p.selected_index, p.reason, c.score_b, c.correct
FROM ranked_b p LEFT JOIN candidates c ON c.task_id = p.task_id AND c.cand_idx = p.selected_index""",
                       "ranked", "ranked_b", "candidates")

SQL["read_examples"] = q("""
SELECT doc_id, template_id, domain, source, label, score, true AS parseable, '' AS source_model,
       '' AS perturbation_type, CAST(length(text) AS INT) AS text_length
FROM examples WHERE source = 'gold' OR parseable""", "examples")

SQL["read_pairs"] = q("""
SELECT task_id, k, 'bestofk_pairwise' AS source, pair_type, positive_index, negative_index, positive_payload,
       negative_payload, score_margin
FROM pairs""", "pairs")

SQL["read_repairs"] = q("""
SELECT seed, task_id, 'verifier_ranked_repair' AS policy, domain, original_score, repair_score, repair_parseable,
       repair_correct
FROM repair_rows""", "repair_rows")

SQL["read_run_summaries"] = q("""
SELECT e.seed AS run, k, policy, s.stratum, count(*) AS total, count_if(parseable) AS parse_count,
       count_if(solvable) AS solve_count, count_if(correct) AS correct_count, count_if(has_error) AS error_count
FROM (SELECT b.*, t.seed, t.domain, t.style, t.init_is_abstract, t.goal_is_abstract
      FROM basic b JOIN tasks t USING (task_id)) e,
     LATERAL (SELECT unnest(['*', 'all', concat('domain=', domain), concat('style=', style),
                             concat('init=', split_part(style, '/', 1)),
                             concat('goal=', split_part(style, '/', 2))]) AS stratum) s
GROUP BY e.seed, k, policy, s.stratum""", "basic", "tasks")

SQL["write_examples"] = q("""
SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, 'all' AS file FROM examples GROUP BY source
UNION ALL
SELECT source, count(*), CAST(sum(label) AS BIGINT), 'parseable' FROM examples WHERE parseable GROUP BY source""",
                          "examples")

SQL["resume_pending"] = q("""
SELECT task_id, domain, seed FROM tasks WHERE task_id NOT IN (SELECT l_orderkey FROM lineitem)""", "tasks")
