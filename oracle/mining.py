"""Expected results of the mining, assembly, sample and split queries."""

from oracle import compare, facts, shared  # noqa: F401  (registers shared views)
from oracle.views import define, q
from oracle.scalars import WS

SQL = {}
EX = "task_id, k, cand_idx, label, source, source_model, template_id, payload"

define("hard_negatives", """
SELECT task_id, k, cand_idx, CAST(correct AS INT) AS label, CASE WHEN correct THEN 'bestofk_mined_positive' ELSE 'bestofk_mined_negative' END AS source,
       model AS source_model, template_id, payload
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, correct ORDER BY picked DESC, s DESC, cand_idx) AS rn
      FROM members WHERE k = 8 AND missed AND n_pos > 0 AND (correct OR picked OR s >= best_pos))
WHERE rn <= CASE WHEN correct THEN 1 ELSE 3 END""", "members")
SQL["mine_hard_negatives"] = q(f"SELECT {EX} FROM hard_negatives", "hard_negatives")
SQL["mine_ranking"] = q(f"SELECT {EX} FROM mined8", "mined8")
SQL["mine_ranking_multi"] = q(f"""
SELECT {EX} FROM (SELECT *, row_number() OVER (PARTITION BY nl, payload, label, template_id ORDER BY seed, task_id, k, label DESC, cand_idx, source) AS rn
  FROM ranking_all) WHERE rn = 1""", "ranking_all")
SQL["mine_from_failures"] = q(f"""
SELECT task_id, k, cand_idx, CAST(correct AS INT) AS label, CASE WHEN correct THEN 'bestofk_focus_positive' ELSE 'bestofk_focus_negative' END AS source,
       model AS source_model, template_id, payload
FROM (SELECT m.*, row_number() OVER (PARTITION BY task_id, k, correct ORDER BY (NOT correct AND picked) DESC,
        CASE WHEN correct THEN 0 WHEN gap <= 0.03::DOUBLE THEN 0 WHEN gap <= 0.1::DOUBLE THEN 1 ELSE 2 END, s DESC, cand_idx) AS rn
      FROM members m JOIN (SELECT task_id, k FROM cases WHERE is_miss AND (margin IS NULL OR margin <= 0.1::DOUBLE)) c USING (task_id, k)
      WHERE n_pos > 0)
WHERE rn <= CASE WHEN correct THEN 2 ELSE 4 END""", "members", "cases")

# Rescored members: class scores of scorer B, picks of scorer A.
SQL["mine_focused"] = q(f"""
SELECT task_id, k, cand_idx, CAST(correct AS INT) AS label,
       CASE WHEN correct THEN 'bestofk_ranking_positive' WHEN n_pos = 0 THEN 'bestofk_ranking_negative_only' ELSE 'bestofk_ranking_negative' END AS source,
       model AS source_model, template_id, payload
FROM (SELECT *, CASE WHEN correct OR n_pos = 0 THEN row_number() OVER (PARTITION BY task_id, k, correct ORDER BY s DESC, cand_idx)
        ELSE row_number() OVER (PARTITION BY task_id, k, correct ORDER BY own_pick DESC, (gap <= 0) DESC, s DESC, cand_idx) END AS rn
      FROM (SELECT m.*, coalesce(r.selected_index = m.cand_idx, false) AS own_pick FROM members_b m JOIN ranked r USING (task_id, k)))
WHERE rn <= CASE WHEN correct THEN 2 WHEN n_pos = 0 THEN 1 ELSE 4 END""", "members_b", "ranked")

PAIR = "task_id, k, pair_no, pair_type, positive_index, negative_index, positive_score, negative_score, score_margin"
SQL["mine_pairs"] = q(f"SELECT {PAIR} FROM pairs", "pairs")
define("pointwise", f"""
SELECT task_id, k, positive_index AS cand_idx, 1 AS label, 'pair_positive' AS source FROM (
  SELECT DISTINCT p.task_id, p.k, p.cand_idx AS positive_index FROM ({shared.pair_sides(4)[0]}) p JOIN ({shared.pair_sides(4)[1]}) n USING (task_id, k) WHERE p.rn <= 2)
UNION ALL SELECT task_id, k, negative_index, 0, 'pair_negative' FROM pairs
UNION ALL SELECT task_id, k, cand_idx, 1, 'positive_only' FROM members WHERE n_neg = 0 AND rank <= 2
UNION ALL SELECT task_id, k, cand_idx, 0, 'negative_only' FROM members WHERE n_pos = 0 AND rank <= 1""", "pairs", "members")
SQL["mine_pairs_pointwise"] = q("SELECT * FROM pointwise", "pointwise")
SQL["example_dedup"] = q("""
SELECT task_id, k, cand_idx, label, source FROM (
  SELECT p.*, row_number() OVER (PARTITION BY nl, payload, label, template_id ORDER BY seed, task_id, k, label DESC, cand_idx, source) AS rn
  FROM pointwise p JOIN candidates c USING (task_id, cand_idx) JOIN tasks t USING (task_id)) WHERE rn = 1""", "pointwise", "candidates", "tasks")
_GUARDED = shared.KIND.replace("'outranks_positive'", "CASE WHEN h.k IS NULL THEN 'outranks_positive' ELSE 'regression' END")
SQL["mine_pairs_guarded"] = q(f"""
SELECT {', '.join('p.' + c.strip() for c in PAIR.split(','))}, h.k IS NOT NULL AS hurt_key
FROM ({shared.pairs(5, _GUARDED, extra='LEFT JOIN hurt_keys h ON h.template_id = p.template_id AND h.k = p.k')}) p
LEFT JOIN hurt_keys h ON h.template_id = p.template_id AND h.k = p.k""", "members", "hurt_keys")
SQL["pair_dedup"] = q("""
SELECT task_id, k, pair_no, template_id FROM (SELECT *, row_number() OVER (PARTITION BY nl, positive_payload, negative_payload, template_id, k
  ORDER BY seed, task_id, k, pair_no) AS rn FROM pairs) WHERE rn = 1""", "pairs")
SQL["mining_counters"] = q("""
SELECT k, (SELECT count(*) FROM tasks) AS considered, count(*) AS with_parseable, count_if(p > 0 AND n = 0) AS positive_only, count_if(p = 0 AND n > 0) AS negative_only,
       count_if(p > 0 AND n > 0) AS mixed, count_if(p > 0 AND missed) AS misses, (SELECT count(*) FROM tasks) - count(*) AS no_parseable
FROM (SELECT task_id, k, max(n_pos) AS p, max(n_neg) AS n, bool_or(missed) AS missed FROM members GROUP BY task_id, k) GROUP BY k""", "members", "tasks")
SQL["pair_stats"] = q("""
SELECT facet, value, count(*) AS n FROM (SELECT unnest(['all', 'domain', 'style', 'k', 'pair_type']) AS facet,
  unnest(['all', domain, style, CAST(k AS VARCHAR), pair_type]) AS value FROM pairs) GROUP BY facet, value""", "pairs")

# Assembly.
define("assembled", """
SELECT task_id, 1 AS label, 'gold' AS source, '' AS source_model, '' AS perturbation_type, domain, true AS parseable, artifact AS text
FROM artifacts JOIN tasks USING (task_id)
UNION ALL SELECT task_id, CAST(correct AS INT), 'llm_local', model, '', domain, parseable, payload FROM candidates JOIN tasks USING (task_id)
UNION ALL SELECT task_id, 0, 'perturbation', '', kind, domain, true, corrupted FROM simple JOIN tasks USING (task_id)""",
       "artifacts", "tasks", "candidates", "simple")
SQL["assemble_examples"] = q("""SELECT task_id, label, source, source_model, perturbation_type, domain, parseable, md5(text) AS text_md5 FROM assembled""", "assembled")
SQL["dataset_stats"] = q("""
SELECT count(*) AS total, count_if(label = 1) AS positives, count_if(label <> 1) AS negatives, count_if(NOT parseable) AS unparseable,
       round_even(count_if(label = 1) / count_if(label <> 1), 4) AS pos_neg_ratio FROM assembled""", "assembled")
SQL["dataset_facets"] = q("""
SELECT facet, value, count(*) AS n FROM (SELECT unnest(['source', 'domain', 'perturbation_type', 'source_model']) AS facet,
  unnest([source, domain, nullif(perturbation_type, ''), nullif(source_model, '')]) AS value FROM assembled) WHERE value IS NOT NULL GROUP BY facet, value""", "assembled")
SQL["run_counters"] = q("""
SELECT count_if(source = 'gold') AS gold, count_if(source = 'llm_local') AS llm_total, count_if(source = 'llm_local' AND parseable) AS llm_parseable,
       count_if(source = 'llm_local' AND label = 1) AS llm_equivalent, count_if(source = 'perturbation') AS pert_total,
       count_if(source = 'perturbation' AND label = 1) AS pert_equivalent FROM assembled""", "assembled")
SQL["augment_base"] = q("""
SELECT nl, payload, label, template_id, parseable FROM base
UNION ALL SELECT nl, payload, label, template_id, true FROM mined8 m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.parseable AND b.nl = m.nl
  AND b.payload = m.payload AND b.label = m.label AND b.template_id = m.template_id)""", "mined8", "candidates", "tasks",
    base="SELECT nl, payload, CAST(correct AS INT) AS label, template_id, parseable FROM candidates JOIN tasks USING (task_id) WHERE cand_idx < 4")
SQL["oversample"] = q("SELECT task_id, cand_idx, label, c AS copy FROM hard_negatives, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS c)", "hard_negatives")

# Samples.
SQL["sample_n"] = q("SELECT task_id, domain, seed FROM tasks ORDER BY md5(concat_ws('|', '42', task_id)), task_id LIMIT 500", "tasks")
SQL["sample_per_stratum"] = q("""
SELECT doc_id, source, label, domain, CAST(rn AS INT) AS rn, stratum_n FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS rn,
  count(*) OVER (PARTITION BY source, label) AS stratum_n FROM examples) WHERE rn <= 3""", "examples")


def split(source: str, key: str, fraction: float, seed: int, first: str, second: str, floor: int = 0) -> str:
    return f"""
SELECT r.*, CASE WHEN coalesce(before, 0) < greatest({floor}, floor(total * {fraction!r}::DOUBLE)) THEN '{first}' ELSE '{second}' END AS split
FROM {source} r JOIN (SELECT {key}, sum(n) OVER (ORDER BY md5(concat_ws('|', '{seed}', {key})), {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  sum(n) OVER () AS total FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})) g USING ({key})"""


SQL["split_by_template"] = q("SELECT task_id, template_id, split FROM task_split", "task_split")
SQL["split_by_content"] = q(f"SELECT doc_id, content_key, split FROM ({split('keyed', 'content_key', 0.8, 42, 'train', 'validation')})",
    keyed=f"""SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')), 1, 16) AS content_key FROM documents""")
define("random_split", """
SELECT *, CASE WHEN d < 0.8 THEN 'train' WHEN d < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', '42', task_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS d FROM tasks)""", "tasks")
SQL["split_random"] = q("SELECT task_id, split FROM random_split", "random_split")
SQL["split_calibration"] = q(f"SELECT task_id, template_id, split FROM ({split('val', 'template_id', 0.5, 123, 'calibration', 'evaluation')})", "task_split",
                             val="SELECT task_id, template_id FROM task_split WHERE split = 'validation'")
SQL["split_pairs"] = q(f"SELECT task_id, k, pair_no, template_id, split FROM ({split('pairs', 'template_id', 0.85, 42, 'train', 'validation')})", "pairs")
SQL["split_pairs_dev_first"] = q(f"SELECT task_id, k, pair_no, template_id, split FROM ({split('pairs', 'template_id', 0.2, 42, 'dev', 'train', 1)})", "pairs")
SQL["split_leakage_check"] = q("""
SELECT 'template' AS kind, template_id, count(DISTINCT split) AS parts FROM task_split GROUP BY template_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'random', template_id, count(DISTINCT split) FROM random_split GROUP BY template_id HAVING count(DISTINCT split) > 1""", "task_split", "random_split")
SQL["split_stats"] = q("""
SELECT split, facet, value, count(*) AS rows, CAST(min(length(nl)) AS INT) AS min_size, CAST(max(length(nl)) AS INT) AS max_size
FROM (SELECT split, nl, unnest(['all', 'domain', 'init_is_abstract', 'goal_is_abstract']) AS facet,
        unnest(['all', domain, CAST(init_is_abstract AS VARCHAR), CAST(goal_is_abstract AS VARCHAR)]) AS value FROM task_split)
GROUP BY split, facet, value""", "task_split")
# The fit of a hybrid scorer is at its optimum; its rows are the ranked examples of each pool and each pair in both orders.
SQL["hybrid_scorer_optimum"] = q("""
SELECT 2 * pairs + points AS n, pairs + hits AS positives, true AS optimal
FROM (SELECT count(*) AS pairs FROM pairs), (SELECT count(*) AS points, count_if(label = 1) AS hits FROM ranking_all WHERE source <> 'bestofk_ranking_negative_only')""", "pairs", "ranking_all")
