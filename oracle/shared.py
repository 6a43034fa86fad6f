"""Shared intermediate views: picks of every policy, cases, snapshots, mined members and pairs."""

from oracle.views import define


def pick(policy: str, order: str, eligible: str, none: str, reason: str, score: str = "score") -> str:
    return f"""
SELECT s.task_id, s.k, '{policy}' AS policy, p.cand_idx AS selected_index,
       CASE WHEN p.cand_idx IS NULL THEN '{none}' ELSE '{reason}' END AS reason,
       coalesce(p.parseable, false) AS parseable, coalesce(p.correct, false) AS correct,
       coalesce(p.solvable, false) AS solvable,
       (p.cand_idx IS NULL OR NOT p.parseable OR p.error IS NOT NULL) AS has_error, p.{score} AS score
FROM slots s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY {order}) AS rn FROM pool WHERE {eligible})
  WHERE rn = 1) p USING (task_id, k)"""


NO_PARSE = "no_parseable_candidate"
NO_SOLVABLE = "no_parseable_solvable_candidate"
BY_SCORE = "score DESC NULLS LAST, cand_idx"
RANDOM = "md5(concat_ws('|', '42', task_id, k, cand_idx))"

define("greedy", pick("greedy_first", "cand_idx", "true", "no_candidates", "first_candidate"), "slots", "pool")
define("drawn", pick("random_parseable", RANDOM, "parseable", NO_PARSE, "random_parseable"), "slots", "pool")
define("ranked", pick("verifier_ranked", BY_SCORE, "parseable", NO_PARSE, "highest_verifier_score"), "slots", "pool")
define("ranked_b", pick("second_scorer_ranked", "score_b DESC NULLS LAST, cand_idx", "parseable", NO_PARSE,
                        "highest_verifier_score", "score_b"), "slots", "pool")
define("solvable_ranked", pick("solvable_then_verifier", BY_SCORE, "parseable AND solvable", NO_SOLVABLE,
                               "highest_verifier_score_among_solvable"), "slots", "pool")
define("first_solvable", pick("parse_solvable_index", "cand_idx", "parseable AND solvable", NO_SOLVABLE,
                              "first_parseable_solvable"), "slots", "pool")
define("lowest", pick("lowest_parseable", "cand_idx", "parseable", NO_PARSE, "lowest"), "slots", "pool")
define("basic", "SELECT * FROM greedy UNION ALL SELECT * FROM drawn UNION ALL SELECT * FROM ranked",
       "greedy", "drawn", "ranked")

# Solvable candidates within the tie margin of the top score, which one window gives to each row.
define("tiebreak", """
SELECT r.task_id, r.k, 'verifier_then_solvable_tiebreak' AS policy, coalesce(n.cand_idx, r.selected_index) AS selected_index,
       CASE WHEN r.selected_index IS NULL THEN 'no_parseable_candidate' WHEN n.cand_idx IS NOT NULL
            THEN 'solvable_within_margin_0.02' ELSE 'no_solvable_near_top' END AS reason,
       coalesce(n.parseable, r.parseable) AS parseable, coalesce(n.correct, r.correct) AS correct,
       coalesce(n.solvable, r.solvable) AS solvable, r.has_error AND n.cand_idx IS NULL AS has_error,
       coalesce(n.score, r.score) AS score
FROM ranked r LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY score DESC, cand_idx) AS rn
    FROM (SELECT *, max(score) FILTER (parseable) OVER (PARTITION BY task_id, k) AS top FROM pool)
    WHERE parseable AND solvable AND top - score <= 0.02::DOUBLE) WHERE rn = 1) n USING (task_id, k)""",
       "ranked", "pool")
define("search", "SELECT * FROM ranked UNION ALL SELECT * FROM solvable_ranked UNION ALL SELECT * FROM tiebreak "
       "UNION ALL SELECT * FROM first_solvable", "ranked", "solvable_ranked", "tiebreak", "first_solvable")

define("pool_stats", """
SELECT s.task_id, s.k, count(p.cand_idx) AS candidate_count, count(p.cand_idx) FILTER (p.parseable) AS parseable_count,
       count(p.cand_idx) FILTER (p.correct) AS correct_count,
       count(p.cand_idx) FILTER (p.parseable AND p.solvable) AS solvable_count,
       count(p.cand_idx) FILTER (p.correct) > 0 AS oracle
FROM slots s LEFT JOIN pool p USING (task_id, k) GROUP BY s.task_id, s.k""", "slots", "pool")

define("second", """
SELECT task_id, k, score AS second_score FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY score DESC NULLS LAST, cand_idx) AS rn FROM pool WHERE parseable)
WHERE rn = 2""", "pool")

define("gaps", """
SELECT g.task_id, g.k, r.score AS top_score, s.second_score, g.score AS first_score,
       r.score - s.second_score AS top_second_gap, r.score - g.score AS top_first_gap
FROM greedy g JOIN ranked r USING (task_id, k) LEFT JOIN second s USING (task_id, k)""", "greedy", "ranked", "second")

# Margin and gap policies: 'take' is false where both scores are missing.
define("margin_policies", """
SELECT task_id, k, m, 'verifier_margin_fallback_m' || ms AS policy,
       CASE WHEN r.selected_index IS NULL THEN NULL WHEN take THEN r.selected_index ELSE g.selected_index END AS selected_index,
       CASE WHEN r.selected_index IS NULL THEN 'no_parseable_candidate'
            WHEN take THEN 'top_beats_greedy_by_' || CASE WHEN g.score IS NULL THEN 'inf' ELSE printf('%.4f', r.score - g.score) END
            ELSE 'fallback_greedy_gap_' || CASE WHEN r.score IS NULL AND g.score IS NULL THEN 'nan' WHEN r.score IS NULL THEN '-inf'
                 ELSE printf('%.4f', r.score - g.score) END END AS reason,
       CASE WHEN take THEN r.parseable ELSE g.parseable AND r.selected_index IS NOT NULL END AS parseable,
       CASE WHEN take THEN r.correct ELSE g.correct AND r.selected_index IS NOT NULL END AS correct,
       CASE WHEN take THEN r.solvable ELSE g.solvable AND r.selected_index IS NOT NULL END AS solvable,
       CASE WHEN take THEN r.score WHEN r.selected_index IS NOT NULL THEN g.score END AS score
FROM (SELECT *, unnest([0.02, 0.05, 0.1, 0.15])::DOUBLE AS m, unnest(['0.02', '0.05', '0.1', '0.15']) AS ms FROM ranked) r
JOIN greedy g USING (task_id, k),
LATERAL (SELECT r.score IS NOT NULL AND (g.score IS NULL OR r.score - g.score >= m) AS take) t""", "ranked", "greedy")
define("gap_policies", """
SELECT task_id, k, m, 'verifier_top_gap_m' || ms AS policy,
       CASE WHEN r.selected_index IS NULL THEN NULL WHEN take THEN r.selected_index ELSE g.selected_index END AS selected_index,
       CASE WHEN r.selected_index IS NULL THEN 'no_parseable_candidate' WHEN parseable_count = 1 THEN 'single_parseable'
            WHEN take THEN 'top_gap_' || CASE WHEN second_score IS NULL THEN 'inf' ELSE printf('%.4f', r.score - second_score) END
            ELSE 'fallback_greedy_top_gap_' || CASE WHEN r.score IS NULL THEN 'nan' ELSE printf('%.4f', r.score - second_score) END
       END AS reason,
       CASE WHEN take THEN r.parseable ELSE g.parseable AND r.selected_index IS NOT NULL END AS parseable,
       CASE WHEN take THEN r.correct ELSE g.correct AND r.selected_index IS NOT NULL END AS correct,
       CASE WHEN take THEN r.solvable ELSE g.solvable AND r.selected_index IS NOT NULL END AS solvable,
       CASE WHEN take THEN r.score WHEN r.selected_index IS NOT NULL THEN g.score END AS score
FROM (SELECT *, unnest([0.02, 0.05, 0.1, 0.15])::DOUBLE AS m, unnest(['0.02', '0.05', '0.1', '0.15']) AS ms FROM ranked) r
JOIN greedy g USING (task_id, k) JOIN pool_stats USING (task_id, k) LEFT JOIN second USING (task_id, k),
LATERAL (SELECT parseable_count = 1 OR (r.score IS NOT NULL AND (second_score IS NULL OR r.score - second_score >= m)) AS take) t""",
       "ranked", "greedy", "pool_stats", "second")
define("agreement", """
SELECT task_id, k, 'scorer_agreement_' || f AS policy,
       CASE WHEN a.selected_index IS NULL THEN NULL WHEN a.selected_index = b.selected_index THEN a.selected_index
            WHEN f = 'greedy' THEN g.selected_index ELSE l.selected_index END AS selected_index,
       CASE WHEN a.selected_index IS NULL THEN 'no_parseable_candidate' WHEN a.selected_index = b.selected_index THEN 'scorers_agree'
            WHEN f = 'greedy' THEN 'fallback_greedy_disagreement' ELSE 'fallback_lowest_parseable' END AS reason,
       CASE WHEN a.selected_index IS NULL THEN false WHEN a.selected_index = b.selected_index THEN a.parseable
            WHEN f = 'greedy' THEN g.parseable ELSE l.parseable END AS parseable,
       CASE WHEN a.selected_index IS NULL THEN false WHEN a.selected_index = b.selected_index THEN a.correct
            WHEN f = 'greedy' THEN g.correct ELSE l.correct END AS correct,
       CASE WHEN a.selected_index IS NULL THEN false WHEN a.selected_index = b.selected_index THEN a.solvable
            WHEN f = 'greedy' THEN g.solvable ELSE l.solvable END AS solvable,
       CASE WHEN a.selected_index IS NULL THEN NULL WHEN a.selected_index = b.selected_index THEN a.score
            WHEN f = 'greedy' THEN g.score ELSE l.score END AS score
FROM ranked a JOIN ranked_b b USING (task_id, k) JOIN greedy g USING (task_id, k) JOIN lowest l USING (task_id, k),
     (SELECT unnest(['greedy', 'lowest_parseable']) AS f)""", "ranked", "ranked_b", "greedy", "lowest")

# Normalised ranks, by normalising every candidate and ranking the rounded value.
define("normalised", """
SELECT p.*, n, (score - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z,
       (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS mm
FROM pool p JOIN (SELECT task_id, k, count(score) AS n, avg(score) AS mu, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi
                  FROM pool WHERE parseable GROUP BY task_id, k) USING (task_id, k)
WHERE parseable""", "pool")
for name, col in (("z", "z"), ("minmax", "mm")):
    define(f"norm_{name}", f"""
SELECT s.task_id, s.k, 'score_normalized_{name}' AS policy, p.cand_idx AS selected_index,
       CASE WHEN p.cand_idx IS NULL THEN 'no_parseable_candidate' WHEN p.n = 0 THEN 'no_finite_scores' ELSE '{name}' END AS reason,
       coalesce(p.parseable, false) AS parseable, coalesce(p.correct, false) AS correct, coalesce(p.solvable, false) AS solvable,
       p.score AS score, p.{col} AS norm
FROM slots s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY round({col}, 9) DESC NULLS LAST, cand_idx) AS rn
  FROM normalised) WHERE rn = 1) p USING (task_id, k)""", "slots", "normalised")
define("penalty", """
SELECT s.task_id, s.k, 'hybrid_rank_index_penalty_a' || s.al AS policy, p.cand_idx AS selected_index,
       CASE WHEN p.cand_idx IS NULL THEN 'no_parseable_candidate' ELSE 'score_minus_' || s.al || '_index' END AS reason,
       coalesce(p.parseable, false) AS parseable, coalesce(p.correct, false) AS correct, coalesce(p.solvable, false) AS solvable, p.score
FROM (SELECT *, unnest(['0', '0.01', '0.03', '0.05']) AS al FROM slots) s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, k, al ORDER BY score - al::DOUBLE * cand_idx DESC NULLS LAST, cand_idx) AS rn
    FROM (SELECT *, unnest(['0', '0.01', '0.03', '0.05']) AS al FROM pool WHERE parseable)) WHERE rn = 1) p
ON p.task_id = s.task_id AND p.k = s.k AND p.al = s.al""", "slots", "pool")

_COLS = "task_id, k, policy, selected_index, reason, parseable, correct, solvable, score"
define("replay", " UNION ALL ".join(f"SELECT {_COLS} FROM {v}" for v in (
    "basic", "margin_policies", "gap_policies", "agreement", "norm_z", "norm_minmax", "penalty")),
    "basic", "margin_policies", "gap_policies", "agreement", "norm_z", "norm_minmax", "penalty")
define("replay_vs", """
SELECT p.*, b.selected_index AS baseline_index, b.correct AS baseline_correct,
       p.selected_index IS DISTINCT FROM b.selected_index AS changed,
       p.selected_index IS DISTINCT FROM b.selected_index AND p.correct AND NOT b.correct AS helped,
       p.selected_index IS DISTINCT FROM b.selected_index AND NOT p.correct AND b.correct AS hurt,
       p.selected_index IS DISTINCT FROM b.selected_index AND p.correct = b.correct AS tied_change
FROM replay p JOIN ranked b USING (task_id, k)""", "replay", "ranked")
define("search_vs", """
SELECT p.*, b.selected_index AS baseline_index, b.correct AS baseline_correct,
       p.selected_index IS DISTINCT FROM b.selected_index AS changed,
       p.selected_index IS DISTINCT FROM b.selected_index AND p.correct AND NOT b.correct AS helped,
       p.selected_index IS DISTINCT FROM b.selected_index AND NOT p.correct AND b.correct AS hurt,
       p.selected_index IS DISTINCT FROM b.selected_index AND p.correct = b.correct AS tied_change
FROM search p JOIN ranked b USING (task_id, k)""", "search", "ranked")

# Failure cases.
define("best_of_class", """
SELECT task_id, k, correct, cand_idx, score FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, k, correct ORDER BY score DESC NULLS LAST, cand_idx) AS rn FROM pool WHERE parseable)
WHERE rn = 1""", "pool")
define("cases", """
SELECT *, CASE WHEN NOT oracle_available THEN 'no_equivalent_in_pool' WHEN ranked_correct THEN 'success'
            WHEN margin <= 0.03::DOUBLE THEN 'near_tie_misranking' ELSE 'equivalent_in_pool_but_misranked' END AS miss_type,
       ranked_correct AND NOT greedy_correct AS gain_over_greedy,
       CASE WHEN NOT ranked_correct THEN 'none' WHEN greedy_correct THEN 'already_solved_by_greedy'
            WHEN NOT greedy_parseable THEN 'dominated_by_unparseable_first_greedy_behavior'
            WHEN needs_extra_k THEN 'requires_extra_k_candidates' ELSE 'within_pool_reranking' END AS gain_reason,
       oracle_available AND NOT ranked_correct AS is_miss
FROM (
SELECT t.task_id, t.seed, t.domain, t.style, r.k, st.oracle AS oracle_available, s4.oracle AS oracle_available_at_k4,
       r.k = 8 AND st.oracle AND NOT s4.oracle AS needs_extra_k, st.parseable_count, st.correct_count,
       bc.cand_idx AS best_correct_index, bc.score AS best_correct_score, bw.cand_idx AS best_wrong_index, bw.score AS best_wrong_score,
       CASE WHEN st.oracle AND r.selected_index IS NOT NULL AND NOT r.correct THEN r.score - bc.score END AS margin,
       g.selected_index AS greedy_index, g.parseable AS greedy_parseable, g.correct AS greedy_correct,
       d.selected_index AS random_index, d.correct AS random_correct, r.selected_index AS ranked_index, r.correct AS ranked_correct,
       (SELECT count(*) FROM pool p WHERE p.task_id = t.task_id AND p.k = r.k AND p.parseable AND p.correct) AS parseable_correct_count
FROM tasks t JOIN ranked r USING (task_id) JOIN greedy g USING (task_id, k) JOIN drawn d USING (task_id, k)
JOIN pool_stats st USING (task_id, k) JOIN pool_stats s4 ON s4.task_id = t.task_id AND s4.k = 4
LEFT JOIN best_of_class bc ON bc.task_id = t.task_id AND bc.k = r.k AND bc.correct
LEFT JOIN best_of_class bw ON bw.task_id = t.task_id AND bw.k = r.k AND NOT bw.correct
WHERE r.k IN (4, 8)) c""", "tasks", "ranked", "greedy", "drawn", "pool_stats", "best_of_class", "pool")

# Two runs on the same tasks; a run numbers its own candidates.
define("own", """
SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY task_id, model ORDER BY cand_idx) - 1 AS INT) AS cand_idx) FROM candidates""", "candidates")
_SNAP = """
SELECT t.task_id, ks48.k, r.cand_idx AS selected_index, coalesce(r.correct, false) AS selected_correct, r.score AS selected_score,
       count(p.cand_idx) FILTER (p.parseable) AS parseable_count, count(p.cand_idx) FILTER (p.parseable AND p.correct) AS correct_count,
       count(p.cand_idx) FILTER (p.parseable AND p.correct) > 0 AS oracle,
       arg_min(p.cand_idx, -p.score * 1000 + p.cand_idx / 100.0) FILTER (p.parseable AND p.correct) AS best_correct_index,
       max(p.score) FILTER (p.parseable AND p.correct) AS best_correct_score,
       arg_min(p.cand_idx, -p.score * 1000 + p.cand_idx / 100.0) FILTER (p.parseable AND NOT p.correct) AS best_wrong_index
FROM (SELECT DISTINCT task_id FROM own WHERE model = '{m}' AND cand_idx < 8) t CROSS JOIN ks48
LEFT JOIN own p ON p.task_id = t.task_id AND p.cand_idx < ks48.k AND p.model = '{m}'
LEFT JOIN (SELECT * FROM (SELECT c.*, ks48.k, row_number() OVER (PARTITION BY task_id, ks48.k ORDER BY score DESC NULLS LAST, cand_idx) AS rn
             FROM own c JOIN ks48 ON cand_idx < ks48.k WHERE parseable AND model = '{m}') WHERE rn = 1) r
  ON r.task_id = t.task_id AND r.k = ks48.k
GROUP BY t.task_id, ks48.k, r.cand_idx, r.correct, r.score"""
define("ks48", "SELECT CAST(unnest([4, 8]) AS INT) AS k")
define("run0", _SNAP.format(m="model_0"), "own", "ks48")
define("run1", _SNAP.format(m="model_1"), "own", "ks48")
define("paired", """
SELECT *, CASE WHEN cand_oracle AND NOT base_oracle THEN 'oracle_availability_gain' WHEN base_oracle AND NOT cand_oracle THEN 'oracle_availability_loss'
  WHEN NOT base_oracle THEN 'both_no_oracle' WHEN outcome = 'candidate_helped' THEN 'selector_gain_with_oracle'
  WHEN outcome = 'candidate_hurt' THEN 'selector_loss_with_oracle' ELSE 'both_oracle_available_same_outcome' END AS cause
FROM (SELECT *, CASE WHEN cand_correct AND NOT base_correct THEN 'candidate_helped' WHEN base_correct AND NOT cand_correct THEN 'candidate_hurt'
        WHEN base_correct THEN 'both_success' ELSE 'both_fail' END AS outcome
  FROM (SELECT task_id, k, a.task_id IS NOT NULL AS base_present, b.task_id IS NOT NULL AS cand_present,
          a.selected_index AS base_index, b.selected_index AS cand_index,
          coalesce(a.selected_correct, false) AS base_correct, coalesce(b.selected_correct, false) AS cand_correct,
          coalesce(a.oracle, false) AS base_oracle, coalesce(b.oracle, false) AS cand_oracle,
          coalesce(a.parseable_count, 0) AS base_parseable_count, coalesce(b.parseable_count, 0) AS cand_parseable_count,
          coalesce(a.correct_count, 0) AS base_correct_count, coalesce(b.correct_count, 0) AS cand_correct_count,
          a.best_correct_index AS base_best_correct_index, b.best_correct_index AS cand_best_correct_index,
          a.best_wrong_index AS base_best_wrong_index, b.best_wrong_index AS cand_best_wrong_index,
          CASE WHEN NOT a.selected_correct THEN a.selected_score - a.best_correct_score END AS base_margin,
          CASE WHEN NOT b.selected_correct THEN b.selected_score - b.best_correct_score END AS cand_margin
        FROM run0 a FULL JOIN run1 b USING (task_id, k)))""", "run0", "run1")

# Mining members: parseable candidates of K = 4 and 8.
def members(score: str) -> str:
    return f"""
SELECT m.*, t.template_id, t.domain, t.style, t.seed, t.nl, m.best_pos - m.s AS gap,
       row_number() OVER (PARTITION BY task_id, k, correct ORDER BY s DESC, cand_idx) AS rank
FROM (SELECT *, count(*) FILTER (correct) OVER w AS n_pos, count(*) FILTER (NOT correct) OVER w AS n_neg,
        max(s) FILTER (correct) OVER w AS best_pos, bool_or(picked AND NOT correct) OVER w AS missed
      FROM (SELECT task_id, k, cand_idx, correct, payload, model, {score} AS raw_score, coalesce({score}, -1.0)::DOUBLE AS s,
              row_number() OVER (PARTITION BY task_id, k ORDER BY {score} DESC NULLS LAST, cand_idx) = 1 AS picked
            FROM candidates JOIN ks48 ON cand_idx < k WHERE parseable AND length(payload) > 0)
      WINDOW w AS (PARTITION BY task_id, k)) m JOIN tasks t USING (task_id)"""


define("members", members("score"), "candidates", "ks48", "tasks")
define("members_b", members("score_b"), "candidates", "ks48", "tasks")

BUCKET = """CASE WHEN picked THEN 0 WHEN gap <= 0 THEN 1 WHEN gap <= 0.03::DOUBLE THEN 2 WHEN gap <= 0.1::DOUBLE THEN 3 ELSE 4 END"""


def pair_sides(limit_bucket: int, bucket: str = BUCKET, source: str = "members") -> tuple[str, str]:
    pos = f"""SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY s DESC, cand_idx) AS rn
      FROM {source} WHERE correct AND n_pos > 0 AND n_neg > 0"""
    neg = f"""SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY b, s DESC, cand_idx) AS rn
      FROM (SELECT *, {bucket} AS b FROM {source} WHERE NOT correct AND n_pos > 0 AND n_neg > 0) WHERE b < {limit_bucket}"""
    return pos, neg


def pairs(limit_bucket: int, kind: str, max_pairs: int = 6, bucket: str = BUCKET, source: str = "members",
          extra: str = "") -> str:
    pos, neg = pair_sides(limit_bucket, bucket, source)
    return f"""
SELECT task_id, k, template_id, domain, style, seed, nl, pair_no, pair_type, positive_payload, negative_payload,
       positive_index, negative_index, positive_score, negative_score, positive_score - negative_score AS score_margin
FROM (SELECT p.task_id, p.k, p.template_id, p.domain, p.style, p.seed, p.nl, {kind} AS pair_type,
        p.payload AS positive_payload, n.payload AS negative_payload, p.cand_idx AS positive_index, n.cand_idx AS negative_index,
        p.s AS positive_score, n.s AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.task_id, p.k ORDER BY p.rn, n.rn) AS INT) AS pair_no
      FROM ({pos}) p JOIN ({neg}) n ON n.task_id = p.task_id AND n.k = p.k {extra} WHERE p.rn <= 2 AND n.rn <= 4)
WHERE pair_no <= {max_pairs}"""


KIND = "['selected_wrong', 'outranks_positive', 'near_tie', 'moderate_gap', 'hard_negative'][n.b + 1]"
define("pairs", pairs(4, KIND), "members")
