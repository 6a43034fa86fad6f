"""Expected results of the calibration queries, computed from the rows and not from a histogram."""

from oracle.views import define, q

SQL = {}
THRESHOLDS = "[" + ", ".join(f"{5 * i / 100}" for i in range(1, 20)) + "]::DOUBLE[]"
TEMPERATURES = "[" + ", ".join(f"{round(0.5 + 0.05 * i, 2)}" for i in range(91)) + "]::DOUBLE[]"
EDGES = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]::DOUBLE[]"
LOGIT = "ln(greatest(0.001::DOUBLE, least(0.999::DOUBLE, score)) / (1.0::DOUBLE - greatest(0.001::DOUBLE, least(0.999::DOUBLE, score))))"


def clip(p: str) -> str:
    return f"greatest(2.220446049250313e-16::DOUBLE, least(1.0::DOUBLE - 2.220446049250313e-16::DOUBLE, {p}))"


def loss(p: str) -> str:
    return f"avg(CASE WHEN label = 1 THEN -ln({clip(p)}) ELSE -ln(1.0::DOUBLE - {clip(p)}) END)"


def binary(by: str, source: str, hit: str) -> str:
    return f"""SELECT {by}, n, (tp + n - p - (hits - tp)) / n AS accuracy, tp / greatest(hits, 1) AS precision, tp / greatest(p, 1) AS recall,
      2 * tp / greatest(hits + p, 1) AS f1, hits / n AS positive_rate
    FROM (SELECT {by}, count(*) AS n, count_if(label = 1) AS p, count_if({hit}) AS hits, count_if({hit} AND label = 1) AS tp FROM {source} GROUP BY {by})"""


def auc(by: str, source: str) -> str:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    return f"""SELECT s.{by}, coalesce(auc, 0.0) AS auc FROM (SELECT DISTINCT {by} FROM {source}) s LEFT JOIN (
      SELECT a.{by}, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
      FROM {source} a JOIN {source} b ON a.{by} = b.{by} AND a.label = 1 AND b.label = 0 GROUP BY a.{by}) x ON x.{by} = s.{by}"""


def ece(by: str, source: str) -> str:
    return f"""SELECT {by}, sum(abs(acc - conf) * bn) / sum(bn) AS ece FROM (
      SELECT {by}, bin, count(*) AS bn, avg(label) AS acc, avg(score) AS conf
      FROM (SELECT *, len(list_filter({EDGES}, lambda e: e <= score AND e < 1.0)) AS bin FROM {source}) GROUP BY {by}, bin) GROUP BY {by}"""


define("one", "SELECT *, 1 AS g FROM examples", "examples")
define("auc_domain", auc("domain", "examples"), "examples")
define("sweep_rows", f"SELECT *, unnest({THRESHOLDS}) AS threshold FROM one", "one")
define("sweep_domain", binary("domain, threshold", "sweep_rows", "score >= threshold"), "sweep_rows")
define("sweep", binary("threshold", "sweep_rows", "score >= threshold"), "sweep_rows")

SQL["binary_metrics"] = q(f"SELECT * EXCLUDE (g) FROM ({binary('g', 'one', 'score >= 0.5')})", "one")
SQL["auc"] = q(f"SELECT auc FROM ({auc('g', 'one')})", "one")
SQL["log_loss"] = q(f"SELECT round({loss('score')}, 9) AS log_loss FROM one", "one")
SQL["ece"] = q(f"SELECT round(ece, 9) AS ece FROM ({ece('g', 'one')})", "one")
SQL["score_summary"] = q(f"""
SELECT domain, n, positives, negatives, log_loss, auc, round(ece, 9) AS ece
FROM (SELECT domain, count(*) AS n, count_if(label = 1) AS positives, count_if(label = 0) AS negatives, round({loss('score')}, 9) AS log_loss FROM one GROUP BY domain)
JOIN auc_domain USING (domain) JOIN ({ece('domain', 'one')}) USING (domain)""", "one", "auc_domain")
SQL["group_metrics"] = q(f"""
SELECT * FROM ({binary('stratum', 'tagged', 'score >= 0.5')}) JOIN ({auc('stratum', 'tagged')}) USING (stratum)""", "examples",
    tagged="SELECT label, score, unnest([concat('source=', source), concat('domain=', domain)]) AS stratum FROM examples")
SQL["threshold_sweep"] = q("SELECT * FROM sweep", "sweep")
SQL["best_threshold"] = q("SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1", "sweep")
SQL["risk_coverage"] = q("""
SELECT threshold, a / n AS coverage, a AS accepted_n, n - a AS rejected_n, CASE WHEN a > 0 THEN tp / a END AS selective_accuracy,
       CASE WHEN a > 0 THEN round(1.0 - tp / a, 9) END AS selective_risk, CASE WHEN a > 0 THEN 2 * tp / (a + tp) END AS selective_f1,
       CASE WHEN a > 0 THEN tp / a END AS selective_precision, CASE WHEN a > 0 THEN CASE WHEN tp > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END END AS selective_recall
FROM (SELECT threshold, count(*) AS n, count_if(score >= threshold) AS a, count_if(score >= threshold AND label = 1) AS tp FROM sweep_rows GROUP BY threshold)""",
                         "sweep_rows")
_SCALED = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{LOGIT} / temperature)))"
define("temps", f"""SELECT temperature, {loss(_SCALED)} AS loss FROM (SELECT *, unnest({TEMPERATURES}) AS temperature FROM one) GROUP BY temperature""", "one")
SQL["temperature_losses"] = q("SELECT temperature, round(loss, 9) AS loss FROM temps", "temps")
SQL["fit_temperature"] = q("SELECT temperature, round(loss, 9) AS loss FROM temps ORDER BY round(loss, 9), temperature LIMIT 1", "temps")
SQL["apply_temperature"] = q(f"SELECT doc_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-{LOGIT} / 1.5::DOUBLE)), 9) AS scaled FROM examples", "examples")
SQL["pairwise_accuracy"] = q("""
SELECT slice, count(*) AS n, count_if(score_margin > 0) AS wins, round(avg(score_margin), 9) AS mean_margin, count_if(score_margin > 0) / count(*) AS pairwise_accuracy
FROM (SELECT score_margin, unnest(['all', concat('domain=', domain), concat('style=', style), concat('k=', k), concat('pair_type=', pair_type)]) AS slice FROM pairs)
GROUP BY slice""", "pairs")
SQL["score_pairs"] = q("""
SELECT task_id, cand_idx, CASE WHEN parseable THEN CAST(length(payload) AS DOUBLE) / (length(nl) + length(payload)) END AS model_score
FROM candidates JOIN tasks USING (task_id)""", "candidates", "tasks")
SQL["replay_scorers"] = q("""
SELECT verifier, k, policy, count(*) AS total, count_if(parseable) AS parse_count, count_if(solvable) AS solve_count, count_if(correct) AS equiv_count,
       count_if(has_error) AS error_count, sum(parseable_count) / count(*) AS avg_parseable_candidates, sum(correct_count) / count(*) AS avg_equivalent_candidates,
       count_if(oracle) / count(*) AS oracle_bestofk_equiv_rate, count_if(parseable) / count(*) AS parse_rate, count_if(solvable) / count(*) AS solve_rate,
       count_if(correct) / count(*) AS equiv_rate, count_if(correct) / greatest(count_if(parseable), 1) AS equiv_given_parse
FROM (SELECT 'scorer_a' AS verifier, * FROM basic WHERE policy <> 'random_parseable' UNION ALL SELECT 'scorer_b', * FROM greedy
      UNION ALL SELECT 'scorer_b', * REPLACE ('verifier_ranked' AS policy) FROM ranked_b) JOIN pool_stats USING (task_id, k)
GROUP BY verifier, k, policy""", "basic", "greedy", "ranked_b", "pool_stats")


def isotonic(fitted: str, applied: str) -> dict[str, str]:
    """Local views: the fit as the largest over starts of the least over ends of the share of positives, read off by lines."""
    return {
        "points": f"""SELECT score, row_number() OVER (ORDER BY score) AS i, sum(count(*)) OVER (ORDER BY score) AS n, sum(sum(label)) OVER (ORDER BY score) AS p
          FROM {fitted} GROUP BY score""",
        "shares": """SELECT s.i AS s, e.i AS e, CAST(e.p - coalesce(b.p, 0) AS DOUBLE) / CAST(e.n - coalesce(b.n, 0) AS DOUBLE) AS share
          FROM points s JOIN points e ON e.i >= s.i LEFT JOIN points b ON b.i = s.i - 1""",
        "fitted": """SELECT score, max(low) AS v FROM (SELECT s, e, min(share) OVER (PARTITION BY s ORDER BY e DESC) AS low FROM shares)
          JOIN points ON i = e GROUP BY score""",
        "read_off": f"""SELECT q.score, CASE WHEN p.v IS NULL THEN n.v WHEN n.v IS NULL OR p.score = n.score THEN p.v
            ELSE p.v + (q.score - p.score) * (n.v - p.v) / (n.score - p.score) END AS iso
          FROM (SELECT DISTINCT score FROM {applied}) q ASOF LEFT JOIN fitted p ON q.score >= p.score ASOF LEFT JOIN fitted n ON q.score <= n.score"""}


CLIPPED = "greatest(1e-6::DOUBLE, least(1.0::DOUBLE - 1e-6::DOUBLE, iso))"
SQL["fit_isotonic"] = q(f"""
SELECT doc_id, score, round({CLIPPED}, 9) AS isotonic FROM examples JOIN read_off USING (score)""", "examples", **isotonic("examples", "examples"))


def report(fitted: str, applied: str) -> tuple[str, dict[str, str]]:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{LOGIT} / temperature)))"
    views = isotonic(fitted, applied) | {
        "best_t": f"""SELECT temperature FROM (SELECT temperature, round({loss(t)}, 9) AS l FROM (SELECT *, unnest({TEMPERATURES}) AS temperature FROM {fitted})
          GROUP BY temperature) ORDER BY l, temperature LIMIT 1""",
        "versions": f"""SELECT label, score, 'raw' AS version FROM {applied} UNION ALL SELECT label, {t}, 'temperature' FROM {applied}, best_t
          UNION ALL SELECT label, {CLIPPED}, 'isotonic' FROM {applied} JOIN read_off USING (score)""",
        "version_rows": f"SELECT *, unnest({THRESHOLDS}) AS threshold FROM versions",
        "version_f1": f"""SELECT version, threshold, f1 AS best_f1 FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY f1 DESC, threshold) AS r
          FROM ({binary('version, threshold', 'version_rows', 'score >= threshold')})) WHERE r = 1"""}
    return f"""
SELECT version, n, positives, negatives, log_loss, auc, round(ece, 9) AS ece, threshold, best_f1
FROM (SELECT version, count(*) AS n, count_if(label = 1) AS positives, count_if(label = 0) AS negatives, round({loss('score')}, 9) AS log_loss FROM versions GROUP BY version)
JOIN ({auc('version', 'versions')}) USING (version) JOIN ({ece('version', 'versions')}) USING (version) JOIN version_f1 USING (version)""", views


_body, _views = report("examples", "examples")
SQL["calibrate_same_split"] = q(_body, "examples", **_views)
_body, _views = report("fitted_rows", "applied_rows")
SQL["calibrate"] = q(_body, "examples", split_rows="""
SELECT e.label, e.score, coalesce(before, 0) < floor(total * 0.5::DOUBLE) AS first FROM examples e JOIN (
  SELECT template_id, sum(n) OVER (ORDER BY md5(concat_ws('|', '123', template_id)), template_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    sum(n) OVER () AS total FROM (SELECT template_id, count(*) AS n FROM examples GROUP BY template_id)) USING (template_id)""",
                     fitted_rows="SELECT * FROM split_rows WHERE first", applied_rows="SELECT * FROM split_rows WHERE NOT first", **_views)

# A fit at its optimum has no gradient; without a penalty on the intercept the scores of the rows fitted have the mean of their labels.
SQL["scorer_optimum"] = q("""
SELECT count(*) AS n, count_if(label = 1) AS positives, true AS optimal, round(avg(label), 3) AS mean_score
FROM (SELECT e.label, coalesce(before, 0) < floor(total * 0.85::DOUBLE) AS train FROM examples e JOIN (
  SELECT template_id, sum(n) OVER (ORDER BY md5(concat_ws('|', '42', template_id)), template_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    sum(n) OVER () AS total FROM (SELECT template_id, count(*) AS n FROM examples GROUP BY template_id)) USING (template_id)) WHERE train""", "examples")
SQL["pair_scorer_optimum"] = q("SELECT 2 * count(*) AS n, count(*) AS positives, true AS optimal FROM pairs", "pairs")
