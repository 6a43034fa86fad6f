"""DuckDB definitions of the input views and the helper that prefixes them to a query."""

TASKS = """
SELECT o_orderkey AS task_id, CAST(o_custkey AS BIGINT) AS template_id,
       CASE o_orderstatus WHEN 'F' THEN 'alpha' WHEN 'O' THEN 'beta' ELSE 'gamma' END AS domain,
       CAST(o_orderkey % 2 AS INT) AS init_is_abstract,
       CAST((o_orderkey % 3) % 2 AS INT) AS goal_is_abstract,
       CAST(48 + o_orderkey % 5 AS INT) AS seed,
       concat('order ', CAST(o_orderkey AS VARCHAR), ' priority ', o_orderpriority) AS nl,
       concat(CASE WHEN o_orderkey % 2 = 1 THEN 'abstract' ELSE 'explicit' END, '/',
              CASE WHEN (o_orderkey % 3) % 2 = 1 THEN 'abstract' ELSE 'explicit' END) AS style
FROM orders"""

CANDIDATES = """
SELECT task_id, cand_idx, parseable,
       (parseable AND flag = 'A' AND qty >= 25) AS correct,
       (parseable AND status = 'F') AS solvable,
       CASE WHEN parseable THEN CAST((pk * 37 + sk * 11 + ln * 7) % 101 AS DOUBLE) / 100 END AS score,
       CASE WHEN parseable THEN CAST((pk * 13 + sk * 29 + ln * 3) % 101 AS DOUBLE) / 100 END AS score_b,
       CASE WHEN NOT parseable AND sk % 2 = 0 THEN 'provider_error' END AS error,
       qty / 10 AS latency_sec,
       concat('model_', CAST(sk % 3 AS VARCHAR)) AS model,
       concat('(supplies p', CAST(pk AS VARCHAR), ' s', CAST(sk AS VARCHAR), ')') AS payload
FROM (
  SELECT l_orderkey AS task_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS cand_idx,
         (l_returnflag <> 'R') AS parseable, l_returnflag AS flag, l_linestatus AS status,
         l_quantity AS qty, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln
  FROM lineitem) AS base"""

REPAIRS = """
SELECT task_id, cand_idx AS original_index, correct AS original_correct, solvable AS original_solvable,
       score AS original_score, payload AS original_payload,
       (task_id % 25 <> 0) AS repair_parseable,
       (task_id % 25 <> 0 AND task_id % 4 <> 0) AS repair_correct,
       (task_id % 25 <> 0 AND task_id % 3 <> 0) AS repair_solvable,
       CASE WHEN task_id % 25 <> 0 THEN CAST((task_id * 17) % 101 AS DOUBLE) / 100 END AS repair_score
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC NULLS LAST, cand_idx) AS rn
      FROM candidates WHERE cand_idx < 8 AND parseable) AS ranked
WHERE rn = 1"""

REPAIR_ROWS = """
SELECT r.*, t.template_id, t.domain, t.style, t.seed, t.nl
FROM repairs r JOIN tasks t USING (task_id)"""

EXAMPLES = """
SELECT d.doc_id, d.source AS template_id, d.lang AS domain,
       CASE WHEN d.doc_id % 10 < 2 THEN 'gold' WHEN d.doc_id % 10 < 6 THEN 'perturbation' ELSE 'llm' END AS source,
       d.n_chars >= 20 AS parseable,
       CAST(l.quality AS INT) AS label,
       CAST((l.quality * 350 + (d.doc_id * 7919) % 650) AS DOUBLE) / 1000 AS score,
       d.text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

RESPONSES = """
SELECT conv_id, turn, text AS body,
       CASE (conv_id + turn) % 5 WHEN 0 THEN text
            WHEN 1 THEN concat('Sure.', chr(10), '```pddl', chr(10), text, chr(10), '```', chr(10), 'Done.')
            WHEN 2 THEN concat('```', chr(10), text, chr(10), '```')
            WHEN 3 THEN concat('Answer: (define (p) ', repeat('(a ', CAST(conv_id % 40 AS INT)), text, repeat(')', CAST(conv_id % 40 + 1 AS INT)), ' (more)')
            ELSE concat('(define (p ', text, ' (define (q))') END AS raw_response
FROM conversations WHERE role = 'assistant'"""

ARTIFACTS = """
SELECT task_id,
       concat('(define (problem t', CAST(task_id AS VARCHAR), ') (:domain supply) (:objects ',
              string_agg(concat('c', CAST(cand_idx AS VARCHAR)), ' ' ORDER BY cand_idx), ') (:init ',
              string_agg(payload, ' ' ORDER BY cand_idx), ') (:goal (and ',
              string_agg(concat('(rank c', CAST(cand_idx AS VARCHAR), ' ', model, ')'), ' ' ORDER BY cand_idx), ')))') AS artifact
FROM candidates GROUP BY task_id"""

STREAM = """
SELECT event_id, ts, user_id AS task_id, event_type AS status, value AS latency_sec,
       CAST(json_extract_string(props, '$.k') AS INT) AS k
FROM events"""

# Shared intermediate results, each in plain window SQL.
KS = "SELECT CAST(unnest([1, 4, 8]) AS INT) AS k"

SLOTS = "SELECT t.*, k FROM tasks t CROSS JOIN ks"
POOL = "SELECT c.*, k FROM candidates c JOIN ks ON c.cand_idx < k"

_VIEWS = {
    "tasks": (TASKS, ()),
    "candidates": (CANDIDATES, ()),
    "repairs": (REPAIRS, ("candidates",)),
    "repair_rows": (REPAIR_ROWS, ("repairs", "tasks")),
    "examples": (EXAMPLES, ()),
    "responses": (RESPONSES, ()),
    "artifacts": (ARTIFACTS, ("candidates",)),
    "stream": (STREAM, ()),
    "ks": (KS, ()),
    "slots": (SLOTS, ("tasks", "ks")),
    "pool": (POOL, ("candidates", "ks")),
}


def define(name: str, sql: str, *needs: str) -> None:
    """Register a shared intermediate view."""
    assert name not in _VIEWS, name
    _VIEWS[name] = (sql, needs)


def bigint_counts(sql: str) -> str:
    """count_if gives HUGEINT; a filtered count gives the BIGINT that Spark counts have."""
    while (start := sql.find("count_if(")) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len("count_if("):end - 1]
        sql = f"{sql[:start]}count(*) FILTER (WHERE {inner}){sql[end:]}"
    return sql


def q(body: str, *needs: str, **local: str) -> str:
    """``WITH`` the needed views (and query-local ones, in order) around ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _VIEWS[name][1]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    body, local = bigint_counts(body), {k: bigint_counts(v) for k, v in local.items()}
    ctes = [f"{name} AS ({bigint_counts(_VIEWS[name][0]).strip()})" for name in ordered]
    ctes += [f"{name} AS ({sql.strip()})" for name, sql in local.items()]
    return f"WITH {', '.join(ctes)} {body.strip()}" if ctes else body.strip()
