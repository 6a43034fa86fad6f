"""Expected results of the scalar and string queries."""

from oracle.views import q

SQL = {}
# Prompt format, written out here so that the expected results don't take them from the library.
SYSTEM_PROMPT = """You are an expert AI planning assistant that translates natural language task descriptions into PDDL (Planning Domain Definition Language) problem files.

Given a natural language description of a planning task in a known domain, generate ONLY the PDDL problem definition. Output nothing else -- no explanations, no commentary, just the PDDL problem wrapped in a code block.

Requirements:
- Output must be a valid PDDL problem definition starting with (define (problem ...)
- Include all required sections: :domain, :requirements, :objects, :init, :goal
- Use :strips requirement unless the domain requires :typing
- Ensure balanced parentheses
- List ALL objects mentioned or implied by the description
- Include ALL initial state predicates described
- Include ALL goal conditions described"""
REPAIR_PROMPT = (
    "You are an expert AI planning assistant. A candidate PDDL problem was generated from a natural "
    "language description but may contain errors. Fix the PDDL to accurately represent the described "
    "task. Output ONLY the corrected PDDL problem definition -- no explanations.")
CONTEXTS = {
    "alpha": """Domain: Blocksworld (STRIPS)
Predicates: (clear ?x), (on-table ?x), (arm-empty), (holding ?x), (on ?x ?y)
Actions: pickup, putdown, stack, unstack
Objects are blocks named b1, b2, b3, etc.""",
    "beta": """Domain: Gripper (STRIPS)
Predicates: (room ?r), (ball ?b), (gripper ?g), (at-robby ?r), (at ?b ?r), (free ?g), (carry ?o ?g)
Actions: move, pick, drop
Rooms are typically rooma, roomb. Grippers are left, right. Balls are ball1, ball2, etc.""",
}
SPECIAL ={"beta": "Mend the problem below and answer with nothing else.\n\nUse the names of the task."}
# The white space class as a pattern.
WS = (r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


SQL["style_label"] = q("SELECT task_id, style FROM tasks", "tasks")
SQL["filter_domain"] = q("SELECT task_id, domain, template_id FROM tasks WHERE domain IN ('alpha', 'beta')", "tasks")
SQL["filter_style"] = q("SELECT task_id, domain, style FROM tasks WHERE style = 'abstract/explicit'", "tasks")
SQL["prefix_k"] = q("SELECT task_id, k, cand_idx, parseable, score FROM pool", "pool")
SQL["eval_error"] = q("""
SELECT s.task_id, s.k, c.cand_idx AS selected_index,
       CASE WHEN c.task_id IS NULL THEN 'no_candidates' ELSE 'first_candidate' END AS reason,
       coalesce(c.parseable, false) AS parseable,
       CASE WHEN c.task_id IS NULL THEN 'no_candidates' WHEN NOT c.parseable THEN coalesce(c.error, 'parse_failed')
            ELSE c.error END AS error
FROM slots s LEFT JOIN candidates c ON c.task_id = s.task_id AND c.cand_idx = 0""", "slots", "candidates")

SQL["extract_block"] = q(rf"""
SELECT conv_id, turn, regexp_replace(
  CASE WHEN regexp_matches(raw_response, '(?s)```(?:pddl)?\s*\n(.*?)```')
         THEN regexp_extract(raw_response, '(?s)```(?:pddl)?\s*\n(.*?)```', 1)
       WHEN stop IS NOT NULL THEN left(tail, stop) ELSE raw_response END, '^{WS}+|{WS}+$', '', 'g') AS block
FROM headed LEFT JOIN closed USING (tail)""", "responses",
    headed=r"SELECT *, regexp_extract(raw_response, '(?s)(\(define\s.*)', 1) AS tail FROM responses",
    steps="""SELECT tail, i, CASE substr(tail, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS d
FROM (SELECT tail, unnest(range(1, length(tail) + 1)) AS i FROM (SELECT DISTINCT tail FROM headed))""",
    closed="""SELECT tail, min(i) AS stop FROM (SELECT *, sum(d) OVER (PARTITION BY tail ORDER BY i) AS depth FROM steps)
WHERE depth = 0 GROUP BY tail""")


def lookup(table: dict, tail: str = "") -> str:
    cases = " ".join(f"WHEN {s(k)} THEN {s(v + tail)}" for k, v in table.items())
    return f"CASE domain {cases} END"


NL = "chr(10)"
PROMPT = f"""concat({s(SYSTEM_PROMPT)}, {NL}, {NL}, coalesce({lookup(CONTEXTS)} || {NL} || {NL}, ''),
  'Task description:', {NL}, nl, {NL}, {NL}, 'PDDL problem definition:')"""
FEEDBACK = """concat('The candidate PDDL parses successfully. The current verifier score for this candidate is ',
  printf('%.4f', original_score), '. A lightweight planner check says the candidate is ',
  CASE WHEN original_solvable THEN 'solvable' ELSE 'not confirmed solvable' END,
  '. This candidate was selected by the current verifier, but it may still fail to match the natural-language task. ',
  'Repair the problem definition so the objects, initial state, and goal match the task description exactly.')"""


def repair_prompt(feedback: str) -> str:
    return f"""concat(coalesce({lookup(SPECIAL)},
      concat({s(REPAIR_PROMPT)}, coalesce({NL} || {NL} || {lookup(CONTEXTS)}, ''))), {NL}, {NL},
      'Task description:', {NL}, nl, {NL}, {NL}, 'Candidate PDDL (may contain errors):', {NL}, original_payload, {NL}, {NL},
      CASE WHEN {feedback} <> '' THEN concat('Issues identified: ', {feedback}, {NL}, {NL}) ELSE '' END,
      'Corrected PDDL problem definition:')"""


SQL["build_prompt"] = q(f"SELECT task_id, {PROMPT} AS prompt FROM tasks", "tasks")
SQL["build_feedback"] = q(f"SELECT task_id, {FEEDBACK} AS feedback FROM repair_rows", "repair_rows")
SQL["build_repair_prompt"] = q(f"""
SELECT task_id, {repair_prompt("fb")} AS prompt
FROM (SELECT *, CASE WHEN original_correct THEN '' ELSE {FEEDBACK} END AS fb FROM repair_rows)""", "repair_rows")

SQL["leakage_audit"] = q("""
SELECT task_id, kind, leak FROM (
  SELECT task_id, kind, CASE l WHEN 1 THEN CASE WHEN contains(lower(txt), lower(gold)) THEN 'gold_text' END
                               WHEN 2 THEN CASE WHEN contains(lower(txt), lower(cand)) THEN 'candidate_text' END
                               ELSE CASE WHEN contains(lower(txt), 'equivalent') THEN 'word_equivalent' END END AS leak
  FROM texts, (SELECT unnest([1, 2, 3]) AS l)) WHERE leak IS NOT NULL""", "repair_rows", "artifacts",
    fb=f"SELECT r.*, a.artifact AS gold, {FEEDBACK} AS fb FROM repair_rows r JOIN artifacts a USING (task_id)",
    texts=f"""SELECT task_id, gold, original_payload AS cand, 'prompt' AS kind, {PROMPT} AS txt FROM fb
              UNION ALL SELECT task_id, gold, original_payload, 'repair_prompt', {repair_prompt("fb")} FROM fb
              UNION ALL SELECT task_id, gold, original_payload, 'feedback', fb FROM fb""")

SQL["plan_requests"] = q("""
SELECT task_id, backend, model, CAST(o + i AS INT) AS candidate_index
FROM tasks, (VALUES ('local', 'model_0', 2, 0), ('remote', 'model_1', 3, 2), ('remote', 'model_2', 1, 5)) b(backend, model, n, o),
     LATERAL (SELECT unnest(range(n)) AS i)""", "tasks")

SQL["content_key"] = f"""
SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')), 1, 16) AS content_key
FROM documents"""

SQL["repair_due"] = q("""
SELECT p.task_id, p.k, p.policy, (p.k = 8 AND c.cand_idx IS NOT NULL AND c.parseable) AS repair_due
FROM basic p LEFT JOIN candidates c ON c.task_id = p.task_id AND c.cand_idx = p.selected_index
WHERE p.policy IN ('verifier_ranked', 'greedy_first')""", "basic", "candidates")

SQL["repair_accept"] = q("""
SELECT task_id, repair_parseable AND coalesce(repair_score >= original_score - 0.05::DOUBLE, false) AS accepted
FROM repair_rows""", "repair_rows")

SQL["repair_final"] = q("""
SELECT task_id, 'verifier_ranked_repair' AS policy, NULL::BOOLEAN AS guard_accepted,
       CASE WHEN repair_parseable THEN 'repair' ELSE 'original_fallback_repair_unparseable' END AS final_source,
       true AS final_parseable, CASE WHEN repair_parseable THEN repair_correct ELSE original_correct END AS final_correct
FROM repair_rows
UNION ALL
SELECT task_id, 'verifier_ranked_repair_guarded', ok,
       CASE WHEN ok THEN 'repair_guard_accepted' ELSE 'original_guard_rejected' END, true,
       CASE WHEN ok THEN repair_correct ELSE original_correct END
FROM (SELECT *, repair_parseable AND coalesce(repair_score >= original_score - 0.05::DOUBLE, false) AS ok FROM repair_rows)""",
                        "repair_rows")

SQL["repair_outcome"] = q("""
SELECT task_id, original_correct, fin AS final_correct,
       CASE WHEN fin AND NOT original_correct THEN 'repair_helped' WHEN original_correct AND NOT fin THEN 'repair_hurt'
            WHEN fin THEN 'both_success' ELSE 'both_fail' END AS outcome
FROM (SELECT *, CASE WHEN repair_parseable AND repair_score >= original_score THEN repair_correct ELSE original_correct END AS fin
      FROM repair_rows)""", "repair_rows")

SQL["failure_type"] = q("""
SELECT task_id, CASE WHEN NOT original_solvable THEN 'unsolvable_selected_candidate'
  WHEN original_score >= 0.8 THEN 'high_verifier_score_wrong_candidate'
  WHEN original_score < 0.4 THEN 'low_verifier_score_wrong_candidate'
  ELSE 'solvable_non_equivalent_selected_candidate' END AS failure_type
FROM repair_rows WHERE NOT original_correct""", "repair_rows")

SQL["miss_type"] = q("SELECT task_id, k, oracle_available, margin, miss_type FROM cases", "cases")
SQL["gain_reason"] = q("SELECT task_id, k, gain_over_greedy, gain_reason FROM cases", "cases")
SQL["change_cause"] = q("SELECT k, outcome, cause, count(*) AS n FROM paired GROUP BY k, outcome, cause", "paired")
SQL["template_family"] = q("""
SELECT task_id, template_name, CASE WHEN contains(template_name, '_') THEN split_part(template_name, '_', 2)
  ELSE template_name END AS family
FROM (SELECT task_id, CASE WHEN goal_is_abstract = 1 THEN concat('t', template_id)
        ELSE concat('orders_', domain, '_', template_id) END AS template_name FROM tasks)""", "tasks")
