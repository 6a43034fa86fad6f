"""Expected results of the artifact queries: facts are unnested to rows and ranked by md5."""

from oracle.views import define, q

SQL = {}
FACT = r"\([^()]+\)"

define("parsed", rf"""
SELECT *, string_split(regexp_extract(objects, '\(:objects (.*)\)', 1), ' ') AS object_list,
       regexp_extract_all(init, '{FACT}') AS init_facts, regexp_extract_all(goal, '{FACT}') AS goal_facts
FROM (SELECT task_id, artifact, regexp_extract(artifact, '\(:objects\s[^()]*\)') AS objects,
        regexp_extract(artifact, '\(:init\s(?:[^()]|\([^()]*\))*\)') AS init,
        regexp_extract(artifact, '\(:goal\s(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)') AS goal FROM artifacts)""", "artifacts")
define("fact_rows", """
SELECT task_id, 'init' AS section, unnest(init_facts) AS fact, unnest(range(len(init_facts))) AS pos FROM parsed
UNION ALL SELECT task_id, 'goal', unnest(goal_facts), unnest(range(len(goal_facts))) FROM parsed""", "parsed")

SQL["extract_section"] = q("SELECT task_id, objects, init, goal FROM parsed", "parsed")
SQL["explode_facts"] = q("""
SELECT task_id, section, CAST(pos AS INT) AS pos, w[1] AS pred, array_to_string(w[2:], ' ') AS args
FROM (SELECT *, string_split(trim(fact, '()'), ' ') AS w FROM fact_rows)""", "fact_rows")
SQL["render_artifact"] = q("SELECT task_id, artifact FROM artifacts", "artifacts")


def chosen(kind: str, section: str, salt: str = "") -> str:
    """The drawn fact of each task (all facts of these artifacts have two arguments)."""
    key = f"concat_ws('|', '7', '{kind}', task_id{', ' + salt if salt else ''}, pos)"
    over = f"task_id{', ' + salt if salt else ''}"
    source = f"(SELECT f.*, a FROM fact_rows f, (SELECT unnest(range(1, 7)) AS a))" if salt else "fact_rows"
    return f"""SELECT * EXCLUDE (rn), string_split(trim(fact, '()'), ' ') AS w FROM (
      SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY md5({key}), pos) AS rn FROM {source} WHERE section = '{section}') WHERE rn = 1"""


ROTATED = "concat('(', w[1], ' ', array_to_string(list_concat(w[3:], [w[2]]), ' '), ')')"
REVERSED = "concat('(', w[1], ' ', array_to_string(list_reverse(w[2:]), ' '), ')')"
WITHOUT = "array_to_string(list_concat(init_facts[1:pos], init_facts[pos + 2:]), ' ')"
EXTRA = "concat('extra_', CAST(CAST(concat('0x', substr(md5(concat_ws('|', '7', 'add_object', task_id{s})), 1, 8)) AS BIGINT) % 99 + 1 AS VARCHAR))"
OBJECTS = "concat('(:objects ', array_to_string(object_list, ' '), ' ', {e}, ')')"


def first(text: str, old: str, new: str) -> str:
    return f"concat(left({text}, instr({text}, {old}) - 1), {new}, substr({text}, instr({text}, {old}) + length({old})))"


def edit(section: str, new: str) -> str:
    return first("artifact", section, new)


# Edits: one drawn fact is replaced, deleted or copied behind the last one.
define("sizes", "SELECT task_id, len(init_facts) AS n_init, len(goal_facts) AS n_goal, len(object_list) AS n_objects FROM parsed", "parsed")


def drawn_edits(salt: str = "", flipped: bool = False) -> dict[str, str]:
    """SELECT of (task_id, [a,] section, pos, op, fact) per kind; ``salt`` is the number of the attempt."""
    keys = "task_id" + (", a" if salt else "")
    negated = "concat('(on-table ', w[2], ')')" if flipped else "concat('(not ', fact, ')')"
    at = lambda kind, section, op, fact, pos="pos", when="true": (
        f"SELECT {keys}, '{section}' AS section, CAST({pos} AS INT) AS pos, '{op}' AS op, {fact} AS fact "
        f"FROM ({chosen(kind, section, salt)}) JOIN sizes USING (task_id) WHERE {when}")
    key = f"task_id{', a' if salt else ''}"
    side = f"CAST(concat('0x', substr(md5(concat_ws('|', '7', 'swap_args', {key}, 'section')), 1, 8)) AS BIGINT) % 2"
    objects = f"(SELECT p.*{', a' if salt else ''} FROM parsed p{', (SELECT unnest(range(1, 7)) AS a)' if salt else ''})"
    two = f"""SELECT {keys}, max(o) FILTER (rn = 1) AS x, max(o) FILTER (rn = 2) AS y FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5(concat_ws('|', '7', 'swap_objects', {key}, i)), i) AS rn
      FROM (SELECT {keys}, unnest(object_list) AS o, unnest(range(len(object_list))) AS i FROM {objects})) WHERE rn <= 2 GROUP BY {keys} HAVING count(*) = 2"""
    named = f"SELECT {keys}, 'model_0' AS x, 'model_1' AS y FROM {objects} WHERE contains(artifact, 'model_0') AND contains(artifact, 'model_1')"
    traded = lambda v: f"CASE {v} WHEN x THEN y WHEN y THEN x ELSE {v} END"
    exchanged = lambda pairs: f"""SELECT {keys}, section, CAST(pos AS INT) AS pos, 'replace' AS op, new AS fact FROM (
      SELECT {keys}, section, pos, fact, concat('(', w[1], ' ', array_to_string(list_transform(w[2:], lambda v: {traded('v')}), ' '), ')') AS new
      FROM (SELECT *, string_split(trim(fact, '()'), ' ') AS w FROM fact_rows) JOIN ({pairs}) USING (task_id)
      UNION ALL SELECT {keys}, 'objects', i, o, {traded('o')} FROM (SELECT task_id, unnest(object_list) AS o, unnest(range(len(object_list))) AS i FROM parsed)
        JOIN ({pairs}) USING (task_id)) WHERE new <> fact"""  # noqa: E731
    return {
        "swap_goal_args": at("swap_goal_args", "goal", "replace", ROTATED, when=f"{ROTATED} <> fact"),
        "drop_init": at("drop_init", "init", "delete", "NULL::VARCHAR", when="n_init > 2"),
        "add_object": f"SELECT {keys}, 'objects' AS section, CAST(len(object_list) AS INT) AS pos, 'insert' AS op, {EXTRA.format(s=', a' if salt else '')} AS fact FROM {objects}",
        "drop_goal": at("drop_goal", "goal", "delete", "NULL::VARCHAR", when="n_goal > 1"),
        "dup_init_wrong_args": at("dup_init_wrong_args", "init", "insert", ROTATED, "n_init", f"{ROTATED} <> fact"),
        "negate_goal": at("negate_goal", "goal", "replace", negated),
        "swap_args": at("swap_args", "init", "replace", REVERSED, when=f"{REVERSED} <> fact AND {side} = 0") + " UNION ALL "
        + at("swap_args", "goal", "replace", REVERSED, when=f"{REVERSED} <> fact AND {side} = 1"),
        "contradict_init": at("contradict_init", "init", "insert", "concat('(holding ', w[2], ')')", "n_init"),
        "swap_objects": exchanged(two), "swap_named": exchanged(named)}


for _kind in ("drop_init", "swap_objects", "swap_named"):
    SQL[f"corrupt_{_kind}"] = q(f"SELECT task_id, section, pos, op, fact FROM ({drawn_edits()[_kind]})", "parsed", "fact_rows", "sizes")


# Texts: the whole artifact after the edit.
def corruption(name: str, body: str, *needs: str, **ctes: str) -> None:
    SQL[name] = q(f"SELECT task_id, corrupted FROM (SELECT task_id, artifact, {body}) WHERE corrupted IS NOT NULL AND corrupted <> artifact", *needs, **ctes)


corruption("corrupt_swap_goal_args", f"{edit('goal', first('goal', 'fact', ROTATED))} AS corrupted FROM parsed JOIN c USING (task_id)",
           "parsed", "fact_rows", c=chosen("swap_goal_args", "goal"))
corruption("corrupt_add_object", f"{edit('objects', OBJECTS.format(e=EXTRA.format(s='')))} AS corrupted FROM parsed", "parsed")
corruption("corrupt_drop_goal", f"""CASE WHEN len(goal_facts) > 1 THEN {edit('goal', f"regexp_replace({first('goal', 'fact', chr(39) * 2)}, ' +', ' ', 'g')")} END AS corrupted
  FROM parsed JOIN c USING (task_id)""", "parsed", "fact_rows", c=chosen("drop_goal", "goal"))
corruption("corrupt_dup_init_wrong_args", f"""CASE WHEN {ROTATED} <> fact THEN {edit('init', f"concat('(:init ', array_to_string(init_facts, ' '), ' ', {ROTATED}, ')')")} END AS corrupted
  FROM parsed JOIN c USING (task_id)""", "parsed", "fact_rows", c=chosen("dup_init_wrong_args", "init"))
corruption("corrupt_negate_goal", f"""{edit('goal', first('goal', 'fact', "concat('(not ', fact, ')')"))} AS corrupted FROM parsed JOIN c USING (task_id)""",
           "parsed", "fact_rows", c=chosen("negate_goal", "goal"))
corruption("corrupt_swap_args", f"""CASE WHEN {REVERSED} <> fact THEN CASE section WHEN 'init' THEN {edit('init', first('init', 'fact', REVERSED))}
    ELSE {edit('goal', first('goal', 'fact', REVERSED))} END END AS corrupted
  FROM parsed JOIN (SELECT * FROM ci UNION ALL SELECT * FROM cg) c USING (task_id)
  WHERE section = CASE WHEN CAST(concat('0x', substr(md5(concat_ws('|', '7', 'swap_args', task_id, 'section')), 1, 8)) AS BIGINT) % 2 = 0 THEN 'init' ELSE 'goal' END""",
           "parsed", "fact_rows", ci=chosen("swap_args", "init"), cg=chosen("swap_args", "goal"))
corruption("corrupt_contradict_init", f"""{edit('init', "concat('(:init ', array_to_string(init_facts, ' '), ' (holding ', w[2], '))')")} AS corrupted
  FROM parsed JOIN c USING (task_id)""", "parsed", "fact_rows", c=chosen("contradict_init", "init"))

_GENERAL = ["swap_goal_args", "drop_init", "add_object", "drop_goal", "dup_init_wrong_args", "negate_goal", "swap_args", "contradict_init"]
_TYPE = "CAST(concat('0x', substr(md5(concat_ws('|', '7', 'type', task_id, a)), 1, 8)) AS BIGINT)"
SQL["corrupt_many"] = q("""
SELECT task_id, CAST(a AS INT) AS attempt, kind, section, pos, op, fact
FROM made JOIN (SELECT task_id, a, row_number() OVER (PARTITION BY task_id ORDER BY a) AS rn FROM (SELECT DISTINCT task_id, a FROM made)) USING (task_id, a)
WHERE rn <= 2""", "parsed", "fact_rows", "sizes", "tasks",
    slots=f"""SELECT task_id, a, CASE domain WHEN 'alpha' THEN {_GENERAL + ['swap_objects']}[{_TYPE} % 9 + 1] WHEN 'beta' THEN {_GENERAL + ['swap_named']}[{_TYPE} % 9 + 1]
  ELSE {_GENERAL + ['swap_objects', 'swap_named']}[{_TYPE} % 10 + 1] END AS kind
FROM parsed JOIN tasks USING (task_id), (SELECT unnest(range(1, 7)) AS a)""",
    made=" UNION ALL ".join(f"SELECT e.*, '{k}' AS kind FROM ({sql}) e JOIN slots s ON s.task_id = e.task_id AND s.a = e.a AND s.kind = '{k}'"
                            for k, sql in drawn_edits("a", flipped=True).items()))

define("drawn_goals", """
SELECT task_id, max(pos) FILTER (rn = 1) AS i, max(pos) FILTER (rn = 2) AS j FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5(concat_ws('|', '7', 'reorder', task_id, pos)), pos) AS rn FROM fact_rows WHERE section = 'goal')
WHERE rn <= 2 GROUP BY task_id""", "fact_rows")
define("simple", f"""
SELECT task_id, kind, artifact, coalesce(CASE kind
  WHEN 'reorder_goal' THEN CASE WHEN len(goal_facts) >= 2 THEN {edit('goal', '''concat('(:goal (and ', array_to_string(list_transform(range(len(goal_facts)),
      lambda p: goal_facts[CASE WHEN p = d.i THEN d.j WHEN p = d.j THEN d.i ELSE p END + 1]), ' '), '))')''')} END
  WHEN 'drop_init' THEN CASE WHEN len(init_facts) > 2 THEN {edit('init', f"concat('(:init ', {WITHOUT.replace('pos', 'c.pos')}, ')')")} END
  ELSE {edit('objects', OBJECTS.format(e=EXTRA.format(s='')))} END, artifact) AS corrupted
FROM (SELECT *, ['reorder_goal', 'drop_init', 'add_object'][CAST(concat('0x', substr(md5(concat_ws('|', '7', 'simple', task_id)), 1, 8)) AS BIGINT) % 3 + 1] AS kind FROM parsed)
JOIN ({chosen('drop_init', 'init')}) c USING (task_id) JOIN drawn_goals d USING (task_id)""", "parsed", "fact_rows", "drawn_goals")
SQL["corrupt_simple"] = q("SELECT task_id, kind, corrupted FROM simple", "simple")

_SET = rf"""
SELECT DISTINCT task_id, kind, fact FROM (
  SELECT task_id, kind, concat('object:', unnest(string_split(regexp_extract({{t}}, '\(:objects ([^()]*)\)', 1), ' '))) AS fact FROM simple
  UNION ALL SELECT task_id, kind, concat('init:', unnest(regexp_extract_all(regexp_extract({{t}}, '\(:init\s(?:[^()]|\([^()]*\))*\)'), '{FACT}'))) FROM simple
  UNION ALL SELECT task_id, kind, concat('goal:', unnest(regexp_extract_all(regexp_extract({{t}}, '\(:goal\s(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)'), '{FACT}'))) FROM simple)"""
define("diff", f"""
SELECT task_id, kind, count_if(c.fact IS NULL) AS missing, count_if(g.fact IS NULL) AS extra, count_if(g.fact = c.fact) AS common, count(*) AS n
FROM ({_SET.format(t='artifact')}) g FULL JOIN ({_SET.format(t='corrupted')}) c USING (task_id, kind, fact) GROUP BY task_id, kind""", "simple")
SQL["fact_diff"] = q("""
SELECT task_id, CAST(missing AS INT) AS missing, CAST(extra AS INT) AS extra, CAST(common AS INT) AS common, common / n AS jaccard,
       missing = 0 AND extra = 0 AS exact FROM diff""", "diff")
SQL["label_corruptions"] = q("""
SELECT kind, policy, count(*) AS n, count_if(eq) AS equal_gold, count_if(eq AND policy = 'keep') AS positives, count_if(eq AND policy = 'relabel') AS relabelled
FROM (SELECT kind, missing = 0 AND extra = 0 AS eq, unnest(['keep', 'relabel', 'drop']) AS policy FROM diff) WHERE NOT (eq AND policy = 'drop') GROUP BY kind, policy""", "diff")
SQL["relabel_policy"] = q("""
SELECT doc_id, source, CASE WHEN source = 'perturbation' THEN 0 ELSE label END AS label, source = 'perturbation' AND label = 1 AS touched, 'relabel' AS policy FROM examples
UNION ALL SELECT doc_id, source, label, false, 'drop' FROM examples WHERE NOT (source = 'perturbation' AND label = 1)""", "examples")
SQL["label_timeouts"] = q("""
SELECT model, count(*) AS n, count_if(correct AND latency_sec < 4.5 AND error IS NULL) AS positives, count_if(latency_sec >= 4.5) AS timeouts
FROM candidates GROUP BY model""", "candidates")
