"""Explicit schemas (DDL) of everything read from files; nothing is inferred."""

_TASK = ("task_id BIGINT, template_id BIGINT, domain STRING, init_is_abstract INT, "
         "goal_is_abstract INT, seed INT")

POOL_LOG = (
    f"{_TASK}, candidate_index INT, error STRING, payload STRING, model STRING, latency_sec DOUBLE, "
    "parseable BOOLEAN, correct BOOLEAN, solvable BOOLEAN, score DOUBLE, score_b DOUBLE, "
    "K INT, policy STRING, selected_index INT, selection_reason STRING")

REPLAY_LOG = (
    f"{_TASK}, candidate_index INT, parseable BOOLEAN, correct BOOLEAN, original_score DOUBLE, "
    "replay_score DOUBLE, K INT, policy STRING, selected_index INT, selection_reason STRING")

EXAMPLE = (
    "doc_id BIGINT, text STRING, label INT, source STRING, source_model STRING, "
    "perturbation_type STRING, domain STRING, parseable BOOLEAN, template_id STRING, score DOUBLE")

PAIR = (
    "nl STRING, positive_payload STRING, negative_payload STRING, source STRING, domain STRING, "
    "template_id BIGINT, task_id BIGINT, style STRING, K INT, pair_type STRING, "
    "positive_index INT, negative_index INT, score_margin DOUBLE")

REPAIR = (
    "task_id BIGINT, domain STRING, style STRING, policy STRING, original_index INT, "
    "original_score DOUBLE, original_correct BOOLEAN, original_solvable BOOLEAN, "
    "repair_parseable BOOLEAN, repair_correct BOOLEAN, repair_solvable BOOLEAN, repair_score DOUBLE")

_METRICS = "STRUCT<total: BIGINT, parse_count: BIGINT, solve_count: BIGINT, correct_count: BIGINT, error_count: BIGINT>"

# run -> K -> policy -> {metrics, stratified: stratum -> metrics}
RUN_SUMMARY = (
    "run INT, comparisons MAP<STRING, STRUCT<policies: MAP<STRING, "
    f"STRUCT<metrics: {_METRICS}, stratified: MAP<STRING, {_METRICS}>>>>>")

EVENTS = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
          "props STRING")
