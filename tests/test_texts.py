"""Corruption queries give whole texts, not only what an edit changes."""

import pytest

import __spark_entry__ as entry

KINDS = ("swap_goal_args", "add_object", "drop_goal", "dup_init_wrong_args", "negate_goal", "swap_args", "contradict_init", "simple")


@pytest.mark.parametrize("kind", KINDS)
def test_corrupted_texts_are_whole(spark, sf_dir, kind):
    texts = {r.task_id: r.artifact for r in entry.queries()["render_artifact"](spark, sf_dir).collect()}
    rows = entry.queries()[f"corrupt_{kind}"](spark, sf_dir).collect()
    assert rows and all(r.corrupted.startswith(f"(define (problem t{r.task_id}) (:domain supply) (:objects ") for r in rows)
    assert all(abs(len(r.corrupted) - len(texts[r.task_id])) < 60 and r.corrupted.count("(:") == 4 for r in rows)
    assert {r.task_id for r in rows if r.corrupted != texts[r.task_id]} and (kind == "simple" or all(r.corrupted != texts[r.task_id] for r in rows))
