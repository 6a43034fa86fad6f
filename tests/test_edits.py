"""Corruptions as edits of a fact table: the same as in the text form, also for a task of very many facts."""

import pytest
from pyspark.sql import functions as F

from poolwise.operators import edits, facts
from poolwise.plans import facts as plans

SETTINGS = facts.Corruption(seed=3, object_prefix="c", named=("m0", "m1"), contradictions={**facts.CONTRADICTION, "on": "holding"},
                            flips={**facts.FLIP, "rank": "on"})
def head():
    return F.concat(F.lit("(define (problem t"), F.col("task_id").cast("string"), F.lit(")"))


def table(spark, sizes):
    """Facts of tasks with ``sizes`` candidates; no two facts of a task are equal."""
    tasks = spark.createDataFrame(list(enumerate(sizes)), "task_id long, n int")
    rows = tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    name = F.concat(F.lit("c"), F.col("pos").cast("string"))
    other = F.concat(F.lit("c"), (F.col("pos") * 7 % 11).cast("string"))
    model = F.concat(F.lit("m"), ((F.col("task_id") + F.col("pos")) % 3).cast("string"))
    sections = F.array(F.struct(F.lit("objects").alias("section"), F.array(name).alias("w")),
                       F.struct(F.lit("init").alias("section"), F.array(F.when(F.col("pos") % 2 == 0, "on").otherwise("near"), other, name).alias("w")),
                       F.struct(F.lit("goal").alias("section"), F.array(F.lit("rank"), name, model).alias("w")))
    return rows.select("task_id", "pos", F.inline(sections))


def shown(rows):
    return rows.select("task_id", "section", "pos", edits.shown(F.col("section"), F.col("w")).alias("fact"))


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, [1, 2, 3, 4, 7, 9, 12, 2, 3, 5]).cache()


@pytest.mark.parametrize("kind", facts.ALL_TYPES)
def test_edits_equal_the_text_form(spark, small, kind):
    texts = edits.render(shown(small), head())
    want = SETTINGS.corrupt(facts.parse_artifacts(texts), kind).select("task_id", "corrupted").collect()
    found = edits.Editor(SETTINGS).edit(small, kind)
    got = edits.render(edits.applied(small, found), head()).join(found.select("task_id").distinct(), "task_id")
    # The text form leaves a blank where the last goal fact goes.
    assert {r.task_id: r.artifact for r in got.collect()} == {r.task_id: r.corrupted.replace(" )", ")") for r in want}
    assert want or kind == "contradict_init"


def test_simple_edits_equal_the_text_form(spark, small):
    texts = edits.render(shown(small), head())
    want = SETTINGS.corrupt_simple(facts.parse_artifacts(texts)).collect()
    kinds, found = edits.Editor(SETTINGS).edit_simple(small)
    got = edits.render(edits.applied(small, found), head()).join(kinds, "task_id").collect()
    assert {(r.task_id, r.kind, r.artifact) for r in got} == {(r.task_id, r.kind, r.corrupted) for r in want}
    differ = facts.fact_diff(spark.createDataFrame(want)).collect()
    columns = ("task_id", "missing", "extra", "common", "jaccard", "exact")
    diff = edits.fact_diff(shown(small), edits.applied(small, found)).collect()
    assert {tuple(r[c] for c in columns) for r in diff} == {tuple(r[c] for c in columns) for r in differ}


def test_attempts_draw_from_pools(spark, small):
    tasks = spark.range(9).select(F.col("id").alias("task_id"), F.when(F.col("id") < 4, "x").alias("domain"))
    editor, pools = edits.Editor(SETTINGS), {"x": ("drop_init", "add_object")}
    rows = editor.edit_many(small, tasks, 3, pools).collect()
    assert {r.kind for r in rows if r.task_id < 4} == {"drop_init", "add_object"} and len({r.kind for r in rows}) > 5
    assert all(1 <= r.rn <= 3 and r.attempt <= 9 for r in rows) and {r.task_id for r in rows} == set(range(10))
    only = editor.edit_many(small, tasks, 2, pools, allowed=["swap_named"]).collect()
    assert {r.kind for r in only} == {"swap_named"}


def test_a_task_with_a_third_of_all_facts(spark):
    """No row holds a task: every row of the results is a fact or an edit."""
    rows = table(spark, [20_000] + [3] * 13_000)
    editor = edits.Editor(SETTINGS)
    tasks = spark.range(13_001).select(F.col("id").alias("task_id"), F.lit("x").alias("domain"))
    many = editor.edit_many(rows, tasks, 2)
    assert many.where("task_id = 0").select("attempt").distinct().count() == 2
    kinds, found = editor.edit_simple(rows)
    diff = edits.fact_diff(shown(rows), edits.applied(rows, found))
    hot = diff.where("task_id = 0").first()
    assert hot.common + hot.missing == 60_000 and hot.missing + hot.extra <= 2 and diff.count() == kinds.count() == 13_001


def test_all_kinds_occur_in_the_mixed_draw(spark, sf_dir):
    import __spark_entry__ as entry
    rows = entry.queries()["corrupt_many"](spark, sf_dir)
    assert {r.kind for r in rows.select("kind").distinct().collect()} == set(facts.ALL_TYPES)
    assert rows.where("kind = 'negate_goal' AND fact LIKE '(on-table %'").count() > 0
    assert {k for p in plans.POOLS.values() for k in p} == set(facts.ALL_TYPES)
