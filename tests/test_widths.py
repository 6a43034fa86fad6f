"""Tasks above and below the width from which they are spread give the same results, and few bytes are moved for them."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

import __spark_entry__ as entry
from poolwise.operators import edits, ordering
from poolwise.plans.inputs import Inputs
from poolwise.plans.facts import EDITOR
from tests.test_edits import SETTINGS, shown, small, table  # noqa: F401


def executed(rows):
    """The final physical plan."""
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_numbers_of_wide_and_narrow_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WIDE", 1500)
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3, None, None]), rng.choice([None, 1, 2]), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "key long, line int, id long")
    wide = ordering.wide_keys(df, "key")
    assert set(wide) == {0, None}
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("line", "id"))).collect()
    for keys in (wide, [], [0], [None]):
        out = ordering.number_rows_by_key(df, "key", ["line", "id"], keys)
        assert out.columns == [*df.columns, "rn"]
        assert sorted((r.id, r.rn) for r in out.collect()) == sorted((r.id, r.rn) for r in want)


@pytest.mark.parametrize("name", ["corrupt_many", "fact_diff", "assemble_examples"])
def test_wide_tasks_give_the_same_rows(spark, sf_dir, name, monkeypatch):
    """Tasks of seven or more candidates count as wide."""
    query = entry.queries()[name]
    want = sorted(map(str, query(spark, sf_dir).collect()))
    monkeypatch.setattr(ordering, "WIDE", 6)
    parts = Inputs(spark, sf_dir).fact_parts()
    assert len(parts) == 2 and all(rows.limit(1).count() for rows, _ in parts)
    assert sorted(map(str, query(spark, sf_dir).collect())) == want


def test_edit_diff_equals_the_comparison_of_both_sides(spark, small):  # noqa: F811
    """Also where facts repeat, an edit writes a fact that is there, or puts back what it takes away."""
    twice = small.unionByName(small.where("section = 'goal' AND pos < 2").withColumn("pos", F.col("pos") + 100))
    first = shown(twice).where("section <> 'objects' AND pos = 0")
    made = first.select("task_id", "section", "pos", F.when(F.col("task_id") % 3 == 0, "delete").otherwise("replace").alias("op"),
                        F.when(F.col("task_id") % 3 == 1, F.col("fact")).when(F.col("task_id") % 3 == 2, F.lit("(new x)")).alias("fact"))
    made = made.unionByName(shown(twice).where("section = 'goal' AND pos = 1 AND task_id > 5").select(
        "task_id", "section", F.lit(900).alias("pos"), F.lit("insert").alias("op"), "fact"))
    editor = edits.Editor(SETTINGS)
    for found in (made, editor.edit_simple(twice)[1]):
        want = edits.fact_diff(shown(twice), edits.applied(twice, found))
        assert sorted(map(tuple, edits.edit_diff(twice, found).collect())) == sorted(map(tuple, want.collect()))


def test_facts_of_a_task_are_shuffled_once(spark, sf_dir):
    """Candidates are numbered in one shuffle; draws and comparison of the bucketed facts need no exchange of them."""
    (rows, layout), = Inputs(spark, sf_dir).fact_parts()
    kinds, found = EDITOR.over(layout).edit_simple(rows)
    assert "Exchange hashpartitioning" not in executed(edits.edit_diff(rows, found, layout))
    numbered = executed(Inputs(spark, sf_dir).artifacts())
    assert numbered.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in numbered
