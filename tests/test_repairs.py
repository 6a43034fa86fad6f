"""Repair policies share one pass over the pools; expected results stand apart from the library."""

from pathlib import Path

import __spark_entry__ as entry
from poolwise.operators import repair
from poolwise.plans.inputs import Inputs


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_policies_share_one_pass(spark, sf_dir):
    x, queries = Inputs(spark, sf_dir), entry.queries()
    once = scans(x.repairs())
    assert scans(queries["repair_final"](spark, sf_dir)) == scans(queries["repair_metrics"](spark, sf_dir)) == once
    assert scans(queries["gate_final_repair"](spark, sf_dir)) == once + scans(x.seed_rates())


def test_one_pass_gives_the_rows_of_each_policy(spark):
    rows = spark.createDataFrame([
        (1, False, 0.5, True, True, 0.5), (2, True, 0.5, True, False, 0.4), (3, True, None, True, False, 0.9),
        (4, False, 0.5, False, False, 0.9), (5, False, 0.5, None, None, None), (1, False, 0.5, True, True, 0.5)],
        "task_id long, original_correct boolean, original_score double, repair_parseable boolean, repair_correct boolean, "
        "repair_score double")
    got = repair.apply_repairs(rows, [None, 0.05, 0.2])
    want = [r for m in (None, 0.05, 0.2) for r in repair.apply_repair(rows, m).collect()]
    assert got.columns == repair.apply_repair(rows).columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
    outcomes = {(r["task_id"], r["policy"], r["guard_accepted"]): r["outcome"] for r in repair.apply_repairs(rows, [None, 0.05]).collect()}
    assert outcomes[1, "verifier_ranked_repair", None] == outcomes[1, "verifier_ranked_repair_guarded", True] == "repair_helped"
    assert outcomes[2, "verifier_ranked_repair", None] == "repair_hurt"
    assert outcomes[2, "verifier_ranked_repair_guarded", False] == "both_success"
    assert repair.apply_repairs(rows.limit(0), [None, 0.05]).count() == 0


def test_expected_results_take_nothing_from_the_library():
    for path in (Path(entry.__file__).parent / "oracle").glob("*.py"):
        assert "poolwise" not in path.read_text(), path.name
