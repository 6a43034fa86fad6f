"""Queries read whole tables: small tables with tasks that a filter or an inner join would lose."""

import datetime

import pytest

import __spark_entry__ as entry

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tasks 1 to 4 have parseable candidates, 5 and 6 have none, 7 has no candidate; 2, 6 and 7 name the word,
    5 holds its own candidate. Candidates of 9 have no task."""
    path = str(tmp_path_factory.mktemp("tables"))
    priority = {2: "equivalent", 5: "(SUPPLIES p50 s1)", 6: "Equivalent", 7: "equivalent"}
    spark.createDataFrame([(k, k * 10, "O", priority.get(k, "low")) for k in range(1, 8)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
                          ).write.parquet(f"{path}/orders.parquet")
    rows = [(k, n, k * 10 + n, n + 1, 1.0, DAY, "R" if k in (5, 6) else "AN"[n], "F", 30.0) for k in (*range(1, 7), 9) for n in range(2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
                                "l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double"
                          ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_prompts_of_tasks_without_a_repair_are_audited(spark, folder):
    rows = [tuple(r) for r in entry.queries()["leakage_audit"](spark, folder).collect()]
    assert sorted(r for r in rows if r[1] == "prompt") == [
        (2, "prompt", "word_equivalent"), (5, "prompt", "candidate_text"), (6, "prompt", "word_equivalent"), (7, "prompt", "word_equivalent")]
    assert sorted({r[0] for r in rows if r[1] == "repair_prompt"}) == [1, 2, 3, 4]


def test_only_candidates_without_a_task_miss_their_text(spark, folder):
    rows = entry.queries()["join_task_text"](spark, folder).collect()
    assert len(rows) == 14 and {r["task_id"] for r in rows if r["missing_source"]} == {9}
    assert all((r["nl"] is None) == r["missing_source"] for r in rows)


def test_base_holds_the_candidates_of_all_tasks(spark, folder):
    assert entry.queries()["anti_base_keys"](spark, folder).collect() == []
    base = entry.queries()["augment_base"](spark, folder).collect()
    assert sorted(r["template_id"] for r in base) == [k * 10 for k in range(1, 7) for _ in range(2)]
