"""What queries leave on disk, send through the driver and hold in a task."""

import re

from pyspark.sql import functions as F

from poolwise import session
from poolwise.sources import logs, tables


def test_pool_logs_are_compressed(spark, tmp_path):
    """Lines repeat their names and reasons; a log takes a small part of its length as text."""
    rows = spark.range(4000)
    candidates = rows.select(F.col("id").alias("task_id"), F.lit(0).alias("candidate_index"), F.md5(F.col("id").cast("string")).alias("payload"))
    picks = rows.select(F.col("id").alias("task_id"), F.lit(8).alias("K"), F.lit("verifier_ranked").alias("policy"),
                        F.lit("highest_verifier_score").alias("selection_reason"))
    logs.write_pool_log(candidates, picks, str(tmp_path / "log"))
    read = logs.read_candidates(spark, str(tmp_path / "log"))
    size = sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*"))
    text = spark.read.text(str(tmp_path / "log")).agg(F.sum(F.length("value"))).first()[0]
    assert size < text / 3
    assert {(r.task_id, r.payload) for r in read.collect()} == {(r.task_id, r.payload) for r in candidates.collect()}
    assert logs.read_selections(spark, str(tmp_path / "log")).count() == 4000


def test_tasks_do_not_pass_through_the_driver(spark, sf_dir):
    """Only the shifts of numbered rows are broadcast, by one integer: other broadcasts grow with the tasks."""
    import __spark_entry__ as entry
    for name in ("leakage_audit", "corrupt_many", "label_corruptions", "read_replay"):
        rows = entry.queries()[name](spark, sf_dir)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"BroadcastExchange HashedRelationBroadcastMode\(List\((.*?)\),(?:true|false)\)", plan)
        assert all(re.fullmatch(r"cast\(input\[\d+, int, \w+\] as bigint\)", f) for f in found), (name, set(found))


def test_shuffle_partitions_follow_the_input(spark, sf_dir, monkeypatch):
    """A task's share of the candidates stays the same, whatever their number."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(session, "PARTITION_ROWS", 100)
        n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        tables.candidates(spark, sf_dir, 8)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-n // 100)
        session.fit_shuffles(spark, 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-n // 100)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == session.PARTITION_BYTES
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
