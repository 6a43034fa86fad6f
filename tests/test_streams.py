"""Streams: state by key instead of rereading what is stored, snapshots that survive a crash, evaluators that fail."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from poolwise.operators import compare
from poolwise.streaming import arrivals

SCHEMA = "event_id long, ts timestamp, task_id long, status string, latency_sec double, k int"
T0 = datetime.datetime(2024, 1, 1)


def batches(spark, folder, rows_of):
    """A stream with one file, so one batch, for each list of rows."""
    for i, rows in enumerate(rows_of):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/all/b{i:03d}")
        for f in (folder / "all" / f"b{i:03d}").glob("part-*"):
            (folder / "in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"b{i:03d}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")


def row(key, second, status="a", latency=1.0):
    return key, T0 + datetime.timedelta(seconds=second), 1, status, latency, 1


def test_ingest_by_state(spark, tmp_path):
    """Over 20 batches of equal size, each with late keys, known keys and ties: no batch reads what is stored."""
    rows = [[row(i, 100 - i), row(i, 100 - i, "tie"), row(i - 1, 0), row(1000 + i, -i), row(7, i)] for i in range(20)]
    stream = batches(spark, tmp_path, rows)
    query = arrivals.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = {r.event_id: (r.ts, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for batch in rows:
        known = set(want)
        for key, *rest in sorted(batch, key=lambda r: (r[0], r[1], r[2], r[3])):
            if key not in known:
                want.setdefault(key, (rest[0], rest[2]))
    assert got == want and len(list((tmp_path / "out").glob("batch_id=*"))) == 20
    progress = query.recentProgress
    assert max(p["numInputRows"] for p in progress) == 5
    # What a batch changes in the state follows the batch; the state itself grows.
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert max(updated) <= 5 and progress[-1]["stateOperators"][0]["numRowsTotal"] == len(want)


def test_ingest_resumes_with_its_state(spark, tmp_path):
    stream = batches(spark, tmp_path, [[row(1, 1), row(None, 2)]])
    for extra in ([], [row(1, 0), row(2, 5), row(None, 1)]):
        if extra:
            spark.createDataFrame(extra, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "more"))
            next((tmp_path / "more").glob("part-*")).rename(tmp_path / "in" / "c.parquet")
        arrivals.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = [(r.event_id, r.ts.second) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == [(1, 1), (2, 5), (None, 2)]


def test_a_crash_leaves_the_last_snapshot(spark, tmp_path):
    rows = [[row(1, 1), row(2, 2, "b")], [row(3, 3)], [row(4, 4, "b"), row(5, 5, None)]]
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    state = arrivals.progress(batches(spark, tmp_path, rows))
    done = lambda: {r.status: r.done for r in arrivals.read_snapshot(spark, path).collect()}
    with pytest.raises(StreamingQueryException):
        arrivals.write_progress(state, path, checkpoint, fail_before_publishing=1).awaitTermination()
    assert done() == {"a": 1, "b": 1} and (tmp_path / "out" / "snapshots" / "version=1").exists()
    arrivals.write_progress(state, path, checkpoint).awaitTermination()
    assert done() == {"a": 2, "b": 2, None: 1}


def test_errors_of_an_evaluator_are_data(spark):
    calls = spark.createDataFrame([("1", True), ("1", True), ("x", True), (None, True), ("2", None), ("3", False)], "payload string, ok boolean")
    evaluate = compare.guarded(lambda text: 10 // int(text), "int")
    out = compare.evaluate_distinct(calls, "payload", evaluate, F.col("ok")).collect()
    assert sorted(((r.payload, r.evaluated, (r.eval_error or "").split(":")[0]) for r in out), key=str) == sorted([
        ("1", 10, ""), ("1", 10, ""), ("x", None, "ValueError"), (None, None, "TypeError"), ("2", None, "parse_failed"),
        ("3", None, "parse_failed")], key=str)


def test_the_rest_works_without_the_training_data_folder(tmp_path):
    """A copy of the library without that subpackage and the pipeline still has its queries."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parent.parent
    for name in ("poolwise", "oracle"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'select_ranked' in q and not [x for x in q if x.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
