"""Streaming queries: run to the end of the available input and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.streaming import arrivals


@query("stream_ingest")
def stream_ingest(x: Inputs) -> DataFrame:
    """Ingested arrivals; the time is given as wall-clock microseconds in any session zone."""
    return arrivals.run_ingest(x.spark, x.dir).select(
        "event_id", "task_id", "status", "latency_sec", "k", F.unix_micros(F.from_utc_timestamp("ts", F.current_timezone())).alias("ts_micros"))


@query("stream_metrics")
def stream_metrics(x: Inputs) -> DataFrame:
    """Progress of a run that has eight calls to make for every task."""
    return arrivals.snapshot_report(arrivals.run_progress(x.spark, x.dir), 8 * x.tasks().count())
