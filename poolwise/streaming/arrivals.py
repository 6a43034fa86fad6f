"""Streaming ingest and running progress metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from poolwise import schemas
from poolwise.session import work_path
from poolwise.sources.tables import stream


def read_arrivals(spark: SparkSession, folder: str, pattern: str = "events.parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the event files of a folder."""
    reader = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return stream(reader.parquet(folder))


def ingest(arrivals: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: Sequence[str] = ("ts",),
           trigger: dict | None = None) -> StreamingQuery:
    """Appends new arrivals to a parquet table, one folder per batch; a key that came before is skipped.

    Which keys came before is state of the query, kept by key in the state store of the checkpoint, so a batch costs by
    its own size and not by what is stored. However late a row comes, a new key is kept; null is a key like others. Of
    rows with one key in a batch the first by ``order`` and then by all columns stays. A restart with the same
    checkpoint continues where the last run stopped; a repeated batch sees the state before it and the same time, and
    replaces its own folder.
    """
    columns = arrivals.columns
    rest = [*order, *[c for c in columns if c not in (key, *order)]]
    # The time is one value for all rows of a batch: a key is new if it was first seen when it was last seen.
    state = arrivals.withColumn("_at", F.current_timestamp()).groupBy(key).agg(
        F.min(F.struct(*rest)).alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))

    def append(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("_first = _last").select(key, "_row.*").select(*columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def progress(arrivals: DataFrame, total: int | None = None) -> DataFrame:
    """Running counts, latency and rates per status."""
    return arrivals.groupBy("status").agg(
        F.count(F.lit(1)).alias("done"), F.sum("latency_sec").alias("elapsed_sec"),
        F.max("ts").alias("last_ts"))


def write_progress(snapshot: DataFrame, path: str, checkpoint: str, key: str = "status",
                   fail_before_publishing: int | None = None) -> StreamingQuery:
    """Keeps the latest snapshot as a table of versions: a batch writes its version, then publishes it.

    Only groups that changed come with a batch; the others are taken from the last published version. Nothing that
    readers may be using is overwritten, and ``read_snapshot`` reads published versions only, so a crash at any place
    leaves the last one readable, and the repeated batch writes its version again. ``fail_before_publishing`` makes a
    batch fail between the two steps, for tests.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = latest_version(spark, path, batch_id)
        if before is not None:
            kept = spark.read.schema(batch.schema).parquet(f"{path}/snapshots/version={before}")
            changed = batch.select(F.col(key).alias("_key"))
            batch = batch.unionByName(kept.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_anti"))
        batch.write.mode("overwrite").parquet(f"{path}/snapshots/version={batch_id}")
        if batch_id == fail_before_publishing:
            raise RuntimeError("stopped before publishing")
        spark.range(1).select(F.lit(batch_id).alias("version")).write.mode("overwrite").parquet(f"{path}/published/batch={batch_id}")

    return (snapshot.writeStream.outputMode("update").foreachBatch(update)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last published version, None if there is none."""
    try:
        published = spark.read.schema("version int").parquet(f"{path}/published")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if below is not None:
        published = published.where(F.col("version") < below)
    return published.agg(F.max("version")).first()[0]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshots/version={latest_version(spark, path)}")


def snapshot_report(state: DataFrame, total: int) -> DataFrame:
    """Progress per status, with that of the whole run: rows done in all, remaining of ``total`` and expected rest.

    The window has one row per status.
    """
    run = Window.partitionBy(F.lit(0))
    done, spent = F.sum("done").over(run), F.sum("elapsed_sec").over(run)
    left = F.greatest(F.lit(0), F.lit(total) - done)
    return state.select(
        "status", "done", done.alias("completed"), left.alias("remaining"), F.round("elapsed_sec", 4).alias("elapsed_sec"),
        F.round(F.col("elapsed_sec") / F.greatest(F.col("done"), F.lit(1)), 6).alias("avg_sec_per_row"),
        F.round(spent / F.greatest(done, F.lit(1)) * left, 4).alias("eta_sec"))


def run_ingest(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = work_path(spark, "ingest"), work_path(spark, "ingest-checkpoint")
    ingest(read_arrivals(spark, folder), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = work_path(spark, "progress"), work_path(spark, "progress-checkpoint")
    write_progress(progress(read_arrivals(spark, folder)), path, checkpoint).awaitTermination()
    return read_snapshot(spark, path)
