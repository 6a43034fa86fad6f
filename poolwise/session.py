"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "poolwise", **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Partition counts are left to AQE on a cluster; ``conf`` overrides anything.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # State of streams by key, on disk: its size is not bounded by an executor's memory.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Input rows for each shuffle partition, and the size up to which AQE puts small partitions together.
PARTITION_ROWS, PARTITION_BYTES = 500_000, "16m"


def fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Raises the session's number of shuffle partitions to that of ``rows``, so a task's memory doesn't grow with them.

    Packed pool rows take some twenty times their size in the sorts and aggregates of a task, so AQE's default of 64 MB
    a partition is too much for them; a size that the caller has set stays.
    """
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, PARTITION_BYTES)
    if rows > int(spark.conf.get(count)) * PARTITION_ROWS:
        spark.conf.set(count, str(-(-rows // PARTITION_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster without it is an error,
    because executors could not read each other's local files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_dirs:
        _local_dirs[app_id] = tempfile.mkdtemp(prefix="poolwise-")
    return _local_dirs[app_id]


#: Rows for each bucket of a table bucketed by task; facts and draws are several times as many.
BUCKET_ROWS = 125_000


def bucket_count(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``rows`` as a table in the shared folder, bucketed and sorted by ``key``: joins and groups by it need no exchange."""
    path = work_path(rows.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten there."""
    return os.path.join(shared_dir(spark), "poolwise", f"{name}-{uuid.uuid4().hex[:12]}")
