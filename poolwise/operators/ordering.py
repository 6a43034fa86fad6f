"""Order-dependent operators without a single-task sort: running totals, keep-first, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.functions.scalars import md5_key
from poolwise.session import work_path

SCORE_BUCKETS = 4096

def running_total(rows: DataFrame, value: str, order: Sequence[str], bucket: Column | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before`` (exclusive running sum in ``order``) and ``total`` per ``by`` group.

    ``bucket`` must not decrease along ``order``; without it the buckets are
    ranges cut from a sample of the rows, even whatever the values are. Rows are
    summed inside their bucket, and the buckets' own running sum gives the
    offset, so no task sees more than one bucket. Only the bucket table (a few
    thousand rows per group, or one per range and group in it) is ordered as a
    whole.
    """
    by = list(by)
    if bucket is None:
        first, *rest = [*by, *order]
        rows = in_ranges(rows, first, rest)
        marked = rows.withColumnRenamed("_range", "_bucket")
    else:
        marked = rows.withColumn("_bucket", bucket)
    buckets = marked.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    across = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = across.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select(
        *by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(across).alias("total"))
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (marked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, [*by, "_bucket"])
            .withColumn("before", F.col("_offset") + F.col("_inside"))
            .drop("_bucket", "_inside", "_offset"))


def hex_bucket(key: Column) -> Column:
    """Bucket of an md5 text: its first three digits (4096 even buckets in md5 order)."""
    return F.substring(key, 1, 3)


def score_bucket(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Even bucket of a score known to lie in low..high; values outside share the outermost buckets."""
    step = F.floor((score - low) / (high - low) * SCORE_BUCKETS)
    return F.greatest(F.lit(-1), F.least(F.lit(SCORE_BUCKETS + 1), step)).cast("int")


def range_count(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` as a written table with ``_range``, the number of their range of (key, order).

    Ranges are cut from a sample of the rows, so they are of about equal size
    whatever the keys. The table is written because a second evaluation could
    sample other bounds.
    """
    path = work_path(rows.sparkSession, "ranges")
    ranged = rows.repartitionByRange(range_count(rows.sparkSession), key, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def number_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rn``, the row number within ``key`` along ``order`` (nulls first), also where one key holds most rows.

    All rows take one path: they are dealt to ranges of (key, order), numbered
    inside their range, and shifted by the rows of their key in earlier ranges.
    Only the first key of a range has such rows, so the table of shifts has at
    most one row per range, which makes it safe to broadcast. It is joined by the
    range alone, a single integer: a broadcast by several keys takes 64 MB however
    few its rows are.
    """
    stored = in_ranges(rows, key, order)
    inside = W.partitionBy(key, "_range").orderBy(*order)
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = (stored.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_c"))
              .select(F.col(key).alias("_key"), F.col("_range").alias("_in"), F.sum("_c").over(earlier).alias("_before"))
              .where("_before > 0"))
    numbered = stored.withColumn("_inside", F.row_number().over(inside))
    before = F.when(F.col(key).eqNullSafe(F.col("_key")), F.coalesce("_before", F.lit(0))).otherwise(0)
    return (numbered.join(F.broadcast(shifts), F.col("_range") == F.col("_in"), "left")
            .withColumn("rn", (F.col("_inside") + before).cast("int"))
            .select(*rows.columns, "rn"))


#: Rows from which a key is wide. A partition of ``session.PARTITION_ROWS`` holds only a few keys just below that.
WIDE = 62_500


def wide_keys(rows: DataFrame, key: str) -> list:
    """The keys with more than ``WIDE`` rows: fewer than one for every ``WIDE`` rows, which is few enough for the driver."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return [r[0] for r in counts.where(F.col("_c") > WIDE).select(key).collect()]


def is_wide(key: str, wide: Sequence) -> Column:
    """Whether ``key`` is one of the wide keys; never null."""
    found = F.coalesce(F.col(key).isin([k for k in wide if k is not None]), F.lit(False))
    return found | F.col(key).isNull() if None in wide else found


def number_rows_by_key(rows: DataFrame, key: str, order: Sequence[str], wide: Sequence) -> DataFrame:
    """``number_rows`` for rows that are cheap to read twice: only keys in ``wide`` are dealt to ranges and written.

    The others are numbered in one shuffle, and the result stays partitioned by ``key`` where no key is wide.
    """
    inside = W.partitionBy(key).orderBy(*order)
    if not wide:
        return rows.withColumn("rn", F.row_number().over(inside))
    narrow = rows.where(~is_wide(key, wide)).withColumn("rn", F.row_number().over(inside))
    return narrow.unionByName(number_rows(rows.where(is_wide(key, wide)), key, order))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of every key in the given order.

    The filter on the bare row number lets Spark drop later copies before the
    shuffle, so a key with very many copies is cut to one row per input task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows per group; trimmed before the shuffle like ``keep_first``."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def sample_n(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` seeded random rows: those with the least md5, ties by key.

    The hashes are counted by their first three digits; the n-th row lies in one of
    these 4096 buckets, and is found there by counting the next three, and so on.
    Every step is a filter and a count with at most 4096 groups, so no task and no
    sort holds the sample. Rows with one key are counted together: of the last key
    as many as are missing stay, by a row number within it.
    """
    hashed = rows.withColumn("_h", md5_key(seed, F.col(key)))
    if n <= 0:
        return rows.limit(0)
    prefix, missing = "", n
    while len(prefix) < 32:
        size = len(prefix) + 3 if len(prefix) < 30 else 32
        digits = F.substring("_h", 1, size)
        counts = sorted(hashed.where(F.col("_h").startswith(prefix)).groupBy(digits.alias("d")).count().collect())
        if not prefix and sum(r["count"] for r in counts) <= n:
            return rows
        for r in counts:
            if r["count"] > missing:
                prefix = r["d"]
                break
            missing -= r["count"]
            prefix = r["d"]
            if not missing:
                break
        if not missing:
            break
    taken = hashed.where(F.substring("_h", 1, len(prefix)) < prefix)
    here = hashed.where(F.col("_h").startswith(prefix))
    if missing:
        rank = F.row_number().over(W.partitionBy("_h").orderBy(key))
        here = here.withColumn("_rn", rank).where(F.col("_rn") <= missing).drop("_rn")
    return taken.unionByName(here).drop("_h")


def sample_per_stratum(rows: DataFrame, strata: Sequence[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to ``n`` seeded random rows per stratum, with the size of the stratum."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_n"))
    drawn = top_per_group(rows, strata, [md5_key(seed, F.col(key)), key], n)
    return drawn.join(sizes, list(strata))


def nearest_rank_quantiles(values: DataFrame, group: Sequence[str], value: str,
                           fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles at rank round((n - 1) * f), half to even, with count, mean, min and max.

    Works on the histogram of distinct values, so a group of any size is never
    collected or sorted row by row; ranges of values are cut from the histogram.
    """
    hist = values.groupBy(*group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = running_total(hist, "c", ["v"], by=group)

    def at(fraction: float) -> Column:
        rank = F.bround((F.col("total") - 1) * F.lit(fraction), 0).cast("bigint")
        hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
        return F.max(F.when(hit, F.col("v")))

    return run.groupBy(*group).agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("v").alias("min"), *[at(f).alias(name) for name, f in fractions.items()], F.max("v").alias("max"))
