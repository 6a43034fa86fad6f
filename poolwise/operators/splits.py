"""Splits whose groups never straddle parts, driven by seeded md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.scalars import md5_key
from poolwise.functions.text import content_key
from poolwise.operators.ordering import hex_bucket, running_total


def assign_groups(rows: DataFrame, key: str, fraction: float, seed: int = 42,
                  parts: tuple[str, str] = ("train", "validation"), at_least_one: bool = False) -> DataFrame:
    """Part of every group key: keys are taken in md5 order until the first part holds its share of rows.

    The target is int(rows * fraction); a key joins the first part while the rows
    before it fall short of the target. Only keys and their counts are ordered.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("group_rows"))
    counts = counts.withColumn("_order", md5_key(seed, F.col(key)))
    run = running_total(counts, "group_rows", ["_order", key], hex_bucket(F.col("_order")))
    target = F.floor(F.col("total") * F.lit(float(fraction)))
    if at_least_one:
        target = F.greatest(F.lit(1), target)
    part = F.when(F.col("before") < target, parts[0]).otherwise(parts[1])
    return run.select(key, "group_rows", part.alias("split"))


def split_by_group(rows: DataFrame, key: str, fraction: float, seed: int = 42, **kwargs) -> DataFrame:
    """Rows with their part. A key with very many rows is one row on the assignment side, so AQE can
    split the row side of this join."""
    return rows.join(assign_groups(rows, key, fraction, seed, **kwargs).select(key, "split"), key)


def split_by_template(rows: DataFrame, key: str = "template_id", val_fraction: float = 0.15,
                      seed: int = 42) -> DataFrame:
    """Train gets its share of rows; all remaining groups are validation."""
    return split_by_group(rows, key, 1.0 - val_fraction, seed)


def split_by_content(rows: DataFrame, text: str, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """The same with the content key of a text as the group."""
    return split_by_group(rows.withColumn("content_key", content_key(F.col(text))), "content_key",
                          train_fraction, seed)


def split_calibration(rows: DataFrame, key: str, fraction: float = 0.5, seed: int = 123) -> DataFrame:
    return split_by_group(rows, key, fraction, seed, parts=("calibration", "evaluation"))


def split_pairs_dev_first(pairs: DataFrame, key: str = "template_id", dev_fraction: float = 0.2,
                          seed: int = 42) -> DataFrame:
    """Dev is filled first, with a target of at least one row."""
    return split_by_group(pairs, key, dev_fraction, seed, parts=("dev", "train"), at_least_one=True)


def unit_draw(key: Column) -> Column:
    """First 8 hex digits of an md5 text as a fraction of 1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_random(rows: DataFrame, key: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Row-wise train / validation / test; each row decides for itself, so nothing is shuffled."""
    draw = unit_draw(md5_key(seed, F.col(key)))
    return rows.withColumn("split", F.when(draw < ratios[0], "train")
                           .when(draw < ratios[0] + ratios[1], "validation").otherwise("test"))


def split_leakage(rows: DataFrame, key: str) -> DataFrame:
    """Groups present in more than one part; empty for every grouped split."""
    return (rows.groupBy(key).agg(F.count_distinct("split").alias("parts"))
            .where(F.col("parts") > 1))


def split_stats(rows: DataFrame, size: str, facets: Sequence[str]) -> DataFrame:
    """Rows and size range of every part: in all, and per value of the facet columns."""
    tags = F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")),
                   *[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return (rows.select("split", size, F.explode(tags).alias("t")).groupBy("split", "t.facet", "t.value")
            .agg(F.count(F.lit(1)).alias("rows"), F.min(size).alias("min_size"), F.max(size).alias("max_size")))
