"""Isotonic regression on a table of scores, fitted and applied without a model object.

A fit is a table of blocks (lo, hi, n, pos): scores lo to hi share the value pos / n, and values increase. Adjacent blocks
that break the order are pooled inside ranges of the score axis; pooling in any order gives the same blocks, so ranges
are cut anew, at other places, until no two neighbours break it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.operators.ordering import in_ranges, range_count
from poolwise.session import work_path

BLOCKS = "lo double, hi double, n long, pos long"


def pooled(blocks: Iterable[tuple]) -> list[tuple]:
    """Blocks (lo, hi, n, pos) in order with adjacent violators put together; whole numbers, so nothing is rounded."""
    stack: list[tuple] = []
    for lo, hi, n, pos in blocks:
        while stack and stack[-1][3] * n >= pos * stack[-1][2]:
            lo, _, n_before, pos_before = stack.pop()
            n, pos = n + n_before, pos + pos_before
        stack.append((lo, hi, n, pos))
    return stack


def _pool_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's range, which comes in order; its blocks stay in the task until the range ends."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    stack = pooled(rows)
    for at in range(0, len(stack), 10_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*stack[at:at + 10_000], strict=True),
                                            (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
            names=["lo", "hi", "n", "pos"])


def _pool_ranges(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks pooled inside ``parts`` ranges, as a written table with the number of their range."""
    path = work_path(blocks.sparkSession, "isotonic")
    ranged = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pool_range, BLOCKS)
    out = ranged.withColumn("_range", F.spark_partition_id())
    out.write.parquet(path)
    return blocks.sparkSession.read.schema(out.schema).parquet(path)


def _violations(blocks: DataFrame) -> int:
    """Pairs of neighbouring ranges whose adjoining blocks break the order, from one row per range."""
    mean = F.struct("n", "pos")
    edges = blocks.groupBy("_range").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    before = F.lag("last").over(W.partitionBy(F.lit(0)).orderBy("_range"))
    product = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    breaks = product(F.col("b.pos"), F.col("first.n")) >= product(F.col("first.pos"), F.col("b.n"))
    return edges.withColumn("b", before).where(breaks).count()


def fit(hist: DataFrame) -> DataFrame:
    """Blocks of the best increasing map from score to share of positives; ``hist`` is (score, n, pos).

    A round writes the blocks once and brings one number to the driver. Neighbours on both sides of a bound meet in the
    next round, whose bounds are others; if that did not help, as with very few blocks, ranges become fewer.
    """
    blocks = hist.select(F.col("score").alias("lo"), F.col("score").alias("hi"), F.col("n").cast("long"), F.col("pos").cast("long"))
    parts, open_before, step = range_count(hist.sparkSession), None, 0
    while True:
        blocks = _pool_ranges(blocks.select("lo", "hi", "n", "pos"), parts + step % 2)
        left = _violations(blocks)
        if not left:
            return blocks.select("lo", "hi", "n", "pos")
        if open_before is not None and left >= open_before:
            parts = max(1, parts // 2)
        open_before, step = left, step + 1


def lookup(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """(score, isotonic) of distinct ``scores``: the value of the block that holds a score, between two blocks the
    straight line from one to the other, outside all blocks the end values.

    An interval join without pairs: blocks and scores are dealt to common ranges, each score takes the nearest blocks
    in its range, and what lies beyond the range comes from a table with one row per range.
    """
    block = F.struct("lo", "hi", (F.col("pos") / F.col("n")).alias("v"))
    points = blocks.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), block.alias("block")).unionByName(
        scores.select(F.col("score").alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    stored = in_ranges(points, "at", ["kind"])
    inside = W.partitionBy("_range").orderBy("at", "kind")
    back, ahead = W.unboundedPreceding, W.unboundedFollowing
    near = stored.select(
        "at", "kind", "_range", F.last("block", ignorenulls=True).over(inside.rowsBetween(back, 0)).alias("p"),
        F.first("block", ignorenulls=True).over(inside.rowsBetween(0, ahead)).alias("q")).where("kind = 1")
    over = W.partitionBy(F.lit(0)).orderBy("_range")
    edges = stored.groupBy("_range").agg(F.min(F.col("block")).alias("first"), F.max("block").alias("last"))
    edges = edges.select("_range", F.last("last", ignorenulls=True).over(over.rowsBetween(back, -1)).alias("before"),
                         F.first("first", ignorenulls=True).over(over.rowsBetween(1, ahead)).alias("after"))
    both = near.join(F.broadcast(edges), "_range").select(
        F.col("at").alias("score"), F.coalesce("p", "before").alias("p"), F.coalesce("q", "after").alias("q"))
    return both.select("score", _between(F.col("score"), F.col("p"), F.col("q")).alias("isotonic"))


def _between(x: Column, p: Column, q: Column) -> Column:
    line = p["v"] + (x - p["hi"]) * (q["v"] - p["v"]) / (q["lo"] - p["hi"])
    return F.when(p.isNull(), q["v"]).when((x <= p["hi"]) | q.isNull(), p["v"]).otherwise(line)
