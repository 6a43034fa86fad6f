"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolwise.llm import common

#: Groups are first packed into bundles of at least 1 / BUNDLES of a shard, so that the last step sees few items.
BUNDLES = 512
#: Groups that one task bundles, on average.
PER_TASK = 200_000


class Rooms:
    """Bins by remaining capacity in a balanced tree: sorted leaves that split when full, below a root of their minima."""

    def __init__(self, leaf: int = 256):
        self.leaf, self.leaves, self.minima = leaf, [], []

    def add(self, room: int, bin_id: int) -> None:
        entry = (room, bin_id)
        at = max(0, bisect_right(self.minima, entry) - 1)
        if not self.leaves:
            self.leaves, self.minima = [[entry]], [entry]
            return
        leaf = self.leaves[at]
        leaf.insert(bisect_left(leaf, entry), entry)
        self.minima[at] = leaf[0]
        if len(leaf) > self.leaf:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.minima[at:at + 1] = [leaf[0], leaf[half]]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room that holds ``size``."""
        at = max(0, bisect_right(self.minima, (size, -1)) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            k = bisect_left(leaf, (size, -1))
            if k < len(leaf):
                entry = leaf.pop(k)
                if leaf:
                    self.minima[at] = leaf[0]
                else:
                    del self.leaves[at], self.minima[at]
                return entry
            at += 1
        return None


def place_all(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing into ``shards`` bins of the least capacity that takes all; sizes descend."""
    def into(capacity: int) -> list[int] | None:
        rooms, out = Rooms(), []
        for k in range(shards):
            rooms.add(capacity, k)
        for size in sizes:
            if (found := rooms.tightest(size)) is None:
                return None
            rooms.add(found[0] - size, found[1])
            out.append(found[1])
        return out

    if not sizes:
        return []
    low = max(-(-sum(sizes) // shards), sizes[0])
    high = low + sizes[0]
    while (best := into(high)) is None:
        high += sizes[0]
    while low < high:
        middle = (low + high) // 2
        if (found := into(middle)) is None:
            low = middle + 1
        else:
            high, best = middle, found
    return best


def _bundle(capacity: int):
    """Groups of a task, largest first, into bundles; a group of ``capacity`` or more is a bundle of its own."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rooms, opened = TaskContext.get().partitionId(), Rooms(), 0
        for b in batches:
            out = []
            for size in b.column(2).to_pylist():
                found = rooms.tightest(size)
                if found is None:
                    found, opened = (max(capacity, size), opened), opened + 1
                if found[0] > size:
                    rooms.add(found[0] - size, found[1])
                out.append(task << 40 | found[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())],
                                             names=["finger", "key", "size", "rows", "bundle"])
    return run


def _place(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((size, bundle) for b in batches for bundle, size in zip(*(c.to_pylist() for c in b.columns),
                                                                             strict=True)), reverse=True)
        placed = place_all([size for size, _ in rows], shards)
        yield pa.RecordBatch.from_arrays([pa.array([b for _, b in rows], pa.int64()), pa.array(placed, pa.int32())],
                                         names=["bundle", "shard"])
    return run


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of a row among the rows of its shard in this task."""
    task, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        places = []
        for shard in b.column(3).to_pylist():
            places.append(seen.get(shard, 0))
            seen[shard] = places[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * b.num_rows, pa.int32()), pa.array(places, pa.int64())],
                                         names=["doc_id", "size", "text_crc32", "shard", "task", "place"])


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law (`bytes`), shard, slot (gapless from 0), grown_shard (null).

    Equal texts are one indivisible group; a null text has no bytes and is grouped with the empty one. Tasks pack their
    groups, in descending order, into bundles by best fit; then all bundles (about ``shards * BUNDLES``, at most twice
    as many and one per task, whatever the input) enter the shards by best fit decreasing at the least capacity. Slots
    are places inside a task plus the counts of the tasks before it. Repeated rows get slots of their own; an empty
    table gives no rows; columns other than doc_id and text are not read. A group above an even share fills its shard.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = common.written(slim.withColumn("finger", F.xxhash64("key")), "shard-rows")
    groups = rows.groupBy("finger", "key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    count, total = rows.groupBy().agg(F.count("*"), F.sum("size")).first()
    tasks, capacity = max(1, -(-count // PER_TASK)), max(1, -(-(total or 0) // (shards * BUNDLES)))
    sorted_groups = groups.repartition(tasks, "finger").sortWithinPartitions(F.desc("size"), "key")
    bundled = common.written(sorted_groups.mapInArrow(
        _bundle(capacity), "finger long, key binary, size long, rows long, bundle long"), "shard-bundles")
    bundles = bundled.groupBy("bundle").agg(F.sum("size").alias("size")).select("bundle", "size")
    placed = bundles.repartition(1).mapInArrow(_place(shards), "bundle long, shard int")
    placed = common.written(placed, "shard-places")
    home = bundled.join(placed, "bundle").select("finger", "key", "rows", "shard")
    known = common.attach(rows, home, ["finger", "key"], "finger", "rows", ["doc_id", "text_crc32", "size"])
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = common.written(known.select("doc_id", "size", "text_crc32", "shard").mapInArrow(
        _number, f"doc_id {doc_kind}, size long, text_crc32 long, shard int, task int, place long"), "shard-slots")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("shard", "task").agg(F.count("*").alias("n")).select(
        "shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
