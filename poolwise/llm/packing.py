"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolwise.llm import common, tokens

#: Items of a cell, islands of a cell, solutions of an island, children of an epoch, epochs with a migration between.
CELL, ISLANDS, SOLUTIONS, CHILDREN, EPOCHS = 2048, 2, 6, 16, 2
#: A sequence filled below this share is packed anew, together with those of other cells, in the next round.
LOOSE, ROUNDS = 0.97, 2
SHIFT = 24


def pieces(docs: DataFrame, capacity: int = 1024, path: str = tokens.BYTE_BPE, end_id: int = 2,
           with_ids: bool = False) -> DataFrame:
    """The written table of pieces: doc_id, piece, start, length, ids_crc32, uid (unique), and the ids if asked for.

    A document of more than ``capacity`` ids is cut from its end, so that only its first piece may be shorter.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, encoder = TaskContext.get().partitionId() << 36, tokens.ids(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                code = encoder.of(text.as_py()) + end
                n = len(code) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = code[4 * s:4 * e]
                    rows.append((doc_id, k, s, e - s, zlib.crc32(part), uid, part if with_ids else None))
                    uid += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in schema.split(", ")] + ["ids"]
            arrays = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays[:6 + with_ids], names=names[:6 + with_ids])

    return common.written(slim.mapInArrow(cut, schema + ", ids binary" * with_ids), "pieces")


def best_fit(items: Iterable[int], sizes: list[int], capacity: int, place: np.ndarray, free: list[int], new: int) -> None:
    """Puts items into the bins of ``free`` (sorted remaining << SHIFT | bin), each into the tightest that takes it."""
    mask = (1 << SHIFT) - 1
    for i in items:
        need = sizes[i]
        at = bisect_left(free, need << SHIFT)
        if at < len(free):
            entry = free.pop(at)
        else:
            entry, new = capacity << SHIFT | new, new + 1
        place[i] = entry & mask
        if left := (entry >> SHIFT) - need:
            insort(free, left << SHIFT | entry & mask)


class Island:
    """A population of packings of the same items; sizes descend, a packing gives each item its bin."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.list, self.capacity = sizes, sizes.tolist(), capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(sizes.sum()) // capacity)

    def fitness(self, packing: np.ndarray) -> float:
        """Fewer bins first (whole part), then fuller full bins."""
        fill = np.bincount(packing, weights=self.sizes) / self.capacity
        return float(-len(fill) + np.mean(fill ** 2) / 2)

    def packed(self, order: np.ndarray) -> np.ndarray:
        place = np.empty(len(self.list), "<i4")
        best_fit(order.tolist(), self.list, self.capacity, place, [], 0)
        return place

    def first(self) -> list[np.ndarray]:
        """Best fit decreasing, then the same with shaken orders."""
        out = [self.packed(np.arange(len(self.list)))]
        while len(out) < SOLUTIONS and -self.fitness(out[0]) > self.least:
            out.append(self.packed(np.argsort(-self.sizes * self.rng.uniform(0.8, 1.25, len(self.list)), kind="stable")))
        return out

    def refit(self, packing: np.ndarray, displaced: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Best fit of the displaced items (largest first) into the bins that are left."""
        place, bins = packing.copy(), int(packing.max()) + 1
        kept = np.ones(len(place), bool)
        kept[displaced] = False
        room = self.capacity - np.bincount(place[kept], weights=self.sizes[kept], minlength=bins).astype(int)
        used = np.bincount(place[kept], minlength=bins) > 0
        used[gone] = False
        free = sorted(int(room[b]) << SHIFT | int(b) for b in np.flatnonzero(used & (room > 0)))
        best_fit(displaced.tolist(), self.list, self.capacity, place, free, bins)
        return np.unique(place, return_inverse=True)[1].astype("<i4")

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Injects whole well-filled bins of ``father``; the bins of ``mother`` that share items with them dissolve."""
        fill = np.bincount(father, weights=self.sizes)
        well = np.flatnonzero(fill >= np.median(fill))
        chosen = self.rng.choice(well, max(1, len(well) // 8), replace=False)
        injected = np.isin(father, chosen)
        broken = np.unique(mother[injected])
        displaced = np.flatnonzero(np.isin(mother, broken) & ~injected)
        child, top = mother.copy(), int(mother.max()) + 1
        child[injected] = top + father[injected]
        child = np.unique(child, return_inverse=True)[1].astype("<i4")
        return self.refit(child, displaced, np.array([], int))

    def mutate(self, packing: np.ndarray) -> np.ndarray:
        """Dissolves the emptiest bins and a few others."""
        fill = np.bincount(packing, weights=self.sizes)
        few = max(1, len(fill) // 50)
        gone = np.union1d(np.argsort(fill, kind="stable")[:few], self.rng.integers(0, len(fill), few))
        return self.refit(packing, np.flatnonzero(np.isin(packing, gone)), gone)

    def evolve(self, population: list[np.ndarray]) -> list[np.ndarray]:
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(population)), reverse=True, key=lambda x: x[:2])
        for k in range(CHILDREN):
            if -ranked[0][0] <= self.least or len(ranked) < 2:
                break
            a, b = sorted(self.rng.choice(len(ranked), 2, replace=False))
            child = self.cross(ranked[a][2], ranked[b][2])
            if self.rng.random() < 0.5:
                child = self.mutate(child)
            ranked = sorted([*ranked[:-1], (self.fitness(child), 100 + k, child)], reverse=True, key=lambda x: x[:2])
        return [p for _, _, p in ranked]


STATE = "cell int, island int, uids array<long>, sizes array<int>, population array<binary>, score double"


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island; rows carry an elite of the neighbouring island as ``migrant``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                seed = (row["cell"] << 8) + (row["island"] << 4) + epoch
                island = Island(np.array(row["sizes"], "i8"), capacity, seed)
                people = [np.frombuffer(x, "<i4") for x in row["population"]] or island.first()
                if row["migrant"] is not None:
                    people = [*people[:-1], np.frombuffer(row["migrant"], "<i4")] if len(people) > 1 else people
                people = island.evolve(people)
                row |= {"population": [p.tobytes() for p in people], "score": island.fitness(people[0])}
                del row["migrant"]
                yield pa.RecordBatch.from_pylist([row], schema=_arrow())

    return islands.mapInArrow(run, STATE)


def _arrow() -> pa.Schema:
    return pa.schema([("cell", pa.int32()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())),
                      ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("score", pa.float64())])


def _round(items: DataFrame, capacity: int, number: int) -> DataFrame:
    """(uid, length, bin) with bins unique over all rounds; each item is in one bin."""
    cells = max(1, -(-items.count() // CELL))
    cell = F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(cells)).cast("int")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("size"), "uid")))
    grouped = items.groupBy(cell.alias("cell")).agg(rows.alias("rows"))
    islands = grouped.select(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("rows.uid").alias("uids"),
        F.transform("rows.size", lambda x: (-x).cast("int")).alias("sizes"),
        F.array().cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    state = _epoch(islands, capacity, 0)
    ring = Window.partitionBy("cell").orderBy("island")
    for epoch in range(1, EPOCHS):
        elite = F.col("population")[0]
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sent = state.withColumn("migrant", F.coalesce(F.lag(elite).over(ring), F.last(elite).over(whole)))
        state = _epoch(sent, capacity, epoch)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, uids, sizes, packing in zip(*(x.to_pylist() for x in b.columns), strict=True):
                bins = np.frombuffer(packing, "<i4").astype("i8") | (number << 56) | (c << SHIFT)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sizes, pa.int64()),
                                                  pa.array(bins)], names=["uid", "length", "bin"])

    best = (state.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "island")))
            .where("place = 1").select("cell", "uids", "sizes", F.col("population")[0].alias("packing")))
    return common.written(best.mapInArrow(unpack, "uid long, length long, bin long"), f"packing-{number}")


def pack(docs: DataFrame, capacity: int = 1024, path: str = tokens.BYTE_BPE, end_id: int = 2,
         with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Full pieces are sequences of their own. The others are dealt by hash into cells of about ``CELL``, each of which
    evolves on ``ISLANDS`` islands whose elites migrate between the epochs; loosely filled sequences of all cells are
    packed again together. Memory is bounded by a cell, and no key can make one large. Null and empty texts are one end
    id, repeated rows and doc_ids are packed each, an empty table gives no rows; other columns are not read.
    """
    table = pieces(docs, capacity, path, end_id, with_ids)
    left, done = table.where(F.col("length") < capacity).select("uid", "length"), []
    for number in range(1, ROUNDS + 1):
        packed = _round(left, capacity, number)
        if number == ROUNDS:
            done.append(packed)
            break
        fill = Window.partitionBy("bin")
        packed = packed.withColumn("fill", F.sum("length").over(fill))
        done.append(packed.where(F.col("fill") >= LOOSE * capacity).drop("fill"))
        left = packed.where(F.col("fill") < LOOSE * capacity).select("uid", "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    inside = Window.partitionBy("bin").orderBy("uid")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.select("uid", F.col("bin").alias("sequence_id"), F.coalesce(offset, F.lit(0)).alias("offset"))
    out = table.join(placed, "uid", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32",
                      F.coalesce("sequence_id", -1 - F.col("uid")).alias("sequence_id"),
                      F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), *["ids"] * with_ids)
