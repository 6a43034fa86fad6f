"""Nearest neighbours by a block matrix join with int8 tiles and error bounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappushpop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwise.llm import common

#: Vectors of a block: its matrices fill a few MB.
BLOCK, QUERY_BLOCK = 2048, 1024


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(file, row, id, v as doubles): without vectors that are null, empty, zero or hold null or non-finite components."""
    rows = common.with_row_numbers(vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.select("file", "row", "doc.*").where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


FIELDS = {"ids": "<i8", "files": "<i8", "rows": "<i8", "matrix": "<f8", "codes": "i1", "scales": "<f8", "errors": "<f8"}
BLOCKS = "dim int, block int, " + ", ".join(f"{f} binary" for f in FIELDS)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``usable`` as matrix blocks of about ``size`` vectors of one width, with int8 codes.

    A vector is scale * code + rest; its error is the length of that rest. Blocks are dealt by the rows' places in their
    files, so repeated rows spread over all of them.
    """
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    parts = F.coalesce(*[F.when(F.size("v") == d, F.lit(max(1, -(-n // size)))) for d, n in counts.items()], F.lit(1))
    block = F.pmod(F.xxhash64("file", "row"), parts).cast("int")
    dealt = rows.select(F.size("v").alias("dim"), block.alias("block"), "file", "row", "id", "v")

    def build(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        scales = np.abs(matrix).max(axis=1) / 127
        scales[scales == 0] = np.finfo(float).tiny
        units = matrix / scales[:, None]
        codes = np.clip(np.rint(units), -127, 127)
        values = {"ids": table["id"], "files": table["file"], "rows": table["row"], "matrix": matrix, "codes": codes, "scales": scales,
                  "errors": np.linalg.norm(units - codes, axis=1) * scales}
        packed = [np.asarray(values[f]).astype(kind).tobytes() for f, kind in FIELDS.items()]
        return pa.table([[v] for v in (dim, block, *packed)], schema=pa.schema([
            ("dim", pa.int32()), ("block", pa.int32()), *[(f, pa.binary()) for f in FIELDS]]))

    return common.written(dealt.groupBy("dim", "block").applyInArrow(build, BLOCKS), "blocks")


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, added up from the first component to the last in double precision.

    Pairs whose squares would leave the range of doubles are scaled by a power of two, which changes no other digit.
    """
    gaps = queries - vectors
    most = np.abs(gaps).max(axis=1, initial=0)
    far = np.where(np.isfinite(most) & (most > 0) & ((most > 1e140) | (most < 1e-140)), np.frexp(most)[1], 0)
    if far.any():
        gaps = np.ldexp(gaps, -far[:, None])
    total = np.zeros(len(gaps))
    for d in range(gaps.shape[1]):
        total += gaps[:, d] ** 2
    return np.ldexp(np.sqrt(total), far)


def tile(q: dict, v: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, distance) of all pairs that can be among a query's ``k`` nearest of this tile.

    The int8 product gives the distance of the coded vectors; the true one differs by at most both errors, and a little
    for the rounding of the bound itself. The tile is scaled by a power of two to components of about 1, so that
    squares of very large ones stay finite and those of very small ones, where they vanish, are within the bound.
    """
    dim = q["codes"].shape[1]
    exact = 127 * 127 * dim < 1 << 24  # sums of products are whole numbers that a float32 holds
    kind = np.float32 if exact else np.float64
    down = -int(np.frexp(max(q["scales"].max(), v["scales"].max()))[1])
    scaled = lambda x, f: np.ldexp(x[f], down)
    dot = (q["codes"].astype(kind) @ v["codes"].astype(kind).T).astype(float) * scaled(q, "scales")[:, None] * scaled(v, "scales")
    square = lambda x: (x["codes"].astype(float) ** 2).sum(axis=1) * scaled(x, "scales") ** 2
    norms = square(q)[:, None] + square(v)
    near = np.sqrt(np.maximum(norms - 2 * dot, 0))
    # Cancellation can leave an error of about eps * norms in the square, so its root in the distance; below 1e-150
    # squares lose their digits.
    error = scaled(q, "errors")[:, None] + scaled(v, "errors") + np.sqrt(norms * 1e-13) + 1e-150 * dim
    own = (q["rows"][:, None] == v["rows"]) & (q["files"][:, None] == v["files"])
    upper = np.where(own, np.inf, near + error)
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
    rows, cols = np.nonzero((near - error <= limit[:, None] * (1 + 1e-12)) & ~own)
    return rows, cols, distances(q["matrix"][rows], v["matrix"][cols])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest other vectors of each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries and vectors are cut into blocks; each pair of a query block and a vector block of the same width is a tile.
    Vector blocks stay one row each, the few query blocks are copied to each of them. A tile's int8 product bounds all
    distances, the pairs that may matter are computed exactly, and heaps of ``k`` per query merge the tiles of a task; a
    window merges tasks. The result is exact. A query takes part as a candidate for others and for repeated rows of its
    own id, but not for itself, which is its place in the table. Ties go to the smaller id. Unusable vectors (see
    ``usable``) are left out; an empty table gives no rows.
    """
    rows = usable(common.scanned(vectors), key, column)
    left, right = blocks(rows.where(is_query), QUERY_BLOCK), blocks(rows, BLOCK)
    named = {s: t.select("dim", *[F.col(c).alias(f"{s}_{c}") for c in t.columns if c != "dim"]) for s, t in (("q", left), ("v", right))}
    last = right.groupBy("dim").agg(F.max("block").alias("last"))
    asked = named["q"].join(last, "dim").withColumn("v_block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    joined = asked.join(named["v"], ["dim", "v_block"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list] = {}
        for b in batches:
            for i in range(b.num_rows):
                dim, sides = b["dim"][i].as_py(), {}
                for side in "qv":
                    x = {f: np.frombuffer(b[f"{side}_{f}"][i].as_py(), kind) for f, kind in FIELDS.items()}
                    sides[side] = x | {f: x[f].reshape(-1, dim) for f in ("matrix", "codes")}
                found, cols, scores = tile(sides["q"], sides["v"], k)
                names = sides["v"]["ids"]
                order = np.lexsort((names[cols], scores, found))
                starts = np.searchsorted(found[order], np.arange(len(sides["q"]["ids"]) + 1))
                for row, query in enumerate(sides["q"]["ids"].tolist()):
                    best = order[starts[row]:starts[row + 1]][:k]
                    heap = heaps.setdefault((query, row, b["q_block"][i].as_py(), dim), [])
                    for score, name in zip(scores[best].tolist(), names[cols[best]].tolist(), strict=True):
                        if len(heap) < k:
                            heappush(heap, (-score, -name))
                        elif (-score, -name) > heap[0]:
                            heappushpop(heap, (-score, -name))
        out = [(key[0], key[1], key[2], -name, -score) for key, heap in heaps.items() for score, name in heap]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                names=["query_id", "q_row", "q_block", "vec_id", "score"])

    pairs = joined.mapInArrow(search, "query_id long, q_row int, q_block int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_block", "q_row").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
