"""Token ids in directly addressable codes: any token can be read without decoding a block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolwise.llm import common, tokens

MAGIC = b"DAC1"
#: Positions between two entries of a rank directory.
RANK_STEP = 512
#: A segment is closed once it holds so many ids; a document is never cut.
SEGMENT = 1 << 18


def pack(ids: np.ndarray) -> bytes:
    """One segment: magic, number of levels, then per level its length, 8-bit chunks, continuation bitmap and ranks.

    Level k holds chunk k of the ids that have more than k chunks, in order. Bit i of its bitmap says whether id i of
    this level goes on in the next one; entry j of its rank directory counts the bits before position j * RANK_STEP.
    """
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little").tobytes()
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_STEP)))
                                if len(more) else []])[:-1 if len(more) else None].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype("u1").tobytes() + bits + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Segment:
    """Random access to the ids of a packed segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        (count,), at = struct.unpack_from("<I", blob, 4), 8
        self.levels = []
        for _ in range(count):
            (n,), at = struct.unpack_from("<Q", blob, at), at + 8
            chunks = np.frombuffer(blob, "u1", n, at)
            bits = np.frombuffer(blob, "u1", -(-n // 8), at := at + n)
            ranks = np.frombuffer(blob, "<u4", max(1, -(-n // RANK_STEP)), at := at + len(bits))
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _bits(self, level: int, start: int, end: int) -> np.ndarray:
        whole = np.unpackbits(self.levels[level][1][start // 8:-(-end // 8)], bitorder="little")
        return whole[start % 8:start % 8 + end - start].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        if at == len(self.levels[level][0]) and at % RANK_STEP == 0:
            return len(self.levels[level + 1][0])
        block = at // RANK_STEP
        return int(self.levels[level][2][block]) + int(self._bits(level, block * RANK_STEP, at).sum())

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive): one slice and one rank per level."""
        out = self.levels[0][0][start:end].astype("<u4")
        where, level = np.arange(end - start), 0
        while len(where) and level + 1 < len(self.levels):
            more = self._bits(level, start, end)
            start = self._rank(level, start)
            end, where, level = start + int(more.sum()), where[more], level + 1
            out[where] |= self.levels[level][0][start:end].astype("<u4") << (8 * level)
        return out


SEGMENTS = "part int, segment int, n long, doc_ids array<long>, lengths array<long>, codes binary"


def write_ids(docs: DataFrame, name: str = "token-ids", path: str = tokens.BYTE_BPE, end_id: int = 0) -> DataFrame:
    """Tokenises each whole text, appends ``end_id`` and writes the ids in ascending doc_id order; returns the table.

    A row of the written table is a segment: part and segment (their order is the order of the ids), number of ids,
    doc_ids with their lengths, and the codes. Rows are dealt by ranges of (doc_id, text hash, place), so a repeated
    doc_id, even in a third of all rows, is split as well. Null and empty texts have ``end_id`` only, null doc_ids come
    first, repeated rows are all written, an empty table has no segments; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        encoder, held = tokens.ids(path), ([], [], [])

        def close() -> pa.RecordBatch:
            doc_ids, lengths, codes = held
            ids = np.frombuffer(b"".join(codes), "<u4")
            row = [[part], [segment], [len(ids)], [list(doc_ids)], [list(lengths)], [pack(ids)]]
            for x in held:
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                                              names=["part", "segment", "n", "doc_ids", "lengths", "codes"])

        total = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                code = encoder.of(text.as_py()) + end
                for x, y in zip(held, (doc_id, len(code) // 4, code), strict=True):
                    x.append(y)
                total += len(code) // 4
                if total >= SEGMENT:
                    yield close()
                    total, segment = 0, segment + 1
        if held[0]:
            yield close()

    return common.written(dealt.mapInArrow(encode, SEGMENTS), name)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, segment, doc_ids, lengths, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held, ends = Segment(codes), np.cumsum(lengths)
            ids = [held.read(int(e - n), int(e)).tobytes() for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(ids), pa.int32()), pa.array([segment] * len(ids), pa.int32()),
                pa.array(doc_ids, pa.int64()), pa.array(ends - np.array(lengths), pa.int64()),
                pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array(ids, pa.binary())],
                names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])


def read_ids(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document read back from ``segments``: doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit).

    ``start`` counts the ids of all documents before it: sums inside each part, on top of sums over the parts, of which
    there are as many as the writing job had tasks. Without the ids themselves only their checksums travel.
    """
    sizes = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = (segments.select("part", "segment", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("first"))
              .join(parts, "part").select("part", "segment", (F.col("base") + F.col("first")).alias("base")))
    read = segments.select("part", "segment", "doc_ids", "lengths", "codes").mapInArrow(
        _decode, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    kept = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return read.select(*kept).join(places, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
