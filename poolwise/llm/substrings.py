"""Substring duplicates: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

Every window is hashed where its document is read. So that not every hash has to move, a window is known by its anchor:
of the shorter sequences inside it, the one with the least hash, which depends on the window's words alone. Equal windows
have equal anchors, neighbouring windows mostly share one. First the spans of neighbouring windows with one anchor are
counted as a whole; only where an anchor occurs in different spans are the windows themselves counted. Nothing is lost:
two equal windows lie in equal spans, or in different spans of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

#: Words of an anchor.
ANCHOR = 16
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among 64-bit numbers
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of texts that are hashed together.
PORTION = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 64
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """``x``, changed in place so that all bits of a number depend on all its bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the number of words before each text and before the end."""
    joined = b" ".join(texts) + b" " * 8  # eight bytes can be read from the start of any word
    blank = BLANK[np.frombuffer(joined, np.uint8)]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        change = np.r_[0, change]
    start, length = change[::2], change[1::2] - change[::2]
    eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    hashes = mixed((eights[start] & FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(BASE))
    for k in range(8, LONG, 8):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        hashes[more] = mixed(hashes[more] * np.uint64(BASE) + (eights[start[more] + k] & FIRST[np.minimum(length[more] - k, 8)]))
    for i in np.flatnonzero(length > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(joined[start[i]:start[i] + length[i]])
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(start, places)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours; there are at least so many."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:len(x) - rest], x[rest:])


def steps(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Rolling:
    """Hashes of word sequences as polynomials in BASE over 64-bit word hashes, from sums of prefixes, for many texts at once."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1)
            factors = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            for f in factors:
                f[0] = 1
            self.up, self.down = (np.multiply.accumulate(f) for f in factors)

    def hashes(self, texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
        """Sums of prefixes over the words of all texts, the number of words before each text and before the end, the
        anchors of the windows from each word on, and whether they stand at its start. Windows that run into the next
        text have no meaning."""
        words, edges = hashed_words(texts)
        self._powers(len(words))
        sums, short = np.zeros(len(words) + 1, np.uint64), min(ANCHOR, window)
        np.cumsum(words * self.up[:len(words)], out=sums[1:])
        if len(words) < window:
            return sums, edges, np.empty(0, np.uint64), np.empty(0, bool)
        grams = mixed((sums[short:] - sums[:-short]) * self.down[:len(words) - short + 1] + np.uint64(short))
        anchors = least_of(grams, window - short + 1)
        return sums, edges, anchors, grams[:len(anchors)] == anchors

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of words start..end - 1."""
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def anchors(self, texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
        """(text, first window, number of windows, anchor, span hash) of the spans of windows that share an anchor
        in one place, its first in the window."""
        sums, edges, anchors, leads = self.hashes(texts, window)
        counts = np.maximum(np.diff(edges) - window + 1, 0)
        if not counts.any():
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        text, at = np.repeat(np.arange(len(texts)), counts), steps(counts)
        place = edges[text] + at
        anchor = anchors[place]
        begins = np.flatnonzero(np.r_[True, leads[place[:-1]] | (anchor[1:] != anchor[:-1]) | (at[1:] == 0)])
        size, text, first = np.diff(np.r_[begins, len(at)]), text[begins], at[begins]
        place = edges[text] + first
        return text, first, size, anchor[begins], self.spans(sums, place, place + size + window - 1)

    def windows(self, texts: list[bytes], text: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, hash) of the windows that begin at word ``start`` of the text of number ``text``."""
        sums, edges, anchors, _ = self.hashes(texts, window)
        place = edges[text] + start
        return anchors[place], self.spans(sums, place, place + window)


def portions(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about PORTION bytes, with the number of the first."""
    begin, part, size = 0, [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PORTION:
            yield begin, part
            begin, part, size = begin + len(part), [], 0
    if part:
        yield begin, part


def words_of(text: bytes) -> list[bytes]:
    """Runs of characters other than common.WORD's separators, which are the white space of byte strings."""
    return text.split()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a for a in columns.values()], names=list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, text in UTF-8; null as empty)."""
    numbered = common.with_row_numbers(docs.select("doc_id", "text"))
    return numbered.select("file", "row", "doc.doc_id", F.coalesce(F.encode("doc.text", "UTF-8"), F.lit(b"")).alias("text"))


def spans(docs: DataFrame, window: int) -> DataFrame:
    """(file, row, doc_id, first, size, anchor, span) of all documents with a doc_id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            found = []
            for begin, texts in portions(b["text"].to_pylist()):
                text, *columns = rolling.anchors(texts, window)
                found.append((text + begin, *columns))
            if not sum(len(f[0]) for f in found):
                continue
            of_doc, first, size, anchor, span = (np.concatenate(x) for x in zip(*found, strict=True))
            yield batch(**{c: b[c].take(pa.array(of_doc)) for c in ("file", "row", "doc_id")},
                        first=pa.array(first, pa.int32()), size=pa.array(size, pa.int32()),
                        anchor=pa.array(signed(anchor)), span=pa.array(signed(span)))

    return rows_of(docs).where("doc_id IS NOT NULL").mapInArrow(
        run, "file long, row long, doc_id long, first int, size int, anchor long, span long")


def decisions(docs: DataFrame, window: int) -> DataFrame:
    """(file, row, spans: array of (first, size, gone)): spans that an earlier document has as a whole, and, not gone,
    spans whose windows have to be looked at one by one, as their anchor occurs in other spans too.

    Both joins have one row per key on one side, so Spark can split a key that many rows have.
    """
    kinds = common.written(spans(docs, window).groupBy("anchor", "span").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "spans")
    shared = (kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("least").alias("low"), F.max("most").alias("high"))
              .where("low < high").select("anchor", "kinds"))
    kinds = kinds.join(shared, "anchor").where("least < most OR kinds > 1").select(
        "anchor", "span", "least", (F.col("kinds") > 1).alias("open"))
    found = spans(docs, window).join(kinds, ["anchor", "span"]).where("doc_id > least OR open")
    return found.groupBy("file", "row").agg(F.collect_list(F.struct(
        "first", "size", (F.col("doc_id") > F.col("least")).alias("gone"))).alias("spans"))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in one of the intervals."""
    if not len(starts):
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def intervals(gone: np.ndarray) -> list[dict[str, int]]:
    if not gone.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


RESULT = "file long, row long, doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_sha256 string"
REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def result(b: pa.RecordBatch, done: list[tuple[list[bytes], np.ndarray]]) -> dict:
    """Result columns for documents given as words and a mask of removed ones."""
    kept = [b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
            for words, gone in done]
    return {"n_words": pa.array([len(w) for w, _ in done], pa.int64()),
            "n_removed": pa.array([int(g.sum()) for _, g in done], pa.int64()),
            "removed": pa.array([intervals(g) for _, g in done], REMOVED),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}


def packed(docs: DataFrame) -> DataFrame:
    """``rows_of`` with compressed texts, as they are about to be shuffled."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = pa.array([squeeze.compress(t) for t in b["text"].to_pylist()], pa.binary())
            yield batch(file=b["file"], row=b["row"], doc_id=b["doc_id"], text=texts)

    return rows_of(docs).mapInArrow(run, "file long, row long, doc_id long, text binary")


def settled(docs: DataFrame, window: int) -> DataFrame:
    """RESULT of all documents, and the compressed text and undecided spans of those that are not settled yet."""
    both = packed(docs).join(decisions(docs, window), ["file", "row"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            done, texts, open_spans = [], [], []
            for text, found in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                words, found = words_of(expand.decompress(text)), found or []
                first, size, gone = (np.array([s[k] for s in found], np.int64) for k in ("first", "size", "gone"))
                gone = gone.astype(bool)
                mask = covered(len(words), first[gone], (first + size + window - 1)[gone])
                left = [s for s in found if not s["gone"]]
                done.append((words, mask))
                texts.append(text if left else None)
                open_spans.append(([s["first"] for s in left], [s["size"] for s in left]))
            firsts, sizes = (pa.array([x[i] for x in open_spans], pa.list_(pa.int32())) for i in (0, 1))
            yield batch(file=b["file"], row=b["row"], doc_id=b["doc_id"], **result(b, done),
                        text=pa.array(texts, pa.binary()), firsts=firsts, sizes=sizes)

    columns = ["file", "row", "doc_id", "text", "spans"]
    return both.select(columns).mapInArrow(run, f"{RESULT}, text binary, firsts array<int>, sizes array<int>")


def open_windows(unsettled: DataFrame, window: int) -> DataFrame:
    """(file, row, doc_id, start, anchor, hash) of the windows of undecided spans."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, rolling = zstandard.ZstdDecompressor(), Rolling()
        for b in (b for b in batches if b.num_rows):
            found = []
            for begin, texts in portions(map(expand.decompress, b["text"].to_pylist())):
                opened = b.slice(begin, len(texts))
                first, size = (opened[c].flatten().to_numpy().astype(np.int64) for c in ("firsts", "sizes"))
                of_span = np.repeat(np.arange(opened.num_rows), pc.list_value_length(opened["sizes"]).to_numpy())
                text, start = np.repeat(of_span, size), np.repeat(first, size) + steps(size)
                found.append((text + begin, start, *rolling.windows(texts, text, start, window)))
            of_doc, start, anchor, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
            yield batch(**{c: b[c].take(pa.array(of_doc)) for c in ("file", "row", "doc_id")}, start=pa.array(start, pa.int32()),
                        anchor=pa.array(signed(anchor)), hash=pa.array(signed(hashed)))

    columns = ["file", "row", "doc_id", "text", "firsts", "sizes"]
    return unsettled.select(columns).mapInArrow(run, "file long, row long, doc_id long, start int, anchor long, hash long")


def finished(unsettled: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """RESULT of documents with undecided spans; ``repeated`` has the windows of them that an earlier document has."""
    starts = repeated.groupBy("file", "row").agg(F.collect_list("start").alias("starts"))
    both = unsettled.join(starts, ["file", "row"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            done = []
            for text, begun, before in zip(b["text"].to_pylist(), b["starts"].to_pylist(), b["removed"].to_pylist(), strict=True):
                words, begun = words_of(expand.decompress(text)), np.array(begun or [], np.int64)
                first = np.r_[begun, [x["start"] for x in before]].astype(np.int64)
                end = np.r_[begun + window, [x["end"] for x in before]].astype(np.int64)
                done.append((words, covered(len(words), first, end)))
            yield batch(file=b["file"], row=b["row"], doc_id=b["doc_id"], **result(b, done))

    return both.select("file", "row", "doc_id", "text", "starts", "removed").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per document: file, row, doc_id, n_words, n_removed, removed (maximal intervals of words), kept_sha256.

    A word goes if it lies in a window of ``window`` words that also begins in a document with a smaller doc_id; windows
    are judged on the input. Words are runs of characters other than ASCII white space, whole texts are read, null counts
    as empty. Rows with one doc_id don't remove from each other; rows without doc_id keep all their words and remove from
    none. Texts shorter than a window keep all words, an empty table gives no rows, columns besides doc_id and text are
    not read. Windows are equal if two 64-bit hashes, of the anchor and of the window, are.
    """
    docs = common.scanned(docs)
    table = common.written(settled(docs, window), "settled")
    names = ["file", "row", "doc_id", "n_words", "n_removed", "removed", "kept_sha256"]
    unsettled = table.where("text IS NOT NULL")
    windows = open_windows(unsettled, window)
    firsts = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    repeated = windows.join(firsts, ["anchor", "hash"]).where("doc_id > least").select("file", "row", "start")
    return table.where("text IS NULL").select(names).unionByName(finished(unsettled, repeated, window))


def texts(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """(doc: all columns of ``docs`` as a struct, kept: the words that ``remove_repeats`` leaves, joined by blanks)."""
    spans_of = removals.select("file", "row", "removed")
    rows = common.with_row_numbers(common.scanned(docs)).join(spans_of, ["file", "row"])
    words = F.filter(F.split(F.coalesce("doc.text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("removed", lambda r: (r["start"] <= i) & (i < r["end"])))
    return rows.select("doc", F.array_join(kept, " ").alias("kept"))
