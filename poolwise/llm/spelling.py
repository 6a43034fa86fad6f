"""Spelling variants by a bit-sliced position index: words that are one inserted, deleted or replaced letter apart.

Two words one edit apart share the first half or the last half of the shorter one, so a word meets all its near words in
the buckets of its halves. A bucket keeps a bitset over its words for each (position, letter); a query word runs through
its letters once, with the words that match so far and those that match with one edit as two kinds of bitsets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

#: Words of a bucket that are indexed, and that are looked up, in one cell.
CELL = 8192


class PositionIndex:
    """Bitsets over ``words`` by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.sets: defaultdict[tuple[int, str], int] = defaultdict(int)
        self.of_length: defaultdict[int, int] = defaultdict(int)
        for number, word in enumerate(words):
            bit = 1 << number
            self.of_length[len(word)] |= bit
            for place in enumerate(word):
                self.sets[place] |= bit

    def near(self, word: str) -> tuple[int, int]:
        """Words with one letter of ``word`` replaced, and words with one letter put into it, as bitsets."""
        same, inside = self.of_length.get(len(word), 0), self.of_length.get(len(word) + 1, 0)
        exact, replaced, put = same | inside, 0, 0
        get = self.sets.get
        for i, letter in enumerate(word):
            here = get((i, letter), 0)
            # ``put`` reads its words one place further on; a letter may be put in before any letter.
            put = (put | exact) & get((i + 1, letter), 0)
            replaced = replaced & here | exact & ~here
            exact &= here
            if not (exact or replaced or put):
                return 0, 0
        return replaced & same, (put | exact) & inside


def numbers(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def compare(shorter: int, side: str, queries: list[tuple[str, int]], indexed: list[tuple[str, int]]) -> dict[str, list]:
    """Per word of a cell: how many near words it has there, and the best of them as (-n, word).

    A pair that shares both halves is left to the bucket of the first half.
    """
    found: dict[str, list] = {}
    index = PositionIndex([w for w, _ in indexed])
    half = shorter // 2

    def add(word: str, other: tuple[str, int]) -> None:
        seen = found.setdefault(word, [0, 0, ""])
        best = (-other[1], other[0])
        seen[0] += 1
        if seen[0] == 1 or best < (seen[1], seen[2]):
            seen[1:] = best

    for query in queries:
        if len(query[0]) != shorter:
            continue
        replaced, longer = index.near(query[0])
        for number in numbers(replaced | longer):
            other = indexed[number]
            if side == "last" and other[0][:half] == query[0][:half]:
                continue
            add(query[0], other)
            if len(other[0]) > shorter:  # two words of one length find each other, as each is a query
                add(other[0], query)
    return found


def buckets(words: DataFrame) -> DataFrame:
    """(shorter, side, part, word, n): a word of length L with pairs whose shorter word has L or L - 1 letters."""
    size = F.length("word")
    keys = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        keys += [F.struct(shorter.alias("shorter"), F.lit("first").alias("side"), F.left("word", half).alias("part")),
                 F.struct(shorter.alias("shorter"), F.lit("last").alias("side"), F.right("word", half).alias("part"))]
    return words.select("word", "n", F.explode(F.array(*keys)).alias("key")).where("key.shorter >= 0").select("key.*", "word", "n")


def cells(rows: DataFrame) -> DataFrame:
    """Buckets cut into cells of at most about CELL queries and CELL indexed words: each pair meets in one cell.

    A bucket of b words in c parts has c * c cells, and each word is copied to 2 * c - 1 of them, so a common beginning
    or end spreads over many tasks.
    """
    key = ["shorter", "side", "part"]
    large = rows.groupBy(*key).agg(F.count("*").alias("_size")).where(F.col("_size") > CELL)
    parts = F.coalesce(F.ceil(F.col("_size") / CELL), F.lit(1)).cast("int")
    dealt = rows.join(large, key, "left").withColumn("_parts", parts)
    own = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(
        own.alias("row"), j.alias("col"), F.lit(True).alias("asks"), (j == own).alias("indexed")))
    more = F.transform(F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda i: i != own), lambda i: F.struct(
        i.alias("row"), own.alias("col"), F.lit(False).alias("asks"), F.lit(True).alias("indexed")))
    return dealt.select(*key, "word", "n", F.explode(F.concat(places, more)).alias("cell")).select(*key, "cell.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words: their number and the one with the largest n, of
    equal ones the smallest in code-point order."""
    place = ["shorter", "side", "part", "row", "col"]
    sorted_cells = cells(buckets(words)).repartition(*place).sortWithinPartitions(*place)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in (*place, "asks", "indexed", "word", "n")), strict=True))
        out: list[tuple] = []
        for key, cell in groupby(rows, key=lambda r: r[:5]):
            members = list(cell)
            if len(members) > 1:
                pick = lambda flag: [r[7:] for r in members if r[flag]]
                out += [(w, *f) for w, f in compare(key[0], key[1], pick(5), pick(6)).items()]
            if len(out) > 20_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "less", "other"])

    found = sorted_cells.mapInArrow(search, "word string, near long, less long, other string")
    best = F.min(F.struct("less", "other"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Words with their near words and their main spelling: word, form, root, n, n_near, form_n.

    ``words`` is (word, n), one row per word; columns besides these two are not read, rows with a null word or n are
    left out. The form of a word is its near word of largest n (ties: the smallest in code-point order) if that n is at
    least ``ratio`` times its own; the root is where following forms ends. As n grows by ``ratio`` with each form, paths
    are short, and a few rounds of doubling reach all roots. An empty table gives no rows.
    """
    words = common.written(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"), "words")
    enough = F.col("form_n") >= ratio * F.col("n")
    rows = (words.join(near_words(words), "word", "left")
            .withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n")))
            .withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long")))
    rows = common.written(rows.select("word", "form", "n", "n_near", "form_n"), "variants")
    most = rows.agg(F.max("form_n")).first()[0] or 1
    links, reach, depth = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1, 1
    while ratio ** depth <= most:
        depth += 1
    while reach < depth:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = common.written(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        reach *= 2
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
