"""Conversation structure repair: the cheapest edits by a run-length dynamic program over a min-plus algebra.

Rows get a symbol for their role and fault. The repaired roles must be nothing, or an optional system row and then pairs
of user and assistant, which an automaton of four states accepts. One row is a 4 x 4 matrix of edit costs over these
states, a run of equal symbols a power of it, and a block of rows their product. So a conversation of any length is cut
into blocks that are worked on apart: matrices give the cost of all that follows a block, each block unrolls its
cheapest edits for each state it may be entered in, and only states pass from block to block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

#: Rows of a block, about.
BLOCK = 100_000
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAR = 10 ** 15
#: Costs of finishing in each state, before insertions that help.
FINAL = (0, FAR, FAR, 0)
#: Blocks of up to so many rows are remembered, as most conversations look like many others.
SHORT = 64
#: Symbols by initial of the role (other roles as x): sound, truncated, to be deleted.
SOUND, TRUNCATED, GONE = "suax", "SUAX", "1234"
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FILL = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")

Matrix = tuple[tuple[int, ...], ...]


# ---------------------------------------------------------------- the program over states

def times(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in columns) for row in a)


@lru_cache(None)
def moves(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) of one row, edits in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol not in GONE:
        extra = CUT * (symbol in TRUNCATED)
        if (kept := NEXT.get((state, symbol.lower()))) is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, FILL[state]))
    return tuple(out)


def insertions() -> Matrix:
    """Costs of any number of inserted rows between two states."""
    step = tuple(tuple(0 if a == b else INSERT if FILL[a] == b else FAR for b in range(4)) for a in range(4))
    return times(times(step, step), step)


@lru_cache(None)
def power(symbol: str, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent rows with ``symbol``, each after any insertions."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    row = tuple(tuple(min([c for _, c, to in moves(symbol, a) if to == b], default=FAR) for b in range(4)) for a in range(4))
    return times(insertions(), row)


def runs(symbols: str) -> Iterator[tuple[str, int]]:
    """Symbols with the length of their run; what must be deleted is alike whatever its role."""
    alike = symbols.translate(str.maketrans(GONE, GONE[0] * len(GONE)))
    for run in re.finditer(r"(.)\1*", alike):
        yield run[1], run.end() - run.start()


@lru_cache(100_000)
def short_matrix(symbols: str) -> Matrix:
    return product(symbols)


def matrix(symbols: str) -> Matrix:
    return short_matrix(symbols) if len(symbols) <= SHORT else product(symbols)


def product(symbols: str) -> Matrix:
    """Costs of a block between any two states."""
    out = tuple(tuple(0 if a == b else FAR for b in range(4)) for a in range(4))
    for symbol, length in runs(symbols):
        for exponent in range(length.bit_length()):
            if length >> exponent & 1:
                out = times(out, power(symbol, exponent))
    return out


def after(m: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, costs, strict=True)) for row in m)


def finish() -> tuple[int, ...]:
    return after(insertions(), FINAL)


@lru_cache(100_000)
def step_back(symbol: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those behind it, less the least of them: few different ones ever occur."""
    out = after(power(symbol, 0), costs)
    return tuple(c - min(out) for c in out)


@lru_cache(100_000)
def choices(symbol: str, state: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest edits of one row, insertions before it included, and the state they lead to."""
    edits = ""
    total = after(power(symbol, 0), costs)[state]
    while True:
        options = [(e, cost + costs[to], to) for e, cost, to in moves(symbol, state)]
        filled = after(power(symbol, 0), costs)[FILL[state]] + INSERT
        options.append(("I", filled, FILL[state]))
        edit, _, to = min(o for o in options if o[1] == total)
        edits, state = edits + edit, to
        if edit != "I":
            return edits, state
        total -= INSERT


def unroll(symbols: str, costs: tuple[int, ...]) -> list[tuple[str, int]]:
    """The edits of a block and the state behind them, for each state it may be entered in; ``costs`` are those of all
    that follows."""
    behind = [tuple(c - min(costs) for c in costs)]
    for symbol in reversed(symbols):
        behind.append(step_back(symbol, behind[-1]))
    out = []
    for state in range(4):
        edits = []
        for symbol, costs_then in zip(symbols, reversed(behind[:-1]), strict=True):
            edit, state = choices(symbol, state, costs_then)
            edits.append(edit)
        out.append(("".join(edits), state))
    return out


@lru_cache(100_000)
def short_unrolled(symbols: str, costs: tuple[int, ...]) -> list[tuple[str, int]]:
    return unroll(symbols, costs)


def unrolled(symbols: str, costs: tuple[int, ...]) -> list[tuple[str, int]]:
    return short_unrolled(symbols, costs) if len(symbols) <= SHORT else unroll(symbols, costs)


def tail(state: int) -> str:
    """Insertions that end a conversation in ``state``."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


# ---------------------------------------------------------------- rows to blocks

def faults(role: Column, text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.length(last) == 0, (F.length(last) > 0) & ~last.isin(".", "!", "?")


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows as a written table in blocks of about BLOCK rows: conv (a key that is never null), block, seq, ...

    Blocks are ranges of (conversation, turn with nulls first, role, text, place in file), so neither a long
    conversation nor a row that is repeated very often fills one of them.
    """
    rows = common.scanned(rows)
    named = common.with_row_numbers(rows.select("conv_id", "turn", "role", "text")).select("doc.*", "file", "row")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    named = named.select(conv.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"), "file", "row")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "file", "row"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK))
    ranged = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blank, truncated = faults(F.col("role"), F.col("text"))
    initial = F.left("role", F.lit(1))
    return common.written(ranged.select(
        "conv", "conv_id", F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"), "turn", "role", "text",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), blank.alias("blank"), truncated.alias("cut"),
        F.unhex(F.sha2(F.concat_ws(":", "conv", F.length("role").cast("string"), "role", "text"), 256)).alias("print")), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows of ``in_blocks`` without their texts, with ``fault``: blank, duplicate or truncated, the first that applies.

    A row is a duplicate if its conversation, role and text stand earlier. There is one row per such print on the other
    side of the join, so Spark can split a print that many rows have.
    """
    firsts = rows.groupBy("print").agg(F.min(F.struct("block", "seq")).alias("first"))
    repeated = F.struct("block", "seq") != F.col("first")
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("cut"), "truncated")
    return (rows.drop("text", "role").join(firsts, "print")
            .select("conv", "conv_id", "block", "seq", "turn", "initial", fault.alias("fault")))


def symbol() -> Column:
    place = F.instr(F.lit(SOUND), F.col("initial"))
    of = lambda letters: F.substring(F.lit(letters), place, F.lit(1))
    return F.when(F.col("fault").isin("blank", "duplicate"), of(GONE)).when(F.col("fault") == "truncated", of(TRUNCATED)).otherwise(of(SOUND))


def mapped(df: DataFrame, function, **columns: pa.DataType) -> DataFrame:
    """``function`` maps a row (a tuple) to rows; Arrow batches in and out."""
    names, kinds = list(columns), list(columns.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in function(*r)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    simple = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>",
              pa.list_(pa.string()): "array<string>"}
    return df.mapInArrow(run, ", ".join(f"{n} {simple[k]}" for n, k in columns.items()))


def illegal(symbols: str) -> int:
    roles = symbols.lower().translate(str.maketrans(GONE, SOUND))
    return sum(roles[i:i + 2] not in LEGAL for i in range(len(roles) - 1))


def edits(flawed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, block, entry, audit) per block, and (conv, cost, illegal) per conversation.

    What one task sees of a conversation is a block, or one matrix and four states for each of its blocks.
    """
    in_order = F.array_sort(F.collect_list(F.struct("seq", symbol().alias("symbol"))))
    joined = F.array_join(F.transform(in_order, lambda r: r["symbol"]), "")
    blocks = common.written(flawed.groupBy("conv", "block").agg(joined.alias("symbols")), "symbols")
    ends_of = lambda s: s[0] + s[-1]
    costs = mapped(blocks.select("conv", "block", "symbols"), lambda c, b, s: [(
        c, b, [x for row in matrix(s) for x in row], illegal(s), ends_of(s))],
        conv=pa.string(), block=pa.int32(), flat=pa.list_(pa.int64()), illegal=pa.int64(), ends=pa.string())

    def suffixes(conv: str, parts: list[dict]) -> Iterator[tuple]:
        behind, odd = finish(), sum(p["illegal"] for p in parts)
        odd += sum(illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(parts, parts[1:]))
        for p in reversed(parts):
            here = after(tuple(tuple(p["flat"][i:i + 4]) for i in range(0, 16, 4)), behind)
            # Whole-conversation figures go out with the first block.
            first = p is parts[0]
            yield conv, p["block"], list(behind), here[START] if first else None, odd if first else None
            behind = here

    per_conv = F.array_sort(F.collect_list(F.struct("block", "flat", "illegal", "ends")))
    ends = common.written(mapped(costs.groupBy("conv").agg(per_conv), suffixes, conv=pa.string(), block=pa.int32(),
                                 behind=pa.list_(pa.int64()), cost=pa.int64(), illegal=pa.int64()), "costs-behind")

    def all_ways(conv: str, block: int, symbols: str, behind: list[int]) -> Iterator[tuple]:
        audits, exits = zip(*unrolled(symbols, tuple(x - min(behind) for x in behind)), strict=True)
        yield conv, block, list(audits), list(exits)

    both = blocks.join(ends.select("conv", "block", "behind"), ["conv", "block"]).select("conv", "block", "symbols", "behind")
    ways = common.written(mapped(both, all_ways, conv=pa.string(), block=pa.int32(), audits=pa.list_(pa.string()),
                                 exits=pa.list_(pa.int64())), "ways")

    def entries(conv: str, parts: list[dict]) -> Iterator[tuple]:
        state = START
        for p in parts:
            entry, state = state, p["exits"][state]
            yield conv, p["block"], entry, tail(state) if p is parts[-1] else ""

    entered = mapped(ways.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "exits")))), entries,
                     conv=pa.string(), block=pa.int32(), entry=pa.int32(), tail=pa.string())
    audit = F.concat(F.get("audits", F.col("entry")), F.col("tail"))
    chosen = ways.join(entered, ["conv", "block"]).select("conv", "block", "entry", audit.alias("audit"))
    return common.written(chosen, "edits"), ends.where("cost IS NOT NULL").select("conv", "cost", "illegal")


ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}


def applied(rows: DataFrame, chosen: DataFrame, by: tuple[str, ...] = ("conv", "block")) -> DataFrame:
    """The repaired rows: conv, block, place, edit, role, text, in order within each group of ``by``.

    A block's edits come as a row before its rows, so a task streams through them and holds one block's edits at a time.
    """
    marks = chosen.select("conv", "block", F.lit(-1).cast("long").alias("seq"), F.col("audit").alias("text"), F.col("entry").cast("string").alias("role"))
    both = rows.select("conv", "block", "seq", "text", "role").unionByName(marks)
    ordered = both.repartition(*by).sortWithinPartitions("conv", "block", "seq")

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, conv, block, state, place = iter(()), None, None, START, 0

        def put(letter: str, role: str, text: str) -> tuple:
            nonlocal state, place
            place += 1
            state = FILL[state] if letter != "K" else NEXT[state, role[:1]]
            return conv, block, place - 1, letter, role if letter == "K" else ROLES[state], text

        for b in batches:
            out = []
            for c, k, seq, text, role in zip(*(b[n].to_pylist() for n in ("conv", "block", "seq", "text", "role")), strict=True):
                if seq < 0:
                    out += [put("I", "", "") for _ in todo]  # insertions behind the last row of the block before
                    todo, conv, block, state, place = iter(text), c, k, int(role), 0
                    continue
                while (letter := next(todo)) == "I":
                    out.append(put("I", "", ""))
                if letter != "D":
                    out.append(put(letter, role, text))
            yield pack(out)
        yield pack([put("I", "", "") for _ in todo])

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          names=["conv", "block", "place", "edit", "role", "text"])

    return ordered.mapInArrow(edit, "conv string, block int, place long, edit string, role string, text string")


def digests(ordered: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of rows that come conversation by conversation in order; texts stream into the hash."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []
        for b in batches:
            for c, role, text in zip(*(b[n].to_pylist() for n in ("conv", "role", "text")), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv", "repaired_sha256"])
                out = []
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


class Repair:
    """Conversations (conv_id, turn, role, text) and their cheapest repair.

    A conversation's rows are taken by turn (nulls first), then role, text and place in the file. A null role or text
    counts as one space, a null conv_id as a conversation of its own. A role is judged by its first letter; an empty one
    can't be kept. Blank rows and those that repeat an earlier role and text go; other rows may be kept, given another
    role or deleted, empty rows may be inserted, and truncated rows that stay cost extra. Of equally cheap edits the
    ASCII-least audit counts. Columns besides the four are not read; an empty table gives no rows.

    Besides the audit of a conversation, which is one value by its nature, and the hash, which must read it in order, no
    group is larger than a block: ``rows`` and ``edits`` are in blocks.
    """

    def __init__(self, conversations: DataFrame):
        self.turns = in_blocks(conversations)
        self.flawed = common.written(with_faults(self.turns), "faults")
        self.edits, self.costs = edits(self.flawed)

    def rows(self) -> DataFrame:
        """The repaired rows: conv, block, place (in the block), edit (K, R or I), role, text."""
        return applied(self.turns, self.edits)

    def conversations(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        turns = self.flawed.groupBy("conv", "conv_id", "turn").agg(
            *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        counts = turns.groupBy("conv", "conv_id").agg(
            F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
        audits = self.edits.groupBy("conv").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        hashes = digests(applied(self.turns, self.edits, by=("conv",)))
        empty = hashlib.sha256().hexdigest()
        return (counts.join(self.costs, "conv").join(audits, "conv").join(hashes, "conv", "left").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))
