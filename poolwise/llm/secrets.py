"""Secrets: fixed formats, and further candidates scored by automata inferred from the credentials found."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

#: Formats of the fixed kinds, in the order in which spans with one start are listed (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Runs are maximal, so a run of the least length is the same as a run that is measured afterwards.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "grammar")
#: What may be a credential of another kind: a run of credential characters, as long as the shortest labelled ones, with a
#: digit and a letter (runs of letters alone are words: they are as likely as credentials by their classes).
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Characters of a credential that have states of their own; those behind them share one state.
DEPTH = 64
#: Labelled credentials per kind that an automaton is inferred from, significance of its merges, and the share of
#: labelled credentials whose likelihood may lie below the threshold.
SAMPLE, ALPHA, MISSED = 400, 0.05, 0.02

#: Symbols of the automata: classes of characters that formats treat alike.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
CLASS_OF = {c: k for k, cs in enumerate(CLASSES) for c in cs}
WIDTH = [math.log(len(cs)) for cs in CLASSES]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the fixed kinds, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    return sorted(out)


def candidate_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of the candidates that are no part of a span of ``taken``; they may hold one as a part."""
    ends = sorted((s, e) for s, _, e, _ in taken)
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if run.isalpha() or not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            continue
        if not any(s <= m.start() and m.end() <= e for s, e in ends):
            out.append((m.start(), m.end(), run))
    return out


TAIL = 1


def classes(text: str) -> Counter:
    """How often each symbol occurs."""
    out: Counter = Counter()
    for c, n in Counter(text).items():
        out[CLASS_OF[c]] += n
    return out


class Automaton:
    """A probabilistic automaton over CLASSES, merged from the prefix tree of examples (ALERGIA).

    A state is [arrivals, ends, {symbol: [uses, next state]}]. State 1 is where examples are behind their first DEPTH
    characters: it leads to itself, so states are bounded whatever the length of the examples.
    """

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.states = [[0, 0, {}], [0, 0, {}]]
        for word in examples:
            at = 0
            self.states[0][0] += 1
            for c in word[:DEPTH]:
                at = self._step(at, CLASS_OF[c], None)
            if len(word) > DEPTH:
                at = self._step(at, CLASS_OF[word[DEPTH]], TAIL)
                for symbol, n in classes(word[DEPTH + 1:]).items():
                    self._step(TAIL, symbol, TAIL, n)
            self.states[at][1] += 1
        self.factor = math.sqrt(0.5 * math.log(2 / alpha))
        self.infer()

    def _step(self, at: int, symbol: int, to: int | None, times: int = 1) -> int:
        step = self.states[at][2].setdefault(symbol, [0, len(self.states) if to is None else to])
        if step[1] == len(self.states):
            self.states.append([0, 0, {}])
        step[0] += times
        self.states[step[1]][0] += times
        return step[1]

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound: the two observed shares can't come from one probability."""
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            pair = stack.pop()
            if TAIL in pair:
                continue
            x, y = (self.states[s] for s in pair)
            if self.differ(x[1], x[0], y[1], y[0]):
                return False
            for symbol in x[2].keys() | y[2].keys():
                p, q = x[2].get(symbol, (0, None)), y[2].get(symbol, (0, None))
                if self.differ(p[0], x[0], q[0], y[0]):
                    return False
                if p[1] is not None and q[1] is not None:
                    stack.append((p[1], q[1]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the counts of the tree below ``tree`` to the states reached alike from ``into``."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            if TAIL in (a, b):
                continue
            x, y = self.states[a], self.states[b]
            x[0] += y[0]
            x[1] += y[1]
            for symbol, (uses, target) in y[2].items():
                if symbol in x[2]:
                    x[2][symbol][0] += uses
                    stack.append((x[2][symbol][1], target))
                else:
                    x[2][symbol] = [uses, target]

    def infer(self) -> None:
        """Red states are settled; each state that one leads to merges with a compatible red one or turns red."""
        red = [0, TAIL]
        while True:
            fringe = [(s, symbol) for s in red for symbol, (_, t) in sorted(self.states[s][2].items()) if t not in red]
            if not fringe:
                return
            source, symbol = max(fringe, key=lambda x: self.states[x[0]][2][x[1]][0])
            blue = self.states[source][2][symbol][1]
            partner = next((r for r in red if self.compatible(r, blue)), None)
            if partner is None:
                red.append(blue)
            else:
                self.states[source][2][symbol][1] = partner
                self.fold(partner, blue)

    def likelihood(self, word: str) -> float:
        """Mean log probability of a character, the end included; unseen steps cost as half an observation."""
        at, total = 0, 0.0
        for k, c in enumerate(word):
            arrivals, _, steps = self.states[at]
            if at == TAIL:  # which leads to itself only: the rest in any order
                for symbol, n in classes(word[k:]).items():
                    total += n * (math.log(steps.get(symbol, (0.5, None))[0] / (arrivals + 1)) - WIDTH[symbol])
                break
            symbol = CLASS_OF[c]
            uses, target = steps.get(symbol, (0.5, None))
            total += math.log(uses / (arrivals + 1)) - WIDTH[symbol]
            if target is None:
                return (total + (len(word) - k) * math.log(0.5 / (self.states[0][0] + 1))) / (len(word) + 1)
            at = target
        return (total + math.log(max(self.states[at][1], 0.5) / (self.states[at][0] + 1))) / (len(word) + 1)


class Grammar:
    """An automaton and a threshold for each kind that has examples."""

    def __init__(self, examples: dict[int, list[str]]):
        self.formats = []
        for _, words in sorted(examples.items()):
            automaton = Automaton(words)
            scores = sorted(automaton.likelihood(w) for w in words)
            self.formats.append((automaton, scores[int(MISSED * len(scores))]))

    def margin(self, word: str) -> float:
        """How far the likelihood under the best format lies above its threshold; negative: no credential."""
        return max((a.likelihood(word) - limit for a, limit in self.formats), default=-math.inf)


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of each whole text: one pass over the texts, a small written table."""
    slim = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, other = [], []
            for text in b.column(1):
                text = text.as_py()
                found = base_spans(text)
                base.append([dict(zip(("start", "kind", "end", "value"), x)) for x in found])
                other.append([{"start": s, "kind": 3, "end": e, "value": v} for s, e, v in candidate_spans(text, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(other, span)],
                                             names=["doc_id", "base", "other"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.written(slim.mapInArrow(find, f"doc_id {kind}, base {SPAN}, other {SPAN}"), "secret-spans")


def infer(spans: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Automata from at most ``sample`` different credentials of each kind, those with the smallest hashes."""
    labelled = spans.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()
    examples: dict[int, list[str]] = {}
    for kind in range(3):
        rows = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if rows:
            examples[kind] = [r["value"] for r in rows]
    return Grammar(examples)


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, found (array of kind, start, end, value; the base spans first of all), n_assign, n_access, n_hex,
    base_sha256, spans.

    Credentials of the fixed formats label the examples; their automata score every other candidate of every text, and
    those at least as likely as all but ``MISSED`` of the examples are added as kind `grammar`. Offsets count code
    points, ends are exclusive. Null and empty texts have no spans, repeated rows repeat, an empty table gives no rows
    (and no automaton); other columns are not read.
    """
    table = scan(docs)
    grammar = infer(table, sample)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, other in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                more = [s for s in other if grammar.margin(s["value"]) >= 0]
                every = sorted(base + more, key=lambda s: (s["start"], s["kind"]))
                count = Counter(s["kind"] for s in base)
                text = [",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in x) for x in (base, every)]
                rows.append((every, count[0], count[1], count[2], hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
            kinds = (b.schema.field(1).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[
                    "doc_id", "found", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(judge, f"doc_id {kind}, found {SPAN}, n_assign long, n_access long, n_hex long, "
                                   "base_sha256 string, spans string")
