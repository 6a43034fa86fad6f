"""Toxicity: a learned lexicon found through Levenshtein automata, with scores of the hits' surroundings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

TOKEN = re.compile(r"[^\W_]+")
#: Labelled documents that the classifier is fitted on at most, those with the smallest hashes of their ids.
SAMPLE = 30_000
#: Lengths of stems; whole words of any length are terms, too, marked by END.
STEMS, END = (4, 5, 6, 7), "$"
#: Terms of at least FUZZY characters may be misspelled.
FUZZY = 5
#: Tokens to each side of a hit, and characters in which a quotation must open and close.
NEAR, QUOTE = 10, 80
OPEN_QUOTES, CLOSE_QUOTES = '"“„«»', '"”“«»'
REMEMBERED = 400_000


class LexiconAutomaton:
    """The Levenshtein-1 automata of all terms at once: a trie walked with an edit budget, determinised as it is used.

    A state is the set of (trie node, edits so far) that the characters read lead to; a missing character of the token
    is a step down the trie without reading one. Stems match as soon as their last node is reached, words at the end.
    """

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [0]
        self.stem: list[int] = [0]
        for term in terms:
            at, plain = 0, term.removesuffix(END)
            for c in plain:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(0)
                    self.stem.append(0)
                at = self.children[at][c]
            (self.word if term.endswith(END) else self.stem)[at] = len(plain)
        self.steps: dict[tuple[int, str], int] = {}
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.ends: list[int] = []
        self.start = self.number(self.closure({(0, 0)}))
        self.dead = self.number(frozenset())

    def closure(self, states: set) -> frozenset:
        out = set(states)
        for node, edits in states:
            if edits == 0 and node >= 0:
                out.update((child, 1) for child in self.children[node].values())
        # A stem reached is a match whatever follows; -1 stands for it.
        found = [e for n, e in out if n >= 0 and self.stem[n] and (e == 0 or self.stem[n] >= FUZZY)]
        return frozenset(out | {(-1, min(found))} if found else out)

    def number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            hits = [e for n, e in states if n == -1 or self.word[n] and (e == 0 or self.word[n] >= FUZZY)]
            self.ends.append(min(hits, default=-1))
        return self.numbers[states]

    def step(self, number: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[number]:
            if node == -1:
                out.add((-1, edits))
                continue
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits == 0:
                out.add((node, 1))
                out.update((child, 1) for child in self.children[node].values())
        self.steps[number, c] = target = self.number(self.closure(out))
        return target

    def distance(self, token: str) -> int:
        """0 for a term, 1 for a misspelled one, -1 otherwise."""
        at, steps = self.start, self.steps
        for c in token:
            following = steps.get((at, c))
            at = self.step(at, c) if following is None else following
            if at == self.dead:
                return -1
        return self.ends[at]


class Model:
    """Lexicon and weights. Features of a text, all logarithms of counts: plain hits, misspelled hits, hits beside
    other hits, hits in a quotation, and plain hits for each hundred words."""

    def __init__(self, terms: list[str], weights: list[float] | None = None):
        self.terms, self.weights = terms, weights
        self.digest = hashlib.sha256("\n".join(terms).encode("utf-8", "surrogatepass")).digest()

    def features(self, text: str) -> list[float]:
        automaton, known = self.automaton()
        low = text.lower()
        words = TOKEN.findall(low)
        rest = [w for w in set(words) if w not in known]
        if len(known) + len(rest) > REMEMBERED:
            known.clear()
            rest = list(set(words))
        known.update([(w, automaton.distance(w)) for w in rest])
        if max(map(known.__getitem__, words), default=-1) < 0:
            return [0.0] * 5
        plain, misspelled, beside, quoted, last = 0, 0, 0, 0, -NEAR - 1
        for k, m in enumerate(TOKEN.finditer(low)):
            kind = known[m.group()]
            if kind < 0:
                continue
            if self.in_quotes(low, m.start(), m.end()):
                quoted += 1
                continue
            plain, misspelled = plain + (kind == 0), misspelled + (kind == 1)
            beside, last = beside + (k - last <= NEAR), k
        density = 100 * plain / max(1, len(words))
        return [math.log1p(x) for x in (plain, misspelled, beside, quoted, density)]

    def automaton(self) -> tuple[LexiconAutomaton, dict[str, int]]:
        """The automaton and the words known so far: one of each in a worker, whatever the number of its tasks."""
        if self.digest not in _built:
            _built.clear()
            _built[self.digest] = LexiconAutomaton(self.terms), {}
        return _built[self.digest]

    @staticmethod
    def in_quotes(text: str, start: int, end: int) -> bool:
        """A quotation mark opens shortly before the hit and one closes it shortly after, in the same line."""
        before, after = text[max(0, start - QUOTE):start].rpartition("\n")[2], text[end:end + QUOTE].partition("\n")[0]
        opened = max(before.rfind(q) for q in OPEN_QUOTES)
        closed = min((p for q in CLOSE_QUOTES if (p := after.find(q)) >= 0), default=-1)
        # An opening mark follows a blank or nothing, so that closing marks of earlier quotations don't count.
        return opened >= 0 and closed >= 0 and (opened == 0 or not before[opened - 1].isalnum())

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text or ""), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


_built: dict[bytes, tuple[LexiconAutomaton, dict[str, int]]] = {}


def logistic(features: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None, penalty: float = 0.1) -> list[float]:
    """Weights (the first without feature) of a logistic regression with a small quadratic penalty, by Newton steps.

    A row counts ``counts`` times.
    """
    counts = np.ones(len(features)) if counts is None else counts
    x = np.column_stack([np.ones(len(features)), features])
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (counts * (labels - p)) - ridge @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a term, summed over a task's part of the bounded sample."""
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = set(TOKEN.findall(text.as_py().lower()))
            terms = {w[:n] for w in words for n in STEMS if len(w) >= n} | {w + END for w in words}
            (toxic if label == 1 else clean).update(terms)
    # A term without toxic documents can't be chosen.
    names = list(toxic)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64())],
                                     names=["term", "n"])
    names = list(clean)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([-clean[t] for t in names], pa.int64())],
                                     names=["term", "n"])


def lexicon(sample: DataFrame) -> list[str]:
    """Terms whose documents are toxic more often than chance explains, from (text, toxic).

    Evidence is the likelihood ratio G of a term's documents against the share of toxic ones; chance among all terms
    tried reaches 2 ln(terms) + 4 in few cases. Of terms that begin alike the one with the most evidence stays.
    The terms are words of the sample, so their number is bounded by it.
    """
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, n long")
    sums = counts.groupBy("term").agg(F.sum(F.greatest("n", F.lit(0))).alias("a"), F.sum(-F.least("n", F.lit(0))).alias("b"))
    labels = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n = labels.get(1, 0), sum(labels.values())
    if not 0 < n1 < n:
        return []
    p, total = n1 / n, F.col("a") + F.col("b")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (total * q))).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), F.lit(p)) + part(F.col("b"), F.lit(1 - p)))
    scored = sums.where("a >= 2").select("term", "a", "b", evidence.alias("g"))
    tried = scored.count()
    # Half of a term's documents at least are toxic, and clearly more than of all documents.
    sure = scored.where((F.col("a") >= F.greatest(F.lit(0.5), F.lit(min(0.95, 2 * p))) * (F.col("a") + F.col("b")))
                        & (F.col("g") >= 2 * math.log(max(tried, 1)) + 4))
    rows = sure.orderBy(F.desc("g"), F.desc(F.length("term")), "term").select("term").collect()
    return unlike_beginnings(r["term"] for r in rows)


def unlike_beginnings(terms: Iterable[str]) -> list[str]:
    """The terms of which none begins like an earlier one, that is, neither is the other's beginning."""
    kept, tree = [], {}
    for term in terms:
        plain, at, k = term.removesuffix(END), tree, 0
        while k < len(plain) and plain[k] in at:
            at, k = at[plain[k]], k + 1
            if not at:  # an earlier term ends here
                break
        if k == len(plain) or k and not at:
            continue
        kept.append(term)
        for c in plain[k:]:
            at[c] = at = {}
    return kept


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fifth.

    Of rows that repeat a sampled id one counts, that with the smallest hash of its text. The sampled places are at most
    ``sample`` rows, so they may be broadcast: no text is shuffled.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = common.scanned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select(
        "doc_id", "text", F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "file", "row")).alias("first")
    places = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(first)
    places = common.written(places.select("doc_id", "toxic", "first.file", "first.row"), "toxicity-sample")
    texts = rows.join(F.broadcast(places), ["doc_id", "file", "row"]).select("text", "toxic")
    model = Model(lexicon(texts))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    # Equal rows are counted, so what comes to the driver is a table of features of at most ``sample`` rows.
    found = texts.mapInArrow(measure, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n"))
    found = sorted(found.collect(), key=lambda r: (r["x"], r["toxic"]))
    x = np.array([r["x"] for r in found]).reshape(len(found), 5)
    y, n = np.array([r["toxic"] for r in found], float), np.array([r["n"] for r in found], float)
    model.weights = logistic(x, y, n) if found else [-3.0] + [0.0] * 5
    return model


def score(model: Model):
    """A column function: text -> toxicity from 0 to 1, of the whole text; null counts as empty."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")
    return of


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    A row's score depends on its text alone, so nothing is shuffled: null and empty texts get the score of a text
    without hits, repeated rows repeat, an empty table gives no rows. Without labels of both kinds no term is learned
    and all texts get one low score. Other columns are not read.
    """
    of = score(train(docs, labels, sample))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs``, all columns, without texts that score ``limit`` or more."""
    of = score(train(docs, labels, sample))
    return docs.where(of(F.col("text")) < limit)
