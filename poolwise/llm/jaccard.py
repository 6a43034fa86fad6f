"""Near duplicates by a chosen-path join on word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

WORDS, SIMILARITY = 5, 0.8
#: Sampled tokens (minima of as many hash functions) that a set is embedded by.
TOKENS = 64
#: A pair at the similarity is found with at least this probability; it fixes AGREE and the number of runs.
RECALL = 0.999999
#: Buckets up to BUCKET sets are compared by brute force: a set meets at most so many others there, some microseconds of
#: work, less than its FANOUT rows in a split cost. Larger ones are split on FANOUT sampled tokens, at most DEPTH times.
#: Children of a bucket whose sets agree on DENSE of their tokens would hold as many pairs as it does, so it isn't split;
#: pairs of blocks of BLOCK sets share it.
BUCKET, FANOUT, DEPTH, BLOCK = 1024, 4, 4, 1024
DENSE = 1 / FANOUT
MASK = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
_FACTOR, _FACTOR2 = (_rng.integers(1, 1 << 31, TOKENS, dtype=np.uint32)[:, None] * 2 + 1 for _ in range(2))
_SHIFT = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)[:, None]


def agreeing(n: int, tokens: int = TOKENS, similarity: float = SIMILARITY) -> float:
    """Probability that a pair at the similarity agrees on exactly ``n`` of its sampled tokens."""
    return math.comb(tokens, n) * similarity ** n * (1 - similarity) ** (tokens - n)


def unlike(least: int, similarity: float = SIMILARITY) -> float:
    """Probability that a pair at the similarity agrees on fewer than ``least`` of all sampled tokens."""
    return sum(agreeing(n, TOKENS, similarity) for n in range(least))


#: Pairs that agree on fewer sampled tokens are not compared exactly: at most a quarter of what RECALL allows to lose.
AGREE = max(n for n in range(TOKENS) if unlike(n) <= (1 - RECALL) / 4)


def apart(n_runs: int, similarity: float = SIMILARITY) -> float:
    """Probability that no run brings a pair at the similarity together.

    Each run's root splits on a token of its own. Later splits try FANOUT different ones of the other tokens, which all
    runs share, so the number of those that the pair agrees on is summed over; a pair parts where it shares none tried.
    """
    rest, out = TOKENS - n_runs, 0.0
    for n in range(rest + 1):
        one = similarity * (1 - math.comb(rest - n, FANOUT) / math.comb(rest, FANOUT)) ** DEPTH
        out += agreeing(n, rest, similarity) * (1 - one) ** n_runs
    return out


def runs(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Runs until the target recall, of which the pairs that AGREE leaves out take their part."""
    for n in range(1, TOKENS - FANOUT):
        if apart(n, similarity) + unlike(AGREE, similarity) <= 1 - recall:
            return n
    raise ValueError(f"{TOKENS} sampled tokens can't reach a recall of {recall}")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str) -> np.ndarray:
    """Sorted different hashes of each ``WORDS`` successive words (lower case, split at white space) of a text.

    A text with fewer words is one shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    codes = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, "u8")
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - n + 1 + k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def embedding(codes: np.ndarray) -> np.ndarray:
    """The sampled tokens of a set: for each of TOKENS hash functions the least value over the set."""
    low, out = codes.astype("u4"), np.full(TOKENS, (1 << 32) - 1, "u4")
    for start in range(0, len(low), 8192):
        x = (low[None, start:start + 8192] ^ _SHIFT) * _FACTOR
        x ^= x >> np.uint32(15)
        x *= _FACTOR2
        out = np.minimum(out, (x ^ (x >> np.uint32(13))).min(axis=1))
    return out


def embed(docs: DataFrame) -> DataFrame:
    """file, row, doc_id, key (digest of the shingle set; null without words), tokens: written."""
    rows = common.with_row_numbers(docs.select("doc_id", "text"))
    rows = rows.select("file", "row", F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tokens = [], []
            for text in b.column(3):
                codes = shingles(text.as_py())
                keys.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
                tokens.append(embedding(codes).view("i4"))
            flat = pa.array(np.concatenate(tokens) if tokens else np.empty(0, "i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.binary()), lists],
                                             names=["file", "row", "doc_id", "key", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"file long, row long, doc_id {kind}, key binary, tokens array<int>"
    return common.written(rows.mapInArrow(run, schema), "jaccard-embedded")


def leaves(sets: DataFrame, n_runs: int) -> DataFrame:
    """(slot, leaf, rows, key): the buckets at which the recursion ends, for each set in them.

    A slot is a node's place in the tree of splits; two sets share a bucket if one slot gives them the same leaf.
    """
    def sized(nodes: DataFrame) -> DataFrame:
        counts = nodes.groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1")
        return common.written(common.attach(nodes, counts, ["leaf"], "leaf", "rows", ["key"]), "jaccard-nodes")

    roots = F.array(*[F.struct(F.lit(r).alias("slot"), F.xxhash64(F.lit(r), F.col("tokens")[r]).alias("leaf"))
                      for r in range(n_runs)])
    level = sized(sets.select("key", F.explode(roots).alias("x")).select("x.slot", "x.leaf", "key"))
    done = []
    for _ in range(DEPTH):
        done.append(level.where(F.col("rows") <= BUCKET).select("slot", "leaf", "rows", "key"))
        big = level.where(F.col("rows") > BUCKET)
        if big.isEmpty():
            return _union(done)
        # Tokens at even distances from a place that the node draws are different ones.
        rest = TOKENS - n_runs
        coordinate = lambda j: n_runs + (F.pmod(F.xxhash64("leaf"), F.lit(rest)) + j * (rest // FANOUT)) % rest
        child = lambda j: F.struct((F.col("slot") * FANOUT + n_runs + j).alias("slot"), F.xxhash64(
            F.col("leaf"), F.lit(j), F.element_at("tokens", (coordinate(j) + 1).cast("int"))).alias("leaf"))
        split = big.join(sets.select("key", "tokens"), "key").select(
            "slot", F.col("leaf").alias("parent"), F.col("rows").alias("of"), "key",
            F.array(*[child(j) for j in range(FANOUT)]).alias("children"))
        split = common.written(split, "jaccard-split")
        # Squares of the shares of a node's children add up to the similarity of its average pair.
        # Sets with the same children, most of a dense bucket, are counted before they are told apart by child.
        alike = split.groupBy("parent", "of", "children").agg(F.count("*").alias("n"))
        shares = alike.select("parent", "of", F.explode("children").alias("x"), "n").groupBy(
            "parent", "of", "x.slot", "x.leaf").agg(F.sum("n").alias("n"))
        dense = shares.groupBy("parent").agg(
            (F.sum(F.pow(F.col("n") / F.col("of"), 2)) / FANOUT).alias("similar"), F.max("of").alias("rows"))
        both = common.attach(split.drop("of"), common.written(dense, "jaccard-dense"), ["parent"], "parent", "rows", ["key"])
        both = common.written(both, "jaccard-judged")
        done.append(both.where(F.col("similar") >= DENSE).select("slot", F.col("parent").alias("leaf"), "rows", "key"))
        rest = both.where(F.col("similar") < DENSE).select("key", F.explode("children").alias("x"))
        level = sized(rest.select("x.slot", "x.leaf", "key"))
    return _union([*done, level.select("slot", "leaf", "rows", "key")])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MEMBER = ("key binary, copies long, leaf long, slot int, held array<struct<slot:int,leaf:bigint>>, side int, "
          "cross boolean, task long")


def members(sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """Sets by task: a bucket up to BLOCK sets is one, a larger one is cut into blocks, and each pair of blocks is one.

    ``held`` has all leaves of a set; a pair is compared in the first slot whose leaf both share, and nowhere else.
    """
    held = buckets.groupBy("key").agg(F.collect_list(F.struct("slot", "leaf", "rows")).alias("x"))
    rows = held.join(sets.select("key", "copies", "tokens"), "key")
    place = F.transform("x", lambda s: F.struct(s["slot"].alias("slot"), s["leaf"].alias("leaf")))
    rows = rows.select("key", "copies", "tokens", place.alias("held"), F.explode("x").alias("b"))
    blocks = F.ceil(F.col("b.rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key", "b.leaf"), blocks).cast("int")
    rows = rows.select("key", "copies", "tokens", "held", "b.leaf", "b.slot", block.alias("side"), blocks.alias("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("leaf", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select("key", "copies", "leaf", "slot", "held", "side", (F.col("side") != F.col("other")).alias("cross"),
                       task.alias("task"), "tokens")


def _in_groups(batches: Iterable[pa.RecordBatch], column: str = "task") -> Iterator[dict]:
    """Successive rows with one ``column`` as columns of Python values; a group has at most about two blocks of them."""
    held: list[pa.RecordBatch] = []

    def give() -> dict:
        out = pa.Table.from_batches(held).to_pydict()
        held.clear()
        return out

    for b in batches:
        ids = b[column].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and held[0][column][0].as_py() != ids[s]:
                yield give()
            held.append(b.slice(s, e - s))
    if held:
        yield give()


def _owned(group: dict) -> np.ndarray:
    """The pairs (i, j) of a task that are compared here: i before j or on sides of a cross, no earlier leaf in common."""
    m, own = len(group["key"]), group["slot"][0]
    if group["cross"][0]:
        low, side = min(group["side"]), np.array(group["side"])
        mask = (side == low)[:, None] & (side != low)[None, :]
    else:
        mask = np.triu(np.ones((m, m), bool), 1)
    earlier: dict[int, np.ndarray] = {}
    for i, held in enumerate(group["held"]):
        for x in held:
            if x["slot"] < own:
                earlier.setdefault(x["slot"], np.arange(-1, -m - 1, -1))[i] = x["leaf"]
    for leaf in earlier.values():
        mask &= leaf[:, None] != leaf[None, :]
    return mask


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a partner of their own that agrees on at least AGREE sampled tokens."""
    schema = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("leaf", pa.int64()), ("slot", pa.int32()),
                        ("held", pa.list_(pa.struct([("slot", pa.int32()), ("leaf", pa.int64())]))),
                        ("side", pa.int32()), ("cross", pa.bool_()), ("task", pa.int64())])
    for group in _in_groups(batches):
        if len(group["key"]) < 2:
            continue
        pairs = _owned(group)
        if not pairs.any():
            continue
        tokens = np.array(group["tokens"], "i4")
        agree = np.zeros(pairs.shape, "u1")
        for column in tokens.T:
            agree += column[:, None] == column[None, :]
        pairs &= agree >= AGREE
        keep = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        if len(keep):
            table = pa.Table.from_pydict({f.name: [group[f.name][k] for k in keep] for f in schema}, schema=schema)
            yield from table.to_batches()


def _linked(similarity: float):
    """Exact comparison: for each member its links, weighted by copies, and the first member its links lead to."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches):
            m = len(group["key"])
            if m < 2:
                continue
            sets = [np.frombuffer(x, "<u8") for x in group["codes"]]
            sizes = np.array([len(x) for x in sets])
            codes, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            rows = np.repeat(np.arange(m), sizes)
            shared = counts[where] > 1
            rows, columns = rows[shared], (np.cumsum(counts > 1) - 1)[where[shared]]
            order = np.argsort(columns, kind="stable")
            rows, columns = rows[order], columns[order]
            common_codes = np.zeros((m, m), np.float64)
            for start in range(0, int((counts > 1).sum()), 4096):
                s, e = np.searchsorted(columns, [start, start + 4096])
                part = np.zeros((m, 4096), np.float32)
                part[rows[s:e], columns[s:e] - start] = 1
                common_codes += part @ part.T
            union = sizes[:, None] + sizes[None, :] - common_codes
            links = _owned(group) & (common_codes >= similarity * union - 1e-9)
            if not links.any():
                continue
            links |= links.T
            copies = np.array(group["copies"])
            root = np.arange(m)
            while True:  # least member reached over links
                least = np.minimum(root, np.where(links, root[None, :], m).min(axis=1))
                if (least == root).all():
                    break
                root = least
            keep = np.flatnonzero(links.any(axis=1))
            yield pa.RecordBatch.from_arrays([
                pa.array([group["key"][k] for k in keep], pa.binary()),
                pa.array([group["key"][root[k]] for k in keep], pa.binary()),
                pa.array((links @ copies)[keep], pa.int64())], names=["key", "root", "links"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b), by large and small stars; root is a component's least node.

    Each round moves the edges only; a node's edges meet in sums, and joins have one row per node on one side.
    """
    state = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = common.written(state, "stars"), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        state = common.written(small, "stars")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: file, row, doc_id, class_id, n_links, kept.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of ``similarity`` or more;
    n_links counts a document's partners, copies included; a class is what links connect, its id is its least doc_id,
    and its row with that doc_id (the first, if repeated) is the one kept.

    Equal sets are one set with a number of copies. Each run splits the sets on one sampled token; buckets of up to
    BUCKET sets are compared by brute force, larger ones are split again on further sampled tokens. Runs are repeated
    until the target recall. In a bucket, agreement on all sampled tokens rules out most pairs; the others are compared
    exactly, by whole shingle sets, each pair in one bucket only. No pair leaves a task: members give their number of
    links and one edge. Null texts, and texts without words, have no links; texts of fewer than five words are one
    shingle; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the sampled tokens are laid out for similarities of {SIMILARITY} or more")
    docs = common.scanned(docs)
    table = embed(docs)
    sets = table.where("key is not null").groupBy("key", "tokens").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "file", "row")).alias("first"))
    sets = common.written(sets, "jaccard-sets")
    buckets = common.written(leaves(sets, runs(recall, similarity)), "jaccard-leaves")
    dealt = members(sets, buckets)
    close = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_sketched, MEMBER)
    close = common.written(close, "jaccard-close")
    wanted = close.select("key").distinct().join(sets.select("key", "first.file", "first.row"), "key")
    texts = common.with_row_numbers(docs.select("text")).select("file", "row", F.col("doc.text").alias("text"))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [shingles(t.as_py() or "").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["key", "codes"])

    codes = common.written(texts.join(wanted, ["file", "row"]).select("key", "text").mapInArrow(
        gather, "key binary, codes binary"), "jaccard-codes")
    exact = close.join(codes, "key").repartition("task").sortWithinPartitions("task")
    linked = common.written(exact.mapInArrow(_linked(similarity), "key binary, root binary, links long"), "jaccard-links")

    roots = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    known = (sets.select("key", "copies", "first").join(links, "key", "left")
             .join(roots.withColumnRenamed("node", "key"), "key", "left"))
    known = known.withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("first").alias("stays"))
    known = known.join(least, "root").select(
        "key", F.xxhash64("key").alias("finger"), "copies", "stays",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = common.written(known, "jaccard-classes")
    with_words = table.where("key is not null").select("file", "row", "doc_id", "key", F.xxhash64("key").alias("finger"))
    placed = common.attach(with_words, known, ["finger", "key"], "finger", "copies", ["file", "row"])
    kept = common.same([F.col("file"), F.col("row")], [F.col("stays.file"), F.col("stays.row")])
    placed = placed.select("file", "row", "doc_id", F.col("stays.doc_id").alias("class_id"), "n_links", kept.alias("kept"))
    alone = table.where("key is null").select("file", "row", "doc_id", F.col("doc_id").alias("class_id"),
                                              F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return placed.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one row of each class."""
    docs = common.scanned(docs)
    dropped = classes(docs, similarity).where(~F.col("kept")).select("file", "row")
    return common.with_row_numbers(docs).join(dropped, ["file", "row"], "left_anti").select("doc.*")
