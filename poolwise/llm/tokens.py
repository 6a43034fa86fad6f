"""Token ids and counts as a public tokenizer gives them."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: How byte-level BPE splits text before its merges, for texts without characters of ``UNUSUAL``: there letters, digits
#: and white space mean the same to Python's ``re`` as to the tokenizer. Fixed values of the tokenizer.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\t\n\r -~ -±´-¸º»¿-ɏ]")
#: Texts without it need no look-ahead when they are split.
WIDE_GAP = re.compile(r"\s\s")
#: Characters of one text that are looked at together, and entries that a worker remembers.
WINDOW, REMEMBERED = 1 << 20, 400_000


@lru_cache(maxsize=4)
def library(path: str):
    """The public tokenizer at ``path``: tokenizers for .json, sentencepiece for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def splits_as_known(path: str) -> bool:
    """Whether the tokenizer splits as ``PRE_TOKEN`` does: byte level, no normaliser, no blank put in front."""
    import json
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    pre = parts.get("pre_tokenizer") or {}
    return (parts["model"].get("type") == "BPE" and parts.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True) and bool(ranks_of(path)))


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proved to encode alone as one token: one pre-token, and all merges lead to that token."""
    tok = library(path)
    ids = list(range(tok.get_vocab_size(with_added_tokens=False)))
    strings = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    usable = [(i, s) for i, s in zip(ids, strings) if s and PRE_TOKEN.fullmatch(s) and not UNUSUAL.search(s)]
    encoded = tok.encode_batch_fast([s for _, s in usable], add_special_tokens=False)
    return frozenset(s for (i, s), e in zip(usable, encoded) if e.ids == [i])


@lru_cache(maxsize=4)
def same_merges(path: str):
    """The vocabulary of ``path`` in tiktoken, whose merges are several times faster: (for lone white space, for any).

    Byte-level vocabularies number their tokens in the order of the merges, which is what tiktoken takes; if this one
    does not, ``splits_as_known`` is false and the library does all the work.
    """
    import tiktoken
    ranks = ranks_of(path)
    word = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    make = lambda name, split: tiktoken.Encoding(
        name, pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return make("lone", word), make("any", word.removesuffix(r"\s+") + r"\s+(?!\S)|\s+")


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes by id, empty unless the ids of merged tokens follow the order of the merges."""
    import json
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # A byte that has no printable character is written as one of the characters from U+0100 on, in ascending order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in pairs]
    if None in made or made != sorted(set(made)) or any(set(t) - byte.keys() for t in model["vocab"]):
        return {}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}


def plain(text: str, path: str) -> bool:
    return splits_as_known(path) and not UNUSUAL.search(text) and not any(s in text for s in special_strings(path))


def windows(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``WINDOW`` characters, cut before a lone blank, where pre-tokens always end."""
    start = 0
    while len(text) - start > WINDOW:
        cut = start + WINDOW
        while (cut := text.find(" ", cut)) > 0 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].isspace()):
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class Counts:
    """Tokens of a pre-token: the proved whole tokens count 1, the rest is merged once and remembered for a while."""

    def __init__(self, path: str):
        self.path, self.whole = path, dict.fromkeys(whole_tokens(path), 1)
        self.known = dict(self.whole)

    def of(self, text: str) -> int:
        if not plain(text, self.path):
            return count_by_library([text], self.path)[0]
        total = 0
        for part in windows(text):
            found = PRE_TOKEN.findall(part)
            rest = [x for x in set(found) if x not in self.known]
            if rest and len(self.known) + len(rest) > REMEMBERED:
                self.known = dict(self.whole)
                rest = [x for x in set(found) if x not in self.known]
            merge = same_merges(self.path)[1].encode_ordinary
            self.known.update([(x, len(merge(x))) for x in rest])
            total += sum(map(self.known.__getitem__, found))
        return total


def count_by_library(texts: list[str], path: str) -> list[int]:
    if path.endswith(".model"):
        return [len(x) for x in library(path).encode(texts, num_threads=1)] if texts else []
    return [len(e.ids) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counts(path: str) -> Counts:
    return Counts(path)


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path = path

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in library(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, text: str) -> bytes:
        if not plain(text, self.path):
            return self.raw([text])[0]
        lone, any_gap = same_merges(self.path)
        out = []
        for part in windows(text):
            found = (any_gap if WIDE_GAP.search(part) else lone).encode_ordinary(part)
            out.append(array("I", found).tobytes())
        return b"".join(out)


@lru_cache(maxsize=4)
def ids(path: str) -> Ids:
    return Ids(path)


def count_tokens(docs: DataFrame, path: str = BYTE_BPE, limit: int = 512) -> DataFrame:
    """Tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    Whole-token shortcut: pre-tokens that the vocabulary is proved to hold as one token are counted without merging;
    only the others are merged. Texts with unusual characters or special strings are left to the library as a whole, and
    so are tokenizers that split otherwise. A row's result depends on its text alone, so nothing is shuffled: null and
    empty texts have 0 tokens, repeated rows repeat, an empty table gives no rows, other columns are not read.
    """
    slim = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortcut = not path.endswith(".model")
        for b in batches:
            texts = b.column(2)
            n = [counts(path).of(t.as_py()) if shortcut else count_by_library([t.as_py()], path)[0] for t in texts]
            n = pa.array(n, pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, over],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
