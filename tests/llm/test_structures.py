"""Conversation repair, spelling variants and repeated passages against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from poolwise.llm import conversations, queries, spelling, substrings
from tests.llm.conftest import rows_of

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def repaired(rows):
    """(cost, audit, text, faults) going forward through all edits; of outputs that end in one role the best stays."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    ways = {"": (0, "", ())}

    def put(ways, way, role, text, edit, price):
        out = (*way[2], (role, text))
        if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in out)):
            new = (way[0] + price, way[1] + edit, out)
            ways[role[0]] = min(new, ways.get(role[0], new))

    def inserted(ways):
        for _ in range(3):
            for way in list(ways.values()):
                for role in ("user", "assistant"):
                    put(ways, way, role, "", "I", 5)

    for (role, text), fault in zip(rows, faults, strict=True):
        inserted(ways)
        after = {end: (cost + 2, audit + "D", out) for end, (cost, audit, out) in ways.items()}
        if fault in (None, "truncated"):
            for way in ways.values():
                for new, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    put(after, way, new, text, edit, price + 5 * (fault == "truncated"))
        ways = after
    inserted(ways)
    cost, audit, out = min(ways[end] for end in ("", "a") if end in ways)
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out), Counter(f for f in faults if f)


def expected(rows):
    """The result of ``Repair.conversations`` for rows (conv_id, turn, role, text), by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        cost, audit, text, faults = repaired([r[2:] for r in own])
        turns = [t for known, t, _, _ in own if known]
        roles = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    draw = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(draw.randrange(1, 7)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, draw.choice([turn, turn, turn + 1, None]), role, draw.choice(["Yes.", "No", " \n", None, "", "Long text!", f"t{turn}? "])))
    rows += [(None, None, "user", "Why?"), (None, 3, "assistant", "So."), (7, 10 ** 12, "user", "É…")] + [rows[0]] * 3
    return rows


def test_repair_matches_all_edits(spark, turns):
    got = conversations.Repair(spark.createDataFrame([(*r, 1, 2, 3) for r in turns], SCHEMA + ", block int, seq int, cost int")).conversations().collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected(turns)


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    """One conversation holds nearly all rows; its blocks are worked on apart."""
    monkeypatch.setattr(conversations, "BLOCK", 5)
    draw = random.Random(3)
    rows = [(1, t, draw.choice(["user", "assistant", "user", "system"]), draw.choice(["a.", "b!", "c", f"d{t}.", f"e{t}"])) for t in range(90)]
    rows += [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    repair = conversations.Repair(spark.createDataFrame(rows, SCHEMA))
    assert repair.edits.where("conv = '=1'").count() > 5
    assert {r[0]: tuple(r[1:]) for r in repair.conversations().collect()} == expected(rows)
    kept = [f"{r['role']}:{r['text']}" for r in sorted(repair.rows().where("conv = '=1'").collect(), key=lambda r: (r["block"], r["place"]))]
    assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == expected(rows)[1][-1]


def test_long_runs_go_by_powers():
    for symbols in ("u" * 1000, "u" * 77 + "a" * 130 + "1" * 50 + "U" * 33, "sua" * 5):
        behind = conversations.finish()
        for symbol in reversed(symbols):
            behind = conversations.after(conversations.power(symbol, 0), behind)
        assert conversations.after(conversations.matrix(symbols), conversations.finish()) == behind


def test_no_conversation(spark):
    assert conversations.Repair(spark.createDataFrame([], SCHEMA)).conversations().count() == 0


def test_conversations_without_rows_after_damage(spark, sf_dir):
    rows = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert set(rows) == {r[0] for r in table.select("conv_id").distinct().collect()}
    damaged = [tuple(r) for r in queries.damaged(table).collect()]
    want = expected(damaged)
    zero = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert {c: tuple(r[1:]) for c, r in rows.items()} == {c: want.get(c, zero) for c in rows}


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    cut = lambda w, i: w[:i] + w[i + 1:]
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(cut(b, i) == a for i in range(len(b)))


def spelled(words):
    form, out = {}, {}
    for word, n in words.items():
        others = [w for w in words if near(word, w)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best is not None and words[best] >= 10 * n else None
        out[word] = len(others)
    rows = set()
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows.add((word, form[word], root, n, out[word], words.get(form[word])))
    return rows


@pytest.mark.parametrize("cell", [8192, 7])
def test_variants_match_brute_force(spark, monkeypatch, cell):
    """Also where a bucket is cut into many cells, and with words that repeat a letter."""
    monkeypatch.setattr(spelling, "CELL", cell)
    draw = random.Random(cell)
    words = {"": 3, "a": 1, "aa": 50, "x" * 3000: 4, "x" * 3001: 400, "éa": 7, "éé": 70}
    for _ in range(300):
        word = "".join(draw.choice("abé") for _ in range(draw.randrange(2, 9)))
        words[word] = draw.choice([1, 2, 10, 30, 400, 5000])
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [(None, 5, "x", 1), ("zzz", None, "x", 1)],
                                 "word string, n long, form string, root int")
    got = spelling.variants(rows)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()} == spelled(words)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_odd_texts(odd, none):
    assert queries.spelled_words(none).count() == 0
    found = {r["word"]: r["n"] for r in queries.spelled_words(odd).collect()}
    assert found["epsilon"] > 2 and all(n >= 2 and len(w) >= 7 and w == re.sub("[A-Z]", "", w) for w, n in found.items())


# ---------------------------------------------------------------- repeated passages

def without_repeats(rows, window):
    """(doc_id, n_words, n_removed, hash) of rows (doc_id, text)."""
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            if k is not None:
                key = tuple(w[i:i + window])
                first[key] = min(k, first.get(key, k))
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and first[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("window", [1, 5, 20, 50])
def test_repeats_match_brute_force(odd, odd_rows, window):
    got = substrings.remove_repeats(odd, window)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == without_repeats([r[:2] for r in odd_rows], window)


def test_passages_shared_by_many(spark):
    """A passage in most documents, with other neighbours each time; near copies; few different words."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(4000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(400)]
    rows = []
    for k in range(120):
        text = [word() for _ in range(draw.randrange(90))]
        if k % 3:
            text[len(text) // 2:len(text) // 2] = passage[k % 7:]
        if k % 5 == 0:
            text = [w if draw.random() > .01 else "other" for w in base]
        if k % 11 == 0:
            text = [draw.choice("ab") for _ in range(300)]
        rows.append((draw.randrange(100), " ".join(text)))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == without_repeats(rows, 50)


def test_repetitive_texts_share_spans(spark):
    """Texts of different lengths, so no window of a common run of one word has to be looked at by itself."""
    rows = [(k, "a " * (60 + k)) for k in range(30)] + [(40, "a " * 49), (41, "a " * 50), (42, None)]
    found = substrings.spans(substrings.common.scanned(spark.createDataFrame(rows, "doc_id long, text string")), 50).collect()
    assert len({(r["anchor"], r["span"]) for r in found}) == 1 and {r["size"] for r in found} == {1}
    assert Counter(r["doc_id"] for r in found) == Counter({k: 11 + k for k in range(30)} | {41: 1})


def test_words_hash_alike_wherever_they_are():
    draw = random.Random(3)
    words = [bytes(draw.choice(b"ab\0\x85\xa0\xff") for _ in range(n)) for n in [*range(1, 20), 63, 64, 65, 66, 200] for _ in range(20)]
    words += [b"x" * n for n in range(1, 130)] + [b"\0" * n for n in range(1, 130)]
    texts = [b"", b" \t", *(b" \n\v"[:draw.randrange(3)] + draw.choice([b" ", b"\f", b"\r", b"\t "]).join(draw.sample(words, draw.randrange(9)))
                            for _ in range(3000)), b"x"]
    hashes, edges = substrings.hashed_words(texts)
    split = [t.split() for t in texts]
    assert np.diff(edges).tolist() == [len(w) for w in split] and edges[0] == 0
    pairs = set(zip([w for x in split for w in x], hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) > 500


def test_spans_do_not_depend_on_other_texts():
    draw = random.Random(4)
    texts = [b" ".join(b"w%d" % draw.randrange(40) for _ in range(draw.randrange(200))) for _ in range(60)]
    text, *columns = substrings.Rolling().anchors(texts, 20)
    together = list(zip(text.tolist(), *(c.tolist() for c in columns), strict=True))
    alone = [(k, *r) for k, t in enumerate(texts) for r in zip(*(c.tolist() for c in substrings.Rolling().anchors([t], 20)[1:]), strict=True)]
    assert together == alone
    first, size = columns[:2]
    of, start = np.repeat(text, size), np.repeat(first, size) + substrings.steps(size)
    anchor, hashed = substrings.Rolling().windows(texts, of, start, 20)
    assert anchor.tolist() == np.repeat(columns[2], size).tolist()
    content = [tuple(texts[t].split()[i:i + 20]) for t, i in zip(of.tolist(), start.tolist(), strict=True)]
    assert len(set(zip(content, hashed.tolist(), strict=True))) == len(set(content)) == len(set(hashed.tolist()))
    parts = list(substrings.portions(iter([b"a" * substrings.PORTION, b"b", b"", b"c" * substrings.PORTION, b"d"])))
    assert [(begin, len(part)) for begin, part in parts] == [(0, 1), (1, 3), (4, 1)]


def test_hashing_costs_little_more_than_splitting():
    """It took twelve times as long as splitting when each text was hashed by itself, now less than twice."""
    draw = random.Random(5)
    texts = [" ".join(f"{draw.randrange(10 ** 7)}" for _ in range(500)).encode() for _ in range(600)]
    rolling, times = substrings.Rolling(), ([], [])
    both = lambda: [t.split() for t in texts], lambda: [rolling.anchors(x, 50) for _, x in substrings.portions(texts)]
    for _ in range(3):
        for took, work in zip(times, both, strict=True):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
    assert min(times[1]) < 5 * min(times[0])


def test_kept_texts(spark, odd, none):
    assert substrings.remove_repeats(none).count() == 0
    docs = substrings.common.scanned(odd)
    found = substrings.remove_repeats(docs, 5)
    texts = rows_of(substrings.texts(docs, found))
    hashes = Counter(hashlib.sha256(r["kept"].encode()).hexdigest() for r in texts)
    assert hashes == Counter(r["kept_sha256"] for r in found.collect())
    assert texts[0]["doc"].asDict().keys() == set(docs.columns)
