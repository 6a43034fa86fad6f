"""Token counts, ids in directly addressable codes, packing: against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

from poolwise.llm import common, dac, packing, tokens
from tests.llm.conftest import rows_of


def library_ids(text):
    return tokens.library(tokens.BYTE_BPE).encode(text or "", add_special_tokens=False).ids


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_and_counts_are_those_of_the_library_for_all_sorts_of_texts():
    pieces = ["a", " ", "\n", "'s", "é", "1", "_", "!", "²", "  ", "\t", "<|endoftext|>", "中", "'", "hello", " the", "\r",
              "\x1c", "\xa0", "\x85", "ß", "%%%", "don't", "x1y2"]
    pick = random.Random(3)
    texts = ["".join(pick.choice(pieces[:pick.choice((9, 14, 24))]) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    want = tokens.Ids(tokens.BYTE_BPE).raw(texts)
    for window in (1 << 20, 7):
        before, tokens.WINDOW = tokens.WINDOW, window
        try:
            assert [tokens.ids(tokens.BYTE_BPE).of(t) for t in texts] == want
            assert [tokens.counts(tokens.BYTE_BPE).of(t) for t in texts] == [len(w) // 4 for w in want]
        finally:
            tokens.WINDOW = before


def test_memory_of_pre_tokens_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", len(tokens.whole_tokens(tokens.BYTE_BPE)) + 5)
    counts = tokens.Counts(tokens.BYTE_BPE)
    for k in range(50):
        text = f"qwxz{k}qq zzyx{k} vvrrt plain words"
        assert counts.of(text) == len(library_ids(text))
        assert len(counts.known) < len(counts.whole) + 30


def test_whole_tokens_are_proved():
    whole = tokens.whole_tokens(tokens.BYTE_BPE)
    assert " the" in whole and len(whole) > 40_000
    sample = sorted(whole)[::997]
    assert all(len(library_ids(t)) == 1 for t in sample)


def test_count_tokens(spark, sf_dir, real, odd, odd_rows, none):
    for docs, rows in ((common.documents(spark, sf_dir), real), (odd, [r[:2] for r in odd_rows])):
        got = sorted(map(str, rows_of(tokens.count_tokens(docs))))
        n = [len(library_ids(t)) for _, t in rows]
        assert got == sorted(str({"doc_id": d, "n_bytes": len((t or "").encode()), "n_tokens": k, "over_limit": k > 512})
                             for (d, t), k in zip(rows, n))
    assert tokens.count_tokens(none).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_are_left_to_their_library(odd, odd_rows, name):
    path = tokens.public_tokenizers.path(name)
    got = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in rows_of(tokens.count_tokens(odd, path))}
    lib = tokens.library(path)
    for d, t, *_ in odd_rows:
        ids = lib.encode(t or "") if name.endswith("model") else lib.encode(t or "", add_special_tokens=False).ids
        assert got[d, len((t or "").encode())] == len(ids)


@pytest.mark.parametrize("ids", [[], [0], [255, 256], list(range(70_000, 0, -7)), [5] * 512, [300] * 513, [2 ** 32 - 1, 0, 2 ** 24]])
def test_codes_give_any_range_back(ids):
    held, pick = dac.Segment(dac.pack(np.array(ids, "<u4"))), random.Random(len(ids))
    assert len(held) == len(ids) and held.read(0, len(ids)).tolist() == ids
    for _ in range(100 if ids else 0):
        s, e = sorted((pick.randint(0, len(ids)), pick.randint(0, len(ids))))
        assert held.read(s, e).tolist() == ids[s:e]


def test_segments_must_be_segments():
    with pytest.raises(ValueError):
        dac.Segment(b"PAR1" + bytes(20))


def test_written_ids_are_read_back(spark, sf_dir, real, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT", 5000)
    want, start = [], 0
    for d, t in sorted(real, key=lambda r: r[0]):
        ids = [*library_ids(t), 0]
        want.append({"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": checksum(ids)})
        start += len(ids)
    segments = dac.write_ids(common.documents(spark, sf_dir))
    assert segments.count() > 5
    assert sorted(rows_of(dac.read_ids(segments, with_ids=False)), key=lambda r: r["doc_id"]) == want
    back = rows_of(dac.read_ids(dac.write_ids(odd)))
    assert all(checksum(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in back)
    lengths = [(r["doc_id"], r["n_tokens"]) for r in sorted(back, key=lambda r: r["start"])]
    assert sorted(lengths, key=str) == sorted(((d, len(library_ids(t)) + 1) for d, t, *_ in odd_rows), key=str)
    assert [d for d, _ in lengths] == sorted((d for d, _ in lengths), key=lambda d: (d is not None, d or 0))
    ends = [r["start"] + r["n_tokens"] for r in sorted(back, key=lambda r: r["start"])]
    assert [0, *ends[:-1]] == sorted(r["start"] for r in back)
    assert dac.read_ids(dac.write_ids(none)).count() == 0


def check_packing(rows, texts, capacity):
    want = []
    for d, t in texts:
        ids = [*library_ids(t), 2]
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        want += [(d, k, s, e - s, checksum(ids[s:e])) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, sf_dir, real, odd, odd_rows, none, monkeypatch):
    used, least = check_packing(rows_of(packing.pack(common.documents(spark, sf_dir))), real, 1024)
    assert used <= least + 3
    monkeypatch.setattr(packing, "CELL", 40)  # many cells, islands and a second round
    used, least = check_packing(rows_of(packing.pack(common.documents(spark, sf_dir))), real, 1024)
    assert used <= 1.05 * least + 2
    check_packing(rows_of(packing.pack(odd, capacity=64)), [r[:2] for r in odd_rows], 64)
    assert packing.pack(none).count() == 0


def test_evolution_keeps_packings_valid_and_does_not_get_worse():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(200, 520, 300))[::-1].astype("i8")
    island = packing.Island(sizes, 1000, 7)
    people = island.first()
    best = island.fitness(people[0])
    for _ in range(3):
        people = island.evolve(people)
        for p in people:
            assert len(p) == 300 and np.bincount(p, weights=sizes).max() <= 1000 and np.bincount(p).min() > 0
        assert island.fitness(people[0]) >= best
        best = island.fitness(people[0])
