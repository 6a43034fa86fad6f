"""Exact dedup, near duplicates, mixing, shards: against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.llm import common, exact_dedup, jaccard, mixing, sharding
from tests.llm.conftest import rows_of


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_exact(rows, texts):
    groups = defaultdict(list)
    for d, t in texts:
        groups[lower(t)].append(d)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    kept = [r for r in rows if r["kept"]]
    assert Counter(r["text_sha256"] for r in kept) == Counter({w[3]: 1 for w in want})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup(spark, sf_dir, real, odd, odd_rows, none):
    check_exact(rows_of(exact_dedup.duplicates(common.documents(spark, sf_dir))), real)
    check_exact(rows_of(exact_dedup.duplicates(odd)), [r[:2] for r in odd_rows])
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len({lower(r[1]) for r in odd_rows})
    assert exact_dedup.duplicates(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_chunks_make_up_the_text_and_meet_again_after_an_edit(spark, odd):
    texts = odd.select(exact_dedup.normal(F.col("text")).alias("t"))
    assert texts.where(F.array_join(exact_dedup.chunks(F.col("t")), "") != F.col("t")).count() == 0
    long = " ".join(f"word{i * 31 % 997}." if i % 9 == 0 else f"w{i}" for i in range(4000))
    a, b = (set(r[0]) for r in spark.createDataFrame([(long,), ("An edit. " + long,)], "t string").select(
        exact_dedup.chunks(F.col("t"))).collect())
    assert len(a & b) > 0.8 * len(a)


def test_different_chunks_with_one_identifier_are_found(odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.length(chunk) % 2)
    with pytest.raises(ValueError):
        exact_dedup.verified(odd)


def shingle_set(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute_classes(texts, similarity=0.8):
    sets, n = [shingle_set(t) for _, t in texts], len(texts)
    where, links, root = defaultdict(list), [0] * n, list(range(n))
    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    for j, s in enumerate(sets):
        shared = Counter(i for g in s for i in where[g])
        for i, k in shared.items():
            if k >= similarity * (len(sets[i]) + len(s) - k) - 1e-9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
        for g in s:
            where[g].append(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(texts)], len({find(i) for i in range(n)})


@pytest.mark.parametrize("bucket", [256, 3])
def test_near_duplicates(spark, sf_dir, real, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BLOCK", bucket)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)  # 3: buckets are split, and dense ones cut into blocks
    rows = rows_of(jaccard.classes(common.documents(spark, sf_dir)))
    want, n = brute_classes(real)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == sorted(want)
    assert sum(r["kept"] for r in rows) == n


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    rows = [r for r in rows_of(jaccard.classes(odd))]
    texts = [(d, t) for d, t, *_ in odd_rows]
    want, n = brute_classes([x for x in texts if x[0] is not None])
    got = [(r["doc_id"], r["class_id"]) for r in rows if r["doc_id"] is not None and not (r["class_id"] is None)]
    assert sum(r["kept"] for r in rows) == brute_classes(texts)[1]
    assert len(rows) == len(texts) and len(got) <= len(want)
    links = Counter((r["doc_id"], r["n_links"]) for r in rows)
    assert links == Counter((d, k) for d, _, k in brute_classes(texts)[0])
    left = jaccard.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == brute_classes(texts)[1]
    assert jaccard.classes(none).count() == 0


def test_a_large_group_of_near_copies_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 200)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    texts = []
    for k in range(700):
        words = list(base)
        for at in rng.integers(0, 120, 1 + k % 4):
            words[at] = f"edit{rng.integers(0, 50)}"
        texts.append((k, " ".join(words)))
    texts += [(1000 + k, " ".join(f"u{k}x{j}" for j in range(40)) + " " + " ".join(base[:30])) for k in range(400)]
    rows = rows_of(jaccard.classes(spark.createDataFrame(texts, "doc_id long, text string")))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == sorted(brute_classes(texts)[0])


def test_buckets_are_split_at_the_production_values(spark):
    """A passage in all texts, about a fifth of each pair's shingles, fills buckets beyond BUCKET; its copies are found."""
    assert (jaccard.BUCKET, jaccard.BLOCK) == (1024, 1024)
    passage = " ".join(f"p{j}" for j in range(25))
    texts = [(k, passage + "".join(f" u{k}x{j}" for j in range(39))) for k in range(3600)]
    for k in range(200):  # one word changed, at the end or in the middle: similarities of 59/61 and 55/65
        words = texts[k * 17][1].split()
        words[-1 if k % 2 else 45] = f"edit{k}"
        texts.append((10_000 + k, " ".join(words)))
    df = common.written(spark.createDataFrame(texts, "doc_id long, text string"), "texts")
    sets = common.written(jaccard.embed(df).select("key", "tokens"), "sets")
    leaves = jaccard.leaves(sets, jaccard.runs())
    assert leaves.where(f"slot >= {jaccard.runs()}").count() > 1000  # below the roots
    want = {k: (k, 0) for k in range(3600)} | {k * 17: (k * 17, 1) for k in range(200)}
    want |= {10_000 + k: (k * 17, 1) for k in range(200)}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(jaccard.classes(df))} == want


def test_losses_of_the_join_stay_within_the_recall():
    assert jaccard.apart(jaccard.runs()) + jaccard.unlike(jaccard.AGREE) <= 1 - jaccard.RECALL
    assert jaccard.runs(0.99) < jaccard.runs() < jaccard.runs(0.9999999)
    rng = np.random.default_rng(11)
    agree = []
    for _ in range(3000):  # 80 of 100 codes in common
        codes = rng.integers(0, 1 << 63, 100, dtype="u8")
        agree.append(int((jaccard.embedding(codes[:90]) == jaccard.embedding(codes[10:])).sum()))
    for least in (46, 49, 52):
        assert np.mean(np.array(agree) < least) == pytest.approx(jaccard.unlike(least), abs=0.03)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}


def test_targets(spark):
    rows = [("b", 100), ("a", 10), (None, 1000), ("c", 0), ("Z", 500)]
    got = {r["source"]: r for r in rows_of(mixing.targets(spark.createDataFrame(rows, "source string, source_size long")))}
    total = 1.5 * 1610
    weights = {"Z": 5, "a": 2, "b": 1, "c": 5, None: 2}
    left, open_ = total, dict(weights)
    want = {}
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * dict(rows)[s]]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * dict(rows)[s]
            left -= want[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    assert {s: pytest.approx(t) for s, t in want.items()} == {s: r["target"] for s, r in got.items()}
    assert sum(r["target"] for r in got.values()) == pytest.approx(total)


def test_mixing_odd_rows(odd, odd_rows, none):
    rows = rows_of(mixing.rated(odd))
    assert len(rows) == len(odd_rows) and all(0 <= r["copies"] <= 2 for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.rated(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"),
                                      F.repeat(F.lit("w "), (1 + F.col("id") % 50).cast("int")).alias("text"))
    for r in rows_of(mixing.rated(docs).groupBy("doc.source").agg(
            F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))):
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)


def check_shards(rows, texts, shards=16):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts), key=str)
    slots, homes, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(shards))
    return max(sizes.values()), sum(sizes.values()) / shards


def test_shards(spark, sf_dir, real, odd, odd_rows, none, monkeypatch):
    most, mean = check_shards(rows_of(sharding.shard(common.documents(spark, sf_dir))), real)
    assert most <= 1.05 * mean
    monkeypatch.setattr(sharding, "BUNDLES", 8)
    monkeypatch.setattr(sharding, "PER_TASK", 50)
    most, mean = check_shards(rows_of(sharding.shard(common.documents(spark, sf_dir))), real)
    assert most <= 1.2 * mean
    check_shards(rows_of(sharding.shard(odd)), [r[:2] for r in odd_rows])
    assert sharding.shard(none).count() == 0


def test_tightest_bin_of_the_tree_is_that_of_a_list():
    rng, rooms, plain = np.random.default_rng(2), sharding.Rooms(leaf=4), []
    for k in range(3000):
        if rng.random() < 0.55:
            entry = (int(rng.integers(1, 200)), k)
            rooms.add(*entry)
            plain.append(entry)
        else:
            size = int(rng.integers(1, 220))
            want = min((e for e in plain if e[0] >= size), default=None)
            assert rooms.tightest(size) == want
            if want:
                plain.remove(want)


def test_hot_keys_join_whole(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = common.attach(rows, groups, ["k"], "k", "n", ["id"])
    assert got.count() == 5000 and got.where("k = 7 and most != 4998").count() == 0
