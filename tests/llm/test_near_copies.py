import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tomeflow.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def brute_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_bits(text):
    """SimHash of the different words, bit by bit."""
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set((text or "").lower().split())]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def brute_kept(rows, max_bits):
    """The smallest id of each component, by trying all pairs."""
    found = [brute_set(t) for _, t in rows]
    bits = [brute_bits(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if (bits[i] ^ bits[j]).bit_count() <= max_bits and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def texts_of(rng, n):
    """Chains and stars of near copies, all with one common line; similarities on both sides of 0.8."""
    line = "this very common line stands in every single document of the whole table"
    base = [[f"w{b}x{i}" for i in range(rng.randrange(5, 120))] for b in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(40)}"
        out.append((i, " ".join(w) + " " + line))
        if rng.random() < 0.3:
            base.append(w)
    return out + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  two"), (n + 4, "one"), (n + 5, out[0][1])]


@pytest.mark.parametrize("seed, max_bits, bucket_rows", [(1, 8, 2048), (2, 8, 4), (3, 12, 20)])
def test_equals_all_pairs(spark, seed, max_bits, bucket_rows):
    """Small buckets force the least and greatest nodes first, longer keys, and pairs of blocks."""
    rows = texts_of(random.Random(seed), 150)
    kept = near_copies.keep_first(spark.createDataFrame(rows, DOCS).repartition(7), max_bits=max_bits, bucket_rows=bucket_rows)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows, max_bits)


def test_a_dense_group_gives_few_pairs(spark, monkeypatch):
    """300 near copies of one text, all close to each other: pairs in proportion to the group, not to its square."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.003 else f"x{i}" for w in words)) for i in range(300)]
    sent = []
    linked = near_copies.Texts.linked
    monkeypatch.setattr(near_copies.Texts, "linked", staticmethod(lambda pairs, sets: sent.append(pairs.distinct().count()) or linked(pairs, sets)))
    for bucket_rows in (4096, 50):
        sent.clear()
        kept = near_copies.keep_first(spark.createDataFrame(rows, DOCS), bucket_rows=bucket_rows)
        assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows, 8)
        assert sum(sent) < 6 * len(rows)


def test_neighbours_of_large_buckets():
    rng = np.random.default_rng(1)
    key = np.repeat(np.arange(4), [3, 700, 20, 900])
    fp = rng.integers(-(2**63), 2**63 - 1, len(key))
    for i in range(100, 600):  # a dense group in a large bucket, and scattered pairs
        fp[i] = fp[99] ^ (1 << int(rng.integers(0, 63)))
    for i in rng.integers(724, 1600, 60):
        fp[i] = fp[rng.integers(723, 1600)] ^ 5
    got = near_copies.with_neighbour(key, fp, 8)
    u = fp.view(np.uint64)
    want = [((np.bitwise_count(u ^ u[i]) <= 8) & (key == key[i])).sum() > 1 for i in range(len(key))]
    assert got.tolist() == want


def test_keys_lengthen_with_the_table():
    assert near_copies.levels(1) == near_copies.levels(200_000) == 1 and near_copies.levels(10_000_000) == 2
    assert 3 <= near_copies.levels(10**9) <= 4 and near_copies.levels(10**18) < 20


def test_stage_finds_near_copies_far_apart_in_bits(spark):
    words = [f"word{i}" for i in range(100)]
    text, other = " ".join(words), " ".join([*words[:50], "changed", *words[51:]])
    fps = [int.from_bytes(simhash.fingerprint(t.encode())) for t in (text, other)]
    assert (fps[0] ^ fps[1]).bit_count() > simhash.MAX_BITS
    df = spark.createDataFrame([(1, text, "x"), (2, other, "y"), (3, "quite another text of more than five words", "z")], DOCS + ", FP string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "nobody knows this one at all"), (4, "x y"), (4, "x y"), (4, "p q")]
    kept = near_copies.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == [(0, "nobody knows this one at all"), (3, "a b c d e f"), (4, "p q"), (4, "x y")]
    assert near_copies.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
        if near_copies.linked(a, b):
            bits = np.frombuffer(near_copies.sketch(a) + near_copies.sketch(b), np.uint64).reshape(2, -1)
            assert near_copies._possible(np.array([len(a), len(b)]), bits, np.array([0]), np.array([1]))[0]
