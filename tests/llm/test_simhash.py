import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tomeflow.llm import simhash

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def brute_roots(values):
    """The smallest member of each value's component, by trying all pairs."""
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def texts(rng, n):
    base = [" ".join(rng.choice(["Alpha", "beta", "γ", "d4", "e."]) for _ in range(60)) for _ in range(6)]
    out = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y"])
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "w" * 50_000), (n + 7, "a b c\u00a0d " * 9_000), (0, out[0][1])]


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_roots(sorted({f for _, f in fps}))
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(roots[f])) for i, f in fps)


@pytest.mark.parametrize("bucket_rows", [1024, 2])
def test_equals_all_pairs(spark, bucket_rows):
    rows = texts(random.Random(bucket_rows), 70)
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("KEY", F.lit(None).cast("int"))
    got = simhash.near_duplicates(df, bucket_rows=bucket_rows).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute(rows)


def test_null_ids_link_but_dont_name(spark):
    rows = [(None, "same words here now"), (7, "same words here now"), (None, "quite another text entirely"), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_first(df).count() == 0


@pytest.mark.parametrize("bucket_rows", [8, 100_000])
def test_hot_buckets_lose_no_link(spark, bucket_rows):
    """Balls of near fingerprints, as a large group of near copies makes; a tiny bucket forces every level."""
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**63, 3):
        for _ in range(150):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    signed = {v: int(np.uint64(v).view(np.int64)) for v in values}
    df = spark.createDataFrame([(signed[v],) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.link_edges(df, bucket_rows)).collect()}
    want = brute_roots(values)
    groups, found = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        found.setdefault(got.get(signed[v], signed[v]), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_coordinates_are_a_lower_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    ca, cb = (simhash.coordinates(simhash.pivot_distances(x.view(np.int64))) for x in (a, b))
    assert ca.min() >= 0 and ca.max() <= 1
    assert (np.abs(ca.astype(int) - cb).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("max_bits", [2, 8])
def test_pairs_of_small_and_large_buckets(max_bits):
    rng = np.random.default_rng(max_bits)
    key = np.repeat(np.arange(40), [1, 2, 5, 400] * 10)
    fp = rng.integers(-(2**63), 2**63 - 1, len(key))
    near = rng.integers(0, len(key), 600)
    for i in near:
        fp[i] = fp[rng.choice(np.flatnonzero(key == key[i]))]
        for bit in rng.integers(0, 63, rng.integers(0, 12)):
            fp[i] ^= 1 << int(bit)
    got = {(int(x), int(y)) for a, b in simhash.close_pairs(key, fp, max_bits) for x, y in zip(a, b, strict=True)}
    u = fp.view(np.uint64)
    want = {(i, j) for i in range(len(key)) for j in np.flatnonzero((key == key[i]) & (np.bitwise_count(u ^ u[i]) <= max_bits)).tolist() if i < j}
    assert got == want


def test_parts_cover_what_is_free():
    for path in (0, 1, 2 + 3 * 4, 1 + 2 * 4 + 3 * 16):
        p = simhash.parts(path)
        flat = [c for x in p for c in x]
        assert len(flat) == len(set(flat))
    for ways in (3, 9):
        assert sorted(c for x in simhash.parts(0, ways) for c in x) == list(range(64))


def test_keep_first_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (5, "something else is here", "z"), (None, "a null id stays alone here", "n"), (8, None, "e"), (6, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.FP) for r in kept.collect()) == [(-1, "n"), (1, "y"), (5, "z"), (6, "e")]


def test_keep_first_of_repeated_ids(spark):
    """Of rows that share an id and fingerprint the least one, however the rows are dealt; map columns don't matter."""
    rows = [(1, "a b c d", "y", {"k": 2}), (1, "a b c d", "x", {"k": 1}), (1, "another text under the id", "q", None), (2, "a b c d", "p", None), (None, None, "b", None), (None, None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Row string, m map<string,int>")
    for n in (1, 5):
        kept = simhash.keep_first(df.repartition(n))
        assert kept.columns == df.columns
        assert sorted(((r.doc_id or 0), r.Row) for r in kept.collect()) == [(0, "a"), (1, "q"), (1, "x")]


def test_texts_arent_shuffled_without_repeated_ids(spark):
    df = spark.createDataFrame([(i, f"text {i % 5} of some words") for i in range(50)], DOCS)
    plan = simhash.keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "MapInArrow" not in plan


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
