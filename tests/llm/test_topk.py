import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import topk

ROWS = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    good = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).withColumn("id", F.lit("clash")).withColumn("Shard", F.lit(0))
    return sorted(tuple(r) for r in topk.top_k(df, **kw).collect())


@pytest.mark.parametrize("dim, shard_rows, block", [(3, 1000, 1000), (3, 40, 5), (16, 60, 1000), (1, 10, 2)])
def test_equals_brute_force_with_ties(spark, dim, shard_rows, block):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, dim) / 64]) for i in range(300)]
    assert run(spark, rows, shard_rows=shard_rows, block_queries=block) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = [(20, None), (40, [None, 1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 1.0, 1.0]), (100, []), (101, []), (0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0, 1.0]), (1, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


@pytest.mark.parametrize("scale", [1e4, 1e7])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * scale]) for i in range(100)]
    assert run(spark, rows, shard_rows=30) == brute(rows)


def test_components_of_any_size(spark):
    """Beyond 2**62 after scaling, beyond a double after scaling, and scores beyond a long: these count as the nearest long."""
    rows = [(0, [1e17, -2.5]), (20, [1.0, 0.5]), (40, [1e308, 1.0]), (1, [3e17, 1.25]), (2, [-1e300, 7.0]), (3, [0.0, 1e-300]), (60, [1.7e308, -1.7e308]), (61, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    want = []
    for i in (0, 20, 40, 60):
        score = {j: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[i], w, strict=True)))) for j, w in ints.items() if j != i}
        want += [(i, r + 1, j, score[j]) for r, j in enumerate(sorted(score, key=lambda j: (-score[j], j)))]
    for shard_rows in (3, 100):
        assert sorted(tuple(r) for r in topk.top_k(df, shard_rows=shard_rows).collect()) == want


def test_seeds_of_ids_with_several_vectors(spark):
    """A kth score that one of an id's vectors finds holds for the merged list of all."""
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 10, 2) / 64]) for i in rng.integers(0, 90, 400)]
    good = {(i, tuple(int(64 * x) for x in v)) for i, v in rows}
    want = []
    for i in sorted({i for i, _ in good if i % 20 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for own, v in good if own == i for j, w in good if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert run(spark, rows, shard_rows=50, block_queries=4) == want


def test_trees_are_built_once(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], ROWS)
    plan = topk.top_k(df, shard_rows=20, block_queries=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "FlatMapGroupsInArrow" not in plan


def test_bounds_hold_and_boxes_are_tight():
    rng = np.random.default_rng(3)
    vecs = rng.integers(-64, 65, (1000, 8))
    tree = topk.KDTree(np.arange(1000), vecs, 50)
    q = rng.integers(-64, 65, 8)
    for cuts, (low, high) in zip(tree.levels, tree.boxes, strict=True):
        assert sum(z - a for a, z in cuts) == 1000
        for (a, z), lo, hi in zip(cuts, low, high, strict=True):
            assert (tree.vecs[a:z].min(axis=0) == lo).all() and (tree.vecs[a:z].max(axis=0) == hi).all()
            assert (tree.vecs[a:z] @ q).max() <= np.maximum(q * lo, q * hi).sum()


def test_pruning_visits_few_leaves():
    """In few dimensions the kth score closes most leaves unseen."""
    rng = np.random.default_rng(4)
    vecs = rng.integers(-64, 65, (20_000, 2))
    tree, q = topk.KDTree(np.arange(20_000), vecs, 100), np.array([[60, 10]])
    seen = []
    top = topk.Top(1, 20)
    add = top.add
    top.add = lambda a, s, i: (seen.append(len(a)), add(a, s, i))
    topk.search(tree, np.array([-1]), q, top)
    assert sum(seen) < len(tree.levels[-1]) / 4
    assert sorted(top.score, reverse=True) == sorted(vecs @ q[0], reverse=True)[:20]
