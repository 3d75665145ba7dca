import hashlib
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tomeflow.llm import registry, runs

FOLDER = "/root/testdata/sf0.001"


def brute(x):
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if (length := j - i + q) >= max(24, 3 * q) and j > i:
                s = x[i : i + length]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    x = []
    while len(x) < rng.randint(20, 400):
        if rng.random() < 0.5:
            x += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 30))]
        else:
            p = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 40))]
            x += (p * 7)[: int(len(p) * rng.uniform(1, 6))]
    return x


def test_runs_equal_all_periods_tried(spark):
    rng = random.Random(3)
    found = 0
    for _ in range(1500):
        x = random_words(rng)
        expected = brute(x)
        assert runs.find_runs(np.array(x, np.int64)) == expected
        found += len(expected)
    assert found > 1000


@pytest.mark.parametrize("p,repeats", [(1, 30), (7, 4), (8, 3), (9, 3), (15, 3), (16, 3), (17, 5), (31, 3), (100, 3), (255, 4), (256, 3), (257, 3)])
def test_a_run_of_each_scale_at_any_place(p, repeats):
    rng = random.Random(p)
    for lead in (0, 1, 5, 13, 64):
        body = [rng.randrange(1000) for _ in range(p)]
        x = [5000 + i for i in range(lead)] + body * repeats + [9000 + i for i in range(lead)]
        assert runs.find_runs(np.array(x, np.int64)) == brute(x) == ([(lead, p * repeats, p)] if p * repeats >= 24 else [])


def test_work_on_one_word_repeated_is_not_quadratic():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def expected(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_equals_brute_force(spark):
    docs = [d for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(d.text) < 12_000]
    ids = {d.doc_id for d in docs}
    got = {tuple(r) for r in registry.op13_runs(spark, FOLDER).collect() if r.doc_id in ids}
    assert got == {expected(d.doc_id, d.text) for d in docs}
    assert sum(r[1] > 0 for r in got) > 5


def test_defined_cases(spark):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \t\n", "a " * 30, "a b\x1cc " * 30, ("x y z " * 8 + "q ") * 4, " ".join(map(str, range(100)))]
    rows = [(i, t, 1, "r") for t in texts for i in (planted, planted + 1, planted + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, runs string")
    got = sorted((tuple(r) for r in runs.digest(runs.periodic_runs(docs, change=runs.planted)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert runs.digest(runs.periodic_runs(docs.limit(0))).collect() == []


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "go " + "a b " * 15 + "end")], "doc_id long, text string")
    r = runs.periodic_runs(docs).first()
    assert [tuple(x) for x in r.runs] == [(1, 30, 2)]
    assert r.collapsed == "go a b end"
