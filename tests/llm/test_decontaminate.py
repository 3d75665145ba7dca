import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tomeflow.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for i, t in items:
        v = WORD.findall(lower(t))
        for s in range(max(1, len(v) - 12) if v else 0):
            p = v[s : s + 13]
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    found.add("" if i is None else str(i))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def made(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "d9", "Ö"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 7, 12, 13, 14, 20, 30]))) for i in range(7)]
    items += [(100, None), (101, "..!"), (102, ""), (None, say(13)), (3, items[3][1]), (3, say(15))]
    docs = [(i, f"{say(rng.randrange(60))} -- {rng.choice(items)[1] or ''}; {say(rng.randrange(60))}") for i in range(40)]
    docs += [(50, None), (51, ""), (52, "?!"), (0, docs[0][1]), (None, items[0][1]), (53, say(30_000)), (54, "z" * 100_000)]
    return items, docs


@pytest.mark.parametrize("seed, block_words, pass_words", [(0, 250_000, 10**9), (1, 10, 10**9), (2, 40, 10**9), (3, 40, 100)])
def test_equals_brute_force(spark, seed, block_words, pass_words):
    items, docs = made(seed)
    docs = [d for d in docs if d[0] != 53]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("STATE", F.lit(1)).withColumn("contamination", F.lit("x"))
    out, name = dc.with_contamination(df, b, block_words=block_words, pass_words=pass_words)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert out.columns == [*df.columns, name]
    got = sorted((r.doc_id if r.doc_id is not None else -1, *r[name]) for r in out.collect())
    assert got == sorted((i if i is not None else -1, *brute(t, items)) for i, t in docs)


def test_long_repetitive_text_in_linear_time():
    rng = random.Random(5)
    w = dc.words_of((" ".join(rng.choice(["the", "of"]) for _ in range(200_000))).encode())
    s = dc.compile_block([("1", dc.words_of(b"the " * 20)), ("2", dc.words_of(b"of"))])
    items = set()
    assert sum(dc.scan(s, w, None, items)) > 0 and "2" in items


def test_shift_table_skips():
    s = dc.WuManber({tuple(f"w{i}".encode() for i in range(13)): {"1"}})
    assert s.jump == 12 and s.shift[(b"w11", b"w12")] == 0 and s.shift[(b"w0", b"w1")] == 11


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out.collect()] == [(1, 0, False)] * len(docs)
