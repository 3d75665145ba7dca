import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tomeflow.llm import mixing

DOCS = "doc_id long, text string, source string"


def sample():
    rows = [(i, "x" * (40 + i % 90), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, "y" * 30, "tiny") for i in range(3)] + [(2000 + i, "z" * 50, None) for i in range(9)]
    return rows + [(3000, None, "hot"), (3001, "", "empty"), (3002, None, None), (5, rows[5][1], rows[5][2]), (None, "no id", "s1")]


def brute(rows, key, budget=None, entropy=0.97, repeats=4.0):
    count = lambda t: (len(t) + 3) // 4 if t else 0
    total, docs = Counter(), defaultdict(list)
    for i, t, s in rows:
        total[s] += count(t)
        docs[s].append((i, count(t)))
    free = {s for s, n in total.items() if not n}  # comes once, whatever the budget
    total = {s: n for s, n in total.items() if n}
    every = sum(total.values())
    budget = every if budget is None else budget
    p = {s: n / every for s, n in total.items()}

    def mixed(a):
        z = sum(x**a for x in p.values())
        w = {s: x**a / z for s, x in p.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max(w[s] * budget / total[s] for s in p)

    def bisect(good):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    goal = entropy * math.log(len(p)) if len(p) > 1 else 0
    a = 1.0 if mixed(1.0)[1] >= goal - 1e-12 else bisect(lambda a: mixed(a)[1] >= goal - 1e-12)
    if mixed(a)[2] > repeats + 1e-9:
        a = bisect(lambda a: mixed(a)[2] > repeats)
    out = [(i, s, 0) for s in free for i, _ in docs[s]]
    for s, w in mixed(a)[0].items():
        whole, left = divmod(math.floor(w * budget + 1e-6), total[s])
        out += [(i, s, b) for b in range(whole) for i, _ in docs[s]]
        used = 0
        for _, i, n in sorted(((key[whole, i], i, n) for i, n in docs[s]), key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2])):
            used += n
            if used > left:
                break
            out.append((i, s, whole))
    return sorted(out, key=repr), mixed(a)


@pytest.mark.parametrize("kw", [{}, {"target_entropy": 1.0}, {"target_entropy": 1.0, "max_repeats": 1.5}, {"budget": 3000}, {"budget": 60_000}, {"budget": 0}])
def test_equals_brute_force(spark, kw):
    rows = sample()
    df = spark.createDataFrame(rows, DOCS).withColumn("BLOCK", F.lit("clash")).withColumn("tokens", F.lit(-1))
    keys = {(b, r.doc_id): r.k for b in range(12) for r in df.select("doc_id", mixing._key(mixing.SEED, F.lit(b), F.col("doc_id")).alias("k")).collect()}
    want, _ = brute(rows, keys, kw.get("budget"), kw.get("target_entropy", 0.97), kw.get("max_repeats", 4.0))
    out = mixing.mix(df, **kw)
    assert out.columns == [*df.columns, "n_tokens", "_block", "place"]
    assert sorted(((r.doc_id, r.source, r._block) for r in out.collect()), key=repr) == want


def test_weights_meet_the_target(spark):
    rows = sample()
    df = spark.createDataFrame(rows, DOCS)
    tokens = defaultdict(int)
    for r in mixing.mix(df, max_repeats=100.0).collect():  # the limit would come first
        tokens[r.source] += r.n_tokens
    every = sum(tokens.values())
    entropy = -sum(n / every * math.log(n / every) for n in tokens.values() if n)
    assert entropy / math.log(sum(n > 0 for n in tokens.values())) > 0.95


def test_ranges_follow_the_order_of_places(spark):
    df = spark.range(2000).select(mixing._key(1, F.lit(0), F.col("id")).alias("k")).withColumn("r", mixing._range(F.col("k"))).orderBy("k")
    got = [r.r for r in df.collect()]
    assert got == sorted(got) and got[0] >= 0 and got[-1] < mixing.RANGES


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None)], [(1, "", "a"), (2, None, None), (3, "", "a"), (None, None, "b")]])
def test_documents_without_tokens_come_once(spark, rows):
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in out), key=repr) == sorted(rows, key=repr)
    assert all(r.n_tokens == 0 and r.block == 0 for r in out)


def test_sources_without_tokens_equal_the_sql(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    pq.write_table(spark.createDataFrame(sample(), DOCS).toArrow(), tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    cursor = con.execute(mixing.oracle_sql())
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = mixing.mix(spark.createDataFrame(sample(), DOCS)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["n_tokens"], r["block"], r["place"]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r["source"] == "empty" for r in got)


def test_one_source(spark):
    df = spark.createDataFrame([(i, "abcd" * 5, "only") for i in range(10)], DOCS)
    out = mixing.mix(df, budget=125).collect()
    assert Counter(r.block for r in out) == {0: 10, 1: 10, 2: 5}
