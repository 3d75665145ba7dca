import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tomeflow.operators import search


def test_bm25_finds_the_best_page_and_ignores_blank_queries(spark):
    docs = spark.createDataFrame(
        [("p1", "Resiliency", "we handle api rate limits with retries and backoff"), ("p2", "Cooking", "an article on soup"), ("p3", None, None)],
        "path string, title string, body string",
    )
    q = spark.createDataFrame([(1, "how do we handle API rate limits"), (2, "  !! "), (3, None)], "query_id long, text string")
    rows = search.bm25(docs, q, 5).collect()
    assert [(r.query_id, r.path, r["rank"]) for r in rows] == [(1, "p1", 1)]
    assert search.bm25(docs.limit(0), q, 5).count() == 0


def test_bm25_equals_the_formula(spark):
    rng = random.Random(1)
    docs = [(f"p{i}", rng.choice(["a b", "c", ""]), " ".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for i in range(40)]
    queries = [(i, " ".join(rng.sample("abcdef", 2))) for i in range(6)]
    df = spark.createDataFrame(docs, "path string, title string, body string")
    got = {(r.query_id, r.path): r.score for r in search.bm25(df, spark.createDataFrame(queries, "query_id long, text string"), 1000).collect()}
    want = {}
    for (qi, q), f in itertools.product(queries, (1, 2)):
        texts = {d[0]: d[f].split() for d in docs}
        mean = sum(map(len, texts.values())) / len(texts)
        for t in set(q.split()):
            df_ = sum(t in x for x in texts.values())
            for p, x in texts.items():
                if t in x:
                    s = math.log(1 + (40 - df_ + 0.5) / (df_ + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean))
                    want[qi, p] = want.get((qi, p), 0) + s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_local_and_global_top_agree_on_ties(spark):
    docs = spark.createDataFrame([(f"p{i:03d}", "", "same") for i in range(50)], "path string, title string, body string").repartition(5)
    q = spark.createDataFrame([(1, "same")], "query_id long, text string")
    assert [r.path for r in search.bm25(docs, q, 7).orderBy("rank").collect()] == [f"p{i:03d}" for i in range(7)]


def test_nearest_is_exact_in_small_shards(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(80, 4))
    rows = [(f"s{i:02d}", f"p{i // 3}", [float(x) for x in v[i]]) for i in range(80)] + [("s99", "p", None)]
    s = spark.createDataFrame(rows, "section_key string, path string, vector array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(5)], "query_id long, vector array<double>")
    for shard in (7, 1000):
        got = {(r.query_id, r["rank"]): r.section_key for r in search.nearest(s, q, 6, shard).collect()}
        for i in range(5):
            order = sorted(range(80), key=lambda j: (round(float(np.linalg.norm(v[i] - v[j])), 6), f"s{j:02d}"))[:6]
            assert [got[i, r] for r in range(1, 7)] == [f"s{j:02d}" for j in order]


def test_fusion(spark):
    both = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "query_id long, item string, rank int")
    got = {r["item"]: r.score for r in search.fuse(both).collect()}
    assert got["b"] > got["a"] > got["c"] and abs(got["b"] - (1 / 61 + 1 / 62)) < 1e-9
    shuffled = search.fuse(both.orderBy(F.rand(3)))
    assert {r["item"]: r.score for r in shuffled.collect()} == got


def test_an_index_answers_like_its_documents(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(f"p{i}", rng.choice(["a b", None, ""]), " ".join(rng.choice("abcde") for _ in range(rng.randrange(9)))) for i in range(50)], "path string, title string, body string")
    queries = spark.createDataFrame([(1, "a c"), (2, "zz"), (3, "e e E")], "query_id long, text string")
    index = search.write_index(docs, str(tmp_path / "i"))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(search.search_index(index, queries, 9).collect()) == key(search.bm25(docs.repartition(7), queries, 9).collect())
    assert key(search.search_index(search.read_index(spark, str(tmp_path / "i")), queries, 9).collect()) == key(search.search_index(index, queries, 9).collect())
    got = {(r.path, r.term): r.tf for r in index.postings.join(index.docs, "doc").where("field = 'body'").collect()}
    want = {(r.path, t): r.body.split().count(t) for r in docs.collect() for t in set(r.body.split())}
    assert got == want
    assert "MapInArrow" not in search.search_index(index, queries, 9)._jdf.queryExecution().executedPlan().toString()


def test_each_vault_has_its_own_statistics(spark):
    docs = spark.createDataFrame([("a", "x", "", "soup"), ("a", "y", "", "soup and rice"), ("b", "x", "", "soup"), ("b", "z", "", "rice")], "vault string, path string, title string, body string")
    queries = spark.createDataFrame([(1, "soup")], "query_id long, text string")
    got = {(r.vault, r.path): r.score for r in search.bm25(docs, queries, 5, group=("vault",)).collect()}
    alone = {(v, r.path): r.score for v in "ab" for r in search.bm25(docs.where(F.col("vault") == v), queries, 5).collect()}
    assert got == alone and got["a", "x"] != got["b", "x"]


def test_federated_search_leaves_a_broken_vault_out(spark):
    def vault(path, body, vector):
        return lambda: (spark.createDataFrame([(path, "T" + path, body)], "path string, title string, body string"), spark.createDataFrame([(path + "#0", path, vector)], "section_key string, path string, vector array<double>"))

    def broken():
        raise OSError("no such folder")

    docs, sections, errors = search.open_vaults({"b": vault("p", "soup", [0.0, 1.0]), "a": vault("p", "rice", [5.0, 5.0]), "c": broken})
    assert errors == {"c": "OSError: no such folder"}
    tq = spark.createDataFrame([(1, "soup")], "query_id long, text string")
    vq = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<double>")
    got = [(r.vault, r.path, r.title, round(r.score, 6)) for r in search.federated(docs, sections, tq, vq, 5).orderBy("rank").collect()]
    assert got == [("b", "p", "Tp", round(2 / 61, 6)), ("a", "p", "Tp", round(1 / 61, 6))]


def test_nearest_with_equal_and_far_vectors(spark):
    """Ties by key, large values, and more queries than a block of the product."""
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(300, 3)) * 1000, 1)
    v[50:90] = v[50]
    s = spark.createDataFrame([(f"s{i:03d}", "p", [float(x) for x in v[i]]) for i in range(300)], "section_key string, path string, vector array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(150)], "query_id long, vector array<double>")
    got = {}
    for r in search.nearest(s, q, 7, 64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.section_key
    for i in range(150):
        order = sorted(range(300), key=lambda j: (round(float(np.sqrt(((v[j] - v[i]) ** 2).sum())), 6), f"s{j:03d}"))[:7]
        assert [got[i][k] for k in range(1, 8)] == [f"s{j:03d}" for j in order]


def test_pruned_search_finds_the_same_rows(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(f"p{i:04d}", " ".join(rng.choices(words, weights, k=rng.randrange(5))), " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 120]))), rng.choice("abc")) for i in range(1500)]
    docs += [(f"q{i}", "", "w3 w9", "a") for i in range(40)]  # ties
    df = spark.createDataFrame(docs, "path string, title string, body string, vault string")
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(25)] + [(90, ""), (91, "nothing"), (92, "w3 w9"), (93, None)], "query_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    for group in ((), ("vault",)):
        index = search.write_index(df, str(tmp_path / f"i{len(group)}"), group=group)
        for limit in (1, 4):
            assert key(search.search_index(index, queries, limit, pruned=True)) == key(search.search_index(index, queries, limit, pruned=False))


def test_pruned_search_scores_few_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    docs = [(f"p{i:04d}", "", " ".join(["the", "of"] + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20))])) for i in range(3000)]
    index = search.write_index(spark.createDataFrame(docs, "path string, title string, body string"), str(tmp_path / "i"))
    queries = spark.createDataFrame([(i, f"the of w{i} w{i + 40}") for i in range(8)], "query_id long, text string")
    monkeypatch.setattr(search.maxscore, "SEEDS", 4)
    one = search.pruned_search(index, queries, 5)
    assert sum(one.rows_scored().values()) * 5 < 8 * 2 * 3000
    one.close()


SYNTAX_DOCS = [
    ("p1", "Rate limits", "we handle api rate limits with retries and back-off"),
    ("p2", "Limits", "a limits rate table, and a rate of limits"),
    ("p3", "Soup", "rate limits of soup: rate limits, rate limits"),
    ("p4", "", "retries"),
    ("p5", None, None),
]


def test_query_syntax(spark, tmp_path):
    from tomeflow.operators import syntax

    df = spark.createDataFrame(SYNTAX_DOCS, "path string, title string, body string")
    index = search.write_index(df, str(tmp_path / "i"), positions=True)
    cases = {
        '"rate limits"': {"p1", "p3"},
        "rate-limits": {"p1", "p3"},
        '"limits rate"': {"p2", "p3"},
        '"rate limits" -soup': {"p1"},
        "+rate +retries": {"p1"},
        "+rate soup": {"p1", "p2", "p3"},
        "title:limits": {"p1", "p2"},
        'title:"rate limits"': {"p1"},
        "-title:soup rate": {"p1", "p2"},
        "-rate": set(),
        "+rate +unknown": set(),
        "unknown retries": {"p1", "p4"},
        'rate "limits': set(),
        "nofield:rate": set(),
        "what is: rate": set(),
        "": set(),
        " !! + - ": set(),
        "RATE !!": {"p1", "p2", "p3"},
        '"a rate of limits"': {"p2"},
        '"back off" "a limits rate"': {"p1", "p2"},
    }
    queries = spark.createDataFrame([*enumerate(cases), (99, None)], "query_id long, text string")
    got = {i: set() for i in range(len(cases))}
    rows = syntax.search_syntax(index, queries, 10).collect()
    for r in rows:
        got[r.query_id].add(r.path)
    assert got == dict(enumerate(cases.values()))
    best = next(r.path for r in rows if r.query_id == 0 and r["rank"] == 1)
    idf = lambda n, df_: math.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
    sizes = {f: [len([t for t in (d[f] or "").replace("-", " ").replace(",", " ").replace(":", " ").split()]) for d in SYNTAX_DOCS] for f in (1, 2)}
    w = lambda f, k, tf, dfs: sum(idf(5, x) for x in dfs) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[f][k] / (sum(sizes[f]) / 5)))
    score = {"p1": w(1, 0, 1, (1, 2)) + w(2, 0, 1, (3, 3)), "p3": w(2, 2, 3, (3, 3))}
    assert best == max(score, key=score.get)
    assert {r.path: r.score for r in rows if r.query_id == 0} == {p: round(s, 6) for p, s in score.items()}


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    from tomeflow.operators import routing

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 20
    v = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6))
    v[100:160] = v[100]  # copies: one cell of many shards
    rows = [(f"s{i:04d}", f"p{i // 3}", v[i].tolist(), "abc"[i % 3] if i % 50 else None) for i in range(900)]
    rows += [("t1", "p", [1.0, 2.0], "a"), ("t2", "p", None, "a"), ("t3", "p", [0.0] * 6, "d")]
    s = spark.createDataFrame(rows, "section_key string, path string, vector array<double>, vault string")
    q = spark.createDataFrame([(i, v[i * 20].tolist()) for i in range(40)] + [(100, v[100].tolist()), (101, [0.0, 0.0]), (102, [1.0])], "query_id long, vector array<double>")
    known = s.where("vault IS NOT NULL")
    key = lambda d: sorted(map(tuple, d.collect()))
    for group, table in (((), s), (("vault",), known)):
        want = key(search.nearest(table, q, 6, 5_000, group))
        assert key(search.nearest(table, q, 6, 30, group)) == want and len(want) > 200
    with monkeypatch.context() as m:  # too many cells to plan with
        m.setattr(routing, "CELLS", 3)
        assert key(search.nearest(s, q, 6, 30)) == key(search.nearest(s, q, 6, 5_000))


def test_few_pairs_of_queries_and_cells_are_left(spark):
    from tomeflow.operators import routing

    rng = np.random.default_rng(4)
    v = (rng.normal(size=(50, 8)) * 20)[rng.integers(0, 50, 4_000)] + rng.normal(size=(4_000, 8))
    s = spark.createDataFrame([(f"s{i}", "p", v[i].tolist()) for i in range(4_000)], "section_key string, path string, vector array<double>")
    q = s.limit(40).select(F.substring("section_key", 2, 9).cast("long").alias("query_id"), "vector")
    router = routing.Router(s, 4_000, 100, 10, ())
    own = router.pairs(q)
    assert own.count() == 40
    found = search._in_cells(router, own, 10, 1)
    reached = search.top(found, 10, "distance", "section_key").groupBy("query_id").agg(F.max("distance").alias("kth")).withColumn("g", F.lit(0))
    asked = 40 + router.pairs(q, reached).count()
    assert asked * 5 < 40 * router.n_cells
    router.close()


def test_postings_are_counted_where_texts_are_read(spark, monkeypatch):
    from tomeflow.operators import counting

    rng = random.Random(5)
    texts = [(f"p{i}", rng.choice(["a b", "", None, "Ä-ß x" + "y" * 40]), " ".join(rng.choices(["a", "b", "É", "７", "z" * 39, "z" * 40, "--"], k=rng.choice([0, 1, 9, 300])))) for i in range(60)]
    docs = spark.createDataFrame([*texts, ("q", None, None)], "path string, title string, body string")

    def want(rows):
        out = {}
        for path, *own in rows:
            for field, text in zip(("title", "body"), own, strict=True):
                found = [t for t in (text or "").lower().replace("-", " ").split() if len(t.encode()) < 40]
                for t in set(found):
                    key = (path, field, t, len(found))
                    out[key] = out.get(key, 0) + found.count(t)
        return out

    got = lambda d: {(r.path, r.field, r.term, r.doc_len): r.tf for r in search.postings(d).collect()}
    for chunk in (50, 1 << 23):
        monkeypatch.setattr(counting, "CHUNK", chunk)
        assert got(docs) == want(texts)
    assert "Exchange" not in search.postings(docs)._jdf.queryExecution().executedPlan().toString()
    again = [*texts, *texts[:7], ("p1", "b", texts[1][2])]
    assert got(spark.createDataFrame(again, docs.schema)) == want(again)


def test_scores_by_document_are_those_of_the_join(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"p{i:04d}", " ".join(rng.choices(words, k=rng.randrange(4))), " ".join(rng.choices(words, k=rng.choice([0, 3, 20]))), rng.choice("abc")) for i in range(900)]
    docs += [(f"q{i:03d}", "w1", "w3 w9 w3 w11", "a") for i in range(200)]  # copies
    df = spark.createDataFrame(docs, "path string, title string, body string, vault string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(25)] + [(90, ""), (92, "w1 w3 w9"), (92, "w3 w11"), (93, None)], "query_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    for group in ((), ("vault",)):
        index = search.write_index(df, str(tmp_path / f"i{len(group)}"), group=group)
        for limit, cells in ((1, 300), (4, 2_000), (2_000, 1 << 20)):
            want = key(search.search_index(index, queries, limit))
            with monkeypatch.context() as m:
                m.setattr(search, "DEALT_ROWS", 1)
                m.setattr(search.bydoc, "CELLS", cells)
                found = search.search_index(index, queries, limit)
                assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
                assert key(found) == want
    # Of copies that tie, a task passes on no more than are asked for.
    known = search.statistics(index, queries.where("query_id = 92").select("query_id", F.explode(search.terms(F.col("text"))).alias("term")))[1]
    known = known.groupBy("vault", "field", "term", "mean", "idf").agg(F.collect_list("query_id").alias("queries"))
    assert search.bydoc.scores(index, known, search.posting_weight(), 3, 10).groupBy("vault", F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 12


def test_query_syntax_by_document_is_that_of_the_join(spark, tmp_path, monkeypatch):
    from tomeflow.operators import syntax

    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    docs = [(f"p{i:03d}", " ".join(rng.choices(words, k=rng.randrange(4))), " ".join(rng.choices(words, k=rng.choice([0, 3, 9]))), rng.choice("xy")) for i in range(150)]
    docs += [(f"q{i:02d}", "a", "b b a b b", "x") for i in range(30)]
    df = spark.createDataFrame(docs, "path string, title string, body string, vault string")

    def clause():
        body = rng.choice(["{0}", '"{0} {1}"', '"{0} {0} {1}"', "{0}-{1}"]).format(*rng.sample(words, 2))
        return rng.choice(["", "", "+", "-"]) + rng.choice(["", "", "title:", "body:"]) + body

    texts = [" ".join(clause() for _ in range(rng.randint(1, 4))) for _ in range(20)] + ["+a +a b", "-a", "a zz", "+zz a", '"b b"']
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    for group, limit, cells in (((), 5, 400), (("vault",), 500, 1 << 20)):
        index = search.write_index(df, str(tmp_path / f"i{len(group)}"), group=group, positions=True)
        want = key(syntax.search_syntax(index, queries, limit))
        with monkeypatch.context() as m:
            m.setattr(search, "DEALT_ROWS", 1)
            m.setattr(search.bydoc, "CELLS", cells)
            found = syntax.search_syntax(index, queries, limit)
            assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
            assert key(found) == want and len(want) > 50


def test_an_index_keeps_no_blocks_and_a_search_counts_asked_terms_only(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(f"p{i}", "a", f"a b w{i}") for i in range(30)], "path string, title string, body string")
    index = search.write_index(docs, str(tmp_path / "i"))
    assert sorted(os.listdir(tmp_path / "i")) == ["docs", "lengths", "rows"]
    blocks, known = search.statistics(index, spark.createDataFrame([(1, "a"), (1, "w3"), (1, "zz"), (2, "a")], "query_id long, term string"))
    assert sorted((r.query_id, r.field, r.term, r.df) for r in known.collect()) == [(1, "body", "a", 30), (1, "body", "w3", 1), (1, "title", "a", 30), (2, "body", "a", 30), (2, "title", "a", 30)]
    assert {r.term for r in blocks.collect()} == {"a", "w3"}
    assert {(r.field, r.term): r.df for r in index.terms.where("term < 'w'").collect()} == {("body", "a"): 30, ("title", "a"): 30, ("body", "b"): 30}


def test_hybrid_search_computes_each_side_once(spark, monkeypatch):
    docs = spark.createDataFrame([(f"p{i}", "T", f"soup w{i}") for i in range(20)], "path string, title string, body string")
    sections = spark.createDataFrame([(f"p{i}#0", f"p{i}", [float(i), 1.0]) for i in range(20)], "section_key string, path string, vector array<double>")
    tq, vq = spark.createDataFrame([(1, "soup w3")], "query_id long, text string"), spark.createDataFrame([(1, [3.0, 1.0])], "query_id long, vector array<double>")
    monkeypatch.setattr(search, "DEALT_ROWS", 1)
    found = search.hybrid(docs, sections, tq, vq, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "CoGroup" not in plan
    assert found.orderBy("rank").first()[:5] == (1, "p3", round(2 / 61, 9), 1, "T")


def test_an_index_has_lists_that_are_dealt_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    docs = [(f"p{i:03d}", rng.choice(["a b", "É-b", None]), " ".join(rng.choices("abcdeé", k=rng.choice([0, 2, 9, 40]))), rng.choice(["x", "y", "z"])) for i in range(200)]
    df = spark.createDataFrame(docs, "path string, title string, body string, vault string").repartition(2)
    want = {(v, p, f, t): (x.lower().replace("-", " ").split().count(t), len(x.replace("-", " ").split())) for p, *texts, v in docs for f, x in zip(("title", "body"), (x or "" for x in texts), strict=True) for t in x.lower().replace("-", " ").split()}
    for chunk, most in ((500, 10_000), (1 << 24, 2 * 3 * 2 * 6)):  # parts, vaults, fields, terms
        monkeypatch.setattr(search.counting, "CHUNK", chunk)
        index = search.write_index(df, str(tmp_path / f"i{chunk}"), group=("vault",), positions=True)
        rows = index.postings.join(index.docs, ["vault", "doc"]).collect()
        assert {(r.vault, r.path, r.field, r.term): (r.tf, r.doc_len) for r in rows} == want and len(rows) == len(want)
        assert all(len(r.positions) == r.tf and r.block == int(4 * math.log2(1 + sum(len((x or "").replace("-", " ").split()) for x in docs[int(r.path[1:])][1:3]))) for r in rows)
        assert index.lists.count() <= most and index.docs.count() == 200
        # Only lists that are asked for are cut up, and none for counts or for scores by document.
        asked = spark.createDataFrame([(1, "a"), (1, "é")], "query_id long, term string")
        known = search.frequencies(index, asked)
        assert {(r.vault, r.field, r.term, r.df) for r in known.collect()} == {(r.vault, r.field, r.term, r.df) for r in search.statistics(index, asked)[1].collect()}
        lists = known.groupBy("vault", "field", "term", "mean", "idf").agg(F.collect_list("query_id").alias("queries"))
        plans = {"counts": known, "scores": search.bydoc.scores(index, lists, search.posting_weight(), 3, 10)}
        assert all("Generate" not in p._jdf.queryExecution().executedPlan().toString() for p in plans.values())


def test_postings_are_not_shuffled_for_few_documents(spark, tmp_path):
    docs = [(f"p{i:04d}", "", f"the w{i % 40} w{i % 7}") for i in range(900)]
    index = search.write_index(spark.createDataFrame(docs, "path string, title string, body string"), str(tmp_path / "i"))
    one = search.pruned_search(index, spark.createDataFrame([(i, f"the w{i}") for i in range(8)], "query_id long, text string"), 3)
    one.threshold()
    stage, rows = one.scored[1]
    # As for tables too large to be sent to every task unless the plan says so.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stage == "seeds, whole" and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    one.close()
