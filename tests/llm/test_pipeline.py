import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tomeflow.llm import decontaminate, pii, registry
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute as groups
from tests.llm.test_toxicity import corpus

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases: toxic ones, copies, a benchmark passage, personal data, nulls and extra columns."""
    base = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus(1200)
    item = " ".join(f"item{i}" for i in range(40))
    docs = [(i, f"doc{i} {t}") for i, t in docs]
    docs += [(5000, docs[0][1]), (5001, docs[1][1]), (5002, f"see {item} here"), (5003, "call +1 (017) 555-7713 or mail a@b.cd today please"), (5004, None), (5005, ""), (None, "nobody knows this one at all")]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t else None, "extra") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, PLACE string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, docs, {i for i, _, t in labels if t}


def test_stages_one_after_another(spark, folder, tmp_path):
    base, texts, toxic = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, base)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((before, docs.collect()))
        if k < 4:
            assert docs.columns == columns
    before, after = seen[0]
    left = {r.doc_id for r in after}
    gone = set(before) - left
    assert len(gone & toxic) >= 0.95 * len(toxic & set(before)) and len(gone - toxic - {5000, 5001}) <= 5
    before, after = seen[1]
    want = {g for *_, g in groups([(i, r.text) for i, r in before.items()])}
    assert {r.doc_id for r in after} == want and len(after) == len(want) and None in want
    assert not {5000, 5005} & {r.doc_id for r in after}
    before, after = seen[2]
    assert set(before) - {r.doc_id for r in after} == {i for i, r in before.items() if contaminated(r.text, [(1, " ".join(f"item{i}" for i in range(40)))])[4]} == {5002}
    before, after = seen[3]
    changed = {r.doc_id: r for r in after}
    assert changed[5003].text == "call [PHONE] or mail [EMAIL] today please" and changed[5003].n_chars == len(changed[5003].text)
    assert all(changed[i].text == r.text for i, r in before.items() if r.text and not pii.graph(r.text)) and changed[5004].text is None
    before, after = seen[4]
    assert docs.columns == [*columns, "n_tokens", "block", "_place"] and {r.doc_id for r in after} <= set(before)


def test_run_is_the_stages(spark, folder):
    base, *_ = folder
    out = corpus_pipeline.run(spark, base)
    assert {"doc_id", "n_tokens", "block"} <= set(out.columns) and out.count() > 500


def test_empty_documents(spark, folder, tmp_path):
    base, *_ = folder
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{base}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_every_operator_has_one_query_over_its_whole_table(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    n = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in registry.QUERIES.items():
        table = "pages" if name in ("op4_urls", "op9_html") else "documents"
        rows = query(spark, FOLDER).count()
        if name == "op12_audit":  # every order and step of each part
            assert rows > 0 and rows % 600 == 0
        else:
            assert rows > 0 if name in ("op3_mixing", "op5_topk") else rows == n[table], name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from tests.oracle import connect, rows_of_spark, rows_of_sql

    df = registry.QUERIES[name](spark, FOLDER)
    assert rows_of_spark(df) == rows_of_sql(connect(FOLDER), registry.ORACLE_SQL[name], df.columns)


def test_benchmark_of_the_real_tables_by_brute_force(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()}
    known = [(r.item_id, r.text) for r in items.collect()]
    for r in docs.where(F.length("text") < 3000).collect():
        assert got[r.doc_id] == contaminated(r.text, known)
