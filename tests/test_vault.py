import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import bundle, compile, lint, store
from tomeflow.sources import paths, vault
from tomeflow.streaming import breaker as chunked
from tomeflow.streaming import state

PAGE = '---\ntype: concept\ntitle: A\nsources:\n  - resource: "/raw/r1"\ntags: [x]\n---\nbody [[b]] [[missing]]'


@pytest.fixture
def root(tmp_path):
    for d in ("raw/deeper", "wiki/concepts/sub", "wiki/entities", ".vault"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "raw/r1.md").write_text("---\nchecksum: x\n---\n\n# Raw one\ntext")
    (tmp_path / "raw/deeper/r2.md").write_text("not read")
    (tmp_path / "wiki/concepts/a.md").write_text(PAGE)
    (tmp_path / "wiki/concepts/sub/b.md").write_text("---\ntype: concept\ntitle: B\nid: concept_bee\n---\nback to [[a]]")
    (tmp_path / "wiki/entities/bad.md").write_text("---\ntype: Person\n---\nno title")
    (tmp_path / "wiki/entities/typo.md").write_text("no front matter")
    return str(tmp_path)


def test_scans_and_lint(spark, root):
    raw = vault.raw_files(spark, root)
    assert [(r.path, r.raw_id, r.title) for r in raw.collect()] == [("raw/r1.md", "r1", "Raw one")]
    pages = vault.wiki_pages(spark, root)
    errors = {r.slug: r.parse_error for r in pages.collect()}
    assert errors["a"] is None and errors["b"] is None and "required" in errors["bad"] and errors["typo"] == "no front matter"
    good = pages.where("parse_error IS NULL")
    links = lint.links(good)
    assert [(r.page, r.target) for r in lint.broken_links(links, good).collect()] == [("wiki/concepts/a.md", "missing")]
    missing = lint.missing_sources(vault.provenance(good), raw)
    fixes = lint.fixable_sources(missing, raw, good)
    assert [(r.old, r.new) for r in fixes.collect()] == [("/raw/r1", "/raw/r1.md")]
    fixed = {r.path: r.content for r in lint.apply_source_fixes(good.select("path", "content"), fixes).collect()}
    assert '"/raw/r1.md"' in fixed["wiki/concepts/a.md"]
    docs = vault.search_documents(raw, spark.createDataFrame([("r1",)], "raw_id string"), pages)
    assert {(r.title, r.doc_type) for r in docs.collect()} == {("Raw one", "raw"), ("A", "concept"), ("B", "concept")}
    asked = spark.createDataFrame([("wiki/concepts/a.md",), ("b",), ("bee",), ("nothing",)], "asked string")
    assert {r.asked: r.path for r in bundle.resolve(good, asked).collect()} == {
        "wiki/concepts/a.md": "wiki/concepts/a.md", "b": "wiki/concepts/sub/b.md", "bee": "wiki/concepts/sub/b.md", "nothing": None}


def test_report(spark):
    none = spark.createDataFrame([], "kind string, page string, target string")
    assert lint.report(none) == "OK: no lint issues found."
    some = spark.createDataFrame([("broken_link", "a.md", "x"), ("orphan_page", "b.md", None)], none.schema)
    lines = lint.report(some).split("\n")
    assert lines[0] == "Broken links (1):" and lines[1] == "  a.md -> [[x]] (target does not exist)" and lines[-1].startswith("FAILED")


def test_missing_folders_are_empty(spark, tmp_path):
    assert vault.raw_files(spark, str(tmp_path)).count() == vault.wiki_pages(spark, str(tmp_path)).count() == 0


def test_id_repair():
    broken = "---\ntype: c\ntitle: T\ntid: x\nsources: 5\n---\nb"
    assert vault.repair_id(broken) is None and vault.repair_id(PAGE) is None
    assert vault.parse_page("---\ntype: c\ntitle: T\n---\nb")["parse_error"] is None


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda *t: f"<w:tc>{''.join(map(p, t))}</w:tc>"
    xml = f"<w:document {w}><w:body>{p('One')}{p('')}<w:tbl><w:tr>{cell('a', 'b')}{cell('c')}</w:tr><w:tr>{cell('d')}{cell('e')}</w:tr></w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "x.DOCX").write_bytes(data.getvalue())
    (tmp_path / "y.txt").write_text("plain")
    (tmp_path / "z.bin").write_text("?")
    got = {os.path.basename(r.uri): (r.content, r.error) for r in vault.local_documents(spark, str(tmp_path)).collect()}
    assert got["x.DOCX"] == ("One\n\na b | c\nd | e", None) and got["y.txt"] == ("plain", None) and got["z.bin"][1] == "unsupported extension: bin"


def test_paths_and_registry(tmp_path):
    assert str(paths.inside("/v", "raw/../wiki/i.md")) == "/v/wiki/i.md"
    for bad in ("../x", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            paths.inside("/v", bad)
    file = str(tmp_path / "c/vaults.toml")
    assert paths.registry(file) == {}
    paths.save_registry(file, {"b": {"path": '/x "q"', "description": "d", "is_default": True}, "a": {"path": "/y"}})
    v = paths.registry(file)
    assert list(v) == ["a", "b"] and v["b"]["is_default"] and v["b"]["path"] == '/x "q"'
    (tmp_path / "vault/.vault").mkdir(parents=True)
    (tmp_path / "vault/in/here").mkdir(parents=True)
    assert paths.resolve_vault("a", "/", v) == "/y"
    assert paths.resolve_vault(None, str(tmp_path / "vault/in/here"), v) == str(tmp_path / "vault")
    assert paths.resolve_vault(None, "/", v) == '/x "q"'
    assert paths.merge_layers({"a": {"x": 1}}, {"a": {"x": 2, "y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}


def test_blobs(spark, tmp_path):
    docs = spark.createDataFrame([("v", "u1", "same", "t"), ("v", "u2", "same", "t"), ("w", "u1", "same", "t")], "vault string, uri string, content string, ingested_at string")
    vault.append_blobs(docs, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).groupBy("vault").count().collect().__len__() == 2


def test_trim_equals_popping_from_the_tail(spark):
    rng = random.Random(0)
    rows = [(q, r, rng.randrange(50)) for q in range(60) for r in range(1, 8)]
    df = spark.createDataFrame(rows, "query_id long, rank int, tokens long")
    got = {}
    for r in compile.trim_related(df, F.lit(20), 100).collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    for q in range(60):
        kept = [(r, t) for k, r, t in rows if k == q]
        while kept and 20 + sum(t for _, t in kept) > 100:
            kept.pop()
        assert sorted(got.get(q, [])) == [r for r, _ in kept]


def test_jobs_run_apart_and_batches_move_on(spark):
    jobs = spark.createDataFrame([(1, "ok"), (2, "boom")], "source_seq long, prompt string")

    def synthesise(p):
        if p == "boom":
            raise RuntimeError("no")
        return '{"operations": [{"action": "CREATE_OR_UPDATE", "path": "a.md", "content": "new"}, {"action": "DELETE", "path": "gone.md", "reason": "merged"}]}'

    results = compile.run_jobs(jobs, synthesise, 2)
    assert {r.source_seq: r.error for r in results.collect()} == {1: None, 2: "RuntimeError: no"}
    pages = spark.createDataFrame([("a.md", "old"), ("b.md", "kept"), ("gone.md", "x")], "path string, content string")
    after = compile.apply_operations(pages, compile.parse_results(results))
    assert {r.path: r.content for r in after.collect()} == {"a.md": "new", "b.md": "kept"}
    pending = spark.createDataFrame([("u2",), ("u1",)], "uri string")
    fixes = spark.createDataFrame([("s1", False), ("s2", True)], "slug string, ready boolean")
    assert [r.key for r in compile.next_batch(pending, fixes, 1).collect()] == ["u1"]
    assert [r.key for r in compile.next_batch(pending.limit(0), fixes, 0).collect()] == ["s2"]


def test_upsert_and_remove(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "path string, v int")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in store.remove(old, new).collect()} == {("a", 1)}


def limiter(times, limit, window):
    passed, out = [], []
    for t in times:
        passed = [p for p in passed if t - p < window]
        out.append(len(passed) < limit)
        passed += [t] * out[-1]
    return out


def breaker(calls, threshold, reset):
    mode, failures, since, out = "closed", 0, 0.0, []
    for t, bad in calls:
        if mode == "open" and t - since >= reset:
            mode = "half_open"
        out.append(mode)
        if mode == "open":
            continue
        failures = failures + 1 if bad else 0
        if bad and (mode == "half_open" or failures >= threshold):
            mode, since = "open", t
        elif not bad:
            mode = "closed"
    return out


def test_folds_equal_plain_loops(spark):
    rng = random.Random(4)
    calls = [(rng.choice(["a", "b"]), i, round(rng.random() * 100, 3), rng.random() < 0.6) for i in range(600)]
    df = spark.createDataFrame(calls, "k string, call_id long, t double, failed boolean").repartition(7)
    allowed = {r.call_id: r.result for r in state.rate_limiter(df, "k", 5, 2.0).collect()}
    met = {r.call_id: r.result for r in chunked.circuit_breaker(df, "k", 3, 1.5).collect()}
    for k in "ab":
        own = sorted((c for c in calls if c[0] == k), key=lambda c: (c[2], c[1]))
        assert [allowed[c[1]] for c in own] == limiter([c[2] for c in own], 5, 2.0)
        assert [met[c[1]] for c in own] == breaker([(c[2], c[3]) for c in own], 3, 1.5)


def test_a_breaker_in_chunks_meets_what_one_fold_meets(spark):
    rng = random.Random(6)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "Z", "é", None])
    calls = [(key(), i, float(rng.randrange(200)) / 3, rng.random() < 0.7) for i in range(900)]
    df = spark.createDataFrame(calls, "k string, call_id long, t double, failed boolean").repartition(5)
    for threshold, reset, rows in ((3, 1.5, 40), (1, 10.0, 40), (5, 0.0, 40), (2, 5.0, 10_000)):
        met = {r.call_id: r.result for r in chunked.circuit_breaker(df, "k", threshold, reset, rows).collect()}
        assert len(met) == 900
        for k in {c[0] for c in calls}:
            own = sorted((c for c in calls if c[0] == k), key=lambda c: (c[2], c[1]))
            assert [met[c[1]] for c in own] == breaker([(c[2], c[3]) for c in own], threshold, reset)
    assert chunked.circuit_breaker(df.limit(0), "k").count() == 0


def test_a_chunk_is_a_function_of_the_state_before():
    rng = random.Random(2)
    for _ in range(300):
        times = sorted(rng.randrange(60) / 2 for _ in range(rng.randint(1, 25)))
        failed = [rng.random() < 0.6 for _ in times]
        threshold, reset = rng.randint(1, 4), rng.choice([0.0, 1.0, 4.5])
        made = chunked.summary(times, failed, threshold, reset)
        for state_ in [(f, 0.0) for f in range(threshold)] + [(chunked.OPEN, times[0] - rng.randrange(12) / 2) for _ in range(5)]:
            assert chunked.through(state_, *made, reset) == chunked.fold(state_, times, failed, threshold, reset)[0]
    # Only calls within the time to reset matter to a breaker that opened before: a long chunk is few numbers.
    assert len(chunked.summary([float(i) for i in range(5_000)], [i % 7 > 0 for i in range(5_000)], 5, 30.0)[1]) < 50


def test_one_key_with_all_calls_is_dealt_to_several_tasks(spark):
    df = spark.range(4_000).selectExpr("'k' AS k", "id AS call_id", "id * 0.5D AS t", "id % 3 > 0 AS failed")
    found = chunked.circuit_breaker(df, "k", 2, 5.0, chunk_rows=500)
    met = {r.call_id: r.result for r in found.collect()}
    assert [met[i] for i in range(4_000)] == breaker([(i * 0.5, i % 3 > 0) for i in range(4_000)], 2, 5.0)
