"""From ingest to search, with a synthesiser and an embedder that are plain functions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tomeflow.functions import payload, text
from tomeflow.operators import compile, embed, lint, manifest, search, store
from tomeflow.sources import eventlog, files, paths, vault

NOW = datetime.datetime(2024, 1, 1)


def docs(spark, *rows):
    return spark.createDataFrame([(u, c, i) for i, (u, c) in enumerate(rows)], "uri string, content string, position long")


def test_ingest_again_change_delete_purge(spark, tmp_path):
    log = str(tmp_path / "log")
    assert eventlog.load(spark, log).count() == 0

    def step(events):
        got = sorted((r.uri, r.outcome) for r in eventlog.outcomes_of(eventlog.load(spark, log), events).collect())
        eventlog.append(events, log)
        return got

    assert step(eventlog.ingest(eventlog.load(spark, log), docs(spark, ("a", "1"), ("b", "1")), NOW)) == [("a", "new"), ("b", "new")]
    assert step(eventlog.ingest(eventlog.load(spark, log), docs(spark, ("a", "1"), ("b", "2")), NOW)) == [("a", "no_op"), ("b", "superseded")]
    assert step(eventlog.delete(eventlog.load(spark, log), docs(spark, ("a", ""), ("c", "")), NOW, "gone")) == [("a", "tombstoned"), ("c", "error")]
    assert step(eventlog.ingest(eventlog.load(spark, log), docs(spark, ("b", "1")), NOW)) == [("b", "superseded")]
    assert step(eventlog.delete(eventlog.load(spark, log), docs(spark, ("b", "")), NOW, purge=True)) == [("b", "purged")]
    assert [(r.uri, r.status) for r in manifest.versions(eventlog.load(spark, log)).collect()] == [("a", "TOMBSTONED")]


def test_compile_run(spark):
    def synthesise(p):
        if "bad" in p:
            return "I can't do that."
        if "boom" in p:
            raise RuntimeError("down")
        return json.dumps({"operations": [{"action": "CREATE_OR_UPDATE", "path": "wiki/concepts/n.md", "content": p[:9]}]})

    kind = "source_seq long, uri string, raw_id string, active string, old_id string, superseded string, related array<struct<path:string,content:string>>"
    sources = spark.createDataFrame([(1, "a", "r1", "good", None, None, []), (2, "b", "r2", "bad", "r0", "old", [("p", "c")]), (3, "c", "r3", "boom", None, None, [])], kind)
    pages = spark.createDataFrame([("wiki/concepts/o.md", "x")], "path string, content string")
    after, outcomes = compile.compile_sources(sources, synthesise, pages, 2)
    assert {r.path for r in after.collect()} == {"wiki/concepts/o.md", "wiki/concepts/n.md"}
    errors = {r.uri: r.error for r in outcomes.collect()}
    assert errors == {"a": None, "b": "the answer isn't a valid payload", "c": "RuntimeError: down"}
    counts = compile.outcome_counts(outcomes)
    assert tuple(counts.first()) == (1, 2)
    none = spark.createDataFrame([], "kind string, page string, target string")
    assert not compile.publishable(lint.summary(none), counts)


def test_prompts(spark):
    df = spark.createDataFrame([("s", [("p", "links")], [("r", "facts")])], "slug string, pages array<struct<path:string,content:string>>, sources array<struct<id:string,content:string>>")
    p = df.select(compile.link_fix_prompt(F.col("slug"), F.col("pages"), F.col("sources")).alias("p")).first().p
    assert "[[s]]" in p and "path: p\n```markdown\nlinks\n```" in p and "id: r\n```markdown\nfacts\n```" in p
    t = spark.createDataFrame([("x" * 400, None, 0), ("x" * 400, "y" * 800, 20)], "a string, s string, r long")
    assert [r.n for r in t.select(text.prompt_tokens(F.col("a"), F.col("s"), F.col("r")).alias("n")).collect()] == [100, 320]


def test_embed_and_refresh(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    d = spark.createDataFrame([("p1", "intro\n## A\nxx"), ("p2", "yyyy")], "path string, body string")
    stored = embed.embed(embed.sections_of(d), load)
    assert {r.section_key: list(r.vector) for r in stored.collect()} == {"p1#0": [5.0, 1.0], "p1#1": [2.0, 1.0], "p2#0": [4.0, 1.0]}
    after = embed.refresh(stored, spark.createDataFrame([("p1", "zzz")], "path string, body string"), load)
    assert {r.section_key: r.vector[0] for r in after.collect()} == {"p1#0": 3.0, "p2#0": 4.0}
    q = spark.createDataFrame([(1, [3.1, 1.0])], "query_id long, vector array<double>")
    assert search.nearest(after, q, 1).first().section_key == "p1#0"


def test_sandboxed_files_and_output(spark, tmp_path):
    root = str(tmp_path)
    files.write_text(root, "wiki/a.md", "x")
    assert files.read_text(root, "raw/../wiki/a.md") == "x" and files.exists(root, "wiki/a.md")
    assert files.remove(root, "wiki/a.md") and not files.remove(root, "wiki/a.md")
    with pytest.raises(ValueError):
        files.write_text(root, "../out.md", "x")
    found = spark.createDataFrame([(1, "p", 0.5, "T")], "rank int, path string, score double, title string")
    assert files.results_text(found) == "1. T (p, 0.5000)" and files.results_text(found.limit(0)) == "No results."
    assert json.loads(files.rows_json(found)) == [{"rank": 1, "path": "p", "score": 0.5, "title": "T"}]


def test_index_and_blob_text(spark, tmp_path):
    d = spark.createDataFrame([("p1", "t", "a b a")], "path string, title string, body string")
    search.write_postings(d, str(tmp_path / "i"))
    search.write_postings(d, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3
    b = spark.range(1).select(eventlog.blob_text(F.lit("raw_1"), F.lit("u"), F.lit("sha256:x"), F.lit("now"), F.lit("# T\nbody")).alias("b")).first().b
    row = spark.createDataFrame([(b,)], "b string").select(text.raw_body(F.col("b")).alias("body")).first()
    assert row.body == "\n# T\nbody"


def test_payloads_are_whole_or_nothing(spark):
    ok = '{"action": "CREATE_OR_UPDATE", "path": "a", "content": "c"}'
    whole = lambda *ops: '{"operations": [' + ", ".join(ops) + "]}"
    cases = [
        (whole(ok), True),
        (f"```json\n{whole(ok)}\n```", True),
        ('{"operations": []}', True),
        (whole(ok) + " trailing", False),
        (whole(ok) + "] [{}", False),
        (whole(ok) + ', "x"', False),
        ("Sure: " + whole(ok), False),
        (whole('{"action": "CREATE_OR_UPDATE", "path": "a", "content": 5}'), False),
        (whole('{"action": "CREATE_OR_UPDATE", "path": "a"}'), False),
        (whole('{"action": "DELETE", "path": "a"}'), False),
        (whole('{"action": "DELETE", "path": "a", "reason": "r"}'), True),
        (whole('{"action": "RENAME", "path": "a"}'), False),
        (whole(ok, '{"action": "DELETE", "path": 1, "reason": "r"}'), False),
        ('{"operations": null}', False),
        ("[]", False),
        ("{not json", False),
        ("", False),
        (None, False),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "source_seq long, payload string")
    got = {r.source_seq: r.valid for r in df.select("source_seq", payload.operations(F.col("payload"))["valid"].alias("valid")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]
    assert {r.source_seq for r in compile.parse_results(df).collect()} == {0, 1, 10}


def test_paths_that_leave_the_vault_fail_their_source(spark):
    def synthesise(p):
        bad = "bad" in p
        return json.dumps({"operations": [{"action": "CREATE_OR_UPDATE", "path": "wiki/./x/../a.md", "content": p[:9]}] + [{"action": "DELETE", "path": "../../etc/passwd", "reason": "r"}] * bad})

    kind = "source_seq long, uri string, raw_id string, active string, old_id string, superseded string, related array<struct<path:string,content:string>>"
    sources = spark.createDataFrame([(1, "a", "r1", "good", None, None, []), (2, "b", "r2", "bad", None, None, [])], kind)
    after, outcomes = compile.compile_sources(sources, synthesise, spark.createDataFrame([("wiki/a.md", "old")], "path string, content string"))
    assert {r.path: r.content for r in after.collect()} == {"wiki/a.md": "# Source\n"}
    assert {r.uri: r.error for r in outcomes.collect()} == {"a": None, "b": "a path leaves the vault"}


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    """The second save fails, as at a crash: what was saved before stays compiled, and no later source is asked."""
    calls = tmp_path / "asked"
    calls.mkdir()

    def synthesise(p):
        uri = p.split("id: ")[1].split("\n")[0]
        (calls / uri).write_text("")
        return json.dumps({"operations": [{"action": "CREATE_OR_UPDATE", "path": f"wiki/{uri}.md", "content": uri}]})

    log, folder = str(tmp_path / "log"), str(tmp_path / "pages")
    eventlog.append(eventlog.ingest(eventlog.load(spark, log), docs(spark, *((u, u) for u in "abcd")), NOW), log)
    saved = []

    def save(pages, outcomes):
        if len(saved) == 1:
            raise OSError("disk full")
        path = f"{folder}/{len(saved)}"
        pages.write.parquet(path)
        eventlog.append(eventlog.compiled(eventlog.load(spark, log), outcomes, NOW), log)
        saved.append(path)
        return spark.read.parquet(path)

    def pending():
        entries = manifest.entries(eventlog.load(spark, log)).where("pending").select("uri")
        rows = [(i, r.uri, r.uri, r.uri, None, None, []) for i, r in enumerate(entries.orderBy("uri").collect())]
        return spark.createDataFrame(rows, "source_seq long, uri string, raw_id string, active string, old_id string, superseded string, related array<struct<path:string,content:string>>")

    none = spark.createDataFrame([], "path string, content string")
    with pytest.raises(OSError):
        compile.compile_in_waves(pending(), synthesise, none, save)
    assert sorted(p.name for p in calls.iterdir()) == ["a", "b"] and [r.uri for r in pending().collect()] == ["b", "c", "d"]
    saved.append("crash")
    pages = spark.read.parquet(saved[0])
    done = compile.compile_in_waves(pending(), synthesise, pages, save, workers=2)
    assert done.where("error IS NULL").count() == 3 and pending().count() == 0
    assert sorted(r.path for r in spark.read.parquet(saved[-1]).collect()) == [f"wiki/{u}.md" for u in "abcd"]


def test_registry_verbs(tmp_path):
    registry, folder = str(tmp_path / "r.toml"), tmp_path / "v"
    paths.create_vault(registry, "v", str(folder), "mine")
    assert (folder / "wiki/concepts").is_dir() and (folder / "raw").is_dir()
    with pytest.raises(ValueError):
        paths.create_vault(registry, "w", str(folder))
    paths.add_vault(registry, "w", "/elsewhere")
    with pytest.raises(LookupError):
        paths.default_vault(registry, "x")
    paths.default_vault(registry, "v")
    assert {n: v["is_default"] for n, v in paths.registry(registry).items()} == {"v": True, "w": False}
    with pytest.raises(PermissionError):
        paths.delete_vault(registry, "v")
    paths.delete_vault(registry, "v", force=True)
    assert not folder.exists() and list(paths.registry(registry)) == ["w"] and not paths.registry(registry)["w"]["is_default"]
    paths.remove_vault(registry, "w")
    assert paths.registry(registry) == {}


def test_reports_are_whole(spark):
    rows = [("orphan_page", f"p{i:04d}", None) for i in range(1_500)] + [("broken_link", 'a"b', "x"), ("pending_compile", "u", None)]
    found = spark.createDataFrame(rows, "kind string, page string, target string")
    text_, cut = lint.report(found).split("\n"), lint.report(found, limit=10).split("\n")
    assert len(text_) == 1_500 + 2 + 3 + 1 and len(cut) < 20 and "  and 1490 more" in cut
    whole = json.loads(lint.report_document(found))
    assert whole["broken_links"] == [['a"b', "x"]] and whole["pending_compiles"] == ["u"] and len(whole["orphan_pages"]) == 1_500 and whole["missing_sources"] == []


def test_one_bad_page_doesnt_end_the_job(spark):
    def convert(html):
        if "bad" in html:
            raise ValueError("no")
        return html.upper()

    got = {r.uri: (r.content, r.error) for r in vault.web_documents(spark.createDataFrame([("u", "x"), ("v", "bad"), ("w", None)], "url string, html string"), convert).collect()}
    assert got == {"u": ("X", None), "v": (None, "ValueError: no"), "w": (None, "no content")}


def test_changes_of_one_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    new = spark.createDataFrame([("b", 9, 1), ("b", 2, 2), ("c", 2, 1)], "path string, v int, at int")
    assert {tuple(r) for r in store.upsert(old, new, order="at").collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_a_batch_says_what_is_left(spark):
    pending = spark.createDataFrame([("u2",), ("u1",), ("u3",)], "uri string")
    fixes = spark.createDataFrame([("s1", False), ("s2", True)], "slug string, ready boolean")
    assert [tuple(r) for r in compile.next_batch(pending, fixes, 2).collect()] == [("compile", "u1", 1), ("compile", "u2", 1)]
    assert [tuple(r) for r in compile.next_batch(pending.limit(0), fixes, 9).collect()] == [("fix_link", "s2", 0)]


def test_tags_of_blobs(spark, tmp_path):
    some = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "tags array<string>")
    heads = [r.b.split("\n---\n")[0].split("now")[1] for r in some.select(eventlog.blob_text(F.lit("r"), F.lit("u"), F.lit("h"), F.lit("now"), F.lit("x"), F.col("tags")).alias("b")).collect()]
    assert heads == ["\ntags:\n- a\n- b", "", ""]
    docs_ = spark.createDataFrame([("v", "u", "x", "now", ["a"]), ("v", "w", "y", "now", None)], "vault string, uri string, content string, ingested_at string, tags array<string>")
    vault.append_blobs(docs_, str(tmp_path / "blobs"))
    assert {r.source_url: r.tags for r in spark.read.parquet(str(tmp_path / "blobs")).collect()} == {"u": ["a"], "w": []}
    ops = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "a")], "vault string, path string")
    assert sorted(r.vault for r in compile.touched_vaults(ops).collect()) == ["v", "w"]
