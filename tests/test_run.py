"""A whole compile, from the log to the decision to publish."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import manifest, run
from tomeflow.sources import eventlog

NOW = datetime.datetime(2026, 1, 1)
SOURCE = "source_seq long, uri string, raw_id string, active string, old_id string, superseded string, related array<struct<path:string,content:string>>"


def page(title, body, source):
    return f'---\ntype: concept\ntitle: {title}\nsources:\n  - resource: "/raw/{source}.md"\n---\n{body}'


class Vault:
    def __init__(self, spark, folder, uris):
        self.spark, self.log, self.folder, self.n = spark, f"{folder}/log", f"{folder}/pages", 0
        docs = spark.createDataFrame([(u, u, i) for i, u in enumerate(uris)], "uri string, content string, position long")
        eventlog.save(spark, self.log, lambda log: eventlog.ingest(log, docs, NOW))
        self.pages = spark.createDataFrame([], "path string, content string")

    def entries(self):
        return manifest.entries(eventlog.load(self.spark, self.log))

    def sources(self):
        rows = [(i, r.uri, r.uri, r.uri, None, None, []) for i, r in enumerate(self.entries().where("pending").orderBy("uri").collect())]
        return self.spark.createDataFrame(rows, SOURCE)

    def save(self, pages, outcomes):
        self.n += 1
        pages.write.parquet(f"{self.folder}/{self.n}")
        eventlog.save(self.spark, self.log, lambda log: eventlog.compiled(log, outcomes, NOW))
        self.pages = self.spark.read.parquet(f"{self.folder}/{self.n}")
        return self.pages

    def run(self, synthesise, files):
        blobs = self.spark.createDataFrame([(f,) for f in files], "path string")
        return run.compile_vault(self.sources(), synthesise, self.pages, self.save, self.entries, blobs, wave=2)


def answers(**bodies):
    def synthesise(prompt):
        uri = prompt.split("id: ")[1].split("\n")[0]
        body = bodies.get(uri, f"about {uri} [[a]]")
        if body is None:
            raise RuntimeError("busy")
        made = body if body.startswith("---") or body == "broken" else page(uri.upper(), body, uri)
        return json.dumps({"operations": [{"action": "CREATE_OR_UPDATE", "path": f"wiki/concepts/{uri}.md", "content": made}]})

    return synthesise


def test_a_clean_run_is_publishable(spark, tmp_path):
    v = Vault(spark, tmp_path, "abc")
    r = v.run(answers(), ["raw/a.md", "raw/b.md", "raw/c.md"])
    assert r.publishable and r.outcomes.where("error IS NOT NULL").count() == 0
    assert [x.line for x in r.index.collect()] == ["- [A](wiki/concepts/a.md)", "- [B](wiki/concepts/b.md)", "- [C](wiki/concepts/c.md)"]
    assert sorted((x.kind, x.page) for x in r.findings.collect()) == [("orphan_page", "wiki/concepts/b.md"), ("orphan_page", "wiki/concepts/c.md")]
    again = v.run(answers(), ["raw/a.md", "raw/b.md", "raw/c.md"])  # nothing is pending
    assert again.publishable and again.outcomes.count() == 0 and again.pages.count() == 3


def test_a_failed_source_keeps_the_others_and_stays_pending(spark, tmp_path):
    v = Vault(spark, tmp_path, "abc")
    r = v.run(answers(b=None), ["raw/a.md", "raw/b.md", "raw/c.md"])
    assert not r.publishable
    assert [(x.uri, x.error) for x in r.outcomes.orderBy("uri").collect()] == [("a", None), ("b", "RuntimeError: busy"), ("c", None)]
    assert sorted(x.path for x in r.pages.collect()) == ["wiki/concepts/a.md", "wiki/concepts/c.md"]
    assert [x.page for x in r.findings.where("kind = 'pending_compile'").collect()] == ["b"]
    assert v.run(answers(), ["raw/a.md", "raw/b.md", "raw/c.md"]).publishable


@pytest.mark.parametrize("bodies, files", [({"b": "see [[nowhere]]"}, "abc"), ({}, "ab"), ({"b": "broken"}, "abc")])
def test_lint_errors_and_unreadable_pages_stop_publishing(spark, tmp_path, bodies, files):
    r = Vault(spark, tmp_path, "abc").run(answers(**bodies), [f"raw/{f}.md" for f in files])
    assert not r.publishable and r.outcomes.where("error IS NOT NULL").count() == 0
    assert r.unreadable.count() == (bodies.get("b") == "broken")
    assert r.summary.select(F.col("n_broken_link") + F.col("n_missing_source")).first()[0] == (0 if bodies.get("b") == "broken" else 1)
