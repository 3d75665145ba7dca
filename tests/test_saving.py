"""Saves of the log by several writers, submitted answers, the index page."""

import datetime
import os
import threading

import pytest
from pyspark.sql import functions as F

from tomeflow.functions import payload, text
from tomeflow.operators import bundle, compile
from tomeflow.sources import eventlog

NOW = datetime.datetime(2026, 1, 1)


def docs(spark, *rows):
    return spark.createDataFrame([(u, c, i) for i, (u, c) in enumerate(rows)], "uri string, content string, position long")


def test_writers_at_once_lose_and_repeat_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    versions, errors = [], []

    def write(name):
        try:
            for i in range(3):
                versions.append(eventlog.save(spark, log, lambda known: eventlog.ingest(known, docs(spark, (f"{name}{i}", "x"), (f"{name}{i}b", "y")), NOW)))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(versions) == list(range(12))
    rows = eventlog.load(spark, log).collect()
    assert len(rows) == 24 and len({r.seq for r in rows}) == 24 and len({r.uri for r in rows}) == 24
    # A save's events stand side by side.
    order = [r.uri.removesuffix("b") for r in sorted(rows, key=lambda r: r.seq)]
    assert all(order[i] == order[i + 1] for i in range(0, 24, 2))


def test_a_stale_append_goes_behind_and_a_repeated_one_changes_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    empty = eventlog.load(spark, log)
    one, two = (eventlog.ingest(empty, docs(spark, (u, "x")), NOW) for u in "ab")
    eventlog.append(one, log, key="k1")
    eventlog.append(two, log)
    eventlog.append(one, log, key="k1")
    assert [(r.uri, r.seq) for r in eventlog.load(spark, log).orderBy("seq").collect()] == [("a", 0), ("b", 1)]


def test_what_a_writer_left_without_a_marker_is_no_part_of_the_log(spark, tmp_path):
    log = str(tmp_path / "log")
    eventlog.append(eventlog.ingest(eventlog.load(spark, log), docs(spark, ("a", "x")), NOW), log)
    eventlog.ingest(eventlog.load(spark, log), docs(spark, ("lost", "x")), NOW).write.parquet(f"{log}/events/dead")
    (tmp_path / "log/saves/.unfinished").write_text("{")
    assert [r.uri for r in eventlog.load(spark, log).collect()] == ["a"]
    assert eventlog.append(eventlog.ingest(eventlog.load(spark, log), docs(spark, ("b", "x")), NOW), log) == 1
    assert not [f for f in os.listdir(tmp_path / "log/saves") if f.startswith(".") and f.endswith(".tmp")]
    assert not eventlog._claim(spark, log, 1, "{}")


def test_failing_work_saves_nothing(spark, tmp_path):
    def make(log):
        raise KeyError("no")

    with pytest.raises(KeyError):
        eventlog.save(spark, str(tmp_path / "log"), make)
    assert eventlog.load(spark, str(tmp_path / "log")).count() == 0


def put(path, content):
    return f'{{"operations": [{{"action": "CREATE_OR_UPDATE", "path": "{path}", "content": "{content}"}}]}}'


def submission(spark, answers, jobs, pages=(), now="2026-01-01 00:10:00"):
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(answers)], "position long, job_id string, payload string")
    j = spark.createDataFrame([(*x, datetime.datetime(2026, 1, 1)) for x in jobs], "job_id string, kind string, key string, vault string, created_at timestamp")
    p = spark.createDataFrame(list(pages), "vault string, path string, content string")
    return compile.submit(a, j, p, F.lit(now).cast("timestamp"))


JOBS = [("j1", "compile", "u1", "v"), ("j2", "compile", "u2", "v"), ("j3", "fix_link", "slug", "w"), ("j4", "compile", "u4", "v")]


def test_one_bad_answer_leaves_the_others_applied(spark):
    gone = '{"operations": [{"action": "DELETE", "path": "wiki/old.md", "reason": "r"}]}'
    answers = [("j1", put("../out.md", "x")), ("j2", put("wiki/a.md", "A")), ("zz", put("wiki/z.md", "Z")), ("j3", put("wiki/./b.md", "B")), ("j4", gone), ("j1", "prose")]
    s = submission(spark, answers, JOBS, [("v", "wiki/old.md", "o"), ("w", "wiki/old.md", "kept")])
    got = [(r.job_id, r.status, r.touched) for r in s.results.orderBy("position").collect()]
    assert got == [("j1", "error", None), ("j2", "applied", ["wiki/a.md"]), ("zz", "error", None), ("j3", "applied", ["wiki/b.md"]), ("j4", "applied", ["wiki/old.md"]), ("j1", "error", None)]
    assert sorted(map(tuple, s.pages.collect())) == [("v", "wiki/a.md", "A"), ("w", "wiki/b.md", "B"), ("w", "wiki/old.md", "kept")]
    assert [r.job_id for r in s.jobs.collect()] == ["j1"]  # stays for another try
    assert sorted(r.key for r in s.compiled.collect()) == ["u2", "u4"]
    assert sorted(r.vault for r in s.vaults.collect()) == ["v", "w"]


def test_later_answers_hold_and_an_applied_job_is_closed(spark):
    answers = [("j1", "prose"), ("j1", put("wiki/a.md", "first")), ("j1", put("wiki/a.md", "late")), ("j2", put("wiki/a.md", "second"))]
    s = submission(spark, answers, JOBS)
    assert [(r.status, r.error) for r in s.results.orderBy("position").collect()] == [("error", "the answer isn't a valid payload"), ("applied", None), ("error", "job not found or expired"), ("applied", None)]
    assert [r.content for r in s.pages.collect()] == ["second"]


def test_old_jobs_and_empty_batches(spark):
    assert [r.error for r in submission(spark, [("j1", put("wiki/a.md", "x"))], JOBS, now="2026-01-01 00:40:00").results.collect()] == ["job not found or expired"]
    s = submission(spark, [], JOBS, [("v", "p", "c")])
    assert s.results.count() == s.vaults.count() == 0 and s.pages.count() == 1 and s.jobs.count() == 4


def test_a_path_that_is_no_page_is_refused(spark):
    for p in ("", ".", "wiki/..", "a/../", "/a", "../a"):
        assert submission(spark, [("j1", put(p, "x"))], JOBS).results.first().status == "error", p
        ops = spark.createDataFrame([(1, 0, "CREATE_OR_UPDATE", p, "x"), (1, 1, "CREATE_OR_UPDATE", "ok.md", "x"), (2, 0, "CREATE_OR_UPDATE", "b.md", "y")], "source_seq long, op_seq int, action string, path string, content string")
        assert [r.path for r in compile.apply_operations(spark.createDataFrame([], "path string, content string"), ops).collect()] == ["b.md"], p
    one = spark.createDataFrame([(put("", "x"),)], "p string")
    assert not one.select(payload.operations(F.col("p")).alias("o")).first().o.valid
    assert spark.range(1).select(text.writable(F.lit("a/./b.md")).alias("w")).first().w


def test_index_page_with_its_head(spark, tmp_path):
    pages = spark.createDataFrame([("wiki/b.md", "B", None), ("wiki/a.md", "A", "first")], "path string, title string, description string")
    bundle.write_index(pages, str(tmp_path / "i"), bundle.index_head("format_version", "0.2", "Wiki Index"))
    files = sorted(f for f in os.listdir(tmp_path / "i") if f.startswith("part"))
    whole = "".join((tmp_path / "i" / f).read_text() for f in files)
    assert whole == '---\nformat_version: "0.2"\n---\n\n# Wiki Index\n\n- [A](wiki/a.md) — first\n- [B](wiki/b.md)\n'
    bundle.write_index(pages.limit(0), str(tmp_path / "e"), bundle.index_head("v", "1", "T"))
    assert "".join((tmp_path / "e" / f).read_text() for f in sorted(os.listdir(tmp_path / "e")) if f.startswith("part")) == '---\nv: "1"\n---\n\n# T\n\n'
