import pytest
from pyspark.sql import functions as F

from tomeflow.functions import payload, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "body, links",
    [
        ("see [[a]] and [[b]]", [("local", None, "a"), ("local", None, "b")]),
        ("[[v::c]]", [("cross_vault", "v", "c")]),
        ("[[slug|shown]] [[v::c|shown]]", [("local", None, "slug"), ("cross_vault", "v", "c")]),
        ("[[|x]]", [("local", None, "")]),
        ("[[]] [[never closed", []),
        ("[[two\nlines]] [[ok]]", [("local", None, "ok")]),
        ("[[[z]]]", [("local", None, "[z")]),
        ("no links", []),
    ],
)
def test_wikilinks(spark, body, links):
    assert [(r.kind, r.vault, r.slug) for r in one(spark, text.wikilinks, body)] == links


@pytest.mark.parametrize(
    "body, want",
    [
        ("intro\n## First\none\n## Second\ntwo", [(None, "intro"), ("First", "one"), ("Second", "two")]),
        ("no headings", [(None, "no headings")]),
        ("## Empty\n\n## Full\nx", [("Full", "x")]),
        ("### deeper\nx", [(None, "### deeper\nx")]),
        ("a\r\n## H \r\nb\r\n", [(None, "a"), ("H", "b")]),
        ("", [(None, "")]),
        (None, [(None, "")]),
        ("## only a heading", [(None, "")]),
    ],
)
def test_sections(spark, body, want):
    assert [(s.heading, s.text) for s in one(spark, text.sections, body)] == want


def test_tokens_and_truncation(spark):
    assert one(spark, text.estimate_tokens, "x" * 400) == 100
    assert one(spark, text.estimate_tokens, "abc") == 1
    assert one(spark, text.estimate_tokens, "") == 0
    assert one(spark, text.estimate_tokens, "é😀x") == 1
    cut = one(spark, lambda c: text.truncate_to_budget(c, F.lit(100)), "y" * 1000)
    assert cut == "y" * 400 + "\n\n[... truncated 600 chars over budget ...]"
    assert one(spark, lambda c: text.truncate_to_budget(c, F.lit(100)), "y" * 400) == "y" * 400


@pytest.mark.parametrize(
    "a, s, budget, want", [(10, 20, 40, (10, 20)), (10, 90, 40, (10, 30)), (90, 10, 40, (30, 10)), (90, 90, 41, (20, 21)), (90, None, 40, (40, None))]
)
def test_shared_budgets(spark, a, s, budget, want):
    df = spark.createDataFrame([(a, s)], "a long, s long")
    r = df.select(text.shared_budgets(F.col("a"), F.col("s"), F.lit(budget).cast("long")).alias("y")).first().y
    assert (r.active, r.superseded) == want


def test_front_matter_and_titles(spark):
    body = one(spark, text.raw_body, "---\na: b\n---\n\n# Title \nrest")
    assert body == "\n# Title \nrest"
    assert one(spark, text.raw_title, body) == "Title"
    assert one(spark, text.raw_title, "## no\ntext") == ""
    assert one(spark, text.raw_body, "---\nnever closed") == "---\nnever closed"


@pytest.mark.parametrize("path, stem", [("raw/a.b.md", "a.b"), ("a", "a"), ("x/.hidden", ".hidden"), ("x/.h.md", ".h"), ("/raw/r1", "r1")])
def test_file_stem(spark, path, stem):
    assert one(spark, text.file_stem, path) == stem


@pytest.mark.parametrize("path, ok", [("raw/a.md", True), ("raw/../wiki/index.md", True), ("../x", False), ("/etc/passwd", False), ("a/../../b", False), ("./a", True)])
def test_inside_vault(spark, path, ok):
    assert one(spark, text.inside_vault, path) is ok


def test_terms(spark):
    assert one(spark, text.terms, "Rate-Limits, É2! " + "z" * 40) == ["rate", "limits", "é2"]
    assert one(spark, text.terms, None) == []


def test_model_spec_and_urls(spark):
    assert tuple(one(spark, text.model_spec, "p/m/x")) == ("p", "m/x")
    assert one(spark, text.model_spec, "p/") is None and one(spark, text.model_spec, "/m") is None
    assert one(spark, text.base_url, "host:1") == "http://host:1/"
    assert one(spark, text.env_name, "my-model.1") == "MY_MODEL_1"
    assert one(spark, text.slashes, "a\\b") == "a/b"


@pytest.mark.parametrize(
    "p, valid",
    [
        ('{"operations": [{"action": "CREATE_OR_UPDATE", "path": "a", "content": "x"}]}', True),
        ('```json\n{"operations": [{"action": "DELETE", "path": "a", "reason": "r"}]}\n```', True),
        ('{"operations": []}', True),
        ("Sure! Here it is.", False),
        ('{"operations": [{"action": "MOVE", "path": "a"}]}', False),
        ('{"operations": [{"action": "CREATE_OR_UPDATE", "path": "a"}]}', False),
        ('{"operations": [', False),
        (None, False),
    ],
)
def test_payloads(spark, p, valid):
    assert one(spark, payload.operations, p).valid is valid


def test_redaction_at_any_depth(spark):
    got = one(spark, payload.redact, '{"a": [{"X-API-Key": 1, "b": {"myToken": {"c": 2}}}], "ok": "password"}')
    assert got == '{"a": [{"X-API-Key": "[REDACTED]", "b": {"myToken": "[REDACTED]"}}], "ok": "password"}'
    assert one(spark, payload.redact, "not json") is None and one(spark, payload.redact, None) is None
