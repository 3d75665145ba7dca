"""URL filter rules, found through an index by each rule's rarest literal token. DataFrame operations only.

Two kinds of rule: a prefix rule has a host and a path and fits that host and its subdomains where the url's path starts
with the rule's; a pattern rule is text in which ^ stands for a boundary (either end, or any character but a letter or
digit) and * for anything, in any case of ASCII letters. Each rule becomes a regular expression over host + path and a list of
literal tokens, the whole alphanumeric runs that every match must hold. Over all pages the tokens that rules name are
counted; a rule is filed under its rarest. A url's tokens fetch the rules filed under them, and only those run their
regular expressions. A rule that has no whole token (as in `ab*`) can't be filed and is checked against every url.

Of the prefix rules that fit, the longest wins (then the longer host); without one, the longest fitting pattern rule
gives the verdict (block before allow at equal length); without any, the url is allowed.

Pages are read twice, once for the counts, once to judge. An index of up to `INLINE_RULES` rules stands beside each row as a
constant, so nothing is shuffled; a larger one is joined, by broadcast up to `BROADCAST_RULES` rules.

Defined cases: a null url, or one without ://, has an empty host and path, which no rule with a token fits; very long urls are
judged whole; ties between rules go by host length, verdict (block first) and name; repeated rows give repeated rows; extra columns, with
whatever names, are ignored; an empty table gives an empty one; without rules every url is allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 256
#: Rules up to this number are broadcast (their tokens and expressions then take some tens of MB at most); more are joined by shuffle.
BROADCAST_RULES = 100_000

# Fixed values of the contract: (verdict, host, path).
PREFIX_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: (verdict, pattern): kinds of site that a text corpus does without.
PATTERN_RULES = [
    ("block", "^cheap-pills^"),
    ("block", "^spam-farm^"),
    ("block", "^casino^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "^viagra^"),
    ("block", "^payday-loans^"),
    ("block", "^link-farm^"),
    ("block", "^wp-login^"),
    ("block", "^login^redirect^"),
]


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    kind: str  # prefix or pattern
    length: int
    host_length: int
    regex: str
    tokens: tuple[str, ...]


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    host = host.translate(str.maketrans(UPPER, LOWER))
    whole = re.findall(r"[a-z0-9]+(?![a-z0-9])", f"{host}/")
    inner = re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, verdict, "prefix", len(host + path), len(host), rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(sorted({*whole, *(t.lower() for t in inner)})))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    pieces = {"^": "(?:^|[^a-z0-9]|$)", "*": ".*"}
    regex = "(?is)" + "".join(pieces.get(c, re.escape(c)) for c in pattern)
    tokens = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", pattern)
    return Rule(pattern, verdict, "pattern", len(pattern), 0, regex, tuple(sorted({t.lower() for t in tokens if t.isascii()})))


def default_rules() -> list[Rule]:
    return [*(prefix_rule(*r) for r in PREFIX_RULES), *(pattern_rule(*r) for r in PATTERN_RULES)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def read_rules(rules: DataFrame) -> list[Rule]:
    """Rules from a table kind (prefix or pattern), verdict (allow or block), host and path, or pattern. Rows that lack one of
    these are refused. The table is small: it is read to the driver."""
    out = []
    for r in rules.select("kind", "verdict", "host", "path", "pattern").distinct().collect():
        if r.verdict not in ("allow", "block") or (r.host is None or r.path is None if r.kind == "prefix" else r.kind != "pattern" or not r.pattern):
            raise ValueError(f"not a rule: {r}")
        out.append(prefix_rule(r.verdict, r.host, r.path) if r.kind == "prefix" else pattern_rule(r.verdict, r.pattern))
    return sorted(out, key=_rank)


def _rank(r: Rule) -> tuple:
    """Of rules that fit, the last in this order wins: any prefix rule over any pattern; block sorts after allow."""
    return r.kind == "prefix", r.length, r.host_length, r.verdict, r.name


def _rarest(tokens: DataFrame, rules: list[Rule], small) -> dict[int, str]:
    """By rule number the token that it is filed under; tokens has one token a row."""
    spark = tokens.sparkSession
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return {}
    counted = tokens.join(small(spark.createDataFrame([(t,) for t in named], "token string")), "token").groupBy("token").count()
    seen = {r.token: r["count"] for r in counted.collect()}  # as many as the rules have tokens, at most
    return {i: min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for i, r in enumerate(rules) if r.tokens}


def judge(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided, else null)."""
    rules = sorted(default_rules() if rules is None else rules, key=_rank)
    first_prefix = sum(r.kind != "prefix" for r in rules)
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda d: d)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("subject", F.concat("host", "path")).withColumn("lower", F.translate("subject", UPPER, LOWER))
    urls = urls.withColumn("tokens", F.array_distinct(F.expr("regexp_extract_all(lower, '[a-z0-9]+', 0)"))).drop("lower")
    filed = _rarest(urls.select(F.explode("tokens").alias("token")), rules, small)
    found = _inline(urls, rules, filed) if len(rules) <= inline_rules else _joined(urls, rules, filed, small)
    best = lambda keep: F.array_max(F.filter("fits", keep))
    found = found.withColumn("prefix", best(lambda i: i >= first_prefix)).withColumn("pattern", best(lambda i: i < first_prefix))

    def of(values: list[str], number: str) -> Column:
        return F.get(F.array(*(F.lit(v) for v in values)), F.col(number)) if values else F.lit(None).cast("string")

    if len(rules) <= inline_rules:
        named = [of([getattr(r, c) for r in rules], n) for n in ("prefix", "pattern") for c in ("name", "verdict")]
    else:
        about = pages.sparkSession.createDataFrame([(i, r.name, r.verdict) for i, r in enumerate(rules)], "n int, name string, verdict string")
        for n in ("prefix", "pattern"):
            found = found.join(small(about.select(F.col("n").alias(n), F.struct("name", "verdict").alias(f"{n}_rule"))), n, "left")
        named = [F.col(f"{n}_rule.{c}") for n in ("prefix", "pattern") for c in ("name", "verdict")]
    rule, rule_verdict, pattern, pattern_verdict = named
    return found.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(rule_verdict, pattern_verdict, F.lit("allow")).alias("verdict"),
        F.when(F.col("prefix").isNull(), pattern).alias("pattern"),
    )


def _inline(urls: DataFrame, rules: list[Rule], filed: dict[int, str]) -> DataFrame:
    """urls with fits, the numbers of the rules that fit. The index is a constant map."""
    numbers = lambda some: F.array(*(F.lit(i) for i in some)).cast("array<int>")
    index: dict[str, list[int]] = {}
    for i, t in filed.items():
        index.setdefault(t, []).append(i)
    candidates = numbers(i for i in range(len(rules)) if i not in filed)
    if index:
        under = F.create_map(*(x for t, some in sorted(index.items()) for x in (F.lit(t), numbers(some))))
        fetched = F.transform(F.filter("tokens", lambda t: t.isin(sorted(index))), lambda t: under[t])
        candidates = F.concat(candidates, F.flatten(fetched))
    if not rules:
        return urls.withColumn("fits", candidates)
    # regexp_instr keeps the last expression compiled.
    regexes = F.array(*(F.lit(r.regex) for r in rules))
    return urls.withColumn("fits", F.filter(candidates, lambda i: F.regexp_instr("subject", F.get(regexes, i)) > 0))


def _joined(urls: DataFrame, rules: list[Rule], filed: dict[int, str], small) -> DataFrame:
    """The same by joins: candidate rows are sorted by rule, so that each expression is compiled once a partition."""
    spark = urls.sparkSession
    subjects = urls.select("subject", "tokens").distinct()
    index = spark.createDataFrame([(filed[i], i, r.regex) for i, r in enumerate(rules) if i in filed], "token string, n int, regex string")
    candidates = subjects.select("subject", F.explode("tokens").alias("token")).join(small(index), "token").select("subject", "n", "regex")
    rest = [F.struct(F.lit(i).alias("n"), F.lit(r.regex).alias("regex")) for i, r in enumerate(rules) if i not in filed]
    if rest:  # those that no index can hold
        candidates = candidates.unionByName(subjects.select("subject", F.explode(F.array(*rest)).alias("r")).select("subject", "r.n", "r.regex"))
    hits = candidates.sortWithinPartitions("n").where(F.expr("regexp_instr(subject, regex) > 0"))
    hits = hits.groupBy("subject").agg(F.collect_set("n").alias("fits"))
    return urls.join(hits, "subject", "left")


def oracle_sql(rules: list[Rule] | None = None) -> str:
    """The same rows in DuckDB's SQL: every expression on every url."""
    rules = default_rules() if rules is None else rules
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def first(kind: str, what: str) -> str:
        order = sorted((r for r in rules if r.kind == kind), key=lambda r: (r.length, r.host_length, r.verdict, r.name), reverse=True)
        return "CASE " + " ".join(f"WHEN regexp_matches(host || path, {text(r.regex)}) THEN {text(getattr(r, what))}" for r in order) + " ELSE NULL END"

    return f"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
        ), p AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM u
        ), r AS (
            SELECT page_id, host, path, {first("prefix", "name")} AS rule, {first("prefix", "verdict")} AS rule_verdict,
                   {first("pattern", "name")} AS pattern, {first("pattern", "verdict")} AS pattern_verdict
            FROM p
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, pattern_verdict, 'allow') AS verdict,
               CASE WHEN rule IS NULL THEN pattern END AS pattern
        FROM r
    """
