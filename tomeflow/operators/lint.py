"""The graph of wiki pages: links, what they miss, and mechanical repairs.

Pages are a DataFrame (path, slug, body, ...); links come from text.wikilinks. All checks are anti-joins that keep
duplicates; a link's slug may be hot, but only distinct slugs are on the other side.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import wikilinks
from ..sources.partitions import fresh_path


def links(pages: DataFrame) -> DataFrame:
    """path, pos, kind, vault, slug."""
    return pages.select("path", F.inline(wikilinks(F.col("body"))))


def broken_links(links_: DataFrame, pages: DataFrame) -> DataFrame:
    """page, target of each local link to no page; one row for each occurrence."""
    local = links_.where("kind = 'local'").select(F.col("path").alias("page"), F.col("slug").alias("target"))
    return local.join(pages.select(F.col("slug").alias("target")).distinct(), "target", "left_anti").select("page", "target")


def orphans(links_: DataFrame, pages: DataFrame) -> DataFrame:
    """page: pages that no local link names; a page's link to itself counts."""
    named = links_.where("kind = 'local'").select("slug").distinct()
    return pages.join(named, "slug", "left_anti").select(F.col("path").alias("page"))


def cross_vault(links_: DataFrame) -> DataFrame:
    """page, target (vault::concept)."""
    return links_.where("kind = 'cross_vault'").select(F.col("path").alias("page"), F.concat_ws("::", "vault", "slug").alias("target"))


def missing_sources(provenance: DataFrame, files: DataFrame) -> DataFrame:
    """page, target: resources that aren't files. provenance(page, resource), files(path); existence counts, not status."""
    p = provenance.withColumn("_path", F.regexp_replace("resource", "^/+", ""))
    return p.join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti").select("page", F.col("resource").alias("target"))


def pending(entries: DataFrame) -> DataFrame:
    """page (the source's uri): active sources that aren't compiled at their current content."""
    return entries.where("pending").select(F.col("uri").alias("page"))


def findings(pages: DataFrame, provenance: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """kind, page, target: everything that a lint finds, as one table. Bodies are parsed once: links and the pages' own slugs are
    written side by side to the shared folder, and all checks of links read that table."""
    own = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("vault"), F.col("slug").alias("slug")))
    spark = pages.sparkSession
    path = fresh_path(spark, "links")
    pages.select("path", F.inline(F.concat(own, wikilinks(F.col("body"))))).write.parquet(path)
    table = spark.read.parquet(path)
    found, named = table.where("kind <> 'page'"), table.where("kind = 'page'").select("path", "slug")
    none = F.lit(None).cast("string").alias("target")
    parts = [
        ("pending_compile", pending(entries).select("page", none)),
        ("broken_link", broken_links(found, named)),
        ("missing_source", missing_sources(provenance, files)),
        ("orphan_page", orphans(found, named).select("page", none)),
        ("cross_vault_link", cross_vault(found)),
    ]
    out = None
    for kind, df in parts:
        df = df.select(F.lit(kind).alias("kind"), "page", "target")
        out = df if out is None else out.unionByName(df)
    return out


def summary(findings_: DataFrame) -> DataFrame:
    """One row: how many of each kind, whether it has errors, and whether it is clean (strictly: without orphans too)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    s = findings_.agg(*(n(k).alias(f"n_{k}") for k in ("pending_compile", "broken_link", "missing_source", "orphan_page", "cross_vault_link")))
    errors = (F.col("n_broken_link") + F.col("n_missing_source")) > 0
    return s.withColumn("has_errors", errors).withColumn("clean", ~errors).withColumn("strictly_clean", ~errors & (F.col("n_orphan_page") == 0))


def fixable_sources(missing: DataFrame, files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """page, old, new: missing resources that exist once .md is added; once for each page and resource. With pages (path,
    content), only where the page holds the resource in double quotes."""
    m = missing.where(~F.col("target").endswith(".md")).select("page", F.col("target").alias("old"), F.concat("target", F.lit(".md")).alias("new")).distinct()
    m = m.withColumn("_path", F.regexp_replace("new", "^/+", "")).join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi").drop("_path")
    if pages is not None:
        held = pages.select(F.col("path").alias("page"), F.col("content").alias("_content"))
        m = m.join(held, "page").where(F.contains("_content", F.concat(F.lit('"'), "old", F.lit('"')))).drop("_content")
    return m


def apply_source_fixes(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """pages(path, content) with each fixed resource rewritten wherever it stands in double quotes."""
    by_page = fixes.groupBy(F.col("page").alias("path")).agg(F.array_sort(F.collect_set(F.struct("old", "new"))).alias("_fixes"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fixed = F.aggregate("_fixes", F.col("content"), lambda t, f: F.replace(t, quoted(f["old"]), quoted(f["new"])))
    return pages.join(by_page, "path", "left").withColumn("content", F.when(F.col("_fixes").isNull(), F.col("content")).otherwise(fixed)).drop("_fixes")


def broken_by_slug(broken: DataFrame) -> DataFrame:
    """slug, n_links, n_pages: what is missing, by how often it is asked for."""
    return broken.groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("n_links"), F.countDistinct("page").alias("n_pages"))


def link_fix_jobs(broken: DataFrame, provenance: DataFrame, blobs: DataFrame) -> DataFrame:
    """slug, n_pages, n_sources, ready: a missing slug can be written only if a page that links to it cites a raw source."""
    cited = provenance.select("page", F.regexp_extract("resource", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("raw_id"))
    cited = cited.join(blobs.select("raw_id").distinct(), "raw_id", "left_semi")
    asked = broken.select(F.col("target").alias("slug"), "page").distinct()
    pages = asked.groupBy("slug").agg(F.count("*").alias("n_pages"))
    sources = asked.join(cited, "page").select("slug", "raw_id").distinct().groupBy("slug").agg(F.count("*").alias("n_sources"))
    return pages.join(sources, "slug", "left").select("slug", "n_pages", F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.col("n_sources").isNotNull().alias("ready"))


# The lines of a report, in the order of its parts; what to do about pending sources the caller says.
_TITLES = {
    "pending_compile": ("Pending compile ({n} source(s) not yet fully compiled — {hint}):", "  {page}"),
    "broken_link": ("Broken links ({n}):", "  {page} -> [[{target}]] (target does not exist)"),
    "missing_source": ("Missing provenance sources ({n}):", "  {page}: sources entry '{target}' does not exist"),
    "orphan_page": ("Orphan pages ({n}, warning):", "  {page} is not linked from any other page"),
    "cross_vault_link": ("Cross-vault links ({n}, informational):", "  {page} -> [[{target}]]"),
}
_EMPTY = "OK: no lint issues found."
_FAILED = "FAILED: fix broken links and missing sources above."
_PASSED = "OK: no blocking issues (see warnings above)."
_FIELDS = {"pending_compile": "pending_compiles", "broken_link": "broken_links", "missing_source": "missing_sources", "orphan_page": "orphan_pages", "cross_vault_link": "cross_vault_links"}


def report(findings_: DataFrame, limit: int | None = None, hint: str = "compile them") -> str:
    """The findings as text, in parts by kind, sorted; with a limit no more lines of a kind, and a line that says how many are left out."""
    counts = {r.kind: r["count"] for r in findings_.groupBy("kind").count().collect()}
    if not counts:
        return _EMPTY
    lines = []
    for kind, (title, line) in _TITLES.items():
        if kind in counts:
            lines.append(title.format(n=counts[kind], hint=hint))
            rows = findings_.where(F.col("kind") == kind).orderBy("page", "target")
            rows = rows.collect() if limit is None else rows.limit(limit).collect()
            lines += [line.format(page=r.page, target=r.target) for r in rows]
            if len(rows) < counts[kind]:
                lines.append(f"  and {counts[kind] - len(rows)} more")
    failed = counts.keys() & {"broken_link", "missing_source"}
    lines.append(_FAILED if failed else _PASSED)
    return "\n".join(lines)


def report_json(findings_: DataFrame) -> DataFrame:
    """part, value: for each of a report's five lists its entries, as JSON: a page, or [page, target]. Sorted by these two columns it is
    the whole report, however long."""
    two = F.to_json(F.array("page", "target"))
    one = F.regexp_extract(F.to_json(F.array("page")), r"^\[(.*)\]$", 1)
    part = F.create_map(*(F.lit(x) for pair in _FIELDS.items() for x in pair))[F.col("kind")]
    return findings_.select(part.alias("part"), F.when(F.col("kind").isin("pending_compile", "orphan_page"), one).otherwise(two).alias("value"))


def report_document(findings_: DataFrame) -> str:
    """The same as one JSON object, made on the driver."""
    found: dict[str, list] = {name: [] for name in _FIELDS.values()}
    for r in report_json(findings_).orderBy("part", "value").toLocalIterator():
        found[r.part].append(json.loads(r.value))
    return json.dumps(found, ensure_ascii=False, indent=2)
