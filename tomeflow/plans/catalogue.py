"""Every query of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import payload, text
from ..operators import bundle, compile, lint, manifest, search, store, syntax
from ..streaming import breaker, state
from . import derived as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LIMIT = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)


# ---- links and lint ---------------------------------------------------------------------------------------------


@query(f"WITH {d.LINKS} SELECT path, pos, kind, vault, slug FROM lk")
def wikilinks_extract(spark, sf):
    return lint.links(d.wiki(spark, sf))


@query(f"WITH {d.LINKS} SELECT kind, vault, slug, count(*) AS n FROM lk GROUP BY ALL")
def links_parse(spark, sf):
    return lint.links(d.wiki(spark, sf)).groupBy("kind", "vault", "slug").agg(F.count("*").alias("n"))


_BROKEN = "br AS (SELECT path AS page, slug AS target FROM lk WHERE kind = 'local' AND slug NOT IN (SELECT slug FROM wk))"
_ORPHAN = "orp AS (SELECT path AS page FROM wk WHERE slug NOT IN (SELECT slug FROM lk WHERE kind = 'local'))"
_MISSING = "ms AS (SELECT page, resource AS target FROM pv WHERE ltrim(resource, '/') NOT IN (SELECT path FROM fl))"
_CROSS = "cr AS (SELECT path AS page, vault || '::' || slug AS target FROM lk WHERE kind = 'cross_vault')"
_FINDINGS = f"""{d.LINKS}, {d.PROVENANCE}, {d.FILES}, {d.ENTRIES}, {_BROKEN}, {_ORPHAN}, {_MISSING}, {_CROSS}, fi AS (
    SELECT 'pending_compile' AS kind, uri AS page, NULL AS target FROM et WHERE pending
    UNION ALL SELECT 'broken_link', page, target FROM br UNION ALL SELECT 'missing_source', page, target FROM ms
    UNION ALL SELECT 'orphan_page', page, NULL FROM orp UNION ALL SELECT 'cross_vault_link', page, target FROM cr
)"""


@query(f"WITH {d.LINKS}, {_BROKEN} SELECT page, target FROM br")
def lint_broken(spark, sf):
    p = d.wiki(spark, sf)
    return lint.broken_links(lint.links(p), p)


@query(f"WITH {d.LINKS}, {_ORPHAN} SELECT page FROM orp")
def lint_orphans(spark, sf):
    p = d.wiki(spark, sf)
    return lint.orphans(lint.links(p), p)


@query(f"WITH {d.LINKS}, {_CROSS} SELECT page, target FROM cr")
def lint_cross_vault(spark, sf):
    return lint.cross_vault(lint.links(d.wiki(spark, sf)))


@query(f"WITH {d.PROVENANCE}, {d.FILES}, {_MISSING} SELECT page, target FROM ms")
def lint_missing_sources(spark, sf):
    return lint.missing_sources(d.provenance(spark, sf), d.files(spark, sf))


@query(f"WITH {d.ENTRIES} SELECT uri AS page FROM et WHERE pending")
def lint_pending(spark, sf):
    return lint.pending(manifest.entries(d.events(spark, sf)))


def _findings(spark, sf):
    return lint.findings(d.wiki(spark, sf), d.provenance(spark, sf), d.files(spark, sf), manifest.entries(d.events(spark, sf)))


@query(f"WITH {_FINDINGS} SELECT kind, page, target FROM fi")
def lint_findings(spark, sf):
    return _findings(spark, sf)


@query(
    f"""WITH {_FINDINGS}, n AS (SELECT {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("pending_compile", "broken_link", "missing_source", "orphan_page", "cross_vault_link"))} FROM fi)
    SELECT *, n_broken_link + n_missing_source > 0 AS has_errors, n_broken_link + n_missing_source = 0 AS clean,
           n_broken_link + n_missing_source = 0 AND n_orphan_page = 0 AS strictly_clean FROM n"""
)
def lint_summary(spark, sf):
    return lint.summary(_findings(spark, sf))


@query(f"WITH {d.PROVENANCE}, {d.FILES}, {_MISSING} SELECT DISTINCT page, target AS old, target || '.md' AS new FROM ms WHERE NOT ends_with(target, '.md') AND ltrim(target, '/') || '.md' IN (SELECT path FROM fl)")
def fixable_sources(spark, sf):
    f = d.files(spark, sf)
    return lint.fixable_sources(lint.missing_sources(d.provenance(spark, sf), f), f)


@query(f"""WITH {d.PROVENANCE}, {d.FILES}, {_MISSING}, fx AS (SELECT DISTINCT page, target AS old FROM ms WHERE NOT ends_with(target, '.md') AND ltrim(target, '/') || '.md' IN (SELECT path FROM fl)),
    h AS (SELECT page AS path, 'sources: "' || resource || '"' AS content FROM pv)
    SELECT path, CASE WHEN old IS NULL THEN content ELSE replace(content, '"' || old || '"', '"' || old || '.md"') END AS content FROM h LEFT JOIN fx ON fx.page = h.path""")
def fix_sources(spark, sf):
    p, f = d.provenance(spark, sf), d.files(spark, sf)
    held = p.select(F.col("page").alias("path"), F.concat(F.lit('sources: "'), "resource", F.lit('"')).alias("content"))
    return lint.apply_source_fixes(held, lint.fixable_sources(lint.missing_sources(p, f), f, held))


@query(f"WITH {d.LINKS}, {_BROKEN} SELECT target AS slug, count(*) AS n_links, count(DISTINCT page) AS n_pages FROM br GROUP BY 1")
def broken_by_slug(spark, sf):
    return lint.broken_by_slug(lint_broken(spark, sf))


@query(
    f"""WITH {d.LINKS}, {d.PROVENANCE}, {d.FILES}, {_BROKEN}, ci AS (
        SELECT page, regexp_extract(resource, '([^/]+?)(\\.[^./]*)?$', 1) AS raw_id FROM pv
    ), so AS (
        SELECT target AS slug, count(DISTINCT raw_id) AS n_sources FROM br JOIN ci USING (page) WHERE 'raw/' || raw_id || '.md' IN (SELECT path FROM fl) GROUP BY 1
    )
    SELECT target AS slug, count(DISTINCT page) AS n_pages, coalesce(any_value(n_sources), 0) AS n_sources, any_value(n_sources) IS NOT NULL AS ready
    FROM br LEFT JOIN so ON so.slug = br.target GROUP BY 1"""
)
def link_fix_jobs(spark, sf):
    blobs = d.files(spark, sf).select(text.file_stem(F.col("path")).alias("raw_id"))
    return lint.link_fix_jobs(lint_broken(spark, sf), d.provenance(spark, sf), blobs)


# ---- manifest ---------------------------------------------------------------------------------------------------


@query(f"""WITH {d.OUTCOMES} SELECT uri, seq, op, hash, outcome, CASE WHEN outcome IN ('new', 'superseded') THEN 'raw_' || substr(hash, 8, 10) END AS raw_id,
       CASE WHEN outcome = 'superseded' THEN 'raw_' || substr(previous, 8, 10) END AS previous_raw_id FROM oc""")
def manifest_outcomes(spark, sf):
    return manifest.outcomes(d.events(spark, sf))


@query(f"WITH {d.VERSIONS} SELECT * FROM vs")
def manifest_versions(spark, sf):
    return manifest.versions(d.events(spark, sf))


@query(f"WITH {d.VERSIONS} SELECT uri, raw_id, hash FROM vs WHERE status = 'ACTIVE'")
def manifest_active(spark, sf):
    return manifest.active(manifest.versions(d.events(spark, sf)))


@query(f"WITH {d.ENTRIES} SELECT uri, n_versions, active_hash, compiled_hash, pending FROM et")
def manifest_entries(spark, sf):
    return manifest.entries(d.events(spark, sf)).drop("active_raw_id")


@query(f"WITH {d.VERSIONS} SELECT uri, raw_id FROM vs JOIN (SELECT uri, max(version_no) - 1 AS version_no FROM vs GROUP BY uri) USING (uri, version_no)")
def superseded_prev(spark, sf):
    return manifest.superseded_previous(manifest.versions(d.events(spark, sf)))


@query(f"WITH {d.VERSIONS} SELECT DISTINCT 'raw_' || substr(hash, 8, 10) AS raw_id, hash FROM oc WHERE outcome IN ('new', 'superseded') AND hash NOT IN (SELECT hash FROM vs)")
def purged_blobs(spark, sf):
    return manifest.purged_blobs(d.events(spark, sf))


@query(f"WITH {d.ENTRIES}, {d.PROVENANCE} SELECT uri, raw_id FROM vs JOIN et USING (uri) WHERE status = 'ACTIVE' AND pending AND raw_id NOT IN (SELECT regexp_extract(resource, '([^/]+?)(\\.[^./]*)?$', 1) FROM pv)")
def select_sources_diff(spark, sf):
    return compile.select_sources(manifest.entries(d.events(spark, sf)), d.provenance(spark, sf))


@query("SELECT 'raw_' || substr(sha256(text), 1, 10) AS raw_id, 'sha256:' || sha256(text) AS hash, count(*) AS n_documents, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def raw_dedup(spark, sf):
    h = text.content_hash(F.col("text"))
    docs = d.read(spark, sf, "documents").select(h.alias("hash"), "doc_id")
    return docs.groupBy("hash").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc")).withColumn("raw_id", text.raw_id(F.col("hash")))


@query("SELECT path, sha AS hash FROM (SELECT doc_id, 'p' || doc_id AS path, sha256(text) AS sha FROM documents) WHERE doc_id % 3 = 0 OR doc_id % 10 = 1 UNION ALL SELECT 'n' || doc_id, sha256(text) FROM documents WHERE doc_id % 9 = 4")
def reindex_changed(spark, sf):
    docs = d.read(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    i = F.col("doc_id")
    stored = docs.where(i % 3 != 0).select("path", F.when(i % 10 == 1, "old").otherwise(F.col("hash")).alias("hash"))
    new = docs.where(i % 9 == 4).select(F.concat(F.lit("n"), i).alias("path"), "hash")
    return store.reindex(stored, docs.select("path", "hash").unionByName(new))[0]


@query("""WITH c AS (SELECT 'p' || doc_id AS path, sha256(text) AS hash FROM documents), s AS (
    SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'gone' || doc_id, 'x' FROM documents WHERE doc_id % 8 = 0)
    SELECT count(*) AS indexed, count(*) FILTER (s.hash IS DISTINCT FROM c.hash) AS embedded, count(*) FILTER (s.hash IS NOT DISTINCT FROM c.hash) AS skipped,
           (SELECT count(*) FROM s WHERE path NOT IN (SELECT path FROM c)) AS removed FROM c LEFT JOIN s USING (path)""")
def reindex_report(spark, sf):
    docs = d.read(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    i = F.col("doc_id")
    stored = docs.where(i % 3 != 0).select("path", F.when(i % 10 == 1, "old").otherwise(F.col("hash")).alias("hash"))
    stored = stored.unionByName(docs.where(i % 8 == 0).select(F.concat(F.lit("gone"), i).alias("path"), F.lit("x").alias("hash")))
    return store.reindex(stored, docs.select("path", "hash"))[2]


@query("""WITH s AS (SELECT 'p' || (vec_id // 5) AS path, 'p' || (vec_id // 5) || '#' || (vec_id % 5) AS section_key, label FROM embeddings)
    SELECT path, section_key, label FROM s WHERE CAST(substr(path, 2) AS BIGINT) % 4 <> 1 UNION ALL SELECT path, section_key || 'n', label + 100 FROM s WHERE CAST(substr(path, 2) AS BIGINT) % 4 = 1 AND ends_with(section_key, '#0')""")
def replace_sections(spark, sf):
    s = d.vectors(spark, sf).join(d.read(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("path", "section_key", "label")
    new = s.where((F.substring("path", 2, 20).cast("long") % 4 == 1) & F.col("section_key").endswith("#0"))
    return store.replace_sections(s, new.select("path", F.concat("section_key", F.lit("n")).alias("section_key"), (F.col("label") + 100).alias("label")))


# ---- bundle, index page, resolution -----------------------------------------------------------------------------


@query(f"WITH {d.WIKI}, {d.PROVENANCE} SELECT path, coalesce(id, slug) AS id, title, type, [resource] AS sources FROM wk JOIN pv ON pv.page = wk.path")
def bundle_concepts(spark, sf):
    p = d.provenance(spark, sf).select(F.col("page").alias("path"), F.array("resource").alias("sources"))
    return bundle.concepts(d.wiki(spark, sf).join(p, "path"))


@query(f"WITH {d.VERSIONS} SELECT uri, raw_id, hash FROM vs WHERE status = 'ACTIVE'")
def bundle_raw(spark, sf):
    return bundle.raw_sources(manifest.active(manifest.versions(d.events(spark, sf))))


@query(f"WITH {d.WIKI} SELECT title, path, description, '- [' || title || '](' || path || ')' || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || description ELSE '' END AS line FROM wk")
def wiki_index(spark, sf):
    return bundle.index_lines(d.wiki(spark, sf))


@query(
    f"""WITH {d.WIKI}, a AS (
        SELECT CASE doc_id % 5 WHEN 0 THEN path WHEN 1 THEN slug WHEN 2 THEN coalesce(id, slug) WHEN 3 THEN 'k' || doc_id ELSE 'unknown' || doc_id END AS asked FROM wk
    ), nm AS (
        SELECT path AS asked, 1 AS tier, path FROM wk UNION ALL SELECT slug, 2, path FROM wk UNION ALL SELECT id, 3, path FROM wk WHERE id IS NOT NULL
        UNION ALL SELECT substr(id, 9), 3, path FROM wk WHERE starts_with(id, 'concept_')
    ), f AS (SELECT asked, path FROM nm QUALIFY row_number() OVER (PARTITION BY asked ORDER BY tier, path) = 1)
    SELECT asked, path FROM a LEFT JOIN f USING (asked)"""
)
def resolve_concept(spark, sf):
    p, i = d.wiki(spark, sf), F.col("doc_id") % 5
    asked = F.when(i == 0, F.col("path")).when(i == 1, F.col("slug")).when(i == 2, F.coalesce("id", "slug")).when(i == 3, F.concat(F.lit("k"), "doc_id")).otherwise(F.concat(F.lit("unknown"), "doc_id"))
    return bundle.resolve(p, p.select(asked.alias("asked")))


# ---- sections and budgets ---------------------------------------------------------------------------------------

_CUT = """cu AS (SELECT path, pos, list_filter(list_transform(range(1, len(ps) + 1), lambda k: struct_pack(
        heading := CASE WHEN k > 1 THEN regexp_replace(string_split(ps[k], chr(10))[1], '^\\s+|\\s+$', '', 'g') END,
        body := regexp_replace(CASE WHEN k = 1 THEN ps[k] WHEN strpos(ps[k], chr(10)) > 0 THEN substr(ps[k], strpos(ps[k], chr(10)) + 1) ELSE '' END, '^\\s+|\\s+$', '', 'g'))), lambda s: s.body <> '') AS kept
    FROM (SELECT path, pos, string_split(chr(10) || replace(b, chr(13) || chr(10), chr(10)), chr(10) || '## ') AS ps FROM src))"""


@query(
    f"""WITH src AS (SELECT 'chat' || conv_id AS path, turn AS pos, '## ' || role || chr(10) || text AS b FROM conversations), {_CUT},
    fl AS (SELECT path, pos, k, kept[k] AS s FROM cu, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS k))
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos, k) - 1 AS i, s.heading AS heading, s.body AS text FROM fl"""
)
def sections_chunk(spark, sf):
    return d.chat_sections(spark, sf)


@query(
    f"""WITH src AS (SELECT 'p' || doc_id AS path, 0 AS pos, replace(text, '. ', '.' || chr(10) || '## ') AS b FROM documents), {_CUT},
    fl AS (SELECT path, k - 1 AS i, kept[k] AS s FROM cu, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS k) UNION ALL SELECT path, 0, struct_pack(heading := CAST(NULL AS VARCHAR), body := '') FROM cu WHERE len(kept) = 0)
    SELECT path || '#' || i AS section_key, path, s.heading AS heading, substr(s.body, 1, 280) AS snippet FROM fl"""
)
def snippets(spark, sf):
    body = F.replace("text", F.lit(". "), F.lit(".\n## "))
    s = d.read(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.posexplode(text.sections(body)).alias("i", "s"))
    return s.select(F.concat("path", F.lit("#"), "i").alias("section_key"), "path", "s.heading", text.snippet(F.col("s.text")).alias("snippet"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return d.read(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_PAIRS = "pr AS (SELECT a.doc_id, a.text AS active, b.text AS superseded FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1 AND a.doc_id % 4 <> 0)"
_TRUNC = "CASE WHEN length({t}) > 4 * {b} THEN substr({t}, 1, 4 * {b}) || chr(10) || chr(10) || '[... truncated ' || (length({t}) - 4 * {b}) || ' chars over budget ...]' ELSE {t} END"
BUDGET = 500


def _pairs(spark, sf):
    docs = d.read(spark, sf, "documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("superseded")).where("doc_id % 4 <> 0")
    return docs.withColumnRenamed("text", "active").join(before, "doc_id", "left")


_SHARES = f"""sh AS (SELECT doc_id, active, superseded,
    CASE WHEN ts IS NULL THEN {BUDGET} WHEN ta + ts <= {BUDGET} THEN ta WHEN ta <= {BUDGET // 2} THEN ta WHEN ts <= {BUDGET // 2} THEN {BUDGET} - ts ELSE {BUDGET // 2} END AS sa,
    CASE WHEN ts IS NULL THEN NULL WHEN ta + ts <= {BUDGET} THEN ts WHEN ta <= {BUDGET // 2} THEN {BUDGET} - ta WHEN ts <= {BUDGET // 2} THEN ts ELSE {BUDGET - BUDGET // 2} END AS ss
    FROM (SELECT *, CAST(ceil(length(active) / 4) AS BIGINT) AS ta, CAST(ceil(length(superseded) / 4) AS BIGINT) AS ts FROM pr))"""


@query(f"WITH {_PAIRS}, {_SHARES} SELECT doc_id, CAST(sa AS BIGINT) AS active_tokens, CAST(ss AS BIGINT) AS superseded_tokens FROM sh")
def prompt_budget_split(spark, sf):
    t = text.estimate_tokens
    s = text.shared_budgets(t(F.col("active")), t(F.col("superseded")), F.lit(BUDGET).cast("long"))
    return _pairs(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.col("s.active").alias("active_tokens"), F.col("s.superseded").alias("superseded_tokens"))


@query(f"WITH {_PAIRS}, {_SHARES} SELECT doc_id, {_TRUNC.format(t='active', b='sa')} AS active, {_TRUNC.format(t='superseded', b='ss')} AS superseded FROM sh")
def truncate_marker(spark, sf):
    return compile.fit_blobs(_pairs(spark, sf), BUDGET).select("doc_id", "active", "superseded")


_RELATED = "re AS (SELECT query_id, path, rank, CAST(ceil(length(body) / 4) AS BIGINT) AS tokens FROM bm JOIN (SELECT 'p' || doc_id AS path, text AS body FROM documents) USING (path))"


@query(f"WITH {d.RELATED.format(n=LIMIT)}, {_RELATED}, ru AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running_tokens FROM re) SELECT * FROM ru WHERE 100 + running_tokens <= 2000")
def trim_related(spark, sf):
    docs = d.search_docs(spark, sf)
    found = search.search_index(d.index(spark, sf), d.related_queries(spark, sf), LIMIT)
    sized = found.join(docs.select("path", text.estimate_tokens(F.col("body")).alias("tokens")), "path")
    return compile.trim_related(sized.select("query_id", "path", "rank", "tokens"), F.lit(100), 2_000)


@query(
    f"""WITH {_PAIRS}, {_SHARES}, t AS (SELECT doc_id, {_TRUNC.format(t='active', b='sa')} AS a, {_TRUNC.format(t='superseded', b='ss')} AS s FROM sh)
    SELECT doc_id, sha256('# Source' || chr(10) || 'id: ' || doc_id || chr(10) || '```markdown' || chr(10) || a || chr(10) || '```' || chr(10) || chr(10) ||
           CASE WHEN s IS NULL THEN '' ELSE '# Version it replaces' || chr(10) || 'id: ' || (doc_id - 1) || chr(10) || '```markdown' || chr(10) || s || chr(10) || '```' || chr(10) || chr(10) END ||
           'Answer with a JSON object of page operations.') AS prompt_sha256 FROM t"""
)
def compile_prompts(spark, sf):
    p = compile.fit_blobs(_pairs(spark, sf), BUDGET)
    none = F.array().cast("array<struct<path:string,content:string>>")
    made = compile.prompt(F.col("doc_id").cast("string"), F.col("active"), (F.col("doc_id") - 1).cast("string"), F.col("superseded"), none)
    return p.select("doc_id", F.sha2(made, 256).alias("prompt_sha256"))


# ---- search -----------------------------------------------------------------------------------------------------

_POSTINGS = """po AS (SELECT path, field, term, count(*) AS tf, dl AS doc_len FROM (
    SELECT path, field, unnest(ts) AS term, len(ts) AS dl FROM (
        SELECT path, field, list_filter(string_split_regex(lower(t), '[^\\pL\\pN]+'), lambda x: x <> '' AND strlen(x) < 40) AS ts FROM (
            SELECT 'p' || doc_id AS path, 'title' AS field, string_split(text, chr(10))[1] AS t FROM documents UNION ALL SELECT 'p' || doc_id, 'body', text FROM documents))) GROUP BY ALL)"""


@query(f"WITH {_POSTINGS} SELECT * FROM po")
def postings(spark, sf):
    return search.postings(d.search_docs(spark, sf))


@query(f"WITH {_POSTINGS} SELECT field, term, count(*) AS df FROM po GROUP BY ALL")
def term_statistics(spark, sf):
    return search.term_statistics(search.postings(d.search_docs(spark, sf)))


@query(f"WITH {d.BM25.format(n=LIMIT)} SELECT query_id, path, score, rank FROM bm")
def bm25_topk(spark, sf):
    return search.search_index(d.index(spark, sf), d.text_queries(spark, sf), LIMIT)


@query(f"WITH {d.SHORT.format(n=LIMIT)} SELECT query_id, path, score, rank FROM bm")
def bm25_pruned(spark, sf):
    return search.search_index(d.index(spark, sf), d.short_queries(spark, sf), LIMIT, pruned=True)


@query(f"""WITH {d.SYNTAX} SELECT query_id, path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM sf
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= {LIMIT}""")
def query_syntax(spark, sf):
    return syntax.search_syntax(d.index(spark, sf, positions=True), d.syntax_queries(spark, sf), LIMIT)


@query(f"WITH {d.RELATED.format(n=5)} SELECT query_id, path, score, rank FROM bm")
def related_batch(spark, sf):
    return search.search_index(d.index(spark, sf), d.related_queries(spark, sf), 5)


@query(f"WITH {d.KNN.format(n=LIMIT)} SELECT * FROM kn")
def knn_topk(spark, sf):
    return search.nearest(d.vectors(spark, sf), d.vector_queries(spark, sf), LIMIT)


@query(f"WITH {d.KNN.format(n=LIMIT)} SELECT * FROM kn")
def knn_routed(spark, sf):
    """The same in small cells, so that routes are planned for tables of any size."""
    return search.nearest(d.vectors(spark, sf), d.vector_queries(spark, sf), LIMIT, shard_rows=128)


_BEST = "be AS (SELECT query_id, path, min(distance) AS distance, arg_min(section_key, (distance, section_key)) AS section_key FROM kn GROUP BY ALL)"


@query(f"WITH {d.KNN.format(n=2 * LIMIT)}, {_BEST} SELECT query_id, path, distance, section_key FROM be")
def best_section_per_path(spark, sf):
    return search.best_sections(search.nearest(d.vectors(spark, sf), d.vector_queries(spark, sf), 2 * LIMIT))


#: Benchmark item q asks the vector of number 50 q, where there is one.
_FUSED = f"""{d.BM25.format(n=2 * LIMIT)}, {d.KNN.format(n=2 * LIMIT)}, {_BEST}, ls AS (
    SELECT query_id, path AS item, rank FROM bm
    UNION ALL SELECT query_id // 50, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, path) AS INTEGER) FROM be WHERE query_id // 50 IN (SELECT item_id FROM benchmark)
), fu AS (SELECT query_id, item, round(sum(1 / (60 + rank)), 9) AS score FROM ls GROUP BY ALL)"""


def _asked_vectors(spark, sf):
    v = d.vector_queries(spark, sf).select((F.col("query_id") / 50).cast("long").alias("query_id"), "vector")
    return v.join(d.text_queries(spark, sf).select("query_id"), "query_id", "left_semi")


@query(f"WITH {_FUSED} SELECT query_id, item, score FROM fu")
def rrf_merge(spark, sf):
    text_list = search.search_index(d.index(spark, sf), d.text_queries(spark, sf), 2 * LIMIT).select("query_id", F.col("path").alias("item"), "rank")
    best = search.best_sections(search.nearest(d.vectors(spark, sf), _asked_vectors(spark, sf), 2 * LIMIT))
    near = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "path")).cast("int"))
    return search.fuse(text_list.unionByName(near.select("query_id", F.col("path").alias("item"), "rank")))


@query(
    f"""WITH {_FUSED}, tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM fu QUALIFY rank <= {LIMIT})
    SELECT tp.query_id, item AS path, score, rank, coalesce(title, '') AS title, coalesce(section_key, '') AS section_key
    FROM tp LEFT JOIN (SELECT 'p' || doc_id AS item, string_split(text, chr(10))[1] AS title FROM documents) USING (item)
    LEFT JOIN (SELECT query_id // 50 AS query_id, path AS item, section_key FROM be) USING (query_id, item)"""
)
def hybrid_search(spark, sf):
    return search.hybrid(d.search_docs(spark, sf), d.vectors(spark, sf), d.text_queries(spark, sf), _asked_vectors(spark, sf), LIMIT, index=d.index(spark, sf))


@query(
    f"""WITH {d.BM25_BY_VAULT.format(n=2 * LIMIT)}, sv AS (
        SELECT 'p' || (vec_id // 5) || '#' || (vec_id % 5) AS section_key, 'p' || (vec_id // 5) AS path, coalesce(lang, 'none') AS vault, CAST(embedding AS DOUBLE[]) AS v
        FROM embeddings LEFT JOIN documents ON doc_id = vec_id // 5
    ), dist AS (
        SELECT vault, q.vec_id // 50 AS query_id, section_key, path, round(list_distance(CAST(q.embedding AS DOUBLE[]), v), 6) AS distance
        FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0 AND vec_id // 50 IN (SELECT item_id FROM benchmark)) q, sv
    ), kn AS (
        SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY vault, query_id ORDER BY distance, section_key) <= {2 * LIMIT}
    ), be AS (
        SELECT vault, query_id, path, min(distance) AS distance, arg_min(section_key, (distance, section_key)) AS section_key FROM kn GROUP BY ALL
    ), ls AS (
        SELECT vault, query_id, path, rank FROM bm
        UNION ALL SELECT vault, query_id, path, row_number() OVER (PARTITION BY vault, query_id ORDER BY distance, path) FROM be
    ), fu AS (
        SELECT * FROM (SELECT vault, query_id, path, round(sum(1 / (60 + rank)), 9) AS score FROM ls GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY vault, query_id ORDER BY score DESC, path) <= {LIMIT}
    )
    SELECT vault, query_id, path, score, coalesce(title, '') AS title, coalesce(section_key, '') AS section_key,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vault, path) AS INTEGER) AS rank
    FROM fu LEFT JOIN (SELECT lang AS vault, 'p' || doc_id AS path, string_split(text, chr(10))[1] AS title FROM documents) USING (vault, path)
    LEFT JOIN be USING (vault, query_id, path) QUALIFY rank <= {LIMIT}"""
)
def federated_search(spark, sf):
    return search.federated(d.search_docs(spark, sf), d.section_vaults(spark, sf), d.text_queries(spark, sf), _asked_vectors(spark, sf), LIMIT, d.index(spark, sf, by_vault=True))


# ---- operations, jobs, folds, streams ---------------------------------------------------------------------------

_APPLIED = """la AS (SELECT path, arg_max(action, (source_seq, op_seq)) AS action, arg_max(struct_pack(c := content), (source_seq, op_seq)).c AS content FROM op GROUP BY path)"""


@query(
    f"""WITH {d.OPERATIONS}, {_APPLIED}, pg AS (SELECT 'wiki/concepts/d' || doc_id || '.md' AS path, lang AS content FROM documents)
    SELECT path, CASE WHEN la.path IS NOT NULL THEN la.content ELSE pg.content END AS content FROM pg FULL JOIN la USING (path) WHERE coalesce(action, '') <> 'DELETE'""".replace("la.path IS NOT NULL", "action IS NOT NULL")
)
def apply_ops_latest(spark, sf):
    pages = d.read(spark, sf, "documents").select(F.concat(F.lit("wiki/concepts/d"), "doc_id", F.lit(".md")).alias("path"), F.col("lang").alias("content"))
    return compile.apply_operations(pages, d.operations(spark, sf))


@query("""WITH op AS (
        SELECT doc_id AS source_seq, CASE doc_id % 4 WHEN 0 THEN './wiki//concepts/x/../d' || doc_id % 300 || '.md' WHEN 1 THEN '../../etc/d' || doc_id WHEN 2 THEN '/etc/d' || doc_id ELSE 'wiki/concepts/d' || doc_id % 300 || '.md' END AS path,
               'a' || doc_id AS content, 0 AS op_seq FROM documents
        UNION ALL SELECT doc_id, 'wiki/entities/e' || doc_id % 50 || '.md', 'b' || doc_id, 1 FROM documents
    ), ok AS (SELECT * FROM op WHERE source_seq % 4 IN (0, 3))
    SELECT CASE WHEN starts_with(path, './') THEN 'wiki/concepts/d' || source_seq % 300 || '.md' ELSE path END AS path, arg_max(content, (source_seq, op_seq)) AS content FROM ok GROUP BY 1""")
def apply_ops_sandboxed(spark, sf):
    """A third of the sources name a path outside the vault, and change nothing."""
    docs, i = d.read(spark, sf, "documents"), F.col("doc_id")
    plain = F.concat(F.lit("wiki/concepts/d"), i % 300, F.lit(".md"))
    first = F.when(i % 4 == 0, F.concat(F.lit("./wiki//concepts/x/../d"), i % 300, F.lit(".md"))).when(i % 4 == 1, F.concat(F.lit("../../etc/d"), i)).when(i % 4 == 2, F.concat(F.lit("/etc/d"), i)).otherwise(plain)
    make = lambda path, content: F.struct(F.lit("CREATE_OR_UPDATE").alias("action"), path.alias("path"), F.concat(F.lit(content), i).alias("content"))
    ops = F.array(make(first, "a"), make(F.concat(F.lit("wiki/entities/e"), i % 50, F.lit(".md")), "b"))
    done = docs.select(i.alias("source_seq"), F.posexplode(ops).alias("op_seq", "o")).select("source_seq", "op_seq", "o.*")
    return compile.apply_operations(spark.createDataFrame([], "path string, content string"), done)


_SUBMITTED = """jb AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 'fix_link' ELSE 'compile' END AS kind, lang AS vault FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 13 <> 12),
    sb AS (SELECT doc_id * 2 AS position, doc_id AS job_id, CASE WHEN doc_id % 7 = 0 THEN 'prose' WHEN doc_id % 7 = 1 THEN 'outside' WHEN doc_id % 7 = 2 THEN 'empty' ELSE 'good' END AS made FROM documents
           UNION ALL SELECT doc_id * 2 + 1, doc_id, 'good' FROM documents WHERE doc_id % 2 = 0),
    ck AS (SELECT position, sb.job_id, kind, vault, CASE WHEN vault IS NULL THEN 'job not found or expired' WHEN made = 'prose' OR made = 'empty' THEN 'the answer isn''t a valid payload' WHEN made = 'outside' THEN 'a path leaves the vault' END AS why
           FROM sb LEFT JOIN jb USING (job_id)),
    rs AS (SELECT position, job_id, vault, CASE WHEN position > min(position) FILTER (why IS NULL) OVER (PARTITION BY job_id) THEN 'job not found or expired' ELSE why END AS error FROM ck)"""


def _submission(spark, sf):
    """Jobs of documents, some of which are too old or unknown; one answer or two for each, some of them unusable."""
    docs, i = d.read(spark, sf, "documents"), F.col("doc_id")
    day = F.timestamp_seconds(F.lit(86_400) - F.when(i % 13 == 12, 7_200).otherwise(0))
    jobs = docs.where(i % 5 != 4).select(i.alias("job_id"), F.when(i % 3 == 0, "fix_link").otherwise("compile").alias("kind"), F.concat(F.lit("doc://"), i).alias("key"), F.col("lang").alias("vault"), day.alias("created_at"))
    path = lambda p: F.concat(F.lit('{"operations": [{"action": "CREATE_OR_UPDATE", "path": "'), p, F.lit('", "content": "c'), i, F.lit('"}]}'))
    good = path(F.concat(F.lit("wiki/./d"), i % 300, F.lit(".md")))
    first = F.when(i % 7 == 0, F.lit("Here it is.")).when(i % 7 == 1, path(F.lit("wiki/.."))).when(i % 7 == 2, path(F.lit(""))).otherwise(good)
    answers = docs.select((i * 2).alias("position"), i.alias("job_id"), first.alias("payload")).unionByName(docs.where(i % 2 == 0).select((i * 2 + 1).alias("position"), i.alias("job_id"), good.alias("payload")))
    return compile.submit(answers, jobs, spark.createDataFrame([], "vault string, path string, content string"), F.timestamp_seconds(F.lit(86_460)), cap=1 << 30)


@query(f"WITH {_SUBMITTED} SELECT position, job_id, CASE WHEN error IS NULL THEN 'applied' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN 'wiki/d' || (job_id % 300) || '.md' END AS touched FROM rs")
def submit_batch(spark, sf):
    return _submission(spark, sf).results.withColumn("touched", F.array_join("touched", ","))


@query(f"WITH {_SUBMITTED} SELECT vault, 'wiki/d' || (job_id % 300) || '.md' AS path, 'c' || arg_max(job_id, position) AS content FROM rs WHERE error IS NULL GROUP BY vault, job_id % 300")
def submit_pages(spark, sf):
    return _submission(spark, sf).pages


@query("""WITH s AS (SELECT 'u' || user_id AS path, event_type AS hash FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
          c AS (SELECT 'u' || user_id % 700 AS path, arg_max(event_type || event_id, event_id) AS hash FROM events GROUP BY 1)
          SELECT path, coalesce(c.hash, s.hash) AS hash FROM s FULL JOIN c USING (path)""")
def upsert_documents(spark, sf):
    """Many changes of one key; the last holds."""
    e = d.read(spark, sf, "events")
    stored = e.groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.min_by("event_type", "event_id").alias("hash"))
    changes = e.select(F.concat(F.lit("u"), F.col("user_id") % 700).alias("path"), F.concat("event_type", "event_id").alias("hash"), "event_id")
    return store.upsert(stored, changes, order="event_id")


@query("""SELECT event_id, event_id % 12 IN (0, 1, 9, 10) AS valid, CASE event_id % 12 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 9 THEN 0 WHEN 10 THEN 1 END AS n_operations FROM events""")
def parse_payloads(spark, sf):
    i = F.col("event_id") % 12
    one = F.format_string('{"action": "CREATE_OR_UPDATE", "path": "wiki/%s.md", "content": "x"}', "event_type")
    gone = F.lit('{"action": "DELETE", "path": "wiki/gone.md", "reason": "merged"}')
    whole = lambda *ops: F.concat(F.lit('{"operations": ['), F.concat_ws(", ", *ops), F.lit("]}"))
    made = [
        F.concat(F.lit("```json\n"), whole(one), F.lit("\n```")),
        whole(one, gone),
        whole(F.lit('{"action": "RENAME", "path": "a"}')),
        F.lit("Here is the payload you asked for."),
        F.concat(whole(one), F.lit("\nThat is all.")),
        whole(F.lit('{"action": "CREATE_OR_UPDATE", "path": "a", "content": 5}')),
        whole(F.lit('{"action": "DELETE", "path": "a"}')),
        whole(F.lit('{"action": "DELETE", "path": null, "reason": "r"}')),
        F.lit('{"operations": {"action": "DELETE"}}'),
        F.lit('{"operations": []}'),
        F.concat(F.lit('{"note": 1, "operations": ['), one, F.lit("]}")),
        F.concat(whole(one), F.lit(","), whole(one)),
    ]
    p = F.get(F.array(*made), i.cast("int"))
    parsed = d.read(spark, sf, "events").select("event_id", payload.operations(p).alias("p"))
    return parsed.select("event_id", F.col("p.valid").alias("valid"), F.when(F.col("p.valid"), F.size("p.operations")).alias("n_operations"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id AS job_id, event_type AS kind, ts AS created_at FROM events, n
          WHERE ts > now - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 500""")
def jobs_evict(spark, sf):
    jobs = d.jobs(spark, sf)
    return compile.evict(jobs, F.lit(jobs.agg(F.max("created_at")).first()[0]), ttl_seconds=86_400)


@query("""SELECT e.event_id AS job_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN 'unknown job ' || event_id END AS error FROM events e""")
def match_jobs(spark, sf):
    jobs = d.jobs(spark, sf)
    return compile.match_submissions(jobs.select("job_id"), jobs.where("job_id % 3 <> 0"))


@query("SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed FROM events")
def outcome_counts(spark, sf):
    e = d.read(spark, sf, "events")
    return compile.outcome_counts(e.select(F.when(F.col("event_type") == "error", "failed").alias("error")))


@query("""SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_url,
          CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END AS base FROM pages""")
def source_dispatch(spark, sf):
    return d.read(spark, sf, "pages").select("page_id", text.is_url(F.col("url")).alias("is_url"), text.base_url(F.col("url")).alias("base"))


@query("""SELECT doc_id, p AS path, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS inside
          FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'raw/../wiki/' || lang WHEN 1 THEN '../' || source WHEN 2 THEN './' || source || '/a.md' ELSE '/' || source END AS p FROM documents)""")
def vault_paths(spark, sf):
    i = F.col("doc_id") % 4
    p = F.when(i == 0, F.concat(F.lit("raw/../wiki/"), "lang")).when(i == 1, F.concat(F.lit("../"), "source")).when(i == 2, F.concat(F.lit("./"), "source", F.lit("/a.md"))).otherwise(F.concat(F.lit("/"), "source"))
    docs = d.read(spark, sf, "documents").select("doc_id", p.alias("path"))
    return docs.select("doc_id", "path", text.inside_vault(F.col("path")).alias("inside"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, string_split(substr(url, strpos(url, '://') + 3), '/')[1] AS provider,
          upper(regexp_replace(substr(url, strpos(url, '://') + 3), '[^A-Za-z0-9]', '_', 'g')) AS env, '{"a":' || page_id || '}' AS bare FROM pages""")
def text_functions(spark, sf):
    rest = F.substring_index("url", "://", -1)
    fenced = F.concat(F.lit("\n```json\n{\"a\":"), "page_id", F.lit("}\n```\n"))
    return d.read(spark, sf, "pages").select("page_id", text.file_stem(F.col("url")).alias("stem"), text.model_spec(rest)["provider"].alias("provider"), text.env_name(rest).alias("env"), text.strip_code_fence(fenced).alias("bare"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T ' || lang ELSE '' END AS title,
          sha256(chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || '#  T ' || lang || ' ' || chr(10) ELSE '' END || text) AS body_sha256 FROM documents""")
def raw_frontmatter(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x\n#  T "), "lang", F.lit(" \n"))).otherwise(F.lit(""))
    body = text.raw_body(F.concat(F.lit("---\ntype: raw\n---\n\n"), head, "text"))
    return d.read(spark, sf, "documents").select("doc_id", text.raw_title(body).alias("title"), F.sha2(body, 256).alias("body_sha256"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value < 5) THEN 'unhealthy' WHEN bool_or(value < 10) THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id""")
def health_rollup(spark, sf):
    status = F.when(F.col("value") < 5, "unhealthy").when(F.col("value") < 10, "degraded").otherwise("healthy")
    e = d.read(spark, sf, "events").select("user_id", (F.col("event_type") == "purchase").alias("critical"), status.alias("status"))
    return compile.health(e, ["user_id"])


@query(
    f"""WITH {d.OUTCOMES}, kn AS (
        SELECT uri, seq, op, last_value(CASE WHEN op IN ('ingest', 'purge') THEN op END IGNORE NULLS) OVER (PARTITION BY uri ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM ev
    )
    SELECT uri, seq, op, outcome FROM oc UNION ALL SELECT uri, seq, op, CASE WHEN entry = 'ingest' THEN 'compiled' ELSE 'error' END FROM kn WHERE op = 'compile'"""
)
def stream_manifest(spark, sf):
    """The event log as a stream, run to its end: what a stream says of each event is what the batch form says."""
    return state.run_to_end(d.events(spark, sf), state.manifest_stream).select("uri", "seq", "op", "outcome")


@query("""SELECT event_id, '{"api_key": "[REDACTED]", "props": ' || props || '}' AS props FROM events""")
def redact_props(spark, sf):
    """The tables' props are flat; tests hold other nesting against a recursive function."""
    e = d.read(spark, sf, "events")
    return e.select("event_id", payload.redact(F.concat(F.lit('{"api_key": "k", "props": '), "props", F.lit("}"))).alias("props"))


def _calls(spark, sf):
    e = d.read(spark, sf, "events")
    return e.select("user_id", F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") < F.lit(30.0)).alias("failed"))


_CALLS = """ca AS (
        SELECT user_id, event_id AS call_id, epoch_us(ts) / 1e6 AS t, value < 30 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events
    )"""


@query(
    f"""WITH RECURSIVE {_CALLS}, fo AS (
        SELECT user_id, call_id, n, [t] AS passed, true AS result FROM ca WHERE n = 1
        UNION ALL
        SELECT user_id, call_id, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3
        FROM (SELECT ca.user_id, ca.call_id, ca.n, ca.t, list_filter(fo.passed, lambda p: ca.t - p < 86400) AS live FROM fo JOIN ca ON ca.user_id = fo.user_id AND ca.n = fo.n + 1)
    ) SELECT user_id, call_id, result FROM fo"""
)
def rate_limiter(spark, sf):
    """A refused call leaves no trace, so this is a sequential fold."""
    return state.rate_limiter(_calls(spark, sf), "user_id", limit=3, window=86_400.0)


@query(
    f"""WITH RECURSIVE {_CALLS}, fo AS (
        SELECT user_id, n, call_id, 'closed' AS result, failed::INT AS failures, 'closed' AS state, t AS since FROM ca WHERE n = 1
        UNION ALL
        SELECT user_id, n, call_id, met, CASE WHEN met = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END,
               CASE WHEN met = 'open' THEN state WHEN NOT failed THEN 'closed' WHEN met = 'half_open' OR failures + 1 >= 3 THEN 'open' ELSE met END,
               CASE WHEN met <> 'open' AND failed AND (met = 'half_open' OR failures + 1 >= 3) THEN t ELSE since END
        FROM (
            SELECT ca.*, fo.failures, fo.state, fo.since, CASE WHEN fo.state <> 'open' THEN fo.state WHEN ca.t - fo.since < 86400 THEN 'open' ELSE 'half_open' END AS met
            FROM fo JOIN ca ON ca.user_id = fo.user_id AND ca.n = fo.n + 1
        )
    ) SELECT user_id, call_id, result FROM fo"""
)
def circuit_breaker(spark, sf):
    return breaker.circuit_breaker(_calls(spark, sf), "user_id", threshold=3, reset=86_400.0)
