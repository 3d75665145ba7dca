"""Relations in the shape of a vault, derived from the test tables by rules that both Spark and SQL state.

The tables hold prose without wiki syntax, so links, provenance and the event log come from ids by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..operators.ordered import numbered
from ..sources.partitions import fresh_path, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri, seq, op, hash: an ingest or delete for each document, some replays, deletes, purges and compiles."""
    d = read(spark, sf_dir, "documents")
    uri = F.concat(F.lit("doc://"), "source", F.lit("/"), "lang")
    i = F.col("doc_id")
    ops = F.array(
        F.when(i % 17 == 16, "delete").otherwise("ingest"),
        F.when(i % 5 == 0, "ingest"),
        F.when(i % 7 == 3, "delete"),
        F.when(i % 97 == 50, "purge").when(i % 11 == 2, "compile"),
    )
    e = d.select(uri.alias("uri"), i, text.content_hash(F.col("text")).alias("h"), F.posexplode(ops).alias("n", "op")).where("op IS NOT NULL")
    return e.select("uri", (4 * i + F.col("n")).cast("long").alias("seq"), "op", F.when(F.col("op") == "ingest", F.col("h")).alias("hash"))


EVENTS = """ev AS (
    SELECT 'doc://' || source || '/' || lang AS uri, seq, op, CASE WHEN op = 'ingest' THEN 'sha256:' || sha256(text) END AS hash
    FROM (
        SELECT source, lang, text, 4 * doc_id AS seq, CASE WHEN doc_id % 17 = 16 THEN 'delete' ELSE 'ingest' END AS op FROM documents
        UNION ALL SELECT source, lang, text, 4 * doc_id + 1, 'ingest' FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT source, lang, text, 4 * doc_id + 2, 'delete' FROM documents WHERE doc_id % 7 = 3
        UNION ALL SELECT source, lang, text, 4 * doc_id + 3, CASE WHEN doc_id % 97 = 50 THEN 'purge' ELSE 'compile' END
            FROM documents WHERE doc_id % 97 = 50 OR doc_id % 11 = 2
    )
)"""

OUTCOMES = (
    EVENTS
    + """, st AS (
    SELECT *, lag(hash) OVER (PARTITION BY uri ORDER BY seq) AS previous FROM ev WHERE op IN ('ingest', 'delete', 'purge')
), en AS (
    SELECT uri, seq, lag(op) OVER (PARTITION BY uri ORDER BY seq) AS entry FROM ev WHERE op IN ('ingest', 'purge')
), oc AS (
    SELECT st.*, CASE WHEN op = 'purge' THEN CASE WHEN entry = 'ingest' THEN 'purged' ELSE 'error' END
                      WHEN op = 'delete' THEN CASE WHEN previous IS NULL THEN 'error' ELSE 'tombstoned' END
                      WHEN previous IS NULL THEN 'new' WHEN previous = hash THEN 'no_op' ELSE 'superseded' END AS outcome
    FROM st LEFT JOIN en USING (uri, seq)
)"""
)

VERSIONS = (
    OUTCOMES
    + """, pu AS (
    SELECT uri, max(seq) AS purged FROM ev WHERE op = 'purge' GROUP BY uri
), lv AS (
    SELECT oc.*, lead(op) OVER w AS next_op, lead(hash) OVER w AS next_hash, lead(seq) OVER w AS next_seq
    FROM oc LEFT JOIN pu USING (uri)
    WHERE outcome IN ('new', 'superseded', 'tombstoned') AND (purged IS NULL OR seq > purged)
    WINDOW w AS (PARTITION BY uri ORDER BY seq)
), vs AS (
    SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY seq) AS version_no, seq, hash, 'raw_' || substr(hash, 8, 10) AS raw_id,
           CASE WHEN next_op IS NULL THEN 'ACTIVE' WHEN next_op = 'ingest' THEN 'SUPERSEDED' ELSE 'TOMBSTONED' END AS status,
           CASE WHEN next_op = 'ingest' THEN 'raw_' || substr(next_hash, 8, 10) END AS by_raw_id,
           CASE WHEN next_op = 'delete' THEN next_seq END AS tombstoned_seq
    FROM lv WHERE op = 'ingest'
)"""
)

ENTRIES = (
    VERSIONS
    + """, mk AS (
    SELECT uri, max(seq) FILTER (op = 'purge') AS purged, max(seq) FILTER (op = 'compile') AS compiled FROM ev GROUP BY uri
), cm AS (
    SELECT mk.uri, max_by(ev.hash, ev.seq) AS compiled_hash0, arg_max(struct_pack(h := ev.hash), ev.seq).h AS compiled_hash
    FROM mk LEFT JOIN ev ON ev.uri = mk.uri AND ev.op IN ('ingest', 'delete') AND ev.seq < compiled AND (purged IS NULL OR ev.seq > purged)
    WHERE compiled IS NOT NULL AND (purged IS NULL OR compiled > purged) GROUP BY mk.uri
), et AS (
    SELECT uri, n_versions, active_hash, compiled_hash,
           active_hash IS NOT NULL AND NOT coalesce(compiled_hash = active_hash, false) AS pending
    FROM (SELECT uri, count(*) AS n_versions, max(hash) FILTER (status = 'ACTIVE') AS active_hash FROM vs GROUP BY uri)
    LEFT JOIN cm USING (uri)
)"""
)


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, slug, title, description, type, id, sources, body: a page for each document, with links by arithmetic."""
    d = read(spark, sf_dir, "documents")
    n, i = F.lit(d.count()), F.col("doc_id")
    link = lambda inner: F.concat(F.lit(" [["), inner, F.lit("]]"))
    more = F.concat(link(F.concat(F.lit("d"), (13 * i) % (2 * n), F.lit("|alias"))), link(F.concat(F.lit("ext::d"), i % 5)))
    slug = F.concat(F.lit("d"), i)
    return d.select(
        F.concat(F.when(i % 4 == 0, "wiki/entities/").otherwise("wiki/concepts/"), slug, F.lit(".md")).alias("path"),
        slug.alias("slug"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(i % 2 == 0, F.col("lang")).alias("description"),
        F.when(i % 4 == 0, "entity").otherwise("concept").alias("type"),
        F.when(i % 3 == 0, F.concat(F.lit("concept_k"), i)).when(i % 3 == 1, F.concat(F.lit("n"), i)).alias("id"),
        F.concat("text", link(F.concat(F.lit("d"), (i * i) % n)), F.when(i % 3 == 0, more).otherwise(F.lit(""))).alias("body"),
        i,
    )


WIKI = """wk AS (
    SELECT CASE WHEN doc_id % 4 = 0 THEN 'wiki/entities/d' ELSE 'wiki/concepts/d' END || doc_id || '.md' AS path, 'd' || doc_id AS slug,
           string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS description,
           CASE WHEN doc_id % 4 = 0 THEN 'entity' ELSE 'concept' END AS type,
           CASE WHEN doc_id % 3 = 0 THEN 'concept_k' || doc_id WHEN doc_id % 3 = 1 THEN 'n' || doc_id END AS id,
           text || ' [[d' || ((doc_id * doc_id) % n) || ']]' || CASE WHEN doc_id % 3 = 0
               THEN ' [[d' || ((13 * doc_id) % (2 * n)) || '|alias]] [[ext::d' || (doc_id % 5) || ']]' ELSE '' END AS body, doc_id
    FROM documents, (SELECT count(*) AS n FROM documents)
)"""
LINKS = (
    WIKI
    + """, lk AS (
    SELECT path, pos - 1 AS pos, CASE WHEN strpos(t, '::') > 0 THEN 'cross_vault' ELSE 'local' END AS kind,
           CASE WHEN strpos(t, '::') > 0 THEN substr(t, 1, strpos(t, '::') - 1) END AS vault,
           CASE WHEN strpos(t, '::') > 0 THEN substr(t, strpos(t, '::') + 2) ELSE t END AS slug
    FROM (
        SELECT path, pos, string_split(inner_[pos], '|')[1] AS t
        FROM (SELECT path, list_filter(regexp_extract_all(body, '(?s)\\[\\[(.*?)\\]\\]', 1), lambda x: x <> '' AND NOT contains(x, chr(10))) AS inner_ FROM wk),
             LATERAL (SELECT unnest(range(1, len(inner_) + 1)) AS pos)
    )
)"""
)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, resource: each page cites its document's blob; some without .md, some a blob that doesn't exist."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rid = F.when(i % 13 == 5, F.concat(F.lit("raw_none"), i)).otherwise(text.raw_id(text.content_hash(F.col("text"))))
    page = F.concat(F.when(i % 4 == 0, "wiki/entities/d").otherwise("wiki/concepts/d"), i, F.lit(".md"))
    return d.select(page.alias("page"), F.concat(F.lit("/raw/"), rid, F.when(i % 11 == 3, "").otherwise(".md")).alias("resource"))


PROVENANCE = """pv AS (
    SELECT CASE WHEN doc_id % 4 = 0 THEN 'wiki/entities/d' ELSE 'wiki/concepts/d' END || doc_id || '.md' AS page,
           '/raw/' || CASE WHEN doc_id % 13 = 5 THEN 'raw_none' || doc_id ELSE 'raw_' || substr(sha256(text), 1, 10) END
           || CASE WHEN doc_id % 11 = 3 THEN '' ELSE '.md' END AS resource
    FROM documents
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("raw/"), text.raw_id(text.content_hash(F.col("text"))), F.lit(".md")).alias("path")).distinct()


FILES = "fl AS (SELECT DISTINCT 'raw/raw_' || substr(sha256(text), 1, 10) || '.md' AS path FROM documents)"


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("p"), "doc_id").alias("path"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("vault"))


_indexes: dict[tuple, str] = {}


def index(spark: SparkSession, sf_dir: str, by_vault: bool = False, positions: bool = False) -> search.Index:
    """The text index of the documents, made by the first query of a session that needs it, as long as the table's files stay the same."""
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(table)
    key = (spark.sparkContext.applicationId, by_vault, positions, tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)))
    group = ("vault",) if by_vault else ()
    if key not in _indexes:
        path = fresh_path(spark, "index")
        search.write_index(search_docs(spark, sf_dir), path, group=group, positions=positions)
        _indexes[key] = path
    return search.read_index(spark, _indexes[key], group, positions)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the benchmark's items, whole."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def related_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cut as the search for related pages cuts them."""
    return text_queries(spark, sf_dir).withColumn("text", text.query_text(F.col("text")))


def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 characters of each: a few words, as users type them."""
    return text_queries(spark, sf_dir).withColumn("text", F.substring("text", 1, 40))


#: Clauses that each benchmark item's words make, with x = its terms: sign, field, words. Item 7 k + 5 has a quotation mark too many, item
#: 7 k + 6 a field that there isn't.
def syntax_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.terms(F.col("text")).alias("x"))
    i, w = F.col("query_id"), lambda k: F.coalesce(F.get("x", F.lit(k)), F.lit("zz"))
    made = F.concat(
        F.lit('"'), w(0), F.lit(" "), w(1), F.lit('" '),
        F.when(i % 2 == 0, F.concat(F.lit("+"), w(2), F.lit(" "))).otherwise(F.lit("")),
        F.when(i % 3 == 0, F.concat(F.lit("-"), w(3), F.lit(" "))).otherwise(F.lit("")),
        F.lit("title:"), w(4), F.lit(" "), w(5), F.lit(" !! body:"), w(6), F.lit("-"), w(7),
        F.when(i % 7 == 5, ' "').when(i % 7 == 6, " nofield:x").otherwise(""),
    )
    return x.select("query_id", made.alias("text"))


def _bm25_sql(query_text: str, documents: str, by: str = "") -> str:
    """bm: the best {n} of each query (and of each group, by a column that `documents` has)."""
    g, using = (f"{by}, ", f"JOIN {{x}} USING ({by})") if by else ("", ", {x}")

    def field(f: str, e: str) -> str:
        return f"""{f}t AS (SELECT {g}'p' || doc_id AS path, list_filter(string_split_regex(lower({e}), '[^\\pL\\pN]+'), lambda t: t <> '' AND strlen(t) < 40) AS ts FROM {documents}),
{f}s AS (SELECT {g}count(*) AS n, coalesce(nullif(avg(len(ts)), 0), 1) AS mean FROM {f}t {f"GROUP BY {by}" if by else ""}),
{f}p AS (SELECT {g}path, len(ts) AS dl, unnest(ts) AS term FROM {f}t),
{f}c AS (SELECT {g}path, dl, term, count(*) AS tf FROM {f}p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
{f}d AS (SELECT {g}term, count(*) AS df FROM {f}c GROUP BY ALL),
{f}x AS (SELECT {g}query_id, path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS s
         FROM {f}c JOIN {f}d USING ({g}term) JOIN qt USING (term) {using.format(x=f + "s")})"""

    return f"""qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(string_split_regex(lower({query_text}), '[^\\pL\\pN]+')) AS term FROM benchmark) WHERE term <> '' AND strlen(term) < 40),
{field("ti", "string_split(text, chr(10))[1]")}, {field("bo", "text")},
bs AS (SELECT {g}query_id, path, round(sum(s), 6) AS score FROM (SELECT * FROM tix UNION ALL SELECT * FROM box) GROUP BY ALL),
bm AS (SELECT {g}query_id, path, score, CAST(row_number() OVER (PARTITION BY {g}query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM bs
       QUALIFY row_number() OVER (PARTITION BY {g}query_id ORDER BY score DESC, path) <= {{n}})"""


BM25 = _bm25_sql("text", "documents")
RELATED = _bm25_sql("substr(text, 1, 500)", "documents")
SHORT = _bm25_sql("substr(text, 1, 40)", "documents")
BM25_BY_VAULT = _bm25_sql("text", "(SELECT *, lang AS vault FROM documents)", "vault")


SYNTAX = """bt AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '' AND strlen(t) < 40) AS x FROM benchmark),
cl AS (
    SELECT query_id, 0 AS clause, '' AS sign, NULL AS limited, [coalesce(x[1], 'zz'), coalesce(x[2], 'zz')] AS ts FROM bt
    UNION ALL SELECT query_id, 1, '+', NULL, [coalesce(x[3], 'zz')] FROM bt WHERE query_id % 2 = 0
    UNION ALL SELECT query_id, 2, '-', NULL, [coalesce(x[4], 'zz')] FROM bt WHERE query_id % 3 = 0
    UNION ALL SELECT query_id, 3, '', 'title', [coalesce(x[5], 'zz')] FROM bt
    UNION ALL SELECT query_id, 4, '', NULL, [coalesce(x[6], 'zz')] FROM bt
    UNION ALL SELECT query_id, 5, '', 'body', [coalesce(x[7], 'zz'), coalesce(x[8], 'zz')] FROM bt
), cv AS (SELECT * FROM cl WHERE query_id % 7 < 5),
fd AS (
    SELECT path, field, list_filter(string_split_regex(lower(t), '[^\\pL\\pN]+'), lambda x: x <> '' AND strlen(x) < 40) AS ts
    FROM (SELECT 'p' || doc_id AS path, 'title' AS field, string_split(text, chr(10))[1] AS t FROM documents UNION ALL SELECT 'p' || doc_id, 'body', text FROM documents)
), st AS (SELECT field, count(*) AS n, coalesce(nullif(avg(len(ts)), 0), 1) AS mean FROM fd GROUP BY field),
tk AS (SELECT path, field, len(ts) AS dl, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM fd),
tn AS (SELECT * FROM tk WHERE term IN (SELECT unnest(ts) FROM cv)),
df AS (SELECT field, term, ln(1 + (any_value(n) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5)) AS idf FROM tn JOIN st USING (field) GROUP BY ALL),
oc AS (
    SELECT query_id, clause, sign, a.field, a.path, a.dl, count(*) AS tf, any_value(d1.idf) + coalesce(any_value(d2.idf), 0) AS idf
    FROM cv JOIN tn a ON a.term = ts[1] AND (limited IS NULL OR limited = a.field) JOIN df d1 ON d1.field = a.field AND d1.term = ts[1]
    LEFT JOIN tn b ON b.path = a.path AND b.field = a.field AND b.pos = a.pos + 1 AND b.term = ts[2] LEFT JOIN df d2 ON d2.field = a.field AND d2.term = ts[2]
    WHERE len(ts) = 1 OR b.path IS NOT NULL GROUP BY ALL
), sx AS (
    SELECT query_id, path, round(sum(CASE WHEN sign <> '-' THEN idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) END), 6) AS score,
           count(*) FILTER (sign = '-') AS excluded, count(DISTINCT clause) FILTER (sign = '+') AS has
    FROM oc JOIN st USING (field) GROUP BY ALL
), sf AS (SELECT query_id, path, score FROM sx WHERE excluded = 0 AND score IS NOT NULL AND has = CASE WHEN query_id % 2 = 0 THEN 1 ELSE 0 END)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    path = F.concat(F.lit("p"), F.floor(i / 5))
    return e.select(F.concat(path, F.lit("#"), i % 5).alias("section_key"), path.alias("path"), F.col("embedding").alias("vector"), i)


def section_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors with their document's language as the vault; those of no document are in the vault 'none'."""
    langs = read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.col("lang").alias("vault"))
    return vectors(spark, sf_dir).join(langs, "path", "left").withColumn("vault", F.coalesce("vault", F.lit("none")))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector: every fiftieth vector."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


KNN = """sv AS (SELECT 'p' || (vec_id // 5) || '#' || (vec_id % 5) AS section_key, 'p' || (vec_id // 5) AS path, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kn AS (
    SELECT query_id, section_key, path, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, section_key) AS INTEGER) AS rank
    FROM (SELECT q.vec_id AS query_id, section_key, path, round(list_distance(CAST(q.embedding AS DOUBLE[]), v), 6) AS distance
          FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, sv)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, section_key) <= {n}
)"""


#: Sections that a turn has at most: a text of less than 2 GB can't have more headings.
PARTS = 1 << 30


def chat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, i, heading, text: the sections of each conversation's transcript, where every turn is a heading and a text.

    Sections are cut turn by turn and then numbered, as one conversation may hold a large share of all turns."""
    c = read(spark, sf_dir, "conversations")
    cut = F.posexplode(text.sections(F.concat(F.lit("## "), "role", F.lit("\n"), "text"))).alias("k", "s")
    t = c.select(F.concat(F.lit("chat"), "conv_id").alias("path"), "turn", cut).where("s.text <> ''")
    t = t.select("path", (F.col("turn") * PARTS + F.col("k")).alias("at"), "s.heading", "s.text")
    # Order values lie PARTS apart, so a chunk holds some thousand turns.
    return numbered(t, ["path"], "at", "i", width=PARTS << 12).select("path", (F.col("i") - 1).alias("i"), "heading", "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_seq, op_seq, action, path, content: two operations for each document, on few paths."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    ops = F.array(
        F.struct(F.lit("CREATE_OR_UPDATE").alias("action"), F.concat(F.lit("wiki/concepts/d"), (i * 7) % 300, F.lit(".md")).alias("path"), F.col("text").alias("content")),
        F.struct(F.when(i % 5 == 1, "DELETE").otherwise("CREATE_OR_UPDATE").alias("action"), F.concat(F.lit("wiki/concepts/d"), (i * 11) % 400, F.lit(".md")).alias("path"), F.when(i % 5 != 1, F.col("lang")).alias("content")),
    )
    return d.select(i.alias("source_seq"), F.posexplode(ops).alias("op_seq", "o")).select("source_seq", "op_seq", "o.*")


OPERATIONS = """op AS (
    SELECT doc_id AS source_seq, 0 AS op_seq, 'CREATE_OR_UPDATE' AS action, 'wiki/concepts/d' || ((doc_id * 7) % 300) || '.md' AS path, text AS content FROM documents
    UNION ALL
    SELECT doc_id, 1, CASE WHEN doc_id % 5 = 1 THEN 'DELETE' ELSE 'CREATE_OR_UPDATE' END, 'wiki/concepts/d' || ((doc_id * 11) % 400) || '.md', CASE WHEN doc_id % 5 <> 1 THEN lang END FROM documents
)"""
