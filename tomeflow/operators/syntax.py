"""Queries with phrases, required and excluded terms, and fields, over an index with positions.

A query is a list of clauses, each a word or a "phrase", with + (required) or - (excluded) and a field's name and a colon before it, all
of which may be left out: `"rate limit" +api -soup title:retries`. A word that has several terms (rate-limit) is a phrase of
them. A clause without a field is looked for in every field. A document is found if it has all required clauses, no excluded one and, where
none is required, at least one. Its score adds up over clauses and fields: a phrase counts as a term that occurs as often as the
phrase, with its terms' idf together; a clause that is written twice counts twice.

A query with an unbalanced quotation mark, a field that the index doesn't have or a colon elsewhere outside a phrase isn't valid and finds
nothing, as a query without terms does; so does one with excluded clauses only. Clauses without terms are passed over. Words such as AND, brackets
and boosts have no meaning of their own.

Positions of a phrase's terms, each less its place in the phrase, are intersected, beginning with the documents of its rarest
term; the other terms' postings are only joined with these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import terms
from ..sources.partitions import written
from . import bydoc, search

#: Documents are scored one by one only for so many terms of all clauses, counted for each field.
DEALT_TERMS = 50_000
#: The joins move a posting about so many times as often as those of a bag of words do.
MOVES = 10

_CLAUSE = r'([+-]?)(?:([A-Za-z_]+):)?(?:"([^"]*)"|([^\s"]+))'


def clauses(queries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """query_id, clause (from 0), sign, field (null: any), terms of each valid query's clauses that have terms."""
    rest = F.regexp_replace("text", _CLAUSE, "")
    cut = queries.where(F.trim(F.regexp_replace(rest, r"\s", "")) == "").select("query_id", F.posexplode(F.expr(f"regexp_extract_all(text, '{_CLAUSE}', 0)".replace("\\", "\\\\"))).alias("clause", "c"))
    part = lambda i: F.regexp_extract("c", _CLAUSE, i)
    name = F.nullif(part(2), F.lit(""))
    cut = cut.select("query_id", "clause", part(1).alias("sign"), name.alias("field"), F.concat(part(3), part(4)).alias("words"), part(4).contains(":").alias("colon"))
    wrong = F.col("colon") | ~F.coalesce(F.col("field").isin(*fields), F.lit(True))
    bad = cut.groupBy("query_id").agg(F.max(wrong).alias("bad")).where("bad")
    return cut.join(bad, "query_id", "left_anti").select("query_id", "clause", "sign", "field", terms(F.col("words")).alias("terms")).where(F.size("terms") > 0)


def _known(index: search.Index, asked: DataFrame) -> DataFrame:
    """query_id, clause, sign, n_terms, offset, group, field, term, df, mean, idf, rank: the terms of each clause in each field that has all of
    them, with their idf together and their rank by rarity; a written table."""
    if not index.positions:
        raise ValueError("phrases need an index with positions")
    place = ("query_id", "clause")
    each = asked.select(*place, "sign", F.col("field").alias("only"), F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
    known = search.frequencies(index, each).where("only IS NULL OR only = field")
    own = W.partitionBy(*place, *index.group, "field")
    # A clause with a term that the field hasn't got occurs nowhere in it.
    known = known.withColumns({"have": F.count("*").over(own), "idf": F.sum("idf").over(own), "rank": F.row_number().over(own.orderBy("df", "offset"))}).where("have = n_terms")
    return written(known.select(*place, "sign", "n_terms", "offset", *index.group, "field", "term", "df", "mean", "idf", "rank"), "asked-clauses")


def matches(index: search.Index, known: DataFrame) -> DataFrame:
    """query_id, clause, sign, group, doc, weight: a row for each field of a document that a clause occurs in."""
    group, place = index.group, ("query_id", "clause")
    posts = search.with_terms(index, known).found(known.drop("df"), [*group, "field", "term"])
    one = posts.where("n_terms = 1").select(*place, "sign", *group, "doc", (F.col("idf") * search.weight()).alias("weight"))
    found = posts.where("n_terms > 1").select(*place, "sign", *group, "field", "doc", "doc_len", "mean", "idf", "n_terms", "rank", F.transform("positions", lambda p: p - F.col("offset")).alias("starts"))
    key = [*place, *group, "field", "doc"]
    first = found.where("rank = 1")
    others = found.where("rank > 1").join(first.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("starts").alias("others"))
    both = first.join(others, key).where("n_terms = 1 + size(others)")
    both = both.withColumn("tf", F.size(F.aggregate("others", F.col("starts"), F.array_intersect))).where("tf > 0")
    return one.unionByName(both.select(*place, "sign", *group, "doc", (F.col("idf") * search.weight()).alias("weight")))


def _dealt(index: search.Index, known: DataFrame, needed: DataFrame, limit: int, rows: int) -> DataFrame:
    """query_id, group, doc, weight of at least the best documents; known is small enough for every task."""
    spark, group = known.sparkSession, index.group
    key = [*group, "field", "term"]
    number: dict[tuple, int] = {}
    clauses_: dict[tuple, dict] = {}
    phrases, means = set(), []
    for r in known.orderBy("query_id", "clause", *group, "field", "offset").collect():  # bounded by the caller
        at = tuple(r[c] for c in key)
        if at not in number:
            means.append((*at, r["mean"], len(number)))
            number[at] = len(number)
        if r.n_terms > 1:
            phrases.add(number[at])
        own = clauses_.setdefault((r.query_id, r.clause, r.sign), {})
        own.setdefault((*(r[g] for g in group), r.field), (r.idf, []))[1].append((number[at], r.offset))
    column = {q: i for i, q in enumerate(dict.fromkeys(q for q, *_ in clauses_))}
    least = np.zeros(len(column), np.int64)
    for r in needed.join(F.broadcast(known.select("query_id").distinct()), "query_id", "left_semi").collect():
        least[column[r.query_id]] = r.needed
    shared = spark.sparkContext.broadcast(([(column[q], sign, list(own.values())) for (q, _, sign), own in clauses_.items()], least))
    ids = spark.createDataFrame([(i, q) for q, i in column.items()], T.StructType([T.StructField("query", T.LongType()), known.schema["query_id"]]))
    schema = T.StructType([*(known.schema[c] for c in (*key, "mean")), T.StructField("number", T.IntegerType()), T.StructField("placed", T.BooleanType())])
    numbered = spark.createDataFrame([(*m, m[-1] in phrases) for m in means], schema)
    norm = search.K1 * (1 - search.B + search.B * F.col("doc_len") / F.col("mean"))
    found = search.with_terms(index, known).found(F.broadcast(numbered), key)
    found = found.select(*group, "doc", "number", "tf", norm.alias("norm"), F.when(F.col("placed"), F.col("positions")).alias("positions"))
    return bydoc.dealt(index, found, rows, lambda t: _best(t, shared.value, limit)).join(F.broadcast(ids), "query").drop("query")


def _best(t: pa.Table, shared: tuple[list, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, weight) of the best of one group's rows."""
    asked, needed = shared
    docs, rows, place = bydoc.placed(t)
    order = np.lexsort((place, t["number"].to_numpy()[rows]))
    place, rows = place[order], rows[order]
    t = t.select(["number", "tf", "norm", "positions"]).take(pa.array(rows)).combine_chunks()
    number, tf, norm = (t[c].to_numpy() for c in ("number", "tf", "norm"))
    lists = pa.concat_arrays(t["positions"].chunks or [pa.array([], pa.list_(pa.int32()))])
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat, first = lists.flatten().to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
    wide = 2 * int(flat.max(initial=0)) + 2**20  # more than any place in a text, and than any clause is long
    step, best = max(1, bydoc.CELLS // len(needed)), bydoc.Best(len(needed), limit)

    def starts(i: np.ndarray, offset: int) -> np.ndarray:
        """Where a phrase would begin for its term in these rows: one number for document and position."""
        own = sizes[i]
        at = np.repeat(first[i] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        return np.repeat(place[i] * wide, own) + flat[at] + wide // 2 - offset

    def hits(terms_: list[tuple[int, int]], a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, tf, norm) of a clause in a field."""
        spans = []
        for n, offset in terms_:
            i, z = np.searchsorted(number, (n, n + 1))
            i, z = i + np.searchsorted(place[i:z], (a, a + step))
            spans.append((np.arange(i, z), offset))
        spans.sort(key=lambda s: len(s[0]))
        i = spans[0][0]
        if len(spans) == 1:
            return place[i], tf[i].astype(float), norm[i]
        for other, _ in spans[1:]:
            i = i[np.isin(place[i], place[other], assume_unique=False)]
        found = starts(i, spans[0][1])
        for other, offset in spans[1:]:
            found = found[np.isin(found, starts(other[np.isin(place[other], place[i])], offset))]
        where, times = np.unique(found // wide, return_counts=True)
        return where, times.astype(float), norm[i][np.searchsorted(place[i], where)]

    for a in range(0, len(docs), step):
        n = min(step, len(docs) - a)
        sums, has, excluded = np.zeros((len(needed), n)), np.zeros((len(needed), n), np.int64), np.zeros((len(needed), n), bool)
        for q, sign, own in asked:
            for idf, terms_ in own:
                where, times, room = hits(terms_, a)
                if sign == "-":
                    excluded[q, where - a] = True
                else:
                    sums[q, where - a] += idf * (times * (search.K1 + 1) / (times + room))
                own_hits = where if terms_ is own[0][1] else np.union1d(own_hits, where)
            if sign == "+":
                has[q, own_hits - a] += 1
        best.add(np.where(excluded | (has < needed[:, None]), 0, sums).T, a)
    return best.who, docs[best.where], best.score


def search_syntax(index: search.Index, queries: DataFrame, limit: int, fields: tuple[str, ...] = search.FIELDS) -> DataFrame:
    """query_id, path, score, rank of queries(query_id, text) in this syntax, best first, ties by path. Where many postings are asked for,
    documents are scored one by one, as by `search.search_index`."""
    asked = clauses(queries, fields)
    needed = asked.groupBy("query_id").agg(F.count(F.when(F.col("sign") == "+", 1)).alias("needed"))
    known = _known(index, asked)
    size = known.agg(F.sum("df").alias("rows"), F.count("*").alias("asked")).first()
    if MOVES * (size.rows or 0) >= search.DEALT_ROWS and size.asked <= DEALT_TERMS:
        return search.named(index, _dealt(index, known, needed, limit, size.rows), limit)
    of = lambda sign: F.when(F.col("sign") == sign, F.col("clause"))
    scores = matches(index, known).groupBy("query_id", *index.group, "doc").agg(F.sum(F.when(F.col("sign") != "-", F.col("weight"))).alias("weight"), F.size(F.collect_set(of("+"))).alias("has"), F.count(of("-")).alias("excluded"))
    scores = scores.join(needed, "query_id").where("excluded = 0 AND has = needed AND weight IS NOT NULL")
    return search.named(index, scores.select("query_id", *index.group, "doc", "weight"), limit)
