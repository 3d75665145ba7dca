"""Search: BM25 over terms, nearest sections by vector, and rank fusion - for one query or many at once.

Queries are a DataFrame (query_id, text) or (query_id, vector). BM25 answers from an index on disk: lists of postings, document
frequencies and lengths, all of which are made once and don't depend on queries; texts aren't read again. A query's
terms meet their lists in one join, and only lists that are asked for are cut up into postings; scores add up under numbers that stand for
documents, and paths are looked up for the best of each query. Where many postings would be scored, `maxscore` leaves out documents that can't be among the best. With `group`, as for several vaults, statistics, rankings and limits are each group's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import terms
from ..sources.partitions import fresh_path, written
from . import bydoc, counting, maxscore, routing

K1, B = 1.2, 0.75
RRF_K = 60
DIGITS = 6
SHARD_ROWS = 16_384
#: Up to so many different terms of all queries are pushed down to the scan of postings.
PUSHED_TERMS = 1_000
#: Up to so many are sent to every task, with what is known of them; beyond, postings are shuffled by term.
BROADCAST_TERMS = 100_000
#: From so many postings on, counted for each query that asks for them, all queries' scores of a document are computed at once.
DEALT_ROWS = 20_000_000
#: As long as queries ask for no more terms than so many, counted for each query and field: every task has them.
DEALT_ASKED = 1_000_000
#: Else, from so many postings on, documents that can't be among the best aren't scored.
PRUNED_ROWS = 100_000_000
FIELDS = ("title", "body")


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """path, field, term, tf, doc_len: the inverted index as a table. Rows of documents under one path add up where their field is of one
    length; only then they are shuffled."""
    names = ("path", "field", "term", "tf", "doc_len")
    found = counting.counted(docs, fields, ("path",)).select(*names)
    if docs.groupBy("path").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("path", "field", "term", "doc_len").agg(F.sum("tf").alias("tf")).select(*names)


def write_postings(docs: DataFrame, path: str) -> None:
    """The whole table anew, sorted by term within files so that a term's rows lie together."""
    postings(docs).repartition("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(path)


@dataclass
class Index:
    """Lists of a run of documents, whose numbers are `base` and an entry of docs: heads(group, base, docs, path) of the documents, and lists(group,
    base, field, term, df, docs, tf, doc_len, block, positions where the index has them) of a term's postings; lengths(group, field, n, mean)."""

    heads: DataFrame
    lists: DataFrame
    lengths: DataFrame
    group: tuple[str, ...]
    positions: bool = False

    @property
    def docs(self) -> DataFrame:
        """group, doc, path."""
        cut = self.heads.select(*self.group, "base", "path", F.posexplode("docs").alias("_at", "_doc"))
        return cut.select(*self.group, (F.col("base") + F.col("_doc")).alias("doc"), F.get("path", F.col("_at")).alias("path"))

    @property
    def postings(self) -> DataFrame:
        """group, doc, block, field, term, tf, doc_len, positions where the index has them."""
        return self._cut(self.lists.drop("df"), [*self.group, "field", "term"])

    def found(self, wanted: DataFrame, key: list[str]) -> DataFrame:
        """postings that wanted has the key of, with its other columns."""
        more = [c for c in wanted.columns if c not in key]
        return self._cut(self.lists.drop("df").join(wanted, key), [*self.group, "field", "term", *more])

    def _cut(self, lists: DataFrame, names: list[str]) -> DataFrame:
        own = ["tf", "doc_len", "block", *(["positions"] if self.positions else [])]
        cut = lists.select(*names, "base", *own, F.posexplode("docs").alias("_at", "_doc"))
        kinds = {"tf": "long", "doc_len": "long", "block": "int", "positions": "array<int>"}
        return cut.select(*names, (F.col("base") + F.col("_doc")).alias("doc"), *(F.get(c, F.col("_at")).cast(kinds[c]).alias(c) for c in own))

    @property
    def terms(self) -> DataFrame:
        """group, field, term, df of all terms. A search counts those that it asks for."""
        return self.lists.groupBy(*self.group, "field", "term").agg(F.sum("df").alias("df"))


def weigh(tf, doc_len, mean):
    """What postings give, without their terms' idf: columns of Spark, or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean))


def posting_weight() -> Callable:
    return weigh


def weight() -> Column:
    return weigh(F.col("tf").cast("double"), F.col("doc_len"), F.col("mean"))


def write_index(docs: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, group: tuple[str, ...] = (), positions: bool = False) -> Index:
    """The index of documents (group, path, fields), anew; with positions it can answer phrases. Texts are read once and no terms
    are shuffled: each run of lists holds whole documents and is sorted by term, so that a search skips the pages without its terms."""
    spark = docs.sparkSession
    put = lambda df, what: df.write.mode("overwrite").parquet(f"{path}/{what}")
    put(counting.listed(docs, fields, group, positions), "rows")
    heads = spark.read.parquet(f"{path}/rows").where("term = ''")
    put(heads.where(F.col("field") == fields[0]).select(*group, "base", "docs", "path"), "docs")
    sums = heads.select(*group, "field", F.explode("doc_len").alias("_len")).groupBy(*group, "field").agg(F.count("*").alias("n"), F.sum("_len").alias("_sum"))
    put(sums.select(*group, "field", "n", (F.greatest("_sum", F.lit(1)) / F.col("n")).alias("mean")), "lengths")
    return read_index(spark, path, group, positions)


def read_index(spark: SparkSession, path: str, group: tuple[str, ...] = (), positions: bool = False) -> Index:
    own = "".join(f"{g} string, " for g in group)
    kinds = {
        "docs": f"{own}base long, docs array<int>, path array<string>",
        "rows": f"{own}base long, field string, term string, df int, docs array<int>, tf array<int>, doc_len array<int>, block array<tinyint>" + (", positions array<array<int>>" if positions else ""),
        "lengths": f"{own}field string, n long, mean double",
    }
    heads, rows, lengths = (spark.read.schema(k).parquet(f"{path}/{t}") for t, k in kinds.items())
    return Index(heads, rows.where("term != ''"), lengths, group, positions)


def term_statistics(postings_: DataFrame) -> DataFrame:
    """field, term, df."""
    return postings_.groupBy("field", "term").agg(F.count("*").alias("df"))


def top(df: DataFrame, limit: int, *order, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first `limit` rows of each query, with their rank. Spark keeps no more than that from each task."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= limit)


def idf() -> Column:
    return F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _small(n: int) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if n <= BROADCAST_TERMS else (lambda d: d)


def with_terms(index: Index, asked: DataFrame) -> Index:
    """The index with lists of the asked terms only: few are pushed down to the scan, which then skips what holds none of them."""
    few = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return index if len(few) > PUSHED_TERMS else replace(index, lists=index.lists.where(F.col("term").isin(few)))


def pruned_search(index: Index, queries: DataFrame, limit: int) -> maxscore.Search:
    """The search that leaves out documents which can't be among the best."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    blocks, known = statistics(index, asked)
    return maxscore.Search(with_terms(index, asked), known.select("query_id", *index.group, "field", "term", "idf", "mean", "df"), blocks, weight(), limit, _small(asked.count()))


def statistics(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the asked terms: blocks(group, field, term, block, df, upper), with the greatest weight of a term in each block of documents;
    and asked with n, mean, df and idf of each field (and group) that has the term."""
    key = [*index.group, "field", "term"]
    wanted = asked.select("term").distinct()
    found = with_terms(index, asked).found(_small(wanted.count())(wanted), ["term"]).join(F.broadcast(index.lengths), key[:-1])
    # A term has as many rows here as there are blocks at most, however many documents have it.
    blocks = written(found.groupBy(*key, "block").agg(F.count("*").alias("df"), F.max(weight()).alias("upper")), "asked-blocks")
    return blocks, _with_idf(index, blocks.groupBy(*key).agg(F.sum("df").alias("df")), asked)


def frequencies(index: Index, asked: DataFrame) -> DataFrame:
    """asked with n, mean, df and idf alone, for which no posting is read."""
    wanted = asked.select("term").distinct()
    lists = with_terms(index, asked).lists.join(_small(wanted.count())(wanted), "term")
    return _with_idf(index, lists.groupBy(*index.group, "field", "term").agg(F.sum("df").alias("df")), asked)


def _with_idf(index: Index, sums: DataFrame, asked: DataFrame) -> DataFrame:
    return sums.join(asked, "term").join(F.broadcast(index.lengths), [*index.group, "field"]).withColumn("idf", idf())


def search_index(index: Index, queries: DataFrame, limit: int, pruned: bool | None = None) -> DataFrame:
    """query_id, path, score (rounded to six digits), rank; documents that share a term with the query, best first, ties by
    path. Scores add up over fields; lengths are exact. A query without terms finds nothing. How documents are scored (pruned; else
    document by document where many postings are asked for, unless too many queries ask) changes no row."""
    if pruned:
        return named(index, pruned_search(index, queries, limit).scores(), limit)
    group = index.group
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    asked = asked.groupBy("term").agg(F.collect_list("query_id").alias("queries"))
    known = written(frequencies(index, asked).select(*group, "field", "term", "df", "mean", "queries", "idf"), "asked-terms")
    size = known.agg(F.sum(F.col("df") * F.size("queries")).alias("pairs"), F.sum("df").alias("rows"), F.sum(F.size("queries")).alias("asked")).first()
    if pruned is None and (size.pairs or 0) >= DEALT_ROWS:
        if size.asked <= DEALT_ASKED:
            return named(index, bydoc.scores(with_terms(index, asked), known, posting_weight(), limit, size.rows), limit)
        if size.pairs >= PRUNED_ROWS:
            return named(index, pruned_search(index, queries, limit).scores(), limit)
    found = with_terms(index, asked).found(_small(known.count())(known.drop("df")), [*group, "field", "term"])
    scores = found.select(*group, "doc", (F.col("idf") * weight()).alias("weight"), F.explode("queries").alias("query_id")).groupBy("query_id", *group, "doc").agg(F.sum("weight").alias("weight"))
    return named(index, scores, limit)


def named(index: Index, scores: DataFrame, limit: int) -> DataFrame:
    """query_id, path, score, rank of scores(query_id, group, doc, weight). Paths are looked up for the best and for what ties with them."""
    own = ("query_id", *index.group)
    best = scores.select(*own, "doc", F.round("weight", DIGITS).alias("score"))
    best = best.withColumn("place", F.rank().over(W.partitionBy(*own).orderBy(F.desc("score")))).where(F.col("place") <= limit)
    return top(best.join(index.docs.select("doc", "path"), "doc"), limit, F.desc("score"), "path", by=own).select(*index.group, "query_id", "path", "score", "rank")


def bm25(docs: DataFrame, queries: DataFrame, limit: int, fields: tuple[str, ...] = FIELDS, group: tuple[str, ...] = ()) -> DataFrame:
    """search_index over documents that have no index yet: it is made in the shared folder."""
    path = fresh_path(docs.sparkSession, "index")
    return search_index(write_index(docs, path, fields, group), queries, limit)


def nearest(sections: DataFrame, queries: DataFrame, limit: int, shard_rows: int = SHARD_ROWS, group: tuple[str, ...] = ()) -> DataFrame:
    """query_id, section_key, path, distance (Euclidean, rounded to six digits), rank: each query's nearest sections, ties
    by key. sections(section_key, path, vector), queries(query_id, vector); exact.

    A table of more than one shard is cut into cells of neighbours, and a query meets only the cells that can hold its nearest ones
    (`routing`); a task has a cell's shard and a block of queries, and passes on the best `limit` for every query. Null vectors, and those
    of another length than the query's, take no part."""
    s = sections.where("vector IS NOT NULL").select(*group, "section_key", "path", F.col("vector").cast("array<double>").alias("vector"))
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n, blocks = s.count(), max(1, math.ceil(q.count() / shard_rows))
    router = routing.Router(s, n, shard_rows, limit, group) if n > shard_rows else None
    found = _routed(router, q, limit, blocks) if router and router.by_dim else _everywhere(s, q, limit, max(1, math.ceil(n / shard_rows)), blocks, group)
    return top(found, limit, "distance", "section_key", by=("query_id", *group)).select(*group, "query_id", "section_key", "path", "distance", "rank")


def _deal(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _everywhere(s: DataFrame, q: DataFrame, limit: int, shards: int, blocks: int, group: tuple[str, ...]) -> DataFrame:
    """query_id, group, section_key, path, distance of the best of each shard, which every query meets."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = s.withColumn("shard", _deal("section_key", shards)).withColumn("block", every(blocks))
    left = q.withColumn("block", _deal("query_id", blocks)).withColumn("shard", every(shards))
    left, right = (d.withColumn("dim", F.size("vector")) for d in (left, right))
    return _meet(left, right, ("block", "shard", "dim"), limit, group, s.schema)


def _routed(router: routing.Router, q: DataFrame, limit: int, blocks: int) -> DataFrame:
    """The same from the cells that each query must ask."""
    own = written(_in_cells(router, router.pairs(q), limit, blocks), "nearest-own")
    best = top(own, limit, "distance", "section_key", by=("query_id", *router.group)).groupBy("query_id", *router.group)
    reached = best.agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") == limit)
    reached = reached.join(F.broadcast(router.groups), list(router.group)) if router.group else reached.withColumn("g", F.lit(0))
    return own.unionByName(_in_cells(router, router.pairs(q, reached.select("query_id", "g", "kth")), limit, blocks))


def _in_cells(router: routing.Router, pairs: DataFrame, limit: int, blocks: int) -> DataFrame:
    left = pairs.withColumn("block", _deal("query_id", blocks)).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    # Of the sections only cells that are asked move, once for each block of queries that does.
    right = router.sections.join(pairs.select("cell", _deal("query_id", blocks).alias("block")).distinct(), "cell")
    return _meet(left.drop("splits"), right, ("cell", "split", "block", "dim"), limit, router.group, router.sections.schema)


def _meet(left: DataFrame, right: DataFrame, by: tuple[str, ...], limit: int, group: tuple[str, ...], schema: T.StructType) -> DataFrame:
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, where, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by("section_key")
            x, y = _matrix(a.column("vector")), _matrix(b.column("vector"))
            names = [pa.compute.rank(pa.concat_arrays(b.column(g).cast("string").chunks), tiebreaker="dense").to_numpy() for g in group]
            _, part = np.unique(np.array(names), axis=1, return_inverse=True) if group else (None, np.zeros(len(y), np.int64))
            own = a.column("query_id").to_numpy()
            for g in np.unique(part):
                rows = np.flatnonzero(part == g)
                for i in range(0, len(x), 64):
                    who, j, d = _closest(x[i : i + 64], y[rows], limit)
                    ids.append(own[i + who])
                    where.append(rows[j])
                    far.append(d)
        out = b.select([*group, "section_key", "path"]).take(pa.array(np.concatenate(where)))
        return out.add_column(0, "query_id", pa.array(np.concatenate(ids), pa.int64())).append_column("distance", pa.array(np.concatenate(far)))

    kinds = ", ".join(["query_id long", *(f"{g} {schema[g].dataType.simpleString()}" for g in group), "section_key string", "path string", "distance double"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, kinds)


def _closest(x: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the nearest `limit` rows of y for each row of x, ties by place: one matrix product finds
    those that can be among them, and only their distances are computed exactly."""
    xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
    rough = np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0)
    k = min(limit, len(y)) - 1
    error = 1e-12 * x.shape[1] * (xx[:, None] + yy.max(initial=0))  # of the product, and of rounding to six digits
    least = np.sqrt(np.partition(rough, k, axis=1)[:, k, None] + error) + 2 * 10.0**-DIGITS
    who, j = np.nonzero(rough <= least**2 + error)
    d = np.round(np.sqrt(((y[j] - x[who]) ** 2).sum(axis=1)), DIGITS)
    order = np.lexsort((j, d, who))
    who, j, d = who[order], j[order], d[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < limit
    return who[kept], j[kept], d[kept]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def best_sections(hits: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """query_id, path, distance, section_key: of each path its nearest section."""
    best = hits.groupBy(*group, "query_id", "path").agg(F.min(F.struct("distance", "section_key")).alias("b"))
    return best.select(*group, "query_id", "path", "b.distance", "b.section_key")


def fuse(lists: DataFrame, k: int = RRF_K, group: tuple[str, ...] = ()) -> DataFrame:
    """query_id, item, score: reciprocal ranks added up. lists(query_id, item, rank)."""
    return lists.groupBy(*group, "query_id", "item").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def hybrid(docs: DataFrame, sections: DataFrame, text_queries: DataFrame, vector_queries: DataFrame, limit: int, group: tuple[str, ...] = (), index: Index | None = None) -> DataFrame:
    """query_id, path, score, rank, title, section_key: both rankings, twice as deep as asked for, fused. Without an index of the
    documents one is made.

    The limit of the vector side counts sections, so a path with many near ones leaves room for fewer others."""
    own = ("query_id", *group)
    text = search_index(index, text_queries, 2 * limit) if index else bm25(docs, text_queries, 2 * limit, group=group)
    # Both are read more than once, and small: some rows a query.
    hits = written(best_sections(nearest(sections, vector_queries, 2 * limit, group=group), group), "near-sections")
    near = hits.withColumn("rank", F.row_number().over(W.partitionBy(*own).orderBy("distance", "path")).cast("int"))
    both = text.select(*own, F.col("path").alias("item"), "rank").unionByName(near.select(*own, F.col("path").alias("item"), "rank"))
    found = top(fuse(both, group=group), limit, F.desc("score"), "item", by=own).withColumnRenamed("item", "path")
    found = written(found.join(hits.select(*own, "path", "section_key"), [*own, "path"], "left"), "found")
    # At most `limit` rows a query are left, so titles are looked up for few paths.
    titles = docs.join(found.select(*group, "path").distinct(), [*group, "path"], "left_semi").select(*group, "path", "title")
    found = found.join(titles, [*group, "path"], "left")
    return found.select(*own, "path", "score", "rank", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("section_key", F.lit("")).alias("section_key"))


def federated(docs: DataFrame, sections: DataFrame, text_queries: DataFrame, vector_queries: DataFrame, limit: int, index: Index | None = None) -> DataFrame:
    """vault, query_id, path, score, rank, title, section_key: the best of what a hybrid search of each vault finds, each with its
    own statistics and cut to `limit`; ties by vault and path. docs and sections have a column vault."""
    found = hybrid(docs, sections, text_queries, vector_queries, limit, ("vault",), index).drop("rank")
    return top(found, limit, F.desc("score"), "vault", "path")


def open_vaults(vaults: dict[str, Callable[[], tuple[DataFrame, DataFrame]]]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(docs, sections, errors) of several vaults for `federated`, by functions that open them; a vault that can't be opened is
    left out, and errors say why."""
    docs = sections = None
    errors = {}
    for name, open_ in sorted(vaults.items()):
        try:
            pair = [x.withColumn("vault", F.lit(name)) for x in open_()]
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        docs, sections = pair if docs is None else (docs.unionByName(pair[0]), sections.unionByName(pair[1]))
    if docs is None:
        raise LookupError(f"no vault can be opened: {errors}")
    return docs, sections, errors
