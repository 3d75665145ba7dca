"""Scores of all queries, document by document.

Lists of asked terms are dealt by the run of documents that they are of, so that a document's scores are computed in one task, and neither
postings nor pairs of a query and a document are shuffled one by one. A task sorts its documents by path, adds up scores of some thousand documents at a time in a matrix with a column for each query, and
passes on, for each query, what can be among the best `limit`: what has the limit-th best score or more, up to rounding, and of equal scores only
the first `limit` by path. Equal documents have exactly equal scores, as terms are added in a fixed order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Postings of a task, about.
POSTINGS = 2_000_000
#: So many parts for each core, at least, where runs are dealt.
RUNS_EVENED = 3
#: Cells of a matrix of documents and queries.
CELLS = 2_000_000
#: More than scores are rounded by.
SLACK = 2e-6


def scores(index, known: DataFrame, weight: Callable, limit: int, rows: int) -> DataFrame:
    """query_id, group, doc, weight: at least every document that can be among the first `limit`. known(group, field, term, mean,
    idf, queries), a written table that every task can have; rows: how many postings its terms have; weight of arrays tf, doc_len and mean,
    without idf."""
    spark, group = known.sparkSession, index.group
    lists = known.orderBy(*group, "field", "term").collect()  # bounded by the caller
    column: dict = {}
    asking = np.array([q for r in lists for q in sorted(column.setdefault(q, len(column)) for q in r.queries)], np.int64)
    first = np.concatenate(([0], np.cumsum([len(r.queries) for r in lists])))
    shared = spark.sparkContext.broadcast((len(column), asking, first))
    ids = spark.createDataFrame(list(enumerate(column)), T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", known.schema["queries"].dataType.elementType)]))
    key = [*group, "field", "term"]
    schema = T.StructType([*(known.schema[c] for c in (*key, "mean", "idf")), T.StructField("number", T.IntegerType())])
    numbered = spark.createDataFrame([(*(r[c] for c in (*key, "mean", "idf")), i) for i, r in enumerate(lists)], schema)
    found = index.lists.join(F.broadcast(numbered), key).select(*group, "base", "number", "idf", "mean", "docs", "tf", "doc_len")
    heads = index.heads.select(*group, "base", F.lit(-1).alias("number"), "docs", "path")
    # A run may have several times the postings of another, so there are more parts than cores.
    parts = _parts(index, rows, RUNS_EVENED)
    best = _mapped(index, found.unionByName(heads, allowMissingColumns=True).repartition(parts, "base"), lambda t: _best(_postings(t, weight), shared.value, limit))
    return best.join(F.broadcast(ids), "query").drop("query")


def dealt(index, found: DataFrame, rows: int, best: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """query, group, doc, weight: what best makes of the rows of one group's documents. found(group, doc, number, ...) are some `rows` rows, which come
    with a row of each document that has its path, and the number -1."""
    both = found.unionByName(index.docs.select(*index.group, "doc", F.lit(-1).alias("number"), "path"), allowMissingColumns=True)
    return _mapped(index, both.repartition(_parts(index, rows), "doc"), best)


def _parts(index, rows: int, times: int = 1) -> int:
    return max(times * index.heads.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / POSTINGS))


def _mapped(index, dealt_: DataFrame, best: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    group = index.group
    out = T.StructType([T.StructField("query", T.LongType()), *(index.heads.schema[g] for g in group), T.StructField("doc", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        for part in _groups(pa.Table.from_batches(held), group) if held else ():
            query, doc, w = best(part)
            own = [part[g].combine_chunks().take(pa.array(np.zeros(len(query), np.int64))) for g in group]
            yield pa.RecordBatch.from_arrays([pa.array(query), *own, pa.array(doc), pa.array(w)], out.names)

    return dealt_.mapInArrow(run, out)


def _groups(t: pa.Table, group: tuple[str, ...]) -> Iterator[pa.Table]:
    if not group:
        yield t
        return
    for values in t.select(list(group)).group_by(list(group)).aggregate([]).to_pylist():
        part = t
        for g, v in values.items():
            part = part.filter(pc.is_null(part[g]) if v is None else pc.equal(part[g], v))
        yield part


def _postings(t: pa.Table, weight: Callable) -> pa.Table:
    """doc, number, weight, path: lists cut up; a document has the number -1."""
    array = lambda c: pa.concat_arrays(t[c].chunks)
    times = pc.list_value_length(t["docs"]).to_numpy()
    number = np.repeat(t["number"].to_numpy(), times)
    doc = np.repeat(t["base"].to_numpy(), times) + array("docs").flatten().to_numpy()
    is_list = t["number"].to_numpy() >= 0
    idf, mean = (np.repeat(t[c].to_numpy()[is_list], times[is_list]) for c in ("idf", "mean"))
    tf, doc_len = (array(c).flatten().to_numpy() for c in ("tf", "doc_len"))
    w = np.zeros(len(doc))
    w[number >= 0] = idf * weight(tf.astype(np.float64), doc_len, mean)
    # Only documents have paths.
    path = pa.array(np.cumsum(number < 0) - 1, mask=number >= 0)
    return pa.table({"doc": doc, "number": number, "weight": w, "path": array("path").flatten().take(path)})


def placed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, rows, place): the numbers of the documents, sorted by path, which rows are postings, and the place of each one's document."""
    number = t["number"].to_numpy()
    heads = np.flatnonzero(number < 0)
    heads = heads[pc.array_sort_indices(pa.concat_arrays(t["path"].take(pa.array(heads)).chunks)).to_numpy()]
    docs, rows = t["doc"].to_numpy()[heads], np.flatnonzero(number >= 0)
    by_id = np.argsort(docs)
    return docs, rows, by_id[np.searchsorted(docs, t["doc"].to_numpy()[rows], sorter=by_id)]


class Best:
    """The best documents of n queries, from matrices of scores (0: not found)."""

    def __init__(self, n: int, limit: int):
        self.limit, self.least = limit, np.zeros(n)
        self.who, self.where, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, sums: np.ndarray, a: int) -> None:
        """sums has a row for each document from place a on."""
        if len(sums) >= self.limit:
            self.least = np.maximum(self.least, np.partition(sums, -self.limit, axis=0)[-self.limit])
        d, q = np.nonzero((sums > 0) & (sums >= self.least - SLACK))
        who, where, score = np.append(self.who, q), np.append(self.where, d + a), np.append(self.score, sums[d, q])
        order = np.lexsort((where, -score, who))
        who, where, score = who[order], where[order], score[order]
        last = np.arange(len(who)) - np.searchsorted(who, who) == self.limit - 1
        self.least[who[last]] = np.maximum(self.least[who[last]], score[last])
        same = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (score[1:] != score[:-1]))[: len(who)])
        tied = np.arange(len(who)) - np.repeat(same, np.diff(np.append(same, len(who))))
        kept = (score >= self.least[who] - SLACK) & (tied < self.limit)
        self.who, self.where, self.score = who[kept], where[kept], score[kept]


def _best(t: pa.Table, shared: tuple[int, np.ndarray, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, weight) of the best of one group's rows."""
    n, asking, first = shared
    docs, rows, place = placed(t)
    number, weight = t["number"].to_numpy()[rows].astype(np.int64), t["weight"].to_numpy()[rows]
    order = np.argsort(place * len(first) + number)
    place, number, weight = place[order], number[order], weight[order]
    step, sizes, best = max(1, CELLS // n), np.diff(first), Best(n, limit)
    for a in range(0, len(docs), step):
        i, z = np.searchsorted(place, (a, a + step))
        own = sizes[number[i:z]]
        query = asking[np.repeat(first[number[i:z]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
        cells = np.repeat((place[i:z] - a) * n, own) + query
        best.add(np.bincount(cells, np.repeat(weight[i:z], own), min(step, len(docs) - a) * n).reshape(-1, n), a)
    return best.who, docs[best.where], best.score
