"""Exact top-k search by inner product with a KD-tree in each shard.

Components are first made integers, floor(scale * x), so every score is exact. Vectors are dealt to shards of a bounded
size in bytes by a hash of their id; each shard is a KD-tree with median splits along the widest dimension and tight bounding boxes
at every node, built once and written. The most that a query can score in a box is the sum over dimensions of
max(q * low, q * high). A block of queries descends a tree level by level, dropping (query, node) pairs whose bound is below the
query's kth score so far; then each query visits its leaves best first until the next leaf's bound is below its kth score.

Every query first searches the tree of its own shard; the kth score that it finds there goes with it to all others, and is
carried on from tree to tree of a task. Pairs of a block and a chain of shards are the tasks, so no task holds more than one block and
`CHAIN` trees, whatever the table's size; chains are shorter while there are fewer tasks than cores.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row without an id; components of
any finite size are exact; vectors of other lengths than the query's are no candidates; rows that share the query's id are its own;
identical rows (id and vector) count once, and where one id has several vectors their lists merge into the k best; ties go to the
smaller id; a table of k or fewer other rows gives them all, an empty one none; a score beyond the range of a long counts as the
nearest long; extra columns, with whatever names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, written

K = 20
SCALE = 64
QUERY_STEP = 20
#: Bytes of a shard's and of a block's vectors, at eight a component.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
LEAF_ROWS = 256
CHAIN = 8
LEAST, MOST = -(2**63), 2**63 - 1


def integers(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, dim, vec, raw, without the rows that take no part. vec holds doubles: the integers, or, where one of them is beyond the
    range of a double (raw), the components."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, dims, vecs, raws = [], [], [], []
        lists = b.column(1)
        start, flat = lists.offsets.to_numpy(), lists.values.cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False)  # a null becomes NaN
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(values * scale)
        none = np.asarray(lists.is_null())
        key = b.column(0)
        for i in range(len(lists)):
            a, z = start[i], start[i + 1]
            if not none[i] and key[i].is_valid and np.isfinite(values[a:z]).all():
                raw = not np.isfinite(scaled[a:z]).all()
                ids.append(key[i].as_py())
                dims.append(z - a)
                vecs.append((values if raw else scaled)[a:z].astype("<f8").tobytes())
                raws.append(raw)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(raws, pa.bool_())], ["id", "dim", "vec", "raw"])

    src = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return arrow_map(src, run, "id long, dim int, vec binary, raw boolean").dropDuplicates()


def exact(vecs: np.ndarray, raw: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The integers of rows of vec: as doubles, or as Python's integers where some row is raw."""
    if not raw.any():
        return vecs
    one = lambda x: math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale
    return np.array([[(one if r else int)(x) for x in row] for row, r in zip(vecs.tolist(), raw.tolist(), strict=True)], object).reshape(vecs.shape)


def cuts_of(n: int, leaf_rows: int) -> list[list[tuple[int, int]]]:
    """The row ranges of the nodes of each level: halves of those above."""
    levels = [[(0, n)]]
    for _ in range(max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))):
        levels.append([half for a, z in levels[-1] for half in ((a, (a + z) // 2), ((a + z) // 2, z))])
    return levels


def tree_order(vecs: np.ndarray, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """Rows in the order of a KD-tree's leaves."""
    order = np.arange(len(vecs))
    for level in cuts_of(len(vecs), leaf_rows)[:-1]:
        for a, z in level:
            if z - a > 1 and vecs.shape[1]:
                rows = order[a:z]
                with np.errstate(over="ignore"):
                    axis = int((vecs[rows].max(axis=0) - vecs[rows].min(axis=0)).argmax())
                order[a:z] = rows[np.argpartition(vecs[rows, axis], (a + z) // 2 - a)]
    return order


class KDTree:
    """Leaves of consecutive rows; level l holds 2**l nodes, each with its row range and box."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf_rows: int = LEAF_ROWS, ordered: bool = False):
        order = np.arange(len(ids)) if ordered else tree_order(vecs, leaf_rows)
        self.levels = cuts_of(len(ids), leaf_rows)
        self.ids, self.vecs = ids[order], vecs[order]
        self.boxes = []
        for cuts in self.levels:
            empty = np.zeros(vecs.shape[1], vecs.dtype)
            self.boxes.append((np.array([self.vecs[a:z].min(axis=0) if z > a else empty for a, z in cuts]), np.array([self.vecs[a:z].max(axis=0) if z > a else empty for a, z in cuts])))


def _as(a: np.ndarray, kind) -> np.ndarray:
    if kind is object and a.dtype != object:
        return np.array([int(x) for x in a.ravel().tolist()], object).reshape(a.shape)
    return a.astype(kind)


def _dtype(q: np.ndarray, v: np.ndarray):
    """One in which every score and bound is exact."""
    if not q.size or not v.size:
        return np.float64
    most = q.shape[1] * int(max(abs(int(q.min())), abs(int(q.max())))) * int(max(abs(int(v.min())), abs(int(v.max()))))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Top:
    """The k best (score, id) of each query so far; least: what the kth is known to be at least."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.n, self.k = n, k
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)
        self.kth = np.full(n, -np.inf, object) if least is None else least

    def add(self, q: list[np.ndarray], score: list[np.ndarray], ids: list[np.ndarray]) -> None:
        q_, s_, i_ = np.concatenate([self.q, *q]), np.concatenate([self.score, *score]), np.concatenate([self.id, *ids])
        order = np.lexsort((i_, -s_, q_))
        q_, s_, i_ = q_[order], s_[order], i_[order]
        first = np.searchsorted(q_, np.arange(self.n))
        rank = np.arange(len(q_)) - first[q_]
        full = q_[rank == self.k - 1]
        self.kth = self.kth.astype(s_.dtype) if s_.dtype != object else self.kth
        self.kth[full] = np.maximum(self.kth[full], s_[rank == self.k - 1])
        kept = rank < self.k
        self.q, self.score, self.id = q_[kept], s_[kept], i_[kept]


def _clip(scores: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(scores, MOST), LEAST) if scores.dtype == object else scores


def search(tree: KDTree, q_ids: np.ndarray, q: np.ndarray, top: Top, skip: np.ndarray | None = None) -> None:
    """Adds what tree holds for each query to top, but for queries that skip it."""
    kind = _dtype(q, tree.vecs)
    q, vecs = _as(q, kind), _as(tree.vecs, kind)
    if top.score.dtype != kind:
        wide = object if object in (kind, top.score.dtype) and len(top.q) else np.float64 if len(top.q) else kind
        top.score, top.kth = top.score.astype(wide), top.kth.astype(wide)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    alive = np.ones((len(q), 1), bool) if skip is None else ~skip[:, None]
    for level, (low, high) in enumerate(tree.boxes):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        bound = np.full(alive.shape, -np.inf, kind)
        nodes = np.flatnonzero(alive.any(axis=0))
        bound[:, nodes] = _clip(plus @ _as(high[nodes], kind).T + minus @ _as(low[nodes], kind).T)
        alive &= bound >= top.kth[:, None]
    leaves = tree.levels[-1]
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(leaves)):
        leaf = order[:, turn]
        open_ = np.flatnonzero((bound[np.arange(len(q)), leaf] >= top.kth) & alive[np.arange(len(q)), leaf])
        if not len(open_):
            break
        found_q, found_s, found_i = [], [], []
        for x in np.unique(leaf[open_]):
            a, z = leaves[x]
            if z == a:
                continue
            who = open_[leaf[open_] == x]
            score = _clip(q[who] @ vecs[a:z].T)
            own = tree.ids[a:z][None, :] == q_ids[who][:, None]
            if kind is object:
                good = ~own
            else:
                score[own] = -np.inf
                least = top.kth[who].astype(kind)
                if z - a > top.k:
                    least = np.maximum(least, np.partition(score, z - a - top.k, axis=1)[:, z - a - top.k])
                good = (score >= least[:, None]) & ~own
            r, c = np.nonzero(good)
            found_q.append(who[r])
            found_s.append(score[r, c])
            found_i.append(tree.ids[a:z][c])
        if found_q:
            top.add(found_q, found_s, found_i)


def _vectors(t: pa.Table, dim: int) -> np.ndarray:
    vecs = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(-1, dim) if dim else np.zeros((t.num_rows, 0))
    return exact(vecs, np.asarray(t.column("raw")))


def _build(t: pa.Table) -> pa.Table:
    """One row for a shard: its ids, vectors and raw marks in the order of its tree."""
    dim = t.column("dim")[0].as_py()
    vecs = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(-1, dim) if dim else np.zeros((t.num_rows, 0))
    order = tree_order(vecs)
    ids, raw = t.column("id").to_numpy()[order].astype("<i8"), np.asarray(t.column("raw"))[order]
    one = [[t.column("shard")[0].as_py()], [dim], [ids.tobytes()], [vecs[order].tobytes()], [np.packbits(raw).tobytes()]]
    return pa.table([pa.array(x, k) for x, k in zip(one, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "dim", "ids", "vecs", "raws"])


_TREE = "shard int, dim int, ids binary, vecs binary, raws binary"
_FOUND = "query_id long, vec_id long, score long, kth long"


def _tree(row: dict) -> KDTree:
    ids = np.frombuffer(row["ids"], "<i8")
    raw = np.unpackbits(np.frombuffer(row["raws"], np.uint8), count=len(ids)).astype(bool)
    return KDTree(ids, exact(np.frombuffer(row["vecs"], "<f8").reshape(len(ids), row["dim"]), raw), ordered=True)


def _searcher(k: int, own: bool):
    """Over a block's queries (id, dim, vec, raw, shard, least) and some trees; own: the trees of the queries' shard, else queries skip
    those. kth is null for a query that has found fewer than k."""

    def run(q: pa.Table, trees: pa.Table) -> pa.Table:
        out: list = [[], [], [], []]
        if q.num_rows and trees.num_rows:
            ids, vecs, shard = q.column("id").to_numpy(), _vectors(q, q.column("dim")[0].as_py()), q.column("shard").to_numpy()
            least = [-np.inf if x is None else x for x in q.column("least").to_pylist()]
            top = Top(len(ids), k, np.array(least, object))
            for row in trees.sort_by("shard").to_pylist():
                search(_tree(row), ids, vecs, top, None if own else shard == row["shard"])
            full = np.bincount(top.q, minlength=len(ids)) >= k
            out = [ids[top.q], top.id, [int(x) for x in top.score], [int(top.kth[i]) if full[i] else None for i in top.q]]
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score", "kth"])

    return run


def top_k(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_step, its k best other rows."""
    rows = written(integers(embeddings, id_col, vec_col), "topk-integers")
    n, dim, asked = rows.agg(F.count("*"), F.max("dim"), F.count_if(F.col("id") % query_step == 0)).first()
    width = 8 * max(1, dim or 1)
    shards = max(1, math.ceil(n / (shard_rows or max(LEAF_ROWS, SHARD_BYTES // width))))
    blocks = max(1, math.ceil(asked / (block_queries or max(LEAF_ROWS, BLOCK_BYTES // width))))
    chain = max(1, min(CHAIN, shards * blocks // (2 * embeddings.sparkSession.sparkContext.defaultParallelism)))
    chains = math.ceil(shards / chain)
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = rows.withColumn("shard", deal(shards))
    trees = written(rows.groupBy("shard", "dim").applyInArrow(_build, _TREE), "topk-trees")

    queries = rows.where(F.col("id") % query_step == 0)
    first = queries.withColumn("least", F.lit(None).cast("long"))
    by = ("shard", "dim")
    own = written(first.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(_searcher(k, True), _FOUND), "topk-own")
    seeds = own.groupBy(F.col("query_id").alias("id")).agg(F.max("kth").alias("least"))

    left = queries.join(seeds, "id", "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    left = left.withColumn("chain", F.explode(numbers(chains)))
    right = trees.withColumn("chain", (F.col("shard") / chain).cast("int")).withColumn("block", F.explode(numbers(blocks)))
    by = ("block", "chain", "dim")
    rest = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searcher(k, False), _FOUND)
    best = own.unionByName(rest)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
