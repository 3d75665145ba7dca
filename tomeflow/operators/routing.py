"""Nearest neighbours by routing: a query goes only to the cells of vectors that can hold one of its nearest.

Some vectors, chosen by a hash, are pivots. Each vector belongs to its nearest pivot, and the vectors of a pivot lie in rings by
their distance to it: a ring of a group's vectors around a pivot is a cell. A query that is d away from the pivot of a cell whose vectors are
between lo and hi away from it is at least max(d - hi, lo - d) away from each of them. It first asks the cell with the least such
bound in each group; the distance of the limit-th row found there is a bound on what matters, and of all other cells only
those within it are asked. Pairs of a query and a cell are dropped before anything is shuffled for them.

A cell with more rows than a shard (copies have the same distances) is dealt to several by a hash. What reaches the driver is bounded:
`PIVOTS` vectors and a row for each of `CELLS` cells at most; where groups make more, `None` says that the route can't be planned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.partitions import discard, written

PIVOTS = 512
CELLS = 200_000
#: Distances are compared with so much room: more than they are rounded by.
SLACK = 3e-6


def rows_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the column's vectors their places and the vectors as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, at = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        place = np.flatnonzero(sizes == dim)
        out[dim] = place, flat[at[place][:, None] + np.arange(dim)].reshape(len(place), dim)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to each of y, from their differences."""
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in y], axis=1)) if len(y) else np.zeros((len(x), 0))


def pivots_of(sections: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vectors the different pivots among about n rows; none has fewer than one."""
    found = sections.select("vector").orderBy(F.xxhash64("section_key"), "section_key").limit(n).collect()  # n is bounded
    out: dict[int, list] = {}
    for r in found:
        v = np.array([np.nan if x is None else x for x in r.vector])
        if np.isfinite(v).all():
            out.setdefault(len(v), []).append(v)
    return {dim: np.unique(np.array(vs), axis=0) for dim, vs in out.items()}


def _added(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    more = T._parse_datatype_string(fields)
    schema = T.StructType([*df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(b)], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def placed(sections: DataFrame, pivots) -> DataFrame:
    """sections with dim, pivot, away. A vector that isn't finite is away from no pivot (null)."""

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        dim, pivot, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.nan)
        for d, (at, x) in rows_of(b.column(b.schema.get_field_index("vector"))).items():
            p = pivots.value.get(d, np.zeros((1, d)))
            dim[at] = d
            if np.isfinite(x).all():
                rough = (p**2).sum(axis=1) - 2 * (x @ p.T)
                near = rough.argmin(axis=1)
            else:
                near = np.zeros(len(x), np.int64)
            pivot[at], away[at] = near, np.sqrt(((x - p[near]) ** 2).sum(axis=1))
        return [pa.array(dim), pa.array(pivot), pa.array(away, mask=~np.isfinite(away))]

    return _added(sections, "dim int, pivot int, away double", fn)


@dataclass
class Cells:
    """What the driver knows of all cells of vectors of one length: arrays of one value a cell, by group, and each group's first."""

    number: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    few: np.ndarray  # has fewer rows than asked for
    group: np.ndarray
    first: np.ndarray

    def bounds(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """The least distance that each row of x has to what each cell holds."""
        d = distances(x, pivots)[:, self.pivot]
        least = np.maximum(np.maximum(d - self.high, self.low - d), 0)
        return np.where(np.isnan(least), 0, least)

    def own(self, bounds: np.ndarray) -> np.ndarray:
        """The cell of each group that each row asks first."""
        value = bounds + np.where(self.few, 1e300, 0)
        return np.stack([a + value[:, a:z].argmin(axis=1) for a, z in zip(self.first, [*self.first[1:], len(self.number)], strict=True)], axis=1)


class Router:
    """Plans which cells each query asks."""

    def __init__(self, sections: DataFrame, n: int, shard_rows: int, limit: int, group: tuple[str, ...]):
        self.group, self.limit = group, limit
        spark = sections.sparkSession
        self.pivots = spark.sparkContext.broadcast(pivots_of(sections, min(PIVOTS, 4 * math.ceil(n / shard_rows))))
        key = [*group, "dim", "pivot"]
        base = written(placed(sections, self.pivots), "nearest-placed")
        wide = base.groupBy(*key).agg(F.ceil(F.count("*") / shard_rows).alias("rings"), F.max("away").alias("radius"))
        ring = F.when(F.col("radius") > 0, F.least(F.floor(F.col("away") / F.col("radius") * F.col("rings")), F.col("rings") - 1)).otherwise(0)
        ringed = base.join(wide.withColumnsRenamed({c: f"{c}_" for c in key}), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]).drop(*(f"{c}_" for c in key))
        ringed = ringed.withColumn("ring", F.when(F.col("away").isNull(), -1).otherwise(ring).cast("int"))
        cells = written(ringed.groupBy(*key, "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), "nearest-cells")
        self.kept = [base, cells]
        self.n_cells = cells.count()
        self.by_dim: dict[int, Cells] = {}
        if self.n_cells > CELLS:
            return
        known = cells.orderBy("dim", *group, "pivot", "ring").collect()
        groups: dict[tuple, int] = {}
        code = [groups.setdefault(tuple(r[g] for g in group), len(groups)) for r in known]
        self.groups = spark.createDataFrame([(i, *g) for g, i in groups.items()], T.StructType([T.StructField("g", T.IntegerType()), *(sections.schema[g] for g in group)]))
        names = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("splits", T.IntegerType()), *(cells.schema[c] for c in (*key, "ring"))])
        self.numbers = spark.createDataFrame([(i, math.ceil(r.n / shard_rows), *(r[c] for c in (*key, "ring"))) for i, r in enumerate(known)], names)
        for d in {r.dim for r in known}:
            mine = sorted((code[i], i) for i, r in enumerate(known) if r.dim == d)
            at = [i for _, i in mine]
            g = np.array([c for c, _ in mine])
            open_ = lambda x, far: far if x is None else x
            self.by_dim[d] = Cells(
                np.array(at, np.int32),
                np.array([known[i].pivot for i in at]),
                np.array([open_(known[i].low, -np.inf) for i in at]),
                np.array([open_(known[i].high, np.inf) for i in at]),
                np.array([known[i].n < limit for i in at]),
                g,
                np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))),
            )
        number = self.numbers.withColumnsRenamed({c: f"{c}_" for c in (*key, "ring")})
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*key, "ring")]
        self.sections = ringed.join(F.broadcast(number), same).select(*group, "section_key", "path", "vector", "dim", "cell", F.pmod(F.xxhash64("section_key"), F.col("splits")).cast("int").alias("split"))

    def pairs(self, queries: DataFrame, reached: DataFrame | None = None) -> DataFrame:
        """query_id, vector, dim, cell, splits: the cells that queries(query_id, vector) ask first, or, with what they reached there
        (query_id, g, kth), all others that they must ask."""
        known = self.numbers.sparkSession.sparkContext.broadcast(self.by_dim)
        pivots, again = self.pivots, reached is not None
        if reached is not None:
            queries = queries.join(reached.groupBy("query_id").agg(F.collect_list(F.struct("g", "kth")).alias("reached")), "query_id", "left")

        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            out: list[list[int]] = [[] for _ in range(b.num_rows)]
            dims = np.zeros(b.num_rows, np.int32)
            limits = b.column(b.schema.get_field_index("reached")).to_pylist() if again else None
            for d, (at, x) in rows_of(b.column(b.schema.get_field_index("vector"))).items():
                dims[at] = d
                cells = known.value.get(d)
                if cells is None:
                    continue
                bounds = cells.bounds(x, pivots.value.get(d, np.zeros((1, d))))
                own = cells.own(bounds)
                for k, i in enumerate(at.tolist()):
                    if limits is None:
                        out[i] = cells.number[own[k]].tolist()
                    else:
                        kth = np.full(cells.group.max() + 1, np.inf)
                        for r in limits[i] or []:
                            if r["g"] < len(kth):
                                kth[r["g"]] = r["kth"]
                        asked = bounds[k] <= kth[cells.group] + SLACK
                        asked[own[k]] = False
                        out[i] = cells.number[asked].tolist()
            return [pa.array(dims), pa.array(out, pa.list_(pa.int32()))]

        rows = _added(queries, "dim int, cells array<int>", fn).select("query_id", "vector", "dim", F.explode("cells").alias("cell"))
        return rows.join(F.broadcast(self.numbers.select("cell", "splits")), "cell")

    def close(self) -> None:
        for df in self.kept:
            discard(df)
