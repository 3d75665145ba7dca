"""Window functions for keys that may hold a large share of all rows.

lag, lead and row_number over (keys, order) would gather a key's rows in one task. Here each key's rows are cut into chunks
of `width` order values; a window runs inside each chunk, and what a chunk needs from its neighbours - one row, or a
count - comes from one aggregated row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / width).cast("long"))


def _joined(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    on = [df[k].eqNullSafe(edges[f"_e_{k}"]) for k in keys] + [df["_chunk"] == edges["_e_chunk"]]
    return df.join(edges, on[0] if len(on) == 1 else _all(on), "left").drop(*(f"_e_{k}" for k in keys), "_e_chunk")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def neighbour(df: DataFrame, keys: list[str], order: str, value: Column, name: str, before: bool = True, width: int = WIDTH) -> DataFrame:
    """df with the value in the row before (or after) within the keys; null where there is none. order has no ties."""
    cut = _chunked(df, order, width).withColumn("_value", F.struct(value.alias("v")))
    pick = (F.max_by if before else F.min_by)("_value", order)
    edges = cut.groupBy(*keys, "_chunk").agg(pick.alias("_edge"))
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    far = (F.lag if before else F.lead)("_edge").over(by_chunk)
    edges = edges.select(*(F.col(k).alias(f"_e_{k}") for k in keys), F.col("_chunk").alias("_e_chunk"), far.alias("_far"))
    near = (F.lag if before else F.lead)("_value").over(W.partitionBy(*keys, "_chunk").orderBy(order))
    out = _joined(cut.withColumn("_near", near), edges, keys)
    return out.withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_near", "_far", "_value", "_chunk")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the row's number within the keys, from 1."""
    cut = _chunked(df, order, width)
    edges = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*(F.col(k).alias(f"_e_{k}") for k in keys), F.col("_chunk").alias("_e_chunk"), before.alias("_before"))
    out = _joined(cut.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(order))), edges, keys)
    return out.withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_before", "_row", "_chunk")
