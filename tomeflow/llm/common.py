"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.partitions import discard, drop_path, fresh_path, spread, written  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Python makes objects of about so many bytes of Arrow data at a time, whatever a batch's rows are.
SLICE_BYTES = 1 << 20


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """fn over Arrow batches of a bounded size, which have rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(fn, slices(b))
        pa.default_memory_pool().release_unused()  # the worker may live on for other operators' tasks

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: list[str], bound: int | None) -> DataFrame:
    """About `bound` different rows (all, if it is None), chosen by a hash of the key columns, so the choice is the same on every run.
    Copies of a row are chosen or left together."""
    n = 0 if bound is None else df.count()
    if bound is None or n <= bound:
        return df
    steps = 1 << 40
    return df.where(F.pmod(F.xxhash64(*key), F.lit(steps)) < math.floor(bound / n * steps))


def one_label(labels: DataFrame, column: str, name: str) -> DataFrame:
    """id, name (0 or 1): the label of each doc_id, once. Ids with both labels, or none, aren't in it."""
    known = labels.select(F.col("doc_id").alias("id"), (F.col(column) > 0).cast("long").alias("y")).dropna()
    return known.groupBy("id").agg(F.min("y").alias(name), F.max("y").alias("_most")).where(F.col(name) == F.col("_most")).drop("_most")


def one_document(docs: DataFrame, sample: DataFrame, bounded: bool) -> DataFrame:
    """docs joined with a sample by id, broadcast only if its size is bounded, one row an id: where several documents share it, the one with the least hash of its
    columns (the least row, where these are equal)."""
    rest = [c for c in docs.columns if c != "id"]
    found = docs.join(F.broadcast(sample) if bounded else sample, "id").groupBy(*sample.columns).agg(F.min(F.struct(F.xxhash64(*rest).alias("_h"), *rest)).alias("_row"))
    return found.select(*sample.columns, *(F.col(f"_row.{c}").alias(c) for c in rest))


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_column(df: DataFrame, inputs: list[str], fn: Callable[..., pa.Array], name: str, ddl: str) -> DataFrame:
    """df with one more column, which fn makes from the input columns' Arrow arrays; all other columns pass unchanged."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(ddl))])
    at, names = [df.columns.index(c) for c in inputs], [*df.columns, name]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, fn(*(b.column(i) for i in at))], names)

    return arrow_map(df, run, schema)
