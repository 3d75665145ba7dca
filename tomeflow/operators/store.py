"""Tables of documents and sections as latest-wins views: upsert, replacement and removal without a MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifest import needing_embedding


def upsert(stored: DataFrame, changes: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """stored with changes on top, one row a key: of changes of one key the last by the column order, which only they have (without
    one, the greatest by their other columns)."""
    row = F.struct(*(c for c in stored.columns if c != key))
    last = changes.groupBy(key).agg((F.max_by(row, order) if order else F.max(row)).alias("_last")).select(key, "_last.*")
    return _replaced(stored, last, key).select(*stored.columns)


def _replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_sections(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All sections of the paths in new go, its own come."""
    return _replaced(stored, new, "path")


def remove(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("path").distinct(), "path", "left_anti")


def reindex(stored: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what to embed, what to keep, counts): documents (path, hash) that are new or changed, the stored ones that aren't
    and still exist, and one row indexed, embedded, skipped, removed."""
    todo = needing_embedding(stored, current)
    kept = stored.join(current.select("path", "hash"), ["path", "hash"], "left_semi")
    gone = stored.join(current.select("path"), "path", "left_anti")
    n = current.select(F.lit("indexed").alias("k")).unionByName(todo.select(F.lit("embedded").alias("k"))).unionByName(gone.select(F.lit("removed").alias("k")))
    c = lambda k: F.count_if(F.col("k") == k)
    counts = n.agg(c("indexed").alias("indexed"), c("embedded").alias("embedded"), (c("indexed") - c("embedded")).alias("skipped"), c("removed").alias("removed"))
    return todo, kept, counts
