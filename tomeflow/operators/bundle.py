"""What a vault publishes: its bundle of concepts and sources, and its index page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem


def concepts(pages: DataFrame) -> DataFrame:
    """path, id, title, type, sources (sorted) of the pages that parse: path, id, title, type, sources array<string>."""
    return pages.select("path", F.coalesce("id", file_stem(F.col("path"))).alias("id"), "title", "type", F.array_sort(F.coalesce("sources", F.array().cast("array<string>"))).alias("sources"))


def raw_sources(active: DataFrame) -> DataFrame:
    return active.select("uri", "raw_id", "hash")


def write_json(concepts_: DataFrame, raw: DataFrame, path: str, version: str) -> None:
    """Sorted JSON lines in two folders and a one-line head; each sorted by range, so no task holds all."""
    spark = concepts_.sparkSession
    concepts_.orderBy("path").write.mode("overwrite").json(f"{path}/concepts")
    raw.orderBy("uri").write.mode("overwrite").json(f"{path}/raw_sources")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").json(f"{path}/head")


def index_lines(pages: DataFrame) -> DataFrame:
    """title, path, description, line of the index page; sort by the first three for the page's order."""
    tail = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(F.lit(""))
    return pages.select("title", "path", "description", F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"), tail).alias("line"))


def index_head(field: str, version: str, title: str) -> str:
    """What stands before an index page's lines: front matter with the format's version, under the caller's name of that field, and a
    heading."""
    return f'---\n{field}: "{version}"\n---\n\n# {title}\n\n'


def write_index(pages: DataFrame, path: str, head: str | None = None) -> None:
    """The index page as text files whose names keep the order of titles; with a head, that comes first."""
    lines = index_lines(pages).select(F.lit(1).alias("part"), "title", "path", "description", "line")
    if head is not None:
        none = F.lit(None).cast("string")
        first = pages.sparkSession.range(1).select(F.lit(0).alias("part"), *(none.alias(c) for c in ("title", "path", "description")), F.lit(head.removesuffix("\n")).alias("line"))
        lines = lines.unionByName(first)
    lines.orderBy("part", "title", "path", "description").select("line").write.mode("overwrite").text(path)


def resolve(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, path: the page that a path, else a file stem, else a legacy id names; ties by path. Unknown ones are null.

    Each kind of name is an equi-join, so nothing is compared with all pages."""
    stem = pages.select(file_stem(F.col("path")).alias("asked"), F.lit(2).alias("tier"), "path")
    names = [pages.select(F.col("path").alias("asked"), F.lit(1).alias("tier"), "path"), stem]
    ids = pages.where("id IS NOT NULL")
    names.append(ids.select(F.col("id").alias("asked"), F.lit(3).alias("tier"), "path"))
    names.append(ids.where(F.col("id").startswith("concept_")).select(F.substring("id", 9, 1_000_000).alias("asked"), F.lit(3).alias("tier"), "path"))
    every = names[0]
    for n in names[1:]:
        every = every.unionByName(n)
    found = asked.join(every, "asked").groupBy("asked").agg(F.min_by("path", F.struct("tier", "path")).alias("path"))
    return asked.join(found, "asked", "left").select("asked", "path")
