"""The manifest on disk: a log of events that only grows, and that several processes may save to at once.

A save writes its events to a folder of its own and then makes them part of the log by one marker file, whose name is the log's next
version; the file is made only where there is none. Of two savers one finds it there, reads the log anew, works its events
out again and tries the next version. So nothing is lost or numbered twice, readers see whole saves only, and a save that
is repeated under the same key changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import manifest
from .partitions import drop_path

SCHEMA = "uri string, seq long, op string, hash string, reason string, at timestamp"
COLUMNS = ("uri", "seq", "op", "hash", "reason", "at")
#: A save gives up after so many others were quicker.
ATTEMPTS = 100


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _saves(spark: SparkSession, path: str) -> list[dict]:
    """version, data, key of each save, oldest first."""
    fs, p = _fs(spark, f"{path}/saves")
    if not fs.exists(p):
        return []
    names = sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())
    return [{"version": v, **json.loads(_read(spark, f"{path}/saves/{v}"))} for v in names]


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, version: int, content: str) -> bool:
    """Makes the marker of a version, whole, unless there is one. On this machine's disk it is a link to a finished file, which fails where
    the name is taken; elsewhere the store's own creation without overwriting, as a distributed file system has it."""
    fs, folder = _fs(spark, f"{path}/saves")
    fs.mkdirs(folder)
    if fs.getScheme() == "file":
        local = Path(folder.toUri().getPath())
        finished = local / f".{uuid.uuid4().hex}"
        finished.write_text(content)
        try:
            os.link(finished, local / str(version))
        except FileExistsError:
            return False
        finally:
            finished.unlink()
        return True
    try:
        stream = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, str(version)), False)
        stream.write(content.encode())
        stream.close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.toString():
            return False
        raise
    return True


def _log(spark: SparkSession, path: str, saves: list[dict]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*(f"{path}/events/{s['data']}" for s in saves)) if saves else spark.createDataFrame([], SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The log; one that doesn't exist yet is empty."""
    return _log(spark, path, _saves(spark, path))


def save(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], key: str | None = None) -> int:
    """Adds the events that make(log) gives for the log as it is, and returns the log's version after that. They follow the log's last in
    seq; make is asked again where another save came first. A key that was saved before adds nothing."""
    for _ in range(ATTEMPTS):
        saves = _saves(spark, path)
        version = saves[-1]["version"] + 1 if saves else 0
        if key is not None and any(s["key"] == key for s in saves):
            return version - 1
        log = _log(spark, path, saves)
        data = uuid.uuid4().hex
        _following(make(log), log).write.parquet(f"{path}/events/{data}")
        if _claim(spark, path, version, json.dumps({"data": data, "key": key})):
            return version
        drop_path(spark, f"{path}/events/{data}")
    raise RuntimeError(f"{ATTEMPTS} other saves to {path} came first")


def _following(events: DataFrame, log: DataFrame) -> DataFrame:
    """events with seq behind the log's last, moved as a whole where they aren't."""
    events = events.select(*(F.col(c).cast("long").alias(c) if c == "seq" else c for c in COLUMNS))
    last, first = log.agg(F.max("seq")).first()[0], events.agg(F.min("seq")).first()[0]
    move = 0 if last is None or first is None else max(0, last + 1 - first)
    return events.withColumn("seq", F.col("seq") + F.lit(move)) if move else events


def append(events: DataFrame, path: str, key: str | None = None) -> int:
    """Saves events that are known already; where others came in between, behind those."""
    return save(events.sparkSession, path, lambda log: events, key)


def ingest(log: DataFrame, documents: DataFrame, at) -> DataFrame:
    """Events for documents(uri, content, position): their seq follows the log's last, in order of position (a long without
    ties, such as a file's number). Arrival decides, not age: old content that comes again is a new version."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    h = text.content_hash(F.col("content"))
    return documents.select("uri", (F.lit(last + 1) + F.col("position")).alias("seq"), F.lit("ingest").alias("op"), h.alias("hash"), F.lit(None).cast("string").alias("reason"), F.lit(at).cast("timestamp").alias("at"))


def delete(log: DataFrame, uris: DataFrame, at, reason: str | None = None, purge: bool = False) -> DataFrame:
    """Events that tombstone, or purge, sources (uri, position)."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return uris.select("uri", (F.lit(last + 1) + F.col("position")).alias("seq"), F.lit("purge" if purge else "delete").alias("op"), F.lit(None).cast("string").alias("hash"), F.lit(reason).alias("reason"), F.lit(at).cast("timestamp").alias("at"))


def compiled(log: DataFrame, outcomes: DataFrame, at) -> DataFrame:
    """Events that mark the sources of a run (source_seq, uri, error) compiled at their current content, but for failed ones."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    none = F.lit(None).cast("string")
    done = outcomes.where("error IS NULL")
    return done.select("uri", (F.lit(last + 1) + F.col("source_seq")).alias("seq"), F.lit("compile").alias("op"), none.alias("hash"), none.alias("reason"), F.lit(at).cast("timestamp").alias("at"))


def outcomes_of(log: DataFrame, new: DataFrame) -> DataFrame:
    """What the new events do on top of the log: only the logs of the uris that they name are looked at."""
    own = log.join(new.select("uri").distinct(), "uri", "left_semi").unionByName(new)
    return manifest.outcomes(own).join(new.select("uri", "seq"), ["uri", "seq"], "left_semi")


def blob_text(raw_id, uri, checksum, ingested_at, content, tags=None):
    """The text of a raw blob's file: front matter, an empty line, the content as it came. Tags (array<string>) that are empty or
    null have no line."""
    lines = [F.lit("---"), F.lit("type: raw_source"), F.concat(F.lit("id: "), raw_id), F.concat(F.lit("source_url: "), uri), F.concat(F.lit("checksum: "), checksum), F.concat(F.lit("ingested_at: "), ingested_at)]
    if tags is not None:
        lines.append(F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), t)), "\n"))))
    return F.concat(F.concat_ws("\n", *lines, F.lit("---")), F.lit("\n\n"), content)
