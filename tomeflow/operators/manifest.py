"""The version history of sources, from an append-only log of events.

Input everywhere: events(uri, seq, op, hash) with op in ingest, delete, purge, compile; seq orders the log and has no ties.
What holds after an event depends on the uri's log only through the last event that set its state - ingest sets it to the
content's hash, delete and purge to nothing - so every outcome follows from a lag, and every status from a lead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import raw_id
from .ordered import WIDTH, neighbour, numbered


def outcomes(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """uri, seq, op, hash, outcome, raw_id, previous_raw_id for ingest, delete and purge.

    ingest: no_op, new or superseded; delete: tombstoned or error; purge: purged, or error where there is no entry."""
    state = F.when(F.col("op") == "ingest", F.col("hash"))
    states = neighbour(events.where(F.col("op").isin("ingest", "delete", "purge")), ["uri"], "seq", state, "previous", width=width)
    entries = neighbour(states.where(F.col("op").isin("ingest", "purge")), ["uri"], "seq", F.col("op"), "entry", width=width)
    purges = entries.where("op = 'purge'")
    rest = states.where("op <> 'purge'").withColumn("entry", F.lit(None).cast("string"))
    outcome = (
        F.when(F.col("op") == "purge", F.when(F.col("entry") == "ingest", "purged").otherwise("error"))
        .when(F.col("op") == "delete", F.when(F.col("previous").isNull(), "error").otherwise("tombstoned"))
        .when(F.col("previous").isNull(), "new")
        .when(F.col("previous") == F.col("hash"), "no_op")
        .otherwise("superseded")
    )
    both = rest.unionByName(purges.select(*rest.columns)).withColumn("outcome", outcome)
    return both.select(
        "uri",
        "seq",
        "op",
        "hash",
        "outcome",
        F.when(F.col("outcome").isin("new", "superseded"), raw_id(F.col("hash"))).alias("raw_id"),
        F.when(F.col("outcome") == "superseded", raw_id(F.col("previous"))).alias("previous_raw_id"),
    )


def versions(events: DataFrame, width: int = WIDTH, outcomes_: DataFrame | None = None) -> DataFrame:
    """uri, version_no, seq, hash, raw_id, status, by_raw_id, tombstoned_seq: every version since the uri's last purge. Outcomes
    that the caller has already aren't computed again."""
    purged = events.where("op = 'purge'").groupBy("uri").agg(F.max("seq").alias("purged"))
    live = (outcomes(events, width) if outcomes_ is None else outcomes_).where(F.col("outcome").isin("new", "superseded", "tombstoned"))
    live = live.join(purged, "uri", "left").where("purged IS NULL OR seq > purged").drop("purged")
    live = neighbour(live, ["uri"], "seq", F.struct("op", "raw_id", "seq"), "following", before=False, width=width)
    ingests = numbered(live.where("op = 'ingest'"), ["uri"], "seq", "version_no", width)
    nxt = F.col("following.op")
    return ingests.select(
        "uri",
        "version_no",
        "seq",
        "hash",
        "raw_id",
        F.when(nxt.isNull(), "ACTIVE").when(nxt == "ingest", "SUPERSEDED").otherwise("TOMBSTONED").alias("status"),
        F.when(nxt == "ingest", F.col("following.raw_id")).alias("by_raw_id"),
        F.when(nxt == "delete", F.col("following.seq")).alias("tombstoned_seq"),
    )


def active(versions_: DataFrame) -> DataFrame:
    """uri, raw_id, hash: the one active version of each source."""
    return versions_.where("status = 'ACTIVE'").select("uri", "raw_id", "hash")


def compiled(events: DataFrame) -> DataFrame:
    """uri, compiled_hash: the content that the last compile since the last purge saw; null if nothing was active then."""
    marks = events.groupBy("uri").agg(F.max(F.when(F.col("op") == "purge", F.col("seq"))).alias("purged"), F.max(F.when(F.col("op") == "compile", F.col("seq"))).alias("compiled"))
    marks = marks.where("compiled IS NOT NULL AND (purged IS NULL OR compiled > purged)")
    before = events.join(marks, "uri").where("op IN ('ingest', 'delete') AND seq < compiled AND (purged IS NULL OR seq > purged)")
    state = F.struct("seq", F.when(F.col("op") == "ingest", F.col("hash")).alias("hash"))
    seen = before.groupBy("uri").agg(F.max(state).getField("hash").alias("compiled_hash"))
    return marks.select("uri").join(seen, "uri", "left").select("uri", "compiled_hash")


def entries(events: DataFrame, width: int = WIDTH, versions_: DataFrame | None = None) -> DataFrame:
    """uri, n_versions, active_hash, active_raw_id, compiled_hash, pending: a row for each source that is known. Versions that the
    caller has already aren't computed again."""
    v = versions(events, width) if versions_ is None else versions_
    known = v.groupBy("uri").agg(F.count("*").alias("n_versions"), F.max(F.when(F.col("status") == "ACTIVE", F.struct("hash", "raw_id"))).alias("_active"))
    known = known.select("uri", "n_versions", F.col("_active.hash").alias("active_hash"), F.col("_active.raw_id").alias("active_raw_id"))
    done = F.coalesce(F.col("compiled_hash") == F.col("active_hash"), F.lit(False))
    return known.join(compiled(events), "uri", "left").select("uri", "n_versions", "active_hash", "active_raw_id", "compiled_hash", (F.col("active_hash").isNotNull() & ~done).alias("pending"))


def superseded_previous(versions_: DataFrame) -> DataFrame:
    """uri, raw_id: the version before the last one, whatever its status."""
    last = versions_.groupBy("uri").agg(F.max("version_no").alias("version_no"))
    return versions_.join(last.select("uri", (F.col("version_no") - 1).alias("version_no")), ["uri", "version_no"]).select("uri", "raw_id")


def purged_blobs(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """raw_id, hash of blobs that only purged histories name: the ones that may be unlinked. A blob that any event since the
    last purge brought, or brought again, is still named."""
    done = outcomes(events, width).where(F.col("outcome").isin("new", "superseded"))
    purged = events.where("op = 'purge'").groupBy("uri").agg(F.max("seq").alias("purged"))
    named = F.bool_or(F.col("purged").isNull() | (F.col("seq") > F.col("purged")))
    return done.join(purged, "uri", "left").groupBy("hash", "raw_id").agg(named.alias("_named")).where("NOT _named").select("raw_id", "hash")


def needing_embedding(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of current(path, hash) whose stored hash differs or is missing."""
    s = stored.select("path", F.col("hash").alias("_stored"))
    return current.join(s, "path", "left").where(~F.col("_stored").eqNullSafe(F.col("hash"))).drop("_stored")
