"""Event logs as streams: the manifest's state, and a rate limiter.

Each key's state is one small row, however many events it has. Streams order a key's events of one micro-batch by seq, in
memory, and refuse those at or below the last one seen: bound micro-batches by the source's maxFilesPerTrigger or
maxOffsetsPerTrigger. The limiter is a fold over a table of calls; the breaker is in `breaker`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.partitions import fresh_path

OUT_MANIFEST = "uri string, seq long, op string, outcome string, active_hash string"
STATE_MANIFEST = "seq long, known boolean, active_hash string, compiled_hash string"


def manifest_step(state: tuple, seq: int, op: str, hash_: str | None) -> tuple[tuple, str]:
    """(new state, outcome) for a state (seq, known, active, compiled)."""
    _, known, active, done = state
    if op == "ingest":
        outcome = "no_op" if active == hash_ else "new" if active is None else "superseded"
        return (seq, True, hash_, done), outcome
    if op == "delete":
        return (seq, known, None, done), "error" if active is None else "tombstoned"
    if op == "purge":
        return (seq, False, None, None), "purged" if known else "error"
    return (seq, known, active, active if known else None), "compiled" if known else "error"


def _manifest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (-1, False, None, None)
    events = pd.concat(list(batches)).sort_values("seq")
    rows = []
    for seq, op, h in zip(events["seq"], events["op"], events["hash"], strict=True):
        if seq <= now[0]:
            rows.append((key[0], seq, op, "late", now[2]))
            continue
        now, outcome = manifest_step(now, int(seq), op, h)
        rows.append((key[0], seq, op, outcome, now[2]))
    state.update(now)
    yield pd.DataFrame(rows, columns=["uri", "seq", "op", "outcome", "active_hash"])


def manifest_stream(events: DataFrame) -> DataFrame:
    """Outcomes of a stream of events(uri, seq, op, hash)."""
    return events.groupBy("uri").applyInPandasWithState(_manifest, OUT_MANIFEST, STATE_MANIFEST, "append", GroupStateTimeout.NoTimeout)


def run_to_end(events: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The output of a stream over a table's rows: the table is written once, read as a stream in one trigger, and the
    output written by the file sink, all in the shared folder."""
    spark = events.sparkSession
    base = fresh_path(spark, "stream")
    events.write.parquet(f"{base}/in")
    out = transform(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _fold(calls: DataFrame, key: str, columns: list[str], schema: str, step) -> DataFrame:
    """A sequential fold over each key's calls in (t, call_id) order, in batches: rows come sorted, and only the fold's
    state lives from one batch to the next, so a key with very many calls needs no memory of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds: dict = {}
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if k not in folds:
                    folds = {k: step()}  # rows are sorted by key: the one before is over
                out.append(folds[k](row))
            yield b[[key, "call_id"]].assign(result=out)

    dealt = calls.select(key, "call_id", *columns).repartition(key).sortWithinPartitions(key, "t", "call_id")
    return dealt.mapInPandas(run, schema)


def rate_limiter(calls: DataFrame, key: str, limit: int = 100, window: float = 1.0) -> DataFrame:
    """key, call_id, result (allowed) of calls(key, call_id, t in seconds)."""

    def step():
        passed: deque = deque()

        def one(row) -> bool:
            while passed and row.t - passed[0] >= window:
                passed.popleft()
            if len(passed) >= limit:
                return False
            passed.append(row.t)
            return True

        return one

    return _fold(calls, key, ["t"], f"{key} {dict(calls.dtypes)[key]}, call_id long, result boolean", step)
