"""A circuit breaker over a table of calls, in chunks of bounded size whatever a key's share of the calls is.

Calls are dealt by ranges of (key, time, call), so a key with very many has many chunks. What a chunk does to the state that it is entered in is
a function which can be written down without knowing that state: one exit for each number of failures so far, and, for a breaker that
opened some time before, an exit for each stretch of times, because only the first call that may try again matters, and
what follows from there was worked out backwards once for all. The functions of all chunks are then applied one after the other - a row
for each chunk, with at most as many stretches as it has calls within the time to reset from its first - and every chunk is gone
through once more from its true state.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.partitions import written

#: Rows of a chunk, about.
CHUNK_ROWS = 1 << 16
#: A state is the number of failures while closed, or OPEN with the time of opening.
OPEN = -1
START = (0, 0.0)


def step(state: tuple[int, float], t: float, failed: bool, threshold: int, reset: float) -> tuple[tuple[int, float], str]:
    """(the state after a call, what the call met)."""
    failures, since = state
    if failures == OPEN:
        if t - since < reset:
            return state, "open"
        return ((OPEN, t) if failed else START), "half_open"
    if not failed:
        return START, "closed"
    return ((OPEN, t) if failures + 1 >= threshold else (failures + 1, 0.0)), "closed"


def fold(state: tuple[int, float], times: list[float], failed: list[bool], threshold: int, reset: float) -> tuple[tuple[int, float], list[str]]:
    met = []
    for t, f in zip(times, failed, strict=True):
        state, one = step(state, t, f, threshold, reset)
        met.append(one)
    return state, met


def _first_after(times: list[float], since: float, reset: float) -> int:
    """The first call that may try again; decided by the same subtraction as in a step."""
    return bisect_left(times, True, key=lambda t: t - since >= reset)


def summary(times: list[float], failed: list[bool], threshold: int, reset: float) -> tuple[list[tuple[int, float]], list[tuple[float, tuple[int, float]]]]:
    """(the exit for each number of failures; for an open breaker (last time, exit) of each stretch of calls from which to try again)."""
    n = len(times)
    closed: list[tuple[int, float]] = [(f, 0.0) for f in range(threshold)]
    tries: list[tuple[int, float]] = [START] * n  # the exit if the call tries again
    for j in range(n - 1, -1, -1):
        if failed[j]:
            again = max(j + 1, _first_after(times, times[j], reset))
            opened = tries[again] if again < n else (OPEN, times[j])
            tries[j], closed = opened, [*closed[1:], opened]
        else:
            tries[j], closed = closed[0], [closed[0]] * threshold
    stretches: list[tuple[float, tuple[int, float]]] = []
    # It opened before the chunk began, so it tries again within the time to reset from there.
    for t, e in zip(times[: _first_after(times, times[0], reset) + 1], tries, strict=False):
        if stretches and stretches[-1][1] == e:
            stretches[-1] = (t, e)
        else:
            stretches.append((t, e))
    return closed, stretches


def through(state: tuple[int, float], closed: list, stretches: list, reset: float) -> tuple[int, float]:
    """The state after a chunk, from its summary."""
    if state[0] != OPEN:
        return tuple(closed[state[0]])
    k = _first_after([t for t, _ in stretches], state[1], reset)
    return tuple(stretches[k][1]) if k < len(stretches) else state


def _sorted(b: pd.DataFrame, key: str) -> list[tuple[object, list[float], list[bool], pd.DataFrame]]:
    """The pieces of a chunk by key, in the order that Spark deals them in."""
    b = b.sort_values(["_rank", "t", "call_id"], kind="stable")
    return [(g[key].iloc[0] if not pd.isna(g[key].iloc[0]) else None, g["t"].tolist(), g["failed"].astype(bool).tolist(), g) for _, g in b.groupby("_rank", sort=True)]


def circuit_breaker(calls: DataFrame, key: str, threshold: int = 5, reset: float = 30.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, call_id, result (what the call meets) of calls(key, call_id, t, failed), each key's in the order of (t, call_id)."""
    spark, kind = calls.sparkSession, dict(calls.dtypes)[key]
    parts = max(1, -(-calls.count() // chunk_rows))
    dealt = calls.select(key, "call_id", F.col("t").cast("double").alias("t"), F.col("failed").cast("boolean").alias("failed")).repartitionByRange(parts, key, "t", "call_id")
    # A key's rank among those of its chunk stands for its place in Spark's order, which pandas need not know.
    dealt = dealt.sortWithinPartitions(key, "t", "call_id").withColumns({"_chunk": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    dealt = written(dealt, "breaker-calls")
    first = dealt.groupBy("_chunk", key).agg(F.min("_place").alias("_rank"))
    dealt = dealt.join(first.withColumnsRenamed({"_chunk": "_c", key: "_k"}), (F.col("_chunk") == F.col("_c")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_c", "_k", "_place")

    def ends(b: pd.DataFrame) -> pd.DataFrame:
        pieces = _sorted(b, key)
        k, times, failed, _ = pieces[0]
        closed, stretches = summary(times, failed, threshold, reset)
        last = fold(START, *pieces[-1][1:3], threshold, reset)[0] if len(pieces) > 1 else None
        row = [int(b["_chunk"].iloc[0]), k, pieces[-1][0], [{"f": f, "s": s} for f, s in closed], [{"t": t, "f": f, "s": s} for t, (f, s) in stretches], last and {"f": last[0], "s": last[1]}]
        return pd.DataFrame([row], columns=["chunk", "first", "last", "closed", "stretches", "end"])

    state_ = "struct<f:int,s:double>"
    found = dealt.groupBy("_chunk").applyInPandas(ends, f"chunk int, first {kind}, last {kind}, closed array<{state_}>, stretches array<struct<t:double,f:int,s:double>>, end {state_}")
    entries, carried = [], None
    for r in found.orderBy("chunk").toLocalIterator():  # a row for each chunk
        entry = carried[1] if carried and carried[0] == r["first"] else START
        entries.append((r.chunk, entry[0], entry[1]))
        if r.end is None:
            carried = r["first"], through(entry, [(x.f, x.s) for x in r.closed], [(x.t, (x.f, x.s)) for x in r.stretches], reset)
        else:
            carried = r["last"], (r.end.f, r.end.s)
    at = spark.createDataFrame(entries, "_chunk int, f int, s double")

    def meet(b: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out, state = [], (int(entry["f"].iloc[0]), float(entry["s"].iloc[0]))
        for _, times, failed, g in _sorted(b, key):
            out.append(g[[key, "call_id"]].assign(result=fold(state, times, failed, threshold, reset)[1]))
            state = START
        return pd.concat(out)

    return dealt.groupBy("_chunk").cogroup(at.groupBy("_chunk")).applyInPandas(meet, f"{key} {kind}, call_id long, result string")
