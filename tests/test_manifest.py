"""The window form of the manifest against a plain sequential model, on random logs; and windows in small chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import manifest, ordered
from tomeflow.streaming.state import manifest_step


def sequential(log):
    """Outcomes, and per uri the history, active and compiled content."""
    outcomes, history, active, done = [], {}, {}, {}
    for uri, seq, op, h in sorted(log, key=lambda e: e[1]):
        a = active.get(uri)
        if op == "ingest":
            if a == h:
                outcomes.append((uri, seq, "no_op"))
                continue
            if a is not None:
                history[uri][-1][1:] = ["SUPERSEDED", "raw_" + h[7:17], None]
            history.setdefault(uri, []).append([h, "ACTIVE", None, None])
            outcomes.append((uri, seq, "new" if a is None else "superseded"))
            active[uri] = h
        elif op == "delete":
            outcomes.append((uri, seq, "error" if a is None else "tombstoned"))
            if a is not None:
                history[uri][-1][1:] = ["TOMBSTONED", None, seq]
                active[uri] = None
        elif op == "purge":
            outcomes.append((uri, seq, "purged" if uri in history else "error"))
            for table in (history, active, done):
                table.pop(uri, None)
        elif uri in history:
            done[uri] = a
    return outcomes, history, active, done


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    ops = ["ingest"] * 5 + ["delete"] * 2 + ["purge", "compile"]
    log = []
    for seq in range(400):
        op = rng.choice(ops)
        log.append((f"u{rng.randrange(30)}", seq, op, f"sha256:{rng.randrange(3)}" + "0" * 12 if op == "ingest" else None))
    events = spark.createDataFrame(log, "uri string, seq long, op string, hash string")
    outcomes, history, active, done = sequential(log)
    for width in (7, 1 << 20):
        got = sorted((r.uri, r.seq, r.outcome) for r in manifest.outcomes(events, width).collect())
        assert got == sorted(outcomes)
        versions = {}
        for r in sorted(manifest.versions(events, width).collect(), key=lambda r: (r.uri, r.version_no)):
            versions.setdefault(r.uri, []).append([r.hash, r.status, r.by_raw_id, r.tombstoned_seq])
        assert versions == {u: h for u, h in history.items() if h}
        for r in manifest.entries(events, width).collect():
            assert (r.active_hash, r.compiled_hash) == (active.get(r.uri), done.get(r.uri))
            assert r.pending == (active.get(r.uri) is not None and done.get(r.uri) != active.get(r.uri))


def test_the_streaming_step_is_the_same_machine():
    rng = random.Random(9)
    log = [("u", s, rng.choice(["ingest", "ingest", "delete", "purge"]), f"h{rng.randrange(2)}".ljust(20, "x")) for s in range(300)]
    state, got = (-1, False, None, None), []
    for uri, seq, op, h in log:
        state, outcome = manifest_step(state, seq, op, h if op == "ingest" else None)
        got.append((uri, seq, outcome))
    assert got == sequential(log)[0]


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), s, rng.choice([None, 1, 2])) for s in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, s long, v int")
    want_lag, want_lead, want_n, last = {}, {}, {}, {}
    by_key = {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((s, v))
    for vs in by_key.values():
        for i, (s, _) in enumerate(vs):
            want_lag[s] = vs[i - 1][1] if i else None
            want_lead[s] = vs[i + 1][1] if i + 1 < len(vs) else None
            want_n[s] = i + 1
    assert {r.s: r.x for r in ordered.neighbour(df, ["k"], "s", F.col("v"), "x", True, 10).collect()} == want_lag
    assert {r.s: r.x for r in ordered.neighbour(df, ["k"], "s", F.col("v"), "x", False, 10).collect()} == want_lead
    assert {r.s: r.x for r in ordered.numbered(df, ["k"], "s", "x", 10).collect()} == want_n


def test_empty_log(spark):
    events = spark.createDataFrame([], "uri string, seq long, op string, hash string")
    assert manifest.versions(events).count() == manifest.entries(events).count() == manifest.outcomes(events).count() == 0
