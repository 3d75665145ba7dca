"""Periodic runs of words: stretches in which words a period apart are identical, three times or more.

Block matching. A run of period q, longer than 3 q and 24 words, holds an aligned block of B words together with its copy q words
on, where B is 8 for q up to 15 and otherwise the power of two with B <= q < 2 B. So for each B the aligned blocks of a document are the
keys of an automaton over integer sequences, which is searched for in the document's word numbers; occurrences that lie q words after a
block, q in B's range, are seeds, and each seed is extended word by word in both directions as long as words q apart agree. A
block of 2 B can recur only where both its halves do, so each scale's keys are pairs of the last one's, both of which were found elsewhere
too, and are searched for in the sequences of their names; in ordinary text hardly any is left after the first. Seeds inside a run of a smaller period that divides theirs (by the theorem of Fine and Wilf
any known run of a period up to B that covers seed and copy is one) and those in a stretch that was extended already are skipped, so
work grows with n log n.

Defined cases: null text has no words and no run; a null id isn't planted (it has no decimal form) and stays null; very long texts are
searched whole; equal greatest exponents are settled by start, then period; repeated rows give repeated rows; extra columns, with whatever names, are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes

MIN_LENGTH, MIN_REPEATS = 24, 3
#: The smallest block. MIN_LENGTH is three of it: runs of any period below two blocks then hold an aligned one with its copy.
BLOCK = MIN_LENGTH // 3


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document of ten, by its id's checksum, with its tail made periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number by first occurrence."""
    ids = dict.fromkeys(words)
    ids.update(zip(ids, range(len(ids)), strict=True))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def _same(x: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many words from a and b on (or back) are identical, up to most."""
    n, size = 0, 32
    while n < most:
        k = min(size, most - n)
        u, v = (x[a + n : a + n + k], x[b + n : b + n + k]) if step > 0 else (x[a - n - k + 1 : a - n + 1][::-1], x[b - n - k + 1 : b - n + 1][::-1])
        differ = np.flatnonzero(u != v)
        if len(differ):
            return n + int(differ[0])
        n, size = n + k, size * 2
    return n


def _search(blocks: list[tuple[int, ...]], sequence: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each block, places in the sequence where keys begin, their keys). All blocks are of one length."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple[int, ...], int] = {}
    own = [keys.setdefault(block, len(keys)) for block in blocks]
    for block, k in keys.items():
        automaton.add_word(block, k)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2)
    return np.array(own, np.int64), found[:, 0] - (len(blocks[0]) - 1), found[:, 1]


def _search_halves(names: np.ndarray, starts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for blocks of two halves, whose names (from 1) are known wherever they occur: a block is a sequence of two names, and
    the document is read in as many threads as a half has words, each of every half-th name."""
    rows = -(-len(names) // half)
    grid = np.zeros((half, rows + 1), np.int64)  # a thread ends with no name
    grid[:, :rows] = np.pad(names, (0, rows * half - len(names))).reshape(rows, half).T
    blocks = list(zip(names[starts].tolist(), names[starts + half].tolist(), strict=True))
    own, at, key = _search(blocks, tuple(grid.ravel().tolist()))
    thread, row = np.divmod(at, rows + 1)
    return own, row * half + thread, key


def _seeds(own: np.ndarray, starts: np.ndarray, at: np.ndarray, key: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance) for each occurrence of it that is low to high - 1 words after it, by distance and start."""
    code = key * (n + 1) + at
    code.sort()
    first = np.searchsorted(code, own * (n + 1) + np.minimum(starts + low, n))
    last = np.searchsorted(code, own * (n + 1) + np.minimum(starts + high, n))
    many = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(starts)), many)
    place = code[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] - own[which] * (n + 1)
    j, q = starts[which], place - starts[which]
    order = np.lexsort((j, q))
    return j[order], q[order]


def find_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start, then period."""
    n = len(x)
    runs: list[tuple[int, int, int]] = []
    if n < MIN_LENGTH:
        return runs
    seen: set[tuple[int, int]] = set()
    # A block with a word that is nowhere else can't recur.
    once = np.concatenate(([0], np.cumsum(np.bincount(x)[x] == 1)))
    starts = np.arange(0, n - BLOCK + 1, BLOCK)
    starts = starts[once[starts + BLOCK] == once[starts]]
    size, low, names = BLOCK, 1, None
    while len(starts) and MIN_REPEATS * low <= n:
        if names is None:
            whole = tuple(x.tolist())
            own, at, key = _search([whole[s : s + size] for s in starts.tolist()], whole)
        else:
            own, at, key = _search_halves(names, starts, size // 2)
        j, q = _seeds(own, starts, at, key, n, low, 2 * size)
        if runs:  # all of a period below this block's size
            s, e = np.array([(a, a + length) for a, length, _ in sorted(runs)]).T
            k = np.searchsorted(s, j, side="right")
            inside = np.concatenate(([0], np.maximum.accumulate(e)))[k] >= j + q + size
            j, q = j[~inside], q[~inside]
        period, until = 0, 0
        for a, p in zip(j.tolist(), q.tolist(), strict=True):
            if p == period and a + p + size <= until:
                continue
            back = _same(x, a - 1, a + p - 1, -1, a)
            on = _same(x, a + size, a + size + p, 1, n - a - size - p)
            start, end = a - back, a + size + p + on
            period, until = p, end
            if end - start >= max(MIN_LENGTH, MIN_REPEATS * p) and (start, end) not in seen:
                seen.add((start, end))  # the first found of equal stretches has the smallest period
                runs.append((start, end - start, p))
        # The next scale's blocks: two neighbours, both of which occur more than once.
        names = np.zeros(n, np.int64)
        names[at] = np.where(np.bincount(key)[key] > 1, key + 1, 0)
        low, size = 2 * size, 2 * size
        starts = np.arange(0, n - size + 1, size)
        starts = starts[(names[starts] > 0) & (names[starts + size // 2] > 0)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; of equals the first."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed (the text without what repeats, words joined by one space). `change` may
    alter a document's words, given with its id, before the search."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found, texts = [], []
        for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            words = (t or b"").split()  # by exactly the white space meant: bytes know no other
            words = change(words, i) if change else words
            runs = find_runs(numbered(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            texts.append(b" ".join(collapsed(words, runs)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))
    return arrow_map(rows, run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    better = lambda a, b: F.when(a.isNull() | (b.length * a.period > a.length * b.period), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
