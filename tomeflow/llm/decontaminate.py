"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text's symbols are its words. The patterns are the benchmark's windows: every 13 consecutive words of an item, or the
whole item where it has fewer. For patterns of at least m words, blocks of B = min(2, m) words end at text position i: the
shift table says how far the next place is at which a block of a pattern could end, m - B + 1 for a block of no pattern,
so most of a text is never looked at. Where the shift is zero, the block's bucket holds, by their first block, the patterns whose
first m words end so, and the text is compared with each of these word by word. Patterns are searched in a few groups of
similar length, so that a short item doesn't shorten the shifts of the long ones.

The benchmark is cut into blocks of `block_words` words, one broadcast each, and all of them are searched in one pass over the
texts, block after block: a worker holds the tables of `KEPT` blocks at most, and with more blocks it takes texts of
`BUFFER_BYTES` at a time, so that tables serve many texts before others take their place. A benchmark above `PASS_WORDS` words,
which no usual one has, takes a written pass for each part of that size, so that no more is broadcast at once.

Defined cases: null and empty texts have no words; null or empty items have no window; an item without an id counts
under the empty id; very long texts are searched whole; patterns that overlap or are equal all count; repeated rows of the
benchmark count once an id, repeated documents give repeated rows; empty tables give no rows, or no hits; extra columns
pass unchanged, and where a name clashes the new one has underscores before it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, slices, written

WINDOW = 13
BLOCK_WORDS = 250_000
PASS_WORDS = 32_000_000
KEPT = 2
BUFFER_BYTES = 16 << 20
#: Least number of words of the groups in which patterns are searched.
GROUPS = (WINDOW, 6, 2, 1)
#: Words are runs of 0-9, a-z and everything beyond ASCII, after A-Z are lower-cased.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

STATE = "struct<n_words:bigint,mark:binary,items:array<string>>"
DIGEST = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WuManber:
    """Patterns of m words or more."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = min(map(len, patterns))
        self.b = min(2, self.m)
        self.jump = self.m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: By the last and the first block of the first m words: (pattern, items that have it).
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], tuple[str, ...]]]]] = {}
        for p, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.m - end)
            self.bucket.setdefault(p[self.m - self.b : self.m], {}).setdefault(p[: self.b], []).append((list(p), tuple(items)))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, length, items) of every occurrence."""
        i, n, b, m, jump, shift = self.m, len(w), self.b, self.m, self.jump, self.shift.get
        while i <= n:
            block = (w[i - 2], w[i - 1]) if b == 2 else (w[i - 1],)
            if s := shift(block, jump):
                i += s
                continue
            at = i - m
            for p, items in self.bucket[block].get(tuple(w[at : at + b]), ()):
                if w[at : at + len(p)] == p:
                    yield at, len(p), items
            i += 1


def compile_block(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    groups: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, w in items:
        for i in range(max(1, len(w) - window + 1)):
            p = tuple(w[i : i + window])
            least = next(g for g in (window, *GROUPS) if len(p) >= g)
            groups.setdefault(least, {}).setdefault(p, set()).add(item)
    return [WuManber(p) for _, p in sorted(groups.items())]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """(words, items with words) of a block at a time; no more than one block is on the driver at once."""
    block, n = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        t = r.t.encode() if r.t else b""
        if k := len(words_of(t)):
            block.append((r.i, t))
            n += k
            if n >= block_words:
                yield n, block
                block, n = [], 0
    if block:
        yield n, block


def scan(searchers: list[WuManber], w: list[bytes], mark: bytearray | None, items: set[str]) -> bytearray | None:
    """Adds what occurs in w to mark (a byte for each word) and items."""
    for s in searchers:
        for at, n, found in s.search(w):
            mark = bytearray(len(w)) if mark is None else mark
            mark[at : at + n] = b"\1" * n
            items.update(found)
    return mark


#: By the broadcast's identity, the tables of the last few blocks.
_cache: dict[int, list[WuManber]] = {}


def _compiled(broadcast) -> list[WuManber]:
    """The tables of a broadcast block, built in each Python worker."""
    if broadcast.id not in _cache:
        while len(_cache) >= KEPT:
            del _cache[next(iter(_cache))]
        block = broadcast.value
        _cache[broadcast.id] = compile_block([(i, words_of(t)) for i, t in block])
        vars(broadcast.broadcast).pop("_value", None)  # the texts aren't needed any more
    return _cache[broadcast.id]


class _Block:
    """A broadcast with a name of its own: identities of objects in a worker may be used again."""

    def __init__(self, broadcast):
        self.id, self.broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self.broadcast.value


def _searched(blocks: list, texts: list[bytes | None], states: list[dict | None]) -> list[tuple[int, bytes | None, list[str]]]:
    """(words, mark, items) of each text after all blocks."""
    marks = [bytearray(s["mark"]) if s and s["mark"] else None for s in states]
    items = [set(s["items"]) if s else set() for s in states]
    n = [0] * len(texts)
    for k in range(0, max(1, len(blocks)), KEPT):
        tables = [s for b in blocks[k : k + KEPT] for s in _compiled(b)]
        for i, t in enumerate(texts):
            w = words_of(t)
            n[i] = len(w)
            marks[i] = scan(tables, w, marks[i], items[i])
    return [(k, bytes(m) if m is not None else None, sorted(x)) for k, m, x in zip(n, marks, items, strict=True)]


def _pass(df: DataFrame, text_col: str, state: str | None, blocks: list, last: bool, name: str) -> DataFrame:
    """df with a column for what the blocks add to the state; the last pass gives the digest."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(DIGEST if last else STATE))])
    at, before, names = df.columns.index(text_col), df.columns.index(state) if state else None, [*df.columns, name]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        states = b.column(before).to_pylist() if before is not None else [None] * b.num_rows
        out = _searched(blocks, as_bytes(b.column(at)), states)
        column = _digest(out) if last else _struct(out, [("n_words", pa.int64()), ("mark", pa.binary()), ("items", pa.list_(pa.string()))])
        return pa.RecordBatch.from_arrays([*b.columns, column], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(blocks) <= KEPT:
            for b in batches:
                yield from map(one, slices(b))
        else:
            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(x.nbytes for x in held) >= BUFFER_BYTES:
                    yield one(pa.concat_batches(held))
                    held = []
            if held:
                yield one(pa.concat_batches(held))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _struct(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _digest(states: list[tuple[int, bytes | None, list[str]]]) -> pa.Array:
    out = []
    for n_words, mark, items in states:
        n_hit = int(np.frombuffer(mark, np.uint8).sum()) if mark else 0
        sha = hashlib.sha256(",".join(items).encode()).hexdigest()
        out.append((n_words, n_hit, len(items), sha, n_hit > 0 and 20 * n_hit >= n_words))
    return _struct(out, [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, name: str = "contamination", pass_words: int = PASS_WORDS) -> tuple[DataFrame, str]:
    """docs with a struct n_words, n_hit, n_items, items_sha256, contaminated; the column's name is returned too."""
    spark, df, state = docs.sparkSession, docs, None
    name = free_name(docs, name)
    some: list[_Block] = []
    words = 0
    for n, block in blocks_of(benchmark, item_id_col, item_text_col, block_words):
        if some and words + n > pass_words:
            column = free_name(df, "state")
            out = written(_pass(df, text_col, state, some, False, column), "decontaminate")
            df = out.drop(state) if state else out
            for b in some:
                b.broadcast.destroy()
            state, some, words = column, [], 0
        some.append(_Block(spark.sparkContext.broadcast(block)))
        words += n
    df = _pass(df, text_col, state, some, True, name)
    return (df.drop(state) if state else df), name


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: every window of every document joined with the windows of the benchmark."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark WHERE text IS NOT NULL),
        wi AS (
            SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
            FROM (SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM iw WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT size FROM wi),
        dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
        dg AS (
            SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
            FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes)
        ), hi AS (SELECT DISTINCT r, i, size, item FROM dg JOIN wi USING (size, g)),
        po AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hi) GROUP BY r),
        it AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hi GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN po USING (r) LEFT JOIN it USING (r)
    """


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    df, name = with_contamination(docs.select("doc_id", "text"), benchmark)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), f"{name}.*")
