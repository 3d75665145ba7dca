"""Term counts of documents, made where the documents are read: nothing is shuffled for them.

Spark puts spaces for what isn't ASCII between a text's terms (`functions.text.spaced`), a task for the rest. It takes some documents at a time,
about `CHUNK` bytes, sorts the numbers of their terms and counts equal ones; so its rows come sorted by term in runs, and each run holds whole
documents. `counted` has a row for each term of a document, `listed` one for each term of a run, with lists of its documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ASCII_SPACED, MAX_TERM_BYTES, spaced

#: Bytes of texts that are counted together; one document may have more.
CHUNK = 1 << 24
#: Rows, or entries of lists, of a batch that goes back to Spark; one list may have more.
ROWS = 1 << 16


def block(length: np.ndarray) -> np.ndarray:
    """The number of a document's block by its length: four for each doubling."""
    return np.floor(4 * np.log2(length + 1)).astype(np.int32)


def counted(docs: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """keys, field, doc_len, term, tf: a row for each term of each field of each document."""
    kinds = {k: docs.schema[k].dataType for k in keys} | {"field": T.StringType(), "doc_len": T.LongType(), "term": T.StringType(), "tf": T.LongType()}

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _count(_whole(held), fields, len(keys), False)
        columns = [c.take(pa.array(r.doc)) for c in r.own]
        columns += [pa.array(list(fields)).take(pa.array(r.field)), pa.array(r.sizes[r.doc, r.field]), r.words.take(pa.array(r.term)), pa.array(r.tf)]
        batch = pa.RecordBatch.from_arrays(columns, list(kinds))
        for i in range(0, len(r.doc), ROWS):
            yield batch.slice(i, ROWS)

    return _by_run(docs, fields, keys, rows, kinds)


def listed(docs: DataFrame, fields: tuple[str, ...], group: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """group, base, field, term, df, docs, tf, doc_len, block (and positions), path: a row for each term of each field in a run of documents
    (of a group), with lists that have an entry for each document: its number less `base`, and what is counted of it. Before them, for each
    field, a row of the run's documents with an empty term, which no text has; only these rows have the list of paths."""
    ints = T.ArrayType(T.IntegerType())
    kinds = {g: docs.schema[g].dataType for g in group}
    kinds |= {"base": T.LongType(), "field": T.StringType(), "term": T.StringType(), "df": T.IntegerType(), "docs": ints, "tf": ints, "doc_len": ints, "block": T.ArrayType(T.ByteType())}
    kinds |= {"positions": T.ArrayType(ints)} if positions else {}
    kinds["path"] = T.ArrayType(T.StringType())
    keys = (*group, "_doc", "path")

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(held)
        code = np.zeros(whole.num_rows, np.int64)
        for g in group:
            known = pc.dictionary_encode(whole.column(g), null_encoding="encode")
            code = code * len(known.dictionary) + known.indices.to_numpy()
        by = np.argsort(code, kind="stable")  # a group's documents lie together, and so do its entries of a term
        r, code = _count(whole.take(pa.array(by)) if group else whole, fields, len(keys), positions), code[by]
        n, number = len(code), r.own[-2].to_numpy()
        base = number.min()
        place, blocks = (number - base).astype(np.int32), block(r.sizes.sum(axis=1)).astype(np.int8)

        def made(doc: np.ndarray, field: np.ndarray, term: np.ndarray, words: pa.Array, tf: np.ndarray, at: pa.Array | None, head: bool) -> Iterator[pa.RecordBatch]:
            new = (term[1:] != term[:-1]) | (field[1:] != field[:-1]) | (code[doc[1:]] != code[doc[:-1]])
            starts = np.flatnonzero(np.append(np.ones(min(1, len(doc)), bool), new))
            ends = np.append(starts, len(doc))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            own = [c.take(pa.array(doc[starts])) for c in r.own[: len(group)]]
            own += [pa.array(np.full(len(starts), base)), pa.array(list(fields)).take(pa.array(field[starts])), words.take(pa.array(term[starts])), pa.array(np.diff(ends).astype(np.int32))]
            own += [lists(pa.array(x)) for x in (place[doc], tf.astype(np.int32), r.sizes[doc, field].astype(np.int32), blocks[doc])]
            own += [lists(at)] if positions else []
            own += [lists(r.own[-1].take(pa.array(doc))) if head else pa.nulls(len(starts), pa.list_(pa.string()))]
            batch, i = pa.RecordBatch.from_arrays(own, list(kinds)), 0
            while i < len(starts):
                to = max(i + 1, int(np.searchsorted(ends, ends[i] + ROWS, "right")) - 1)
                yield batch.slice(i, to - i)
                i = to

        d, f = np.tile(np.arange(n), len(fields)), np.repeat(np.arange(len(fields)), n)
        none = np.zeros(len(d), np.int64)
        yield from made(d, f, none, pa.array([""], pa.string()), none, pa.nulls(len(d), pa.list_(pa.int32())) if positions else None, True)
        yield from made(r.doc, r.field, r.term, r.words, r.tf, r.positions, False)

    # Numbers of documents hold for good once they are written.
    return _by_run(docs.withColumn("_doc", F.monotonically_increasing_id()), fields, keys, rows, kinds)


def _by_run(docs: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...], rows: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: dict[str, T.DataType]) -> DataFrame:
    """What rows makes of the keys and texts of some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            # A document without text takes room too.
            ends = np.cumsum(sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in b.columns[-len(fields) :]) + 16)
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                to = max(int(np.searchsorted(ends, before + CHUNK - size, "right")), at if held else at + 1)
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(ends[to - 1] - before)
                if to < b.num_rows:
                    yield from rows(held)
                    held, size = [], 0
                at = to
        if held:
            yield from rows(held)

    cut = docs.select(*keys, *(spaced(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)))
    return cut.mapInArrow(run, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(columns) for columns in zip(*(b.columns for b in held), strict=True)], held[0].schema.names)


def _terms(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, and how many each has."""
    bits, ends, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(ASCII_SPACED) if data else b"")
    runs = pc.split_pattern(pa.StringArray.from_buffers(len(texts), ends, data, bits, texts.null_count, texts.offset), " ")
    words = runs.flatten()
    size = pc.binary_length(words).to_numpy()
    kept = (size > 0) & (size < MAX_TERM_BYTES)
    until = np.concatenate(([0], np.cumsum(kept)))
    return words.filter(pa.array(kept)), np.diff(until[runs.offsets.to_numpy()])


class Counts(NamedTuple):
    """Documents' own columns and numbers of terms by field; by term (a place in the sorted words), field and document its tf and positions."""

    own: list[pa.Array]
    sizes: np.ndarray
    words: pa.Array
    term: np.ndarray
    field: np.ndarray
    doc: np.ndarray
    tf: np.ndarray
    positions: pa.Array | None


def _count(held: pa.RecordBatch, fields: tuple[str, ...], n_keys: int, positions: bool) -> Counts:
    n, k = held.num_rows, len(fields)
    cut = [_terms(held.column(n_keys + j)) for j in range(k)]
    sizes = np.stack([size for _, size in cut], axis=1)
    lens = sizes.T.reshape(-1)  # a field after the other
    words = pa.concat_arrays([w for w, _ in cut]).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    # One number says term, field and document.
    key = place[words.indices.to_numpy()] * (k * n) + np.repeat(np.arange(k * n), lens)
    if positions:
        by = np.argsort(key, kind="stable")
        key = key[by]
        found = (np.arange(len(by)) - np.repeat(np.cumsum(lens) - lens, lens))[by].astype(np.int32)
    else:
        key.sort()
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    term, rest = np.divmod(key[starts], k * n)
    field, doc = np.divmod(rest, n)
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(found)) if positions else None
    return Counts(held.columns[:n_keys], sizes, words.dictionary.take(order), term, field, doc, np.diff(np.append(starts, len(key))), at)
