"""SimHash near-duplicate detection by pivot distance tables.

A fingerprint holds, for each of 64 positions, the majority bit of the XXH64 hashes of a text's word shingles. Two
fingerprints link when they differ in at most two bits; documents of one connected component are near-duplicates.
`near_copies` uses the same tables for a wider search, whose finds it verifies by their texts.

Links are found through distances to 81 reference fingerprints (pivots). Zero and the 64 that have one bit set give 64
coordinates, (d(x,0) + 1 - d(x,p_j)) / 2, with sum_j |c_j(x) - c_j(y)| = d(x,y); so of b + 1 parts of the coordinates
one agrees for any pair that differs in b bits at most. Fingerprints meet in a bucket for each part. Within a bucket a pair
is discarded if its distances to any of 16 more pivots, rows of the Walsh matrix, differ by more than b (triangle inequality;
these distances are independent of each other for unrelated texts), and survivors are verified bit by bit. A bucket above `bucket_rows` isn't
compared: its members move on to finer buckets, whose keys also hold the next part of the coordinates that are still free
- by the same argument no link is lost. After `LEVELS` levels, what is still too large (a dense group of near copies) is dealt out: its
members fall into blocks by a hash, and each pair of blocks is a bucket. No stage emits the pairs of a group: a bucket
gives one edge for each member that has a link there, to its local root.

Defined cases: a null or empty text has fingerprint zero and links like any other; very long texts count whole; a null doc_id
takes part in linking, but component_id is the smallest doc_id that isn't null (null if there is none); ties can't be, as a
component's smallest id is one; repeated rows give repeated rows; extra columns, with whatever names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, as_bytes, discard, free_name, with_column, written

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
BITS = 64
LEVELS = 3
BUCKET_ROWS = 1024
UNITS = np.array([0, *(1 << j for j in range(BITS))], dtype=np.uint64)
#: Rows of the Walsh matrix: bit i of row j is the parity of i & j.
WALSH = np.array([sum(((i & j).bit_count() & 1) << i for i in range(BITS)) for j in range(1, 17)], dtype=np.uint64)
#: Pairs that are tried at a time.
TILE = 1 << 17


def digests(text: bytes | None, words: int, seed: int = SEED) -> bytes:
    """XXH64 digests of the text's word shingles, most significant byte first, repeats kept; a text of fewer words is one shingle.
    bytes.lower() and bytes.split() see ASCII letters and ASCII space only."""
    w = (text or b"").lower().split()
    if not w:
        return b""
    if len(w) <= words:
        return xxhash.xxh64_digest(b" ".join(w), seed)
    joined, digest = b" ".join(w), xxhash.xxh64_digest
    after = list(accumulate(map(len, w), lambda a, n: a + n + 1))
    starts = [0, *(x + 1 for x in after)]
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, after[words - 1 :], strict=False)])


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first."""
    found = digests(text, words, seed)
    return _majority(found) if found else bytes(8)


def _majority(digests: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def _fp_array(texts: pa.Array) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(fingerprint(t) for t in as_bytes(texts)), ">u8").astype(np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), _fp_array(b.column(1))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


# ---- candidate buckets from the pivot table ---------------------------------------------------------------------


def pivot_distances(fp: np.ndarray, pivots: np.ndarray = UNITS) -> np.ndarray:
    """A row for each fingerprint, its Hamming distance to every pivot."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ pivots[None, :]).astype(np.int8)


def coordinates(dist: np.ndarray) -> np.ndarray:
    """From the distances to UNITS."""
    return (dist[:, :1] + 1 - dist[:, 1:]) // 2


@lru_cache(maxsize=None)
def parts(path: int, ways: int = MAX_BITS + 1) -> tuple[tuple[int, ...], ...]:
    """The parts of the coordinates that are free after a path: digits 1 to ways to the base ways + 1 from the lowest, first choice
    first."""
    free = list(range(BITS))
    while path:
        path, d = divmod(path, ways + 1)
        gone = set(free[d - 1 :: ways])
        free = [c for c in free if c not in gone]
    return tuple(tuple(free[i::ways]) for i in range(ways))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_keys(fp: np.ndarray, path: np.ndarray, key: np.ndarray, level: int, ways: int = MAX_BITS + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member its buckets one level down: (index of the member, path, key). Different buckets that collide in
    a key only cost comparisons."""
    coords = coordinates(pivot_distances(fp)).astype(np.uint64)
    index, paths, keys = [], [], []
    with np.errstate(over="ignore"):
        for p in np.unique(path):
            at = np.flatnonzero(path == p)
            for i, part in enumerate(parts(int(p), ways)):
                value = np.zeros(len(at), np.uint64)
                for c in part:
                    value = value * np.uint64(2) + coords[at, c]
                index.append(at)
                paths.append(np.full(len(at), int(p) + (i + 1) * (ways + 1) ** level, np.int64))
                keys.append(_mix(_mix(key[at].view(np.uint64) + np.uint64(i + 1)) + value).view(np.int64))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(index), np.concatenate(paths), np.concatenate(keys)


def _members(df: DataFrame, level: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        path = b.column(1).to_numpy(zero_copy_only=False) if level else np.zeros(len(fp), np.int64)
        key = b.column(2).to_numpy(zero_copy_only=False) if level else np.zeros(len(fp), np.int64)
        i, p, k = bucket_keys(fp, path, key, level)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(p), pa.array(k)], ["fp", "path", "key"])

    return arrow_map(df, run, "fp long, path long, key long")


def dealt(members: DataFrame, hot: DataFrame, bucket_rows: int, by: str) -> DataFrame:
    """members, with a bucket of its own for each pair of blocks where a key is hot (key, count); blocks are dealt by a hash of
    the column by."""
    blocks = F.ceil(F.col("count") / bucket_rows).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least("block", o), F.greatest("block", o))))
    over = members.join(hot.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), by), F.col("blocks")).cast("int"))
    over = over.select(pair.alias("dealt"), *members.columns).drop("key").withColumnRenamed("dealt", "key")
    return members.join(hot, "key", "left_anti").unionByName(over)


class Pivots:
    """The pivot table of some fingerprints, which discards pairs; those left are verified bit by bit."""

    def __init__(self, fp: np.ndarray, max_bits: int):
        table = pivot_distances(fp, WALSH).astype(np.uint8)
        self.bits, self.max_bits = fp.view(np.uint64), max_bits
        self.columns, self.lifted = table.T.copy(), (table + np.uint8(max_bits)).T.copy()

    def verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.bitwise_count(self.bits[a] ^ self.bits[b]) <= self.max_bits
        return a[good], b[good]

    def among(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs a, b the close ones."""
        for j in range(len(WALSH)):  # most pairs go with the first pivots
            good = (self.lifted[j, a] - self.columns[j, b]) <= 2 * self.max_bits
            a, b = a[good], b[good]
        return self.verified(a, b)

    def between(self, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs of one of rows and a later one of cols; in the order of rows, some at a time."""
        width = max(1, min(len(cols), 1 << 12))
        height = TILE // width
        difference, good, every = np.empty(TILE, np.uint8), np.empty(TILE, bool), np.empty(TILE, bool)
        for r in range(0, len(rows), height):
            some = rows[r : r + height]
            lifted = self.lifted[:, some]
            later = cols[np.searchsorted(cols, some[0], side="right") :]
            for c in range(0, len(later), width):  # tiles that stay in the processor's cache
                other = later[c : c + width]
                columns = self.columns[:, other]
                d, g, e = (x[: len(some) * len(other)].reshape(len(some), len(other)) for x in (difference, good, every))
                np.less(some[:, None], other[None, :], out=e)
                for j in range(len(WALSH)):
                    np.subtract(lifted[j, :, None], columns[j, None, :], out=d)
                    np.less_equal(d, np.uint8(2 * self.max_bits), out=g)
                    np.logical_and(e, g, out=e)
                found = np.flatnonzero(e)
                if len(found):
                    yield self.verified(some[found // len(other)], other[found % len(other)])


#: Buckets up to this size are compared all together, row by next row; larger ones by tiles.
SMALL = 64


def buckets_of(key: np.ndarray) -> tuple[np.ndarray, list[range]]:
    """(rows of small buckets, the large buckets), of rows that come sorted by key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    large = sizes > SMALL
    return np.flatnonzero(np.repeat(~large, sizes)), [range(a, a + n) for a, n in zip(starts[large], sizes[large], strict=True)]


def small_pairs(key: np.ndarray, small: np.ndarray, pivots: Pivots) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, shift = small, 1
    while len(at := at[at + shift < len(key)]) and len(at := at[key[at] == key[at + shift]]):
        yield pivots.among(at, at + shift)
        shift += 1


def close_pairs(key: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that differ in max_bits at most; rows come sorted by key."""
    pivots = Pivots(fp, max_bits)
    small, large = buckets_of(key)
    yield from small_pairs(key, small, pivots)
    for bucket in large:
        every = np.arange(bucket.start, bucket.stop)
        yield from pivots.between(every, every)


def linked_in(key: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for each row that has a link in its bucket; rows come sorted by key."""
    root = np.arange(len(fp))
    found = [(a[differ], b[differ]) for a, b in close_pairs(key, fp, max_bits) for differ in [fp[a] != fp[b]]]
    if not found:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    while True:  # the least row of each local component
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    rows = np.unique(np.concatenate([a, b]))
    rows = rows[root[rows] != rows]
    return fp[rows], fp[root[rows]]


def _edges(members: DataFrame) -> DataFrame:
    """Edges from sorted buckets; a bucket that an Arrow batch cuts is carried into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = linked_in(k, f)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield out(key, fp)

    return members.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def link_edges(distinct_fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) whose components are those of the relation 'at most two bits differ'. Input: column fp, distinct."""
    edges = None
    level_in = distinct_fps.select("fp")
    for level in range(LEVELS):
        members = _members(level_in, level)
        hot = written(members.groupBy("key").count().where(F.col("count") > bucket_rows), "simhash-hot")
        any_hot = bool(hot.take(1))
        last = level == LEVELS - 1
        found = _edges(dealt(members, hot, bucket_rows, "fp") if any_hot and last else members.join(hot, "key", "left_anti") if any_hot else members)
        edges = found if edges is None else edges.unionByName(found)
        if not any_hot or last:
            break
        level_in = written(members.join(hot, "key", "left_semi").select("fp", "path", "key"), "simhash-level")
    return edges.distinct()


# ---- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node that has an edge.

    Alternating large-star and small-star steps; each is an aggregate and a join, so no neighbourhood is ever gathered
    in one place, and each round is written to the shared folder."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    mark = lambda d: d.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.where("u <> v").distinct(), "components")
        discard(old)
        discard(large)
        if (now := mark(e)) == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _rooted(fps: DataFrame, bucket_rows: int) -> DataFrame:
    """fp, first (smallest doc_id that isn't null), root (a fingerprint that names the component), for distinct fp."""
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    roots = written(components(link_edges(firsts, bucket_rows)), "simhash-roots")
    return firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id, one row for each input row."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    rooted = _rooted(fps, bucket_rows)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    # One row for each fingerprint on the right; a fingerprint that many documents share is a skewed join, which Spark splits.
    return fps.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest id (a row without an id only where no
    other is there); of rows that share that id and fingerprint the least by their other columns."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    return first_of_each(docs, fps, _rooted(fps, bucket_rows), _fp_array, id_col, text_col)


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def first_of_each(docs: DataFrame, fps: DataFrame, rooted: DataFrame, of_texts: Callable[[pa.Array], pa.Array], id_col: str, text_col: str) -> DataFrame:
    """keep_first for fingerprints (doc_id, fp) that of_texts makes, and their components (fp, first, root).

    Rows are told apart by their ids; only those whose id occurs more than once are fingerprinted again and shuffled. The ids
    that go are joined by broadcast while they are small."""
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("b"))
    kept = written(best.select(F.col("b.first").alias("keep_id"), F.col("b.fp").alias("keep_fp")), "simhash-kept")
    ids = fps.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("fp").alias("fp"))
    stays = ids.doc_id.eqNullSafe(kept.keep_id) & (ids.fp == kept.keep_fp)
    gone = ids.join(kept, stays & (F.col("rows") == 1), "left_anti").select(F.col("doc_id").alias("gone_id"), (F.col("rows") > 1).alias("again"))
    gone = written(gone, "simhash-gone")
    same = docs[id_col].cast("long").eqNullSafe(gone.gone_id)
    out = docs.join(gone, same, "left_anti")
    if not gone.where("again").take(1):
        return out
    again = gone.where("again")
    rest = docs.join(again, docs[id_col].cast("long").eqNullSafe(again.gone_id), "left_semi")
    key, fp, row = (free_name(docs, c) for c in ("key", "fp", "row"))
    rest = with_column(rest, [text_col], of_texts, fp, "bigint").withColumn(key, F.col(f"`{id_col}`").cast("long"))
    rest = rest.join(kept, rest[key].eqNullSafe(kept.keep_id) & (rest[fp] == kept.keep_fp), "left_semi")
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    order = [c for c, f in zip(columns, docs.schema.fields, strict=True) if _orderable(f.dataType)]
    one = rest.groupBy(key, fp).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias(row))
    return out.union(one.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
