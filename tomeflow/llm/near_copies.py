"""Near copies: SimHash fingerprints within a wide radius by pivot distance tables, verified by the texts' own shingles.

Two texts link when their fingerprints differ in `MAX_BITS` bits at most and their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; documents of one connected component are near copies. The fingerprint is the SimHash of a
text's different words: a changed word changes five shingles but one word, so near copies lie closer to each other than by the
shingles' SimHash. Texts that are equal but for letter case and white space are one node.

The search is the one of `simhash` with parts for `MAX_BITS` + 1: of so many parts of the pivot coordinates one agrees, nodes
meet in a bucket for each, the pivot tables discard, and the bits decide. With more nodes a bucket's key holds more parts,
one after the other (`levels`); a bucket above `BUCKET_ROWS` is dealt into pairs of blocks. The search tells which nodes are close to
any other; only these are cut into shingles. In their buckets each is then paired with the least node that it may link to by bits,
sizes and sketches; these pairs are verified, and only possible pairs that then still are in different components follow. So
a bucket gives rows in proportion to its members, no step drops a pair that links, and a dense group of copies, which
soon is one component, isn't compared pair by pair.

Defined cases: a text of one to four words is one shingle; null and empty texts have the empty set and are one group; very long
texts count whole; of a component's rows the one with the smallest id stays; a null id only where there is no other; repeated
rows are copies; extra columns stay, with whatever names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, written
from .simhash import BITS, Pivots, _majority, bucket_keys, buckets_of, components, dealt, digests, first_of_each, small_pairs

SHINGLE_WORDS = 5
MAX_BITS = 8
BUCKET_ROWS = 4096
SKETCH_BITS = 2048
#: Hashes of so many different words are kept in a Python worker.
KEPT_WORDS = 1 << 18


def shingles(text: bytes | None) -> np.ndarray:
    """The different shingle hashes, sorted."""
    return np.unique(np.frombuffer(digests(text, SHINGLE_WORDS), ">u8").astype(np.uint64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


_known: dict[bytes, bytes] = {}


def _digest(word: bytes) -> bytes:
    found = _known.get(word)
    if found is None:
        if len(_known) >= KEPT_WORDS:
            _known.clear()
        found = _known[word] = xxhash.xxh64_digest(word, 42)
    return found


def word_fingerprint(words: list[bytes]) -> bytes:
    """SimHash of the different words; eight bytes, most significant first."""
    return _majority(b"".join([_digest(w) for w in set(words)])) if words else bytes(8)


def _node(text: bytes | None) -> tuple[int, bytes]:
    """(name, fingerprint); texts with equal words in equal order share a name."""
    words = (text or b"").lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words)), word_fingerprint(words)


def _names(names: list[int]) -> pa.Array:
    return pa.array(np.array(names, np.uint64).view(np.int64), pa.int64())


def _text_names(texts: pa.Array) -> pa.Array:
    return _names([_node(t)[0] for t in as_bytes(texts)])


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, name, fp."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [_node(t) for t in as_bytes(b.column(1))]
        fps = np.frombuffer(b"".join(fp for _, fp in found), ">u8").astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), _names([n for n, _ in found]), pa.array(fps)], ["doc_id", "name", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, "doc_id long, name long, fp long")


def levels(nodes: int, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> int:
    """How many parts a key needs for buckets of random fingerprints to be small."""
    free, bits, level = BITS, 0, 0
    while level == 0 or nodes / 2**bits > bucket_rows and free > 2 * max_bits:
        part = free // (max_bits + 1)
        free, bits, level = free - part, bits + part, level + 1
    return level


def _keyed(nodes: DataFrame, level: int, max_bits: int) -> DataFrame:
    """key, fp, name: a row for each bucket of each node."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy()
        rows, path, key = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
        for k in range(level):
            at, path, key = bucket_keys(fp[rows], path, key, k, max_bits + 1)
            rows = rows[at]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows]), b.column(1).take(pa.array(rows))], ["key", "fp", "name"])

    return arrow_map(nodes.select("fp", "name"), run, "key long, fp long, name long")


def _buckets(df: DataFrame, fn: Callable[[pa.Table], Iterator[pa.Table]], schema: str, then: str = "name") -> DataFrame:
    """fn over whole buckets, sorted by key (the first column); one that an Arrow batch cuts is carried into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            for t in fn(pa.Table.from_batches(held).combine_chunks()):
                yield from t.to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
                held.append(b.slice(0, cut))
                yield from out()
                held = []
            elif cut:
                held = [b.slice(0, cut)]
                yield from out()
                held = []
            held.append(b.slice(cut))
        if held:
            yield from out()

    return df.repartition("key").sortWithinPartitions("key", then, "name").mapInArrow(run, schema)


def with_neighbour(key: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether each row is close to another one of its bucket. Pairs of rows that both are known to be aren't looked at."""
    pivots, found = Pivots(fp, max_bits), np.zeros(len(key), bool)
    small, large = buckets_of(key)
    for a, b in small_pairs(key, small, pivots):
        found[a] = found[b] = True
    for bucket in large:
        for start in range(bucket.start, bucket.stop, 256):
            rows, cols = np.arange(start, min(start + 256, bucket.stop)), np.arange(start, bucket.stop)
            was = found[rows]
            for some, others in ((rows[~was], cols), (rows[was], cols[~found[cols]])):
                for a, b in pivots.between(some, others):
                    found[a] = found[b] = True
    return found


def _searched(max_bits: int) -> Callable[[pa.Table], Iterator[pa.Table]]:
    def run(t: pa.Table) -> Iterator[pa.Table]:
        key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy()
        yield t.filter(pa.array(with_neighbour(key, fp, max_bits)))

    return run


class _Bucketed:
    """Rows key, name, fp, n, sketch, sorted by key."""

    def __init__(self, t: pa.Table, max_bits: int):
        self.key, self.name, self.fp = (t.column(c).to_numpy() for c in ("key", "name", "fp"))
        self.n = t.column("n").to_numpy().astype(np.int64)
        self.bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(self.key), -1)
        self.pivots = Pivots(self.fp, max_bits)
        self.small, self.large = buckets_of(self.key)

    def possible(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in pairs:
            for i in range(0, len(a), 1 << 14):
                x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
                good = _possible(self.n, self.bits, x, y) & (self.name[x] != self.name[y])
                yield x[good], y[good]


def _with_least(max_bits: int) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """u, v: each node with the least one of its bucket that it may link to."""

    def run(t: pa.Table) -> Iterator[pa.Table]:
        b = _Bucketed(t, max_bits)
        least = np.full(len(b.key), len(b.key))
        for u, v in b.possible(small_pairs(b.key, b.small, b.pivots)):
            np.minimum.at(least, v, u)
        for bucket in b.large:
            for start in range(bucket.start, bucket.stop, 64):
                left = np.arange(start, bucket.stop)
                left = left[least[left] == len(b.key)]  # the others have theirs, among lesser names
                for u, v in b.possible(b.pivots.between(np.arange(start, min(start + 64, bucket.stop)), left)):
                    np.minimum.at(least, v, u)
        v = np.flatnonzero(least < len(b.key))
        yield pa.table([pa.array(b.name[least[v]]), pa.array(b.name[v])], ["u", "v"])

    return run


def _across(max_bits: int) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """u, v: all pairs of a bucket that may link and are in different components. Rows come sorted by key and component, so a
    row's own component ends before the rows that it is compared with."""

    def run(t: pa.Table) -> Iterator[pa.Table]:
        b, comp = _Bucketed(t, max_bits), t.column("comp").to_numpy()

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from small_pairs(b.key, b.small, b.pivots)
            for bucket in b.large:
                for start in range(bucket.start, bucket.stop, 64):
                    own = start + int(np.searchsorted(comp[start : bucket.stop], comp[start], side="right"))
                    yield from b.pivots.between(np.arange(start, min(start + 64, bucket.stop)), np.arange(own, bucket.stop))

        for u, v in b.possible((u[comp[u] != comp[v]], v[comp[u] != comp[v]]) for u, v in pairs()):
            u, v = b.name[u], b.name[v]
            yield pa.table([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity of the number of shingles for each of so many hash values."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _possible(n: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets a and b may link, by their sizes and sketches."""
    both = n[a] + n[b]
    fits = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    return fits & (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= both - 2 * ((4 * both + 8) // 9))


class Texts:
    """Verifies pairs of nodes by the texts of their first documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame):
        """nodes: name, first."""
        self.docs, self.id_col, self.text_col, self.nodes = docs, id_col, text_col, nodes

    def sets(self, names: DataFrame) -> DataFrame:
        """name, n, sketch, s (the set) of some nodes, as a written table."""
        wanted = written(self.nodes.join(names, "name", "left_semi").select("name", "first"), "near-wanted")
        src = self.docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).alias("text"))
        src = src.join(wanted.select("first"), src.id.eqNullSafe(F.col("first")), "left_semi").select("text")

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(b.column(0))
            found = [shingles(t) for t in texts]
            columns = [_names([_node(t)[0] for t in texts]), pa.array([len(s) for s in found], pa.int32()), pa.array([sketch(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["name", "n", "sketch", "s"])

        out = arrow_map(src, run, "name long, n int, sketch binary, s binary")
        return written(out.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"]), "near-sets")

    @staticmethod
    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs u, v, whose sets are among sets, those that link, as a written table."""

        def same(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(i).to_pylist()] for i in (2, 3))
            return b.select(["u", "v"]).filter(pa.array([linked(i, j) for i, j in zip(x, y, strict=True)], pa.bool_()))

        side = lambda name: sets.select(F.col("name").alias(name), F.col("s").alias(f"s_{name}"))
        pairs = written(pairs.distinct(), "near-pairs")
        both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "s_u", "s_v")
        return written(arrow_map(both, same, "u long, v long").distinct(), "near-edges")


def links(nodes: DataFrame, n: int, texts: Texts, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between names whose components are those of the relation. nodes: name, fp; n: how many."""
    keyed = _keyed(nodes, levels(n, max_bits, bucket_rows), max_bits)
    hot = written(keyed.groupBy("key").count().where(F.col("count") > bucket_rows), "near-hot")
    members = dealt(keyed, hot, bucket_rows, "name") if hot.take(1) else keyed
    close = written(_buckets(members.select("key", "name", "fp"), _searched(max_bits), "key long, name long, fp long"), "near-close")
    sets = texts.sets(close.select("name").distinct())
    known = written(close.join(sets.select("name", "n", "sketch"), "name").select("key", "name", "fp", "n", "sketch"), "near-known")
    tried = written(_buckets(known, _with_least(max_bits), "u long, v long").distinct(), "near-tried")
    edges = texts.linked(tried, sets)
    roots = written(components(edges), "near-roots")
    comps = known.join(roots, known.name == roots.node, "left").select("key", F.coalesce("root", "name").alias("comp"), "name", "fp", "n", "sketch")
    mixed = comps.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    more = _buckets(comps.join(mixed, "key", "left_semi"), _across(max_bits), "u long, v long", "comp").distinct()
    return edges.unionByName(texts.linked(more.join(tried, ["u", "v"], "left_anti"), sets))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest id (a row without an id only where no
    other is there); of rows that share that id and words the least by their other columns."""
    found = written(named(docs, id_col, text_col), "near-names")
    nodes = written(found.groupBy("name").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")), "near-nodes")
    texts = Texts(docs, id_col, text_col, nodes)
    roots = written(components(links(nodes, nodes.count(), texts, max_bits, bucket_rows)), "near-roots")
    rooted = nodes.join(roots, nodes.name == roots.node, "left").select(F.col("name").alias("fp"), "first", F.coalesce("root", "name").alias("root"))
    return first_of_each(docs, found.select("doc_id", F.col("name").alias("fp")), rooted, _text_names, id_col, text_col)
