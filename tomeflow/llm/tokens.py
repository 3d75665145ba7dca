"""Token counts of documents in flat token files, by a vectorised scan for separators.

A token file is an array of little-endian token ids and nothing else: each document's tokens, then the end-of-document
id. It has no index, so lengths come from the places of the separators. A file of any size is read in ranges of bytes, each a
task of its own (Spark's text reader splits files at a byte's value, wherever in a token that is). A
range is scanned in blocks: one comparison and one search give a block's separators for each place at which its first whole token
may begin; documents inside a block are differences of neighbouring places. What a block's first separator closes may have begun
blocks or ranges before, so each block also tells its bytes, how many separators and tokens it has and where its last separator is.
A prefix scan over a file's blocks then gives every block the place where its tokens begin, the number of documents before it and
the tokens that it must add to its first. Only these few numbers of each block come together; the lengths stay
dealt by block. A document that is cut by the file's end counts as one.

`write_tokens` makes such files from texts with a given vocabulary: one Spark write, so a lost task leaves nothing behind.
Ids on disk are the tokenizer's plus one, as two bytes, or four for a vocabulary that needs them; 0 ends a document. Beside the token
files it writes the documents' ids in the same order.

Defined cases: null and empty texts have no tokens and still end with a separator; very long texts are tokenised whole, and their
tokens may span many blocks and ranges; a null id stays null; repeated rows are documents of their own; there are no ties, as each
document has its own place; an empty file has no document; an empty table writes no file; extra columns, with whatever names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh_path, slices, written

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The byte-level BPE pre-tokenizer pattern that goes with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 0
#: A task starts a new file beyond this size; it holds that much at a time.
FILE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
#: Files are cut after bytes of this value, which has nothing to do with tokens: one byte is found alike from wherever a search begins.
CUT = b"\n"
_encoders: dict[tuple[int, str], object] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A tokenizer from the text of a vocabulary file; built once in each Python worker."""
    import tiktoken

    key = (hash(vocabulary), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def id_type(vocabulary: bytes) -> str:
    """Two bytes for each id, or four where the vocabulary's greatest needs them."""
    return "<u2" if max((int(line.split()[1]) for line in vocabulary.splitlines()), default=0) + 1 < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, path: str, vocabulary_file: str = VOCABULARY_FILE, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> str:
    """Token files in path/kind=tokens/chunk=*, the documents' ids in path/kind=ids/chunk=*. Returns the type of the tokens' ids."""
    with open(vocabulary_file, "rb") as f:  # on the driver; a vocabulary has a fixed size of a few MB at most
        data = f.read()
    dtype = id_type(data)
    end = b"\0" * np.dtype(dtype).itemsize
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        part, files = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids)
            tokens = b"".join(parts)[: -len(end)]  # the writer adds the last separator
            chunk = f"c{part:06d}_{files:04d}"
            return pa.RecordBatch.from_arrays([pa.array(["tokens", "ids"]), pa.array([chunk, chunk]), pa.array([tokens, known], pa.binary())], ["kind", "chunk", "value"])

        for b in (x for whole in batches for x in slices(whole)):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = (np.array(encode(t), np.int64) + 1).astype(dtype).tobytes() + end if t else end
                parts.append(own)
                ids.append(i)
                size += len(own)
                if size >= file_bytes:
                    yield flush()
                    parts, ids, size, files = [], [], 0, files + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "kind string, chunk string, value binary")
    # The text writer puts out a string's bytes as they are, then the separator.
    rows.select("kind", "chunk", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "chunk").option("lineSep", end.decode()).text(path)
    return dtype


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """path, start, size, value, joined: the files below path, in pieces between bytes of one value; start tells the range of the file
    that a piece is in, and pieces of a range come in order."""
    rows = spark.read.option("lineSep", CUT.decode()).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"), F.lit(True).alias("joined"))


def whole(files: DataFrame) -> DataFrame:
    """The same of files that were read whole (path, content), one range each."""
    return files.select("path", F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("size"), F.col("content").alias("value"), F.lit(False).alias("joined"))


def scan_block(block: np.ndarray, end: int = END) -> tuple[int, int, np.ndarray]:
    """(tokens before the first separator, or all; place of the last separator or -1; lengths of the documents that begin
    and end in the block)."""
    at = np.flatnonzero(block == end)
    return (int(at[0]), int(at[-1]), np.diff(at) - 1) if len(at) else (len(block), -1, at)


_BLOCK = "path string, start long, k long, size long, bytes long, first binary, tail binary, heads array<long>, lasts array<long>, seps array<long>, inner array<array<long>>"


def blocks(pieces: DataFrame, end: int = END, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: path, start, k (its number in the range), size (of the file), bytes, its first and last bytes, and for each
    number of bytes that belong to a token begun before: head, last (place in the block, or -1), separators, inner lengths."""
    width = np.dtype(dtype).itemsize
    step = max(1, block_bytes // width) * width
    schema = to_arrow_schema(T._parse_datatype_string(_BLOCK))

    def scanned(path: str, start: int, k: int, size: int, data: bytes) -> tuple:
        found = [scan_block(np.frombuffer(data, dtype, max(0, len(data) - skip) // width, skip if len(data) >= skip else 0), end) for skip in range(width)]
        seps = [len(inner) + (last >= 0) for _, last, inner in found]
        edges = data[: width - 1], data[len(data) - width + 1 :] if width > 1 else b""
        return path, start, k, size, len(data), *edges, [h for h, *_ in found], [x for _, x, _ in found], seps, [x.tolist() for *_, x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, data, k = None, bytearray(), 0
        rows: list[tuple] = []
        def cut(least: int) -> None:
            nonlocal k
            while len(data) >= least:
                n = step if len(data) >= step + width else len(data)
                rows.append(scanned(own[0], own[1], k, own[2], bytes(data[:n])))
                del data[:n]
                k += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return made

        for b in (x for all_ in batches for x in slices(all_)):
            for path, start, size, value, joined in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if own != (path, start, size):
                    cut(1)
                    own, k = (path, start, size), 0
                data += value
                data += CUT if joined else b""
                cut(step + width)
            if rows:
                yield out()
        cut(1)
        if rows:
            yield out()

    return pieces.select("path", "start", "size", "value", "joined").mapInArrow(run, _BLOCK)


def count_tokens(files: DataFrame, end: int = END, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, ordinal (from 0), n_tokens: one row for each document of the files, which come as ranges or as path and content."""
    pieces = files if "joined" in files.columns else whole(files)
    width = np.dtype(dtype).itemsize
    separator = np.array([end], dtype).tobytes()
    b = written(blocks(pieces, end, dtype, block_bytes), "token-blocks")
    key = ["path", "start", "k"]
    order = W.partitionBy("path").orderBy("start", "k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    s = b.drop("inner").withColumn("at", at).withColumn("rest", F.lag("tail").over(order)).withColumn("closing", F.lead("start").over(order).isNull())
    # Bytes of a token that began in the block before; that token is the block's first.
    s = s.withColumn("skip", F.pmod(-F.col("at"), F.lit(width)).cast("int")).withColumn("token", F.floor(F.col("at") / width))
    torn = F.concat(F.substring("rest", F.greatest("skip", F.lit(1)), F.lit(width) - F.col("skip")), F.substring("first", F.lit(1), F.col("skip")))
    s = s.withColumn("torn", F.coalesce((F.col("skip") > 0) & (torn == F.lit(separator)), F.lit(False)))
    s = s.withColumn("base", F.col("token") + (F.col("skip") > 0).cast("int"))
    for c in ("head", "last", "sep"):
        s = s.withColumn(c, F.get(f"{c}s", F.col("skip")))
    s = s.withColumn("own", F.when(F.col("sep") > 0, F.col("base") + F.col("last")).when(F.col("torn"), F.col("token")))
    s = s.withColumn("docs", F.coalesce(F.sum(F.col("sep") + F.col("torn").cast("int")).over(before), F.lit(0)))
    s = s.withColumn("carry", F.col("token") - 1 - F.coalesce(F.max("own").over(before), F.lit(-1)))
    s = s.withColumn("until", F.coalesce("own", F.col("token") - 1 - F.col("carry")))
    s = s.select(*key, "size", "skip", "torn", "base", "token", "head", "sep", "docs", "carry", "until", "closing")
    s = b.select(*key, "inner").join(s, key)
    none = F.array().cast("array<bigint>")
    inner = F.get("inner", F.col("skip"))
    begun = F.col("carry") + F.col("base") - F.col("token") + F.col("head")
    lengths = (
        F.when((F.col("sep") == 0) & ~F.col("torn"), none)
        .when(F.col("sep") == 0, F.array("carry"))
        .when(F.col("torn"), F.concat(F.array("carry", "head"), inner))
        .otherwise(F.concat(F.array(begun), inner))
    )
    # At the file's end: a byte that joining pieces put there may make a separator of a torn token. Then a document ends, not begins.
    total = F.floor(F.col("size") / width)
    tail = total - 1 - F.col("until")
    s = s.withColumn("lengths", lengths)
    closed = F.when(F.col("until") >= total, F.when(F.element_at("lengths", -1) == 0, F.slice("lengths", F.lit(1), F.size("lengths") - 1)).otherwise(F.col("lengths")))
    closed = closed.otherwise(F.concat("lengths", F.when(tail > 0, F.array(tail)).otherwise(none)))
    s = s.select("path", "docs", F.posexplode(F.when(F.col("closing"), closed).otherwise(F.col("lengths"))).alias("i", "n_tokens"))
    return s.select("path", (F.col("docs") + F.col("i")).alias("ordinal"), "n_tokens")


def document_ids(files: DataFrame) -> DataFrame:
    """path, ordinal, doc_id of the files that write_tokens puts beside the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                data = content.as_py()
                n = len(data) // 9
                known = np.frombuffer(data, np.uint8, n, 8 * n) == 0
                ids = pa.array(np.frombuffer(data, "<i8", n), mask=known)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), pa.array(np.arange(n)), ids], ["path", "ordinal", "doc_id"])

    return files.mapInArrow(run, "path string, ordinal long, doc_id long")


def document_tokens(docs: DataFrame, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    """doc_id, n_tokens: writes the token files, scans them, and gives each document its id back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    dtype = write_tokens(docs, path, vocabulary_file)
    chunk = F.regexp_extract("path", "chunk=([^/]+)", 1)
    if not _exists(spark, f"{path}/kind=tokens"):
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counts = count_tokens(ranges(spark, f"{path}/kind=tokens"), dtype=dtype).select(chunk.alias("chunk"), "ordinal", "n_tokens")
    ids = document_ids(_files(spark, f"{path}/kind=ids")).select(chunk.alias("chunk"), "ordinal", "doc_id")
    return counts.join(ids, ["chunk", "ordinal"]).select("doc_id", "n_tokens")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
