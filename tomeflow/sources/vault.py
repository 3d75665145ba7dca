"""Reading and writing vaults with Spark: raw blobs, wiki pages, local documents and fetched pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

PAGE_FIELDS = "slug string, type string, title string, description string, id string, version string, timestamp string, tags array<string>, sources array<string>, body string, parse_error string"
LOCAL = ("md", "txt", "pdf", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """path, raw_id, title, body of raw/*.md, not of folders below it. An empty or missing folder gives no rows."""
    files = _markdown(spark, f"{root}/raw", recursive=False)
    body = text.raw_body(F.col("content"))
    return files.select("path", text.file_stem(F.col("path")).alias("raw_id"), text.raw_title(body).alias("title"), body.alias("body"))


def wiki_pages(spark: SparkSession, root: str, version_field: str = "version") -> DataFrame:
    """path, content and the fields of wiki/concepts and wiki/entities, with parse_error where a page can't be read; each
    consumer decides what to do with those. The format's version is read from the field that the caller names."""
    return parsed_pages(_markdown(spark, f"{root}/wiki/concepts").unionByName(_markdown(spark, f"{root}/wiki/entities")), version_field)


def parsed_pages(files: DataFrame, version_field: str = "version") -> DataFrame:
    """The same of pages(path, content) from anywhere."""
    return files.select("path", "content").mapInPandas(partial(_parse_pages, version_field=version_field), f"path string, content string, {PAGE_FIELDS}")


def _markdown(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, content string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").rsplit("/raw", 1)[0].rsplit("/wiki/", 1)[0]
    relative = F.regexp_replace("path", "^[a-z0-9]+:/*" + re.escape(re.sub(r"^[a-z0-9]+:/*", "", root).lstrip("/")) + "/", "")
    return found.select(relative.alias("path"), F.col("content").cast("string").alias("content"))


def parse_page(content: str, version_field: str = "version") -> dict:
    """The fields of a page; parse_error says which of the three ways of being unreadable it is."""
    if not content.startswith("---\n"):
        return {"parse_error": "no front matter"}
    end = content.find("\n---\n", 3)
    if end < 0:
        return {"parse_error": "front matter isn't closed"}
    try:
        meta = yaml.safe_load(content[4:end]) if end > 3 else {}
        if not isinstance(meta, dict) or not all(isinstance(meta.get(k), str) for k in ("type", "title")):
            raise ValueError("type and title are required")
        sources = [s["resource"] for s in meta.get("sources") or []]
        optional = {k: None if meta.get(k) is None else str(meta[k]) for k in ("description", "id", "timestamp")}
        optional["version"] = None if meta.get(version_field) is None else str(meta[version_field])
        tags = [str(t) for t in meta.get("tags") or []]
    except Exception as e:
        return {"parse_error": f"bad front matter: {str(e).splitlines()[0]}"}
    return {"type": meta["type"], "title": meta["title"], "tags": tags, "sources": sources, "body": content[end + 5 :], "parse_error": None, **optional}


def repair_id(content: str) -> str | None:
    """The page with a mistyped id field put right, if that makes it readable; else null."""
    if parse_page(content)["parse_error"] is None or not content.startswith("---\n") or (end := content.find("\n---\n", 3)) < 0:
        return None
    head = content[4:end].split("\n")
    if any(x.startswith("id:") for x in head) or not any(x.startswith("tid:") for x in head):
        return None
    at = next(i for i, x in enumerate(head) if x.startswith("tid:"))
    fixed = "---\n" + "\n".join([*head[:at], head[at][1:], *head[at + 1 :]]) + content[end:]
    return fixed if parse_page(fixed)["parse_error"] is None else None


def repair_ids(pages: DataFrame) -> DataFrame:
    """path, content of the pages whose id field was mistyped, put right."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(content=b["content"].map(repair_id))
            yield b[b["content"].notna()]

    return pages.where("parse_error IS NOT NULL").select("path", "content").mapInPandas(run, "path string, content string")


def _parse_pages(batches: Iterator[pd.DataFrame], version_field: str) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    for b in batches:
        parsed = [parse_page(c or "", version_field) for c in b["content"]]
        for n in names[1:]:
            b[n] = [p.get(n) for p in parsed]
        b["slug"] = [p.rsplit("/", 1)[-1].removesuffix(".md") for p in b["path"]]
        yield b[["path", "content", *names]]


def provenance(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("path").alias("page"), F.explode("sources").alias("resource"))


def docx_text(data: bytes) -> str:
    """Paragraphs apart by an empty line, empty ones dropped; table rows are lines, cells apart by ' | '."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def words(e: ElementTree.Element) -> str:
        return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            out.append(words(e))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(" ".join(w for p in c.iter(f"{_W}p") if (w := words(p))) for c in r.findall(f"{_W}tc")) for r in e.findall(f"{_W}tr")]
            out.append("\n".join(rows))
    return "\n\n".join(x for x in out if x.strip())


def local_documents(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """uri, content, error of local md, txt, docx files, and of whatever else extractors know (as for pdf)."""
    known = {"md": lambda b: b.decode("utf-8"), "txt": lambda b: b.decode("utf-8"), "docx": docx_text, **(extractors or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                ext = p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else ""
                try:
                    rows.append((p, known[ext](bytes(data)), None) if ext in known else (p, None, f"unsupported extension: {ext}"))
                except Exception as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["uri", "content", "error"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return found.mapInPandas(run, "uri string, content string, error string")


def split_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(URLs, local paths) of a column source."""
    return sources.where(text.is_url(F.col("source"))), sources.where(~text.is_url(F.col("source")))


def web_documents(pages: DataFrame, to_markdown: Callable[[str], str]) -> DataFrame:
    """uri, content, error of fetched pages (url, html) by a converter; a page that it fails on is a row with an error."""

    def one(html: str | None) -> tuple[str | None, str | None]:
        try:
            return (to_markdown(html), None) if html is not None else (None, "no content")
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *one(h)) for u, h in zip(b["url"], b["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["uri", "content", "error"])

    return pages.select("url", "html").mapInPandas(run, "uri string, content string, error string")


def append_blobs(documents: DataFrame, path: str) -> None:
    """documents(vault, uri, content, ingested_at, and tags if there are any) as blobs, partitioned by vault; the front matter that a file
    would have is columns here."""
    h = text.content_hash(F.col("content"))
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in documents.columns else F.array().cast("array<string>")
    blobs = documents.select("vault", text.raw_id(h).alias("raw_id"), h.alias("checksum"), F.col("uri").alias("source_url"), "ingested_at", tags.alias("tags"), "content")
    blobs.dropDuplicates(["vault", "checksum"]).write.mode("append").partitionBy("vault").parquet(path)


def search_documents(raw: DataFrame, active: DataFrame, pages: DataFrame) -> DataFrame:
    """path, title, body, doc_type: active raw files (an untitled one by its id) and the wiki pages that parse."""
    kept = raw.join(active.select("raw_id"), "raw_id", "left_semi")
    a = kept.select("path", F.when(F.col("title") == "", F.col("raw_id")).otherwise(F.col("title")).alias("title"), "body", F.lit("raw").alias("doc_type"))
    return a.unionByName(pages.where("parse_error IS NULL").select("path", "title", "body", F.col("type").alias("doc_type")))
