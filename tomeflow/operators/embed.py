"""Vectors for sections, from an embedder that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .store import replace_sections

Embedder = Callable[[list[str]], list[list[float]]]


def sections_of(documents: DataFrame) -> DataFrame:
    """section_key, path, heading, snippet, text of documents(path, body)."""
    s = documents.select("path", F.posexplode(text.sections(F.col("body"))).alias("i", "s"))
    return s.select(F.concat("path", F.lit("#"), "i").alias("section_key"), "path", "s.heading", text.snippet(F.col("s.text")).alias("snippet"), "s.text")


def embed(sections: DataFrame, load: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """sections with a vector for each text. load() runs once in a task, not once a row: models are large."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            model = model or load()
            texts = f["text"].tolist()
            f["vector"] = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield f[["section_key", "path", "heading", "snippet", "vector"]]

    return sections.mapInPandas(run, "section_key string, path string, heading string, snippet string, vector array<float>")


def refresh(stored: DataFrame, changed: DataFrame, load: Callable[[], Embedder]) -> DataFrame:
    """The section table after changed documents (path, body) are cut and embedded anew; the rest stays as it is."""
    return replace_sections(stored, embed(sections_of(changed), load))
