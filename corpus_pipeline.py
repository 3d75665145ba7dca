"""From raw documents to a training mix: toxic documents go, one of each group of near-duplicates stays, contaminated
documents go, personal data is masked, and sources are mixed to target weights.

Each stage takes and returns documents with all their columns; the last returns a row for each time that a document is in
the mix, with n_tokens, block and place besides. The near-duplicates stage searches by SimHash and pivot tables as op1 does, in a wider
radius, and verifies by the Jaccard similarity of five-word shingles.

Defined cases: a null or empty text is neither toxic nor contaminated; such documents are near-duplicates of each other. Very
long texts count whole. Of near-duplicates the one with the smallest id stays, of rows that share an id and words the least by their
other columns; so repeated rows become one. Nulls in other columns don't matter; extra columns pass all stages, and where
their names clash with new ones, these have underscores before them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import decontaminate, mixing, near_copies, pii, toxicity
from tomeflow.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored, severity = toxicity.with_severity(docs, model)
    return scored.where(F.col(severity) < model.cut).drop(severity)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged, found = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col(f"{found}.contaminated")).drop(found)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
]

#: A trained model, XXH64 fingerprints and message passing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents; what each stage keeps is written to the shared folder before the next begins, and what it was made
    from is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
