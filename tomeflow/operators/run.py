"""A whole compile: pending sources are asked for pages and saved wave by wave, then the pages are checked and listed, and the run is
published or not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import vault
from ..sources.partitions import written
from . import bundle, compile, lint


@dataclass
class Report:
    """outcomes(source_seq, uri, error); pages(path, content) after the run; unreadable(path, parse_error) of pages that no check can
    look at; findings and summary of the lint; index (the lines of the index page, in order); publishable: no source failed, every
    page is readable, and the lint has no error."""

    outcomes: DataFrame
    pages: DataFrame
    unreadable: DataFrame
    findings: DataFrame
    summary: DataFrame
    index: DataFrame
    publishable: bool


def compile_vault(
    sources: DataFrame,
    synthesise: Callable[[str], str],
    pages: DataFrame,
    save: Callable[[DataFrame, DataFrame], DataFrame],
    entries: Callable[[], DataFrame],
    files: DataFrame,
    workers: int = 1,
    wave: int | None = None,
    budget: int = text.PROMPT_BUDGET,
    version_field: str = "version",
) -> Report:
    """Asks for sources as `compile_in_waves` does, which also says what they and save are. entries() gives the manifest's entries
    as they are after the run; files(path) are the raw blobs that pages may cite. A failed source stays pending, so it is both in the
    outcomes and among the findings; where saving fails the run ends there, with what was saved before."""
    last = [pages]

    def keep(after: DataFrame, outcomes: DataFrame) -> DataFrame:
        last[0] = save(after, outcomes)
        return last[0]

    outcomes = compile.compile_in_waves(sources, synthesise, pages, keep, workers, wave, budget)
    parsed = written(vault.parsed_pages(last[0], version_field), "parsed-pages")
    good = parsed.where("parse_error IS NULL")
    unreadable = parsed.where("parse_error IS NOT NULL").select("path", "parse_error")
    findings = lint.findings(good, vault.provenance(good), files, entries())
    summary = written(lint.summary(findings), "lint-summary")
    index = bundle.index_lines(good).orderBy("title", "path", F.coalesce("description", F.lit(""))).select("line")
    ready = compile.publishable(summary, compile.outcome_counts(outcomes)) and not unreadable.take(1)
    return Report(outcomes, last[0], unreadable, findings, summary, index, ready)
