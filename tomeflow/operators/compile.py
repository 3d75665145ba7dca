"""Selecting sources to synthesise, prompts within a budget, and applying what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import payload, text
from ..sources.partitions import fresh_path


#: So many open jobs are sent to every task.
BROADCAST_JOBS = 100_000


def referenced_ids(provenance: DataFrame) -> DataFrame:
    """raw_id: what pages cite."""
    return provenance.select(text.file_stem(F.col("resource")).alias("raw_id")).distinct()


def select_sources(entries: DataFrame, provenance: DataFrame) -> DataFrame:
    """uri, raw_id of active sources that are pending and that no page cites yet. entries: those of `manifest.entries`."""
    pending = entries.where("pending").select("uri", F.col("active_raw_id").alias("raw_id"))
    return pending.join(referenced_ids(provenance), "raw_id", "left_anti").select("uri", "raw_id")


def trim_related(related: DataFrame, base_tokens: Column, budget: int = text.PROMPT_BUDGET, by: str = "query_id") -> DataFrame:
    """Of each prompt's related pages (rank, tokens), the first ones that fit; what is over goes from the tail."""
    running = F.sum("tokens").over(W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return related.withColumn("running_tokens", running).where(base_tokens + F.col("running_tokens") <= budget)


def fit_blobs(blobs: DataFrame, budget: int = text.PROMPT_BUDGET) -> DataFrame:
    """blobs(active, superseded) with both cut to a shared budget."""
    b = F.lit(budget).cast("long")
    shares = text.shared_budgets(text.estimate_tokens(F.col("active")), text.estimate_tokens(F.col("superseded")), b)
    cut = blobs.withColumn("_s", shares)
    for c in ("active", "superseded"):
        cut = cut.withColumn(c, text.truncate_to_budget(F.col(c), F.col(f"_s.{c}")))
    return cut.drop("_s")


def prompt(raw_id: Column, active: Column, old_id: Column, superseded: Column, related: Column) -> Column:
    """The text that a synthesiser gets: the source, the version it replaced (if any), and related pages (if any:
    array<struct<path,content>>). The words are this library's own."""
    fenced = lambda c: F.concat(F.lit("```markdown\n"), c, F.lit("\n```\n\n"))
    first = F.concat(F.lit("# Source\nid: "), raw_id, F.lit("\n"), fenced(active))
    second = F.when(superseded.isNotNull(), F.concat(F.lit("# Version it replaces\nid: "), old_id, F.lit("\n"), fenced(superseded))).otherwise(F.lit(""))
    pages = F.array_join(F.transform(related, lambda p: F.concat(F.lit("path: "), p["path"], F.lit("\n"), fenced(p["content"]))), "")
    third = F.when(F.size(related) > 0, F.concat(F.lit("# Pages that exist\n"), pages)).otherwise(F.lit(""))
    return F.concat(first, second, third, F.lit("Answer with a JSON object of page operations."))


def link_fix_prompt(slug: Column, pages: Column, sources: Column) -> Column:
    """The text that asks for a missing page: its slug, the pages that link to it (array<struct<path,content>>), and what those
    cite (array<struct<id,content>>)."""
    fenced = lambda c: F.concat(F.lit("```markdown\n"), c, F.lit("\n```\n\n"))
    listed = lambda a, key, f: F.array_join(F.transform(a, lambda x: F.concat(F.lit(f"{key}: "), x[f], F.lit("\n"), fenced(x["content"]))), "")
    return F.concat(
        F.lit("# Missing page\n[["), slug, F.lit("]] is linked but doesn't exist. Write that page from the sources below and from nothing else.\n\n# Pages that link to it\n"),
        listed(pages, "path", "path"), F.lit("# Sources they cite\n"), listed(sources, "id", "id"), F.lit("Answer with a JSON object of page operations."),
    )


def compile_sources(sources: DataFrame, synthesise: Callable[[str], str], pages: DataFrame, workers: int = 1, budget: int = text.PROMPT_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(pages after the run, outcomes source_seq, uri, error) of sources(source_seq, uri, raw_id, active, old_id, superseded,
    related array<struct<path,content>>). A source whose answer can't be used is an error of its own, and stays pending."""
    fitted = fit_blobs(sources, budget)
    jobs = fitted.select("source_seq", "uri", prompt(F.col("raw_id"), F.col("active"), F.col("old_id"), F.col("superseded"), F.col("related")).alias("prompt"))
    # Each source is asked once, whatever reads its answer.
    answers = _written(run_jobs(jobs, synthesise, workers), "answers")
    checked = answers.withColumn("_p", payload.operations(F.col("payload")))
    outside = F.exists("_p.operations", lambda o: ~text.writable(o["path"]))
    error = F.coalesce("error", F.when(~F.col("_p.valid"), F.lit("the answer isn't a valid payload")), F.when(outside, F.lit("a path leaves the vault")))
    outcomes = jobs.select("source_seq", "uri").join(checked.select("source_seq", error.alias("error")), "source_seq")
    return apply_operations(pages, parse_results(answers)), outcomes


def _written(df: DataFrame, what: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compile_in_waves(sources: DataFrame, synthesise: Callable[[str], str], pages: DataFrame, save: Callable[[DataFrame, DataFrame], DataFrame], workers: int = 1, wave: int | None = None, budget: int = text.PROMPT_BUDGET) -> DataFrame:
    """source_seq, uri, error of every source that was asked, in the order of source_seq, `wave` of them at a time (by default as many
    as there are workers). After each wave save(pages, outcomes) makes its results last and returns the pages to go on with; so a
    run that is stopped has lost one wave at most, and where saving fails no further source is asked."""
    seqs = [r.source_seq for r in sources.select("source_seq").orderBy("source_seq").collect()]  # a synthesiser reads each: few
    spark, step, done = sources.sparkSession, wave or max(1, workers), None
    for i in range(0, len(seqs), step):
        some = sources.where(F.col("source_seq").between(seqs[i], seqs[min(i + step, len(seqs)) - 1]))
        after, outcomes = compile_sources(some, synthesise, pages, workers, budget)
        outcomes = _written(outcomes, "outcomes")
        pages = save(after, outcomes)
        done = outcomes if done is None else done.unionByName(outcomes)
    return done if done is not None else spark.createDataFrame([], "source_seq long, uri string, error string")


def touched(operations: DataFrame) -> DataFrame:
    """path of every page that operations name, once."""
    return operations.select("path").distinct()


def touched_vaults(operations: DataFrame) -> DataFrame:
    """vault of every vault whose index page is to be made anew, once."""
    return operations.select("vault").distinct()


def publishable(summary: DataFrame, counts: DataFrame) -> bool:
    """Whether a run may be published: no failed source and no lint error."""
    return not summary.first().has_errors and not counts.first().failed


def parse_results(results: DataFrame) -> DataFrame:
    """source_seq, op_seq, action, path, content of valid payloads; a payload with any bad operation gives none."""
    parsed = results.withColumn("_p", payload.operations(F.col("payload"))).where("_p.valid")
    return parsed.select("source_seq", F.posexplode("_p.operations").alias("op_seq", "_o")).select("source_seq", "op_seq", "_o.action", "_o.path", "_o.content")


def sandboxed(operations: DataFrame) -> DataFrame:
    """operations with normal paths, without those of sources of which any operation's path leaves the vault or is its own folder."""
    escaping = operations.where(~text.writable(F.col("path"))).select("source_seq").distinct()
    return operations.join(escaping, "source_seq", "left_anti").withColumn("path", text.normal_path(F.col("path")))


def apply_operations(pages: DataFrame, operations: DataFrame) -> DataFrame:
    """path, content after all operations in order: the last one for a path holds; deleting what isn't there is fine. A source that
    names a path outside the vault, or the vault's own folder, changes nothing.

    The last operation is an aggregate, not a window: a path that very many operations touch is reduced before the shuffle."""
    last = sandboxed(operations).groupBy("path").agg(F.max_by(F.struct("action", "content"), F.struct("source_seq", "op_seq")).alias("_o"))
    both = pages.select("path", F.col("content").alias("_old"), F.lit(True).alias("_there")).join(last, "path", "full_outer")
    both = both.where("_o IS NULL OR _o.action <> 'DELETE'")
    return both.select("path", F.when(F.col("_o").isNotNull(), F.col("_o.content")).otherwise(F.col("_old")).alias("content"))


def run_jobs(jobs: DataFrame, synthesise: Callable[[str], str], workers: int) -> DataFrame:
    """source_seq, payload, error: a callable over prompts on `workers` tasks. One job's failure is a row, not the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for seq, p in zip(b["source_seq"], b["prompt"], strict=True):
                try:
                    rows.append((seq, synthesise(p), None))
                except Exception as e:
                    rows.append((seq, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_seq", "payload", "error"])

    return jobs.select("source_seq", "prompt").repartition(max(1, workers)).mapInPandas(run, "source_seq long, payload string, error string")


def next_batch(pending: DataFrame, jobs: DataFrame, batch: int) -> DataFrame:
    """kind, key, remaining: the next sources to compile, or once there are none the missing slugs that can be written; and how
    many are left after these."""
    n = max(1, min(50, batch))

    def first(kind: str, some: DataFrame, key: str) -> DataFrame:
        left = F.lit(some.count()) - F.lit(n)
        return some.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.greatest(left, F.lit(0)).cast("long").alias("remaining")).orderBy("key").limit(n)

    found = first("compile", pending, "uri")
    return found if found.take(1) else first("fix_link", jobs.where("ready"), "slug")


def evict(jobs: DataFrame, now: Column, ttl_seconds: int = 1_800, cap: int = 500) -> DataFrame:
    """jobs(job_id, created_at) that are younger than the limit; of those the newest `cap`."""
    young = jobs.where(F.unix_micros(F.col("created_at").cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - F.lit(ttl_seconds * 1_000_000))
    return young.orderBy(F.desc("created_at"), "job_id").limit(cap)


def match_submissions(submitted: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, kind, error: submissions whose job isn't known are errors of their own."""
    found = submitted.join(jobs.select("job_id", F.col("kind").alias("_k")), "job_id", "left")
    return found.select("job_id", F.col("_k").alias("kind"), F.when(F.col("_k").isNull(), F.concat(F.lit("unknown job "), F.col("job_id").cast("string"))).alias("error"))


@dataclass
class Submission:
    """What a batch of answers did. results(position, job_id, status, error, touched array<string>), pages(vault, path, content) after
    it, jobs that are still open, compiled(vault, key) of sources whose content is compiled now, vaults(vault) whose index page is to be
    made anew, once each."""

    results: DataFrame
    pages: DataFrame
    jobs: DataFrame
    compiled: DataFrame
    vaults: DataFrame


def submit(submitted: DataFrame, jobs: DataFrame, pages: DataFrame, now: Column, ttl_seconds: int = 1_800, cap: int = 500) -> Submission:
    """Applies submitted(position, job_id, payload) to jobs(job_id, kind, key, vault, created_at) and pages(vault, path, content), as if
    one after the other by position. An answer that isn't valid, names a path that can't be written, or whose job isn't known or is too old is
    an error of its own, and the others are applied; its job stays open for another try, a later one of the same batch too. An applied job is
    closed, so what comes after it finds none."""
    open_ = _written(evict(jobs, now, ttl_seconds, cap).select(*jobs.columns), "open-jobs")
    known = open_.select("job_id", "kind", "key", "vault")
    own = submitted.join(F.broadcast(known) if cap <= BROADCAST_JOBS else known, "job_id", "left").withColumn("_p", payload.operations(F.col("payload")))
    bad_path = F.exists("_p.operations", lambda o: ~text.writable(o["path"]))
    why = F.when(F.col("vault").isNull(), "job not found or expired").when(~F.col("_p.valid"), "the answer isn't a valid payload").when(bad_path, "a path leaves the vault")
    own = own.select("position", "job_id", "kind", "key", "vault", "_p.operations", why.alias("error"))
    own = _written(own, "submitted")
    first = own.where("error IS NULL").groupBy("job_id").agg(F.min("position").alias("_applied"))
    own = own.join(first, "job_id", "left").withColumn("error", F.when(F.col("position") > F.col("_applied"), "job not found or expired").otherwise(F.col("error")))
    applied = own.where("error IS NULL")
    touched = F.array_sort(F.array_distinct(F.transform("operations", lambda o: text.normal_path(o["path"]))))
    results = own.select("position", "job_id", F.when(F.col("error").isNull(), "applied").otherwise("error").alias("status"), "error", F.when(F.col("error").isNull(), touched).alias("touched"))
    ops = applied.select("vault", "position", F.posexplode("operations").alias("op_seq", "_o")).select("vault", "position", "op_seq", "_o.action", text.normal_path(F.col("_o.path")).alias("path"), "_o.content")
    last = ops.groupBy("vault", "path").agg(F.max_by(F.struct("action", "content"), F.struct("position", "op_seq")).alias("_o"))
    both = pages.select("vault", "path", F.col("content").alias("_old")).join(last, ["vault", "path"], "full_outer").where("_o IS NULL OR _o.action <> 'DELETE'")
    after = both.select("vault", "path", F.when(F.col("_o").isNotNull(), F.col("_o.content")).otherwise(F.col("_old")).alias("content"))
    compiled = applied.where("kind = 'compile'").select("vault", "key").distinct()
    return Submission(results, after, open_.join(applied.select("job_id"), "job_id", "left_anti"), compiled, touched_vaults(applied))


def health(checks: DataFrame, by: list[str]) -> DataFrame:
    """status of each group of checks(critical, status): unhealthy if a critical one is, degraded if any isn't healthy."""
    bad = F.bool_or(F.col("critical") & (F.col("status") == "unhealthy"))
    return checks.groupBy(*by).agg(F.when(bad, "unhealthy").when(F.bool_or(F.col("status") != "healthy"), "degraded").otherwise("healthy").alias("status"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """processed, failed."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
