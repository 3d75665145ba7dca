"""The best documents of BM25 without scoring every document that shares a term with a query.

Documents of about one length are a block, and the index holds the greatest weight of each term in each block. So for every query it is known
what a term can give, and what it can give in a block. A threshold is a score that the limit-th best document reaches surely: some
documents with the query's strongest terms are scored whole, and the limit-th best of them has it. Terms that even together
stay below the threshold can't lift a document over it; so only documents with one of the other terms are scored. What these reach, and
what the terms left out can add in their block, decides who goes on to the next, weaker terms. Bounds are upper ones all along, so
the rows are those of scoring everything; only the order of additions differs, by less than the digits kept.

Each stage is a join of the postings of its terms with what is left of the documents, and one aggregation. Queries come in parts of a
bounded number, so that the list of those that ask a term, or still want a document, is bounded too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.partitions import discard, written

#: The strongest terms of a query up to so many documents for each one asked for give the threshold.
SEEDS = 32
#: Up to so many of these documents, counted for each query, are sent to every task.
SEEDS_SENT = 100_000
#: Terms go into a stage as long as they and all weaker ones may reach this share of the threshold.
CUTS = (1.0, 0.5)
#: More than scores are rounded by, and differ by the order of additions.
SLACK = 2e-6
QUERIES_A_PART = 4_096


class Search:
    """One search: terms_(query_id, part, group, field, term, idf, mean, df, upper, below) has a query's terms, with the sum of its
    weaker terms' bounds and its own; bounds(query_id, group, field, term, block, upper)."""

    def __init__(self, index, asked: DataFrame, blocks: DataFrame, weight: Column, limit: int, small):
        """asked(query_id, group, field, term, idf, mean, df) of an index; blocks(group, field, term, block, upper) of these terms, a written table;
        weight of a posting without idf."""
        self.group, self.index, self.weight, self.limit, self.small = index.group, index, weight, limit, small
        self.own = ("query_id", *self.group)
        self.kept: list[DataFrame] = [blocks]
        term = (*self.group, "field", "term")
        parts = max(1, math.ceil(asked.select("query_id").distinct().count() / QUERIES_A_PART))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        reach = blocks.groupBy(*term).agg(F.max("upper").alias("upper"))
        known = asked.join(reach, list(term)).withColumn("upper", F.col("upper") * F.col("idf"))
        # Left out first: terms that give little for the many documents that have them.
        weakest = W.partitionBy(*self.own).orderBy(F.col("upper") / F.col("df"), "field", "term").rowsBetween(W.unboundedPreceding, 0)
        strongest = W.partitionBy(*self.own).orderBy(F.desc("upper"), "field", "term").rowsBetween(W.unboundedPreceding, -1)
        self.terms_ = self._keep(known.select("*", F.sum("upper").over(weakest).alias("below"), F.coalesce(F.sum("df").over(strongest), F.lit(0)).alias("seen")), "query-terms")
        self.bounds = blocks.join(self.terms_.select(*self.own, "field", "term", "idf"), list(term)).select(*self.own, "field", "term", "block", (F.col("upper") * F.col("idf")).alias("upper"))
        self.scored: list[tuple[str, DataFrame]] = []

    def _weights(self, terms_: DataFrame, wanted: DataFrame | None, stage: str, few: bool = False) -> DataFrame:
        """query_id, group, doc, block, weight: a row for each posting of a query's terms - of the wanted (query_id, doc), if these
        are given. Few go to every task, so that postings aren't shuffled for them."""
        lists = terms_.groupBy(*self.group, "field", "term", "idf", "mean", "part").agg(F.collect_list("query_id").alias("queries"))
        found = self.index.found(self.small(lists), [*self.group, "field", "term"])
        asking = F.col("queries")
        if wanted is not None:
            by_doc = wanted.groupBy("doc", "part").agg(F.collect_list("query_id").alias("wanting"))
            found, asking = found.join(F.broadcast(by_doc) if few else by_doc, ["doc", "part"]), F.array_intersect("queries", "wanting")
        rows = found.select(*self.group, "doc", "block", "part", (F.col("idf") * self.weight).alias("weight"), F.explode(asking).alias("query_id"))
        self.scored.append((stage, rows))
        return rows

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.own, "doc", "block", "part").agg(F.sum("weight").alias("weight"))

    def _best(self, rows: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*self.own).orderBy(F.desc("weight"), "doc"))
        return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")

    def _reached(self, rows: DataFrame) -> DataFrame:
        """query_id, group, least: the limit-th best of what rows have, where there are as many."""
        best = self._best(rows, self.limit).groupBy(*self.own).agg(F.count("*").alias("n"), F.min("weight").alias("least"))
        return best.where(F.col("n") == self.limit).drop("n")

    def threshold(self) -> DataFrame:
        """query_id, group, least: what the limit-th best document surely reaches; 0 where fewer are known."""
        seeds = self.terms_.where(F.col("seen") < SEEDS * self.limit)
        first = self._keep(self._best(self._sums(self._weights(seeds, None, "seeds")), 4 * self.limit), "seeds")
        rest = self.terms_.where(F.col("seen") >= SEEDS * self.limit)
        whole = self._sums(first.unionByName(self._weights(rest, first, "seeds, whole", first.count() <= SEEDS_SENT).select(*first.columns)))
        return self.terms_.select(*self.own).distinct().join(self._reached(whole), list(self.own), "left").fillna(0.0, "least")

    def scores(self) -> DataFrame:
        """query_id, group, doc, weight (the score): at least every document that can be among the first `limit`."""
        self.least = self._keep(self.threshold(), "thresholds")
        ranked = self.terms_.join(self.least, list(self.own)).withColumn("share", F.when(F.col("least") > 0, F.col("below") / F.col("least")).otherwise(float("inf"))).drop("least")
        left, least = None, self.least
        for i, cut in enumerate((*CUTS, 0.0)):
            tier = ranked.where((F.col("share") >= cut) & (F.col("share") < CUTS[i - 1] if i else F.lit(True)))
            rows = self._weights(tier, left, f"terms from {cut} of the threshold on")
            left = self._sums(rows if left is None else left.unionByName(rows.select(*left.columns)))
            if not cut:
                break
            # What documents have by now may raise the threshold.
            left = self._keep(left, "scores")
            higher = least.unionByName(self._reached(left)).groupBy(*self.own).agg(F.max("least").alias("least"))
            least = self._keep(higher, "thresholds")
            weaker = ranked.where(F.col("share") < cut).select(*self.own, "field", "term")
            more = self.bounds.join(weaker, [*self.own, "field", "term"]).groupBy(*self.own, "block").agg(F.sum("upper").alias("more"))
            left = left.join(more, [*self.own, "block"], "left").join(least, list(self.own))
            left = left.where(F.col("weight") + F.coalesce("more", F.lit(0.0)) >= F.col("least") - SLACK).select(*self.own, "doc", "block", "part", "weight")
        return left.select(*self.own, "doc", "weight")

    def rows_scored(self) -> dict[str, int]:
        """How many postings were scored for a query, by stage. Runs the search for each."""
        if not self.scored:
            self.scores()
        return {stage: rows.count() for stage, rows in self.scored}

    def _keep(self, df: DataFrame, what: str) -> DataFrame:
        self.kept.append(written(df, what))
        return self.kept[-1]

    def close(self) -> None:
        """Removes the search's own tables, once its scores are read."""
        for df in self.kept:
            discard(df)
