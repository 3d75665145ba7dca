"""Mixing sources to target weights by temperature.

Source i with a share p_i of all tokens gets the weight p_i**a / sum p**a. The exponent a is found by bisection on [0, 1]:
the largest whose weights have at least the target entropy (a fraction of the largest possible one), raised, if need be,
to the smallest that repeats no source more than `max_repeats` times - the limit comes first. Both are monotone in a. Each
step tries 32 exponents in one aggregate over the sources, so any number of sources may exist.

A source's budget is its weight times the budget of all. It is met in blocks: block e is a permutation of all the source's
documents by a hash of (seed, e, id). Whole blocks come as often as they fit; of the last, documents are taken in order
while their tokens fit the rest. Its sums are first made over 4,096 ranges of the hash, so that only the one range in which
the budget ends is sorted and summed document by document; no source, however large, is gathered in one task.

Tokens are estimated as a quarter of the characters, rounded up.

Defined cases: a null source is a source; documents without tokens (null or empty text) come with every whole block of their source and cost
nothing; a source that has only such documents comes as one whole block; very long texts count whole; ties of a place go by id and
tokens; a null id is an id; repeated rows are documents of their own, with neighbouring places; an empty table gives an empty
mix; extra columns are kept. A budget above `max_repeats` times all tokens
repeats all sources alike, with a warning.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, written

SEED = 17
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
RANGES = 4_096
_TRIES, _ROUNDS = 32, 8


def token_estimate(text: Column) -> Column:
    return F.coalesce(F.floor((F.char_length(text) + 3) / 4), F.lit(0)).cast("long")


def exponent(sources: DataFrame, total: int, budget: int, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[float, float]:
    """(a, sum of p**a) for a table of sources with a column tokens, all above zero."""
    p = F.col("tokens") / F.lit(float(total))

    def at(tries: list[float]) -> list[tuple[float, float, float]]:
        """For each exponent: the sum, the entropy, and the repeats of the most repeated source."""
        sums = [x for a in tries for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1))))]
        got = sources.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()
        out = []
        for i, a in enumerate(tries):
            z, zl, most = got[3 * i], got[3 * i + 1], got[3 * i + 2]
            out.append((z, math.log(z) - a * zl / z, most / z * budget / total))
        return out

    def search(good) -> float:
        """The edge of the exponents that are good, which lie below it: between 0, taken as good, and 1."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            tries = [low + (high - low) * i / _TRIES for i in range(1, _TRIES + 1)]
            ok = [good(x) for x in at(tries)]
            n = next((i for i, x in enumerate(ok) if not x), _TRIES)
            low, high = ([low, *tries])[n], ([*tries, high])[n]
            if low == high:
                break
        return low

    n = sources.count()
    goal = target_entropy * math.log(n) if n > 1 else 0.0
    a = search(lambda x: x[1] >= goal - 1e-12)
    if at([a])[0][2] > max_repeats + 1e-9:
        a = min(1.0, search(lambda x: x[2] > max_repeats) + 2.0**-40)
    return a, at([a])[0][0]


def plan(tokens: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """source, whole (blocks), edge (the range in which the last block ends), rest (tokens left where that range begins).

    tokens: a table doc_id, source, tokens."""
    found = written(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    # Of sources without tokens one whole block, and nothing of the next.
    free = found.where("tokens = 0").select("source", F.lit(1).cast("long").alias("whole"), F.lit(-1).alias("edge"), F.lit(-1).cast("long").alias("rest"))
    sources = found.where("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return free
    budget = total if budget is None else budget
    if budget > max_repeats * total:
        warnings.warn(f"a budget of {budget} repeats {total} tokens more than {max_repeats} times", stacklevel=2)
    a, z = exponent(sources, total, budget, target_entropy, max_repeats)
    share = F.floor(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z) * F.lit(float(budget)) + 1e-6).cast("long")
    budgets = sources.withColumn("budget", share).select("source", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("tokens")).alias("left"))
    budgets = written(budgets, "mix-budgets")
    keyed = tokens.join(budgets, tokens.source.eqNullSafe(budgets.source)).select(budgets.source, "left", "whole", "tokens", _range(_key(seed, F.col("whole"), F.col("doc_id"))).alias("range"))
    ranges = keyed.groupBy("source", "left", "whole", "range").agg(F.sum("tokens").alias("tokens"))
    after = F.sum("tokens").over(W.partitionBy("source").orderBy("range"))
    # The first range after which the sum passes what is left; a range always does, as less is left than the source has.
    edges = ranges.withColumn("after", after).where(F.col("after") > F.col("left"))
    edge = edges.groupBy("source").agg(F.min(F.struct("range", (F.col("left") - F.col("after") + F.col("tokens")).alias("rest"))).alias("e"))
    edge = edge.select(F.col("source").alias("s"), "e")
    paid = budgets.join(edge, budgets.source.eqNullSafe(F.col("s")), "left").select("source", "whole", F.coalesce("e.range", F.lit(0)).alias("edge"), F.coalesce("e.rest", F.lit(0)).cast("long").alias("rest"))
    return paid.unionByName(free)


def _key(seed: int, block: Column, doc_id: Column) -> Column:
    """The place in a permutation: the first 60 bits of the MD5 of seed, block and id."""
    named = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _range(key: Column) -> Column:
    """The range of a place; places run from 0 to 2**60 - 1."""
    return F.shiftright(key, 48).cast("int")


def oracle_sql(target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> str:
    """The same rows in DuckDB's SQL, for the budget of all tokens: bisection by a recursion, and one window a source."""

    def bisect(name: str, start: str, good: str) -> str:
        return f"""{name} AS (
            SELECT 0 AS n, CAST({start} AS DOUBLE) AS low, 1.0::DOUBLE AS high
            UNION ALL
            SELECT n + 1, CASE WHEN {good} THEN mid ELSE low END, CASE WHEN {good} THEN high ELSE mid END
            FROM (SELECT n, low, high, (low + high) / 2 AS mid, sum(pow(p, (low + high) / 2)) AS z, sum(pow(p, (low + high) / 2) * ln(p)) AS zl, max(pow(p, (low + high) / 2 - 1)) AS most
                  FROM {name}, sh WHERE n < 60 GROUP BY n, low, high)
        )"""

    return f"""
        WITH RECURSIVE tk AS (
            SELECT doc_id, source, coalesce((length(text) + 3) // 4, 0) AS n_tokens FROM documents
        ), so AS (SELECT source, sum(n_tokens) AS tokens FROM tk GROUP BY source), sr AS (SELECT * FROM so WHERE tokens > 0),
        sh AS (SELECT source, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM sr) AS p, tokens FROM sr),
        whole AS (SELECT -sum(p * ln(p)) AS entropy, {target_entropy} * ln(count(*)) AS goal FROM sh),
        {bisect("be", "0", "ln(z) - mid * zl / z >= (SELECT goal FROM whole) - 1e-12")},
        ae AS (SELECT CASE WHEN (SELECT entropy >= goal - 1e-12 FROM whole) THEN 1.0 ELSE (SELECT max(low) FROM be) END AS a),
        {bisect("br", "0", f"most / z > {max_repeats}")},
        ar AS (SELECT CASE WHEN (SELECT max(pow(p, (SELECT a FROM ae) - 1)) / sum(pow(p, (SELECT a FROM ae))) FROM sh) > {max_repeats} + 1e-9 THEN (SELECT max(low) FROM br) ELSE (SELECT a FROM ae) END AS a),
        bu AS (
            SELECT source, tokens, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM sh, ar) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM sr) + 1e-6) AS BIGINT) AS budget FROM sh, ar
        ), pl AS (
            SELECT source, CAST(budget // tokens AS BIGINT) AS full_blocks, CAST(budget % tokens AS BIGINT) AS rest FROM bu
            UNION ALL SELECT source, 1, -1 FROM so WHERE tokens = 0
        ),
        ex AS (
            SELECT doc_id, tk.source, n_tokens, full_blocks, rest, unnest(range(0, full_blocks + 1)) AS block
            FROM tk JOIN pl ON tk.source IS NOT DISTINCT FROM pl.source
        ), pc AS (SELECT *, CAST('0x' || substr(md5('{seed}:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM ex),
        cu AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY place, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS used FROM pc)
        SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(block AS BIGINT) AS block, place FROM cu WHERE block < full_blocks OR used <= rest
    """


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """A row of docs for each time that a document is in the mix, with n_tokens, block and place (its order in the block).

    Of columns that clash with these names, the new one has underscores before it."""
    n, block, place = (free_name(docs, c) for c in ("n_tokens", "block", "place"))
    tokens = written(docs.select("doc_id", "source", token_estimate(F.col("text")).alias("tokens")), "mix-tokens")
    todo = written(plan(tokens, budget, target_entropy, max_repeats, seed), "mix-plan")
    p, hidden, passed = (free_name(docs, c) for c in ("plan", "range", "passed"))
    todo = todo.select(F.struct("*").alias(p))
    rows = docs.join(todo, docs.source.eqNullSafe(F.col(f"{p}.source"))).withColumn(n, token_estimate(F.col("text")))

    blocks = F.sequence(F.lit(0).cast("long"), F.col(f"{p}.whole") - 1)
    whole = rows.where(F.col(f"{p}.whole") > 0).withColumn(block, F.explode(blocks)).withColumn(place, _key(seed, F.col(block), F.col("doc_id")))
    last = rows.withColumn(block, F.col(f"{p}.whole")).withColumn(place, _key(seed, F.col(f"{p}.whole"), F.col("doc_id")))
    last = last.withColumn(hidden, _range(F.col(place)))
    inside = last.where(F.col(hidden) < F.col(f"{p}.edge"))
    order = W.partitionBy(f"{p}.source").orderBy(place, "doc_id", n).rowsBetween(W.unboundedPreceding, 0)
    at_edge = last.where(F.col(hidden) == F.col(f"{p}.edge")).withColumn(passed, F.sum(n).over(order)).where(F.col(passed) <= F.col(f"{p}.rest"))
    columns = [*docs.columns, n, block, place]
    pick = lambda d: d.select(*[F.col(f"`{c}`") for c in columns])
    return pick(whole).unionByName(pick(inside)).unionByName(pick(at_edge))
