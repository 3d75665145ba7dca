"""How five text filters interact: what each removes in every order, alone, in vain, and its Shapley share.

Inclusion-exclusion. A document's five failures are bits of a mask; for each of the 32 sets S of filters the sum over documents of the
product of their flags is J(S), the number that fails all of S. Only these sums are gathered, three times for each part (of all
documents, of the good and of the toxic ones). Everything else is a signed sum of them:

- survivors of T (fail none of T): the sum over S within T of (-1)^|S| J(S), the Möbius transform;
- removed by f after P: survivors of P less survivors of P with f; redundant: J(f) less removed;
- fail f only: the sum over S with f of (-1)^(|S|-1) J(S);
- the game v(T) = documents that T removes has the Harsanyi dividends (-1)^(|S|-1) J(S), so the Shapley value of f is the
  sum over S with f of its dividend / |S|; times the 120 orders it is a whole number, and is what f removes added up over all of them.

The filters are column expressions; no Python runs. Whether an equal text has a smaller id needs no join of texts: rows come together by
id (with labels) and by a digest of the text, as counts that tasks add up before they are shuffled, so a text that a third of all
documents share is a few rows a task.

Defined cases: null text and null part are empty strings; an empty text has no words, fails A only (and E as a copy), and holds B and C
(nothing is less or more than nothing); very long texts count whole; a null id has no label, is smaller than no id and never fails
E; repeated rows (same id and text) are all counted, and none is a copy of the other, as their ids are equal; a label of 1 in any of an id's
label rows counts, null labels don't; ties don't arise, as nothing is ranked; an empty table gives no row; extra columns, with whatever
names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
#: Percent of a text's words that must be different; of its characters that may be capitals.
MIN_DISTINCT, MAX_CAPITALS = 50, 3
SYMBOLS = "[#$%&*|]"
#: Nulls' rows are dealt over so many keys.
SPREAD = 1 << 20


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A few words, B repeated words, C capitals, D symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    at = lambda i, fails: F.when(fails, 1 << i).otherwise(0)
    # One struct, so that words are cut once.
    return F.transform(
        F.array(counts),
        lambda c: at(0, c.n < MIN_WORDS)
        + at(1, 100 * c.d < MIN_DISTINCT * c.n)
        + at(2, 100 * capitals > MAX_CAPITALS * F.length(text))
        + at(3, text.rlike(SYMBOLS)),
    )[0]


def _labels(labels: DataFrame) -> DataFrame:
    """id, good, toxic of each labelled id, once."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def joint_failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, all, good, toxic: for each part arrays of J(S), S = 0 to 31 with bit i for filter i; J(0) counts the documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # Null ids join nothing; they are dealt by digest, not all to one task.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("salt", salt).join(_labels(labels).withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # An id is in a group once, so the least id's own count is n of one row. All but the least id's rows are copies.
    key = ("digest", "part", "mask", "good", "toxic")
    groups = rows.select("id", "part", "digest", "mask", "n", *known).groupBy(*key)
    groups = groups.agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    own = groups.groupBy("digest").agg(F.collect_list(F.struct(*key[1:], "n", "least", "at_least", "unknown")).alias("own"), F.min("least").alias("first"))
    own = own.select("first", F.inline("own"))
    first = F.col("unknown") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + SETS // 2).alias("mask"), (F.col("n") - first).alias("n"))))
    counted = own.select("part", "good", "toxic", each.alias("c")).where("c.n > 0")
    weights = {"all": "n", "good": "n * good", "toxic": "n * toxic"}
    sums = [f"array({', '.join(f'sum(if(mask & {s} = {s}, {w}, 0L))' for s in range(SETS))}) AS `{k}`" for k, w in weights.items()]
    return counted.select("part", "good", "toxic", "c.mask", "c.n").groupBy("part").agg(*map(F.expr, sums))


def _signed_sum(joint: str, holds: str, factor: str) -> str:
    """SQL: the sum of factor * J(s) over the sets s for which a condition holds."""
    return f"aggregate(sequence(0, {SETS - 1}), 0L, (sum, s) -> sum + if({holds}, {factor} * get({joint}, s), 0L))"


def survivors(joint: str) -> Column:
    """For each set t of filters the number of documents that fail none of t, from the joint failures."""
    return F.expr(f"transform(sequence(0, {SETS - 1}), t -> {_signed_sum(f'`{joint}`', 's & ~t = 0', '(1 - 2 * (bit_count(s) % 2))')})")


def unique_failures(joint: str) -> Column:
    """For each filter the number of documents that fail it and no other."""
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), i -> {_signed_sum(f'`{joint}`', 's & shiftleft(1, i) <> 0', '(2 * (bit_count(s) % 2) - 1)')})")


def shapley(joint: str) -> Column:
    """For each filter its Shapley value times the number of orders, from the dividends."""
    share = f"(2 * (bit_count(s) % 2) - 1) * ({len(ORDERS)} div bit_count(s))"
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), i -> {_signed_sum(f'`{joint}`', 's & shiftleft(1, i) <> 0', share)})")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and
    step."""
    joint = joint_failures(docs, labels, part)
    table = joint.select("part", "all", *(survivors(k).alias(f"{k}_left") for k in ("all", "good", "toxic")), unique_failures("all").alias("only"), shapley("all").alias("shares"))
    s = table.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    first = lambda least: sum((F.when(F.instr("filter_order", f) <= F.col("step") - least, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    s = s.withColumns({"before": first(1), "after": first(0), "i": F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1")})
    lost = lambda k: F.get(f"{k}_left", F.col("before")) - F.get(f"{k}_left", F.col("after"))
    fails = F.get("all", F.col("after") - F.col("before"))
    return s.select(
        "part",
        "filter_order",
        "step",
        F.get("all_left", F.col("after")).alias("kept"),
        lost("all").alias("removed"),
        (fails - lost("all")).alias("redundant"),
        F.get("only", F.col("i")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("i")).alias("shapley"),
    )


def oracle_sql() -> str:
    """The same by applying each order's filters one after the other to the counts of failure masks."""
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    return f"""
    WITH t AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents
    ), f AS (
        SELECT doc_id, part, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS up, length(x) AS n,
               regexp_matches(x, '{SYMBOLS}') AS d, coalesce(min(doc_id) OVER (PARTITION BY x) < doc_id, false) AS e
        FROM t
    ), m AS (
        SELECT part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b, 100 * up > {MAX_CAPITALS} * n AS c, d, e,
               coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM f LEFT JOIN (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) ON id = doc_id
    ), g AS (
        SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
               count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
        FROM m GROUP BY ALL
    ), o AS (
        SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM (VALUES {orders}) v(filter_order), range(1, 6) r(step)
    ), r AS (
        SELECT part, filter_order, step, f,
               sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
        FROM g, o GROUP BY ALL
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM r
    """
