import os
import re
from itertools import permutations

import pytest

from tests.oracle import connect, rows_of_spark, rows_of_sql
from tomeflow.llm import audit, registry

FOLDER = "/root/testdata/sf0.001"


def by_hand(docs, labels):
    """Applies every order's filters one after the other to the documents themselves."""
    fails = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        flag = lambda k: int(any(x[0] == i and x[k] == 1 for x in labels if i is not None))
        fails.append((lang or "", f, flag(1), flag(2)))
    out = []
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                every = [x for x in own if f in x[1]]
                total[f] += len(gone)
                rows.append((part, order, k + 1, len(kept), len(gone), len(every) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
                left = kept
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


DOCS = [
    (1, "a b c", "en"),
    (2, "a b c", "fr"),
    (2, "a b c", "fr"),
    (None, "a b c", None),
    (None, None, ""),
    (3, None, "en"),
    (4, "", "en"),
    (5, " ".join(f"w{i}" for i in range(250)), "en"),
    (6, " ".join(["w"] * 250), "en"),
    (7, " ".join(f"W{i}" for i in range(250)) + " #", "fr"),
    (8, " ".join(f"W{i}" for i in range(250)) + " #", "en"),
    (9, "  x\x1cy " * 220, "de"),
    (10, "A" * 3 + "b" * 97, "de"),
    (11, "A" * 4 + "😀" * 96, "de"),
    (12, "a\tb\x0bc\x0cd\re\n" * 90, "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (12, 1, 0)]


def test_rows_equal_filters_applied_one_by_one(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS part", "3 AS mask", "4 AS digest")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(docs, labels).collect())
    assert got == by_hand(DOCS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    some = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in audit.audit(some, labels).collect()) == by_hand(DOCS, [])


def test_dividends_sum_to_what_all_filters_remove(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    joint = audit.joint_failures(docs, labels)
    for r in joint.select("all", audit.survivors("all").alias("left"), audit.shapley("all").alias("shares")).collect():
        assert r.left[0] == r.all[0]
        assert sum(r.shares) == 120 * (r.all[0] - r.left[-1])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_equals_sql(spark):
    df = registry.op12_audit(spark, FOLDER)
    assert rows_of_spark(df) == rows_of_sql(connect(FOLDER), registry.ORACLE_SQL["op12_audit"], df.columns)


def test_no_python_runs(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = audit.audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)
