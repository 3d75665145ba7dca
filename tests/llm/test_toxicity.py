import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=0):
    """Clean prose, and prose with one to five of a few bad words or of a family of inflected ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.15
        for _ in range(rng.randint(1, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "scum!!", "MORON", "qwort" + rng.choice(vocabulary)]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_thresholds_are_ordered_and_severity_rises_with_grade():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random((n, 3)) < 0.3
    grade = np.minimum(3, x.sum(axis=1))
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit(rows, cols, grade, 3)
    assert (np.diff(t) > 0).all() and (w > 1).all()
    severity = toxicity._above(x @ w, t).sum(axis=1)
    means = [severity[grade == g].mean() for g in range(3)]
    assert means == sorted(means) and np.abs(means[0]) < 0.5


def test_gradient_by_differences():
    """The fit ends where moving any weight or threshold raises the loss."""
    rng = np.random.default_rng(1)
    x = rng.random((300, 2)) < 0.4
    grade = np.clip(x.sum(axis=1) + (rng.random(300) < 0.3), 0, 3)
    rows, cols = np.nonzero(x)
    decay = 1e-2
    w, t = toxicity.fit(rows, cols, grade, 2, steps=3000, rate=0.02, decay=decay)

    def loss(w, t):
        c = np.hstack([np.ones((300, 1)), toxicity._above(x @ w, t), np.zeros((300, 1))])
        return -np.log(c[np.arange(300), grade] - c[np.arange(300), grade + 1]).mean() + decay / 2 * (w**2).sum()

    best = loss(w, t)
    for i in range(2):
        for d in (-0.1, 0.1):
            assert loss(w + d * np.eye(2)[i], t) > best
    for i in range(3):
        for d in (-0.1, 0.1):
            assert loss(w, t + d * np.eye(3)[i]) > best


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    unseen, truth = corpus(seed=0, n=1500)[0][1000:], labels[1000:]
    model = toxicity.train(spark.createDataFrame(docs[:1000], DOCS), spark.createDataFrame(labels[:1000], LABELS))
    said = model.severities([t for _, t in unseen]) >= model.cut
    toxic = np.array([t for *_, t in truth], bool)
    assert (said & toxic).sum() / toxic.sum() >= 0.95 and (said & ~toxic).sum() / (~toxic).sum() <= 0.01


def test_length_and_repeats_dont_dilute(spark):
    docs, labels = corpus()
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    long = "abc " * 50_000 + "idiot and scum"
    a, b, c, none = model.severities([long, "idiot and scum", "idiot scum idiot scum", None])
    assert a == pytest.approx(b) and b == pytest.approx(c) and a >= model.cut > none


def test_odd_rows(spark):
    docs, labels = corpus(300)
    docs += [(900, None), (901, ""), (None, "idiot scum moron"), (0, docs[0][1])]
    labels += [(None, 1, 1), (5, 1, None), (999, 0, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("severity", F.lit("clash")).withColumn("TOXIC", F.lit(1))
    rows = toxicity.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(r.severity is not None for r in rows)
    got = {r.doc_id: r.toxic for r in rows}
    assert got[900] is False and got[901] is False and got[None] is True
    out, name = toxicity.with_severity(df, toxicity.Model({}, np.zeros(0), np.full(3, 40.0), 0.5))
    assert out.columns == [*df.columns, name] and name == "_severity"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_labels_of_one_kind_or_none(spark, labels):
    df = spark.createDataFrame([(1, "idiot"), (2, "fine")], DOCS)
    rows = toxicity.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == 2 and not any(r.toxic for r in rows)
    assert toxicity.score(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def brute_features(text):
    """Words, their first letters, and families, letter by letter."""
    found, word = set(), b""
    for c in (text or "").lower().encode() + b" ":
        if 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            found.add(word)
            word = b""
    out = set(found)
    for w in found:
        for k in (3, 4, 5, 6, 7):
            if len(w) > k:
                out.add(w[:k] + b"*")
        if len(w) > 6 and sum(v[:6] == w[:6] and len(v) > 6 for v in found) > 1:
            out.add(w[:6] + b"**")
    return out


def test_scores_of_a_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(docs, labels, least_texts=1, least_z=1.0)
    assert len(model.vocabulary) > 5
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.severity for r in toxicity.with_severity(docs, model)[0].collect()}
    for r in rows:
        z = sum(model.weights[model.vocabulary[f]] for f in brute_features(r.text) if f in model.vocabulary)
        assert got[r.doc_id] == pytest.approx(sum(1 / (1 + np.exp(-(z - t))) for t in model.thresholds), abs=1e-5)


def test_vocabulary_by_brute_force(spark):
    docs, labels = corpus(400)
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    toxic = {i for i, _, t in labels if t}
    n = [len(docs) - len(toxic), len(toxic)]
    seen = {}
    for i, t in docs:
        for f in brute_features(t):
            seen.setdefault(f, [0, 0])[i in toxic] += 1
    want = set()
    for f, (c, t) in seen.items():
        mean = (c + t) / sum(n)
        z = (t / n[1] - c / n[0]) / np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]) + 1e-12)
        if t >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z:
            want.add(f)
    assert want <= set(model.vocabulary)
    assert all(model.weights[model.vocabulary[f]] == 0 for f in set(model.vocabulary) - want)


def test_grades_are_thirds_of_held_out_scores():
    rng = np.random.default_rng(2)
    at = [tuple(sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist())) for _ in range(300)]
    toxic = np.array([3 in x or 4 in x for x in at])
    rows = toxicity.Rows(at, toxic, np.ones(300), rng.integers(0, 2, 300))
    every = np.ones(6, bool)
    grade = toxicity.grades_of(rows, [every, every])
    assert (grade[~toxic] == 0).all() and set(grade[toxic]) == {1, 2, 3}
    score = rows.held_out(toxic.astype(int), [every, every], 2)
    for g in (1, 2):
        assert score[grade == g].max() < score[grade == g + 1].min()
    w, t = rows.fitted(grade, every, 4)
    assert 0 < toxicity.cut_of(rows, grade, [every, every], t) < 3


def test_ids_with_both_labels_or_several_texts(spark):
    docs, labels = corpus(400)
    more = labels + [(0, 1, 0), (0, 1, 1), (1, 1, None)] + labels[:50]
    again = docs + [(2, "another text of a labelled id"), (2, "and one more")]
    a = toxicity.train(spark.createDataFrame(again, DOCS).repartition(3), spark.createDataFrame(more, LABELS))
    b = toxicity.train(spark.createDataFrame(again, DOCS).repartition(5), spark.createDataFrame([x for x in more if x[0] != 0], LABELS))
    assert a.vocabulary == b.vocabulary and np.allclose(a.weights, b.weights) and a.cut == pytest.approx(b.cut)
