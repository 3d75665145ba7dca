import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import quality
from tomeflow.llm.common import one_document, one_label

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def corpus(n=900, seed=0):
    """Prose and junk of three kinds; one source has most of the junk."""
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        t = say(rng.randint(30, 150)) + "."
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(w + "%%%" for w in t.split()), "spam " * 200])
        docs.append((i, t, "en", "farm" if not good and rng.random() < 0.9 else f"s{rng.randrange(5)}", len(t)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = quality.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:500], LABELS)).collect()
    truth = {i: q == 1 for i, q, _ in labels}
    unseen = [r for r in rows if r.doc_id >= 500]
    assert np.mean([r.keep == truth[r.doc_id] for r in unseen]) >= 0.97
    good = [r.keep for r in unseen if truth[r.doc_id]]
    assert np.mean(good) >= 0.98


def test_views_teach_each_other():
    """With labels that show only one of two signs of junk, the pool ties the page view's sign to it."""
    rng = np.random.default_rng(0)

    def rows(n, bad):
        t = rng.normal(size=(n, quality.TEXT_FEATURES)) + np.where(bad[:, None], 3.0, 0.0)
        p = np.stack([np.where(bad, 200, rng.integers(0, 50, n)), np.zeros(n), rng.normal(size=n)], axis=1).astype(float)
        return t, p

    bad = rng.random(3000) < 0.3
    t, p = rows(3000, bad)
    few = np.arange(60)
    p[few, 0] = 7  # the labelled documents all have one source
    alone = quality.co_train(t[few], p[few], (~bad[few]).astype(float), quality.Held(t[:0], p[:0]), 0)
    both = quality.co_train(t[few], p[few], (~bad[few]).astype(float), quality.Held(t[60:], p[60:]), 5)
    page = lambda m: quality.log_odds(m.page(p[60:, 2:3], p[60:, :2].astype(int)), m.page_w)
    right = lambda z: np.mean((z > 0) == ~bad[60:])
    assert right(page(both)) > 0.95 > right(page(alone))


def test_scores_are_calibrated(spark):
    docs, labels = corpus(1500, seed=3)
    rng = random.Random(1)
    noisy = [(i, q if rng.random() < 0.9 else 1 - q, 0) for i, q, _ in labels]
    rows = quality.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(noisy, LABELS)).collect()
    said = dict((i, q) for i, q, _ in noisy)
    assert abs(np.mean([r.score for r in rows]) - np.mean(list(said.values()))) < 0.08


def test_odd_rows(spark):
    docs, labels = corpus(200)
    docs += [(900, None, None, None, None), (901, "", "en", "", 0), (None, "x", "en", "s", 1), (0, *docs[0][1:]), (902, "word " * 60_000, "en", "s", -5)]
    labels += [(None, 1, 1), (3, None, 1), (999, 0, 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("ID", F.lit(None).cast("int")).withColumn("y", F.lit(5))
    rows = quality.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and (r.keep == (r.score >= 0.5) or abs(r.score - 0.5) < 1e-5) for r in rows)


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1, 0)], 0.999), ([(1, 0, 0)], 0.001)])
def test_labels_of_one_class_or_none(spark, labels, want):
    df = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", "de", "t", 1)], DOCS)
    rows = quality.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert [r.score for r in rows] == [pytest.approx(want, abs=1e-3)] * 2
    assert quality.score(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_features():
    f = quality.text_features("AB ab 12!\nAB ab 12!\né|")
    assert f.shape == (quality.TEXT_FEATURES,) and f[1] > 0 and f[14] == pytest.approx(1 / 3)
    assert not quality.text_features(None).any()


def brute_features(text):
    """The text view's numbers, by plain loops."""
    if not text:
        return [0.0] * quality.TEXT_FEATURES
    raw = text.encode()
    kinds = [lambda c: chr(c) in "#$%&*@^~\\", lambda c: c == 33, lambda c: c == 124, lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c >= 128, lambda c: c in (9, 10, 13, 32), lambda c: chr(c) in ".,;:?"]
    shares = [sum(map(k, raw)) / len(raw) for k in kinds]
    w = raw.split()
    n = max(1, len(w))
    lines = raw.split(b"\n")
    top = max((w.count(x) for x in set(w)), default=0) / n
    again = sum(w[i] == w[i + 1] for i in range(len(w) - 1)) / n
    return [*shares, again, np.log(1 + len(w)), sum(len(x) for x in w) / n, top if n > 20 else 0.0, len(set(w)) / n if n > 20 else 1.0, 1 - len(set(lines)) / len(lines)]


def test_scores_of_a_whole_table_by_brute_force(spark):
    """Each document's additive model by its bins, both calibrations and their weights, one after another."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, labels, m).collect()}

    def bin_of(edges, x):
        return sum(x >= e for e in edges)

    for r in docs.collect():
        if len(r.text or "") > 3_000:
            continue
        z = m.text_w[-1] + sum(m.text_w[m.text.offsets[i] + bin_of(m.text.edges[i], x)] for i, x in enumerate(brute_features(r.text)))
        source, lang, size = quality.page_features(r.source, r.lang, r.n_chars)
        y = m.page_w[-1] + m.page_w[bin_of(m.page.edges[0], size)] + m.page_w[m.page.offsets[1] + source] + m.page_w[m.page.offsets[2] + lang]
        views = [m.platt[0][0] * z + m.platt[0][1], m.platt[1][0] * y + m.platt[1][1]]
        sure = lambda x: 1 / (1 + np.exp(-x))
        want = [sure(views[0]), sure(views[1]), sure(m.mix[0] * views[0] + m.mix[1] * views[1] + m.mix[2])]
        assert np.allclose([got[r.doc_id].p_text, got[r.doc_id].p_page, got[r.doc_id].score], want, atol=1e-5)


def test_ids_with_both_labels_or_several_texts(spark):
    docs, labels = corpus(300)
    more = labels + [(0, 1, 0), (0, 0, 0), (1, None, 0)] + labels[:50]
    again = docs + [(2, "another text of a labelled id", "en", "s1", 9)]
    a = quality.train(spark.createDataFrame(again, DOCS).repartition(3), spark.createDataFrame(more, LABELS))
    b = quality.train(spark.createDataFrame(again, DOCS).repartition(5), spark.createDataFrame([x for x in more if x[0] != 0], LABELS))
    assert np.allclose(a.text_w, b.text_w, atol=0.2) and len(a.page_w) == len(b.page_w)


def test_samples_without_a_bound(spark):
    """All rows, as a bound above the tables' sizes takes, and no broadcast that was asked for."""
    docs, labels = corpus(200)
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    a, b = quality.train(docs, labels, None), quality.train(docs, labels, 10_000)
    assert np.allclose(a.text_w, b.text_w) and np.allclose(a.page_w, b.page_w) and np.allclose(a.mix, b.mix)
    sample, parts = one_label(labels, "quality", "y"), docs.select(F.col("doc_id").alias("id"), "text")
    hints = [one_document(parts, sample, bounded)._jdf.queryExecution().analyzed().toString().count("broadcast") for bounded in (True, False)]
    assert hints == [1, 0]


def test_a_table_teaches_like_rows_in_memory(spark):
    rng = np.random.default_rng(1)
    bad = rng.random(900) < 0.4
    t = rng.normal(size=(900, quality.TEXT_FEATURES)) + np.where(bad[:, None], 2.5, 0.0)
    p = np.stack([np.where(bad, rng.integers(0, 20, 900), rng.integers(20, 60, 900)), np.zeros(900), rng.normal(size=900)], axis=1).astype(float)
    y = (~bad).astype(float)
    rows = spark.createDataFrame([(a, b, 1) for a, b in zip(t.tolist(), p.tolist(), strict=True)], "t array<double>, p array<double>, n long").repartition(3)
    table = quality.Table(rows.where("p[2] < 99").select("t", "p"), rows)
    held = quality.Held(t, p)
    ours, theirs = table.edges(t[:0], p[:0]), held.edges(t[:0], p[:0])
    for i, (a, b) in enumerate(zip(ours, theirs, strict=True)):
        x = t[:, i] if i < quality.TEXT_FEATURES else p[:, 2]
        assert len(a) == len(b) and np.abs(np.searchsorted(np.sort(x), a) - np.searchsorted(np.sort(x), b)).max() <= 4
    binner = quality.Binner(theirs[:-1])
    w = quality.logistic(binner(t[:200]), y[:200], np.ones(200), binner)
    for _ in range(3):  # what was given once isn't given again
        a, b = table.surest(0, binner, w, 30, 40), held.surest(0, binner, w, 30, 40)
        assert sorted(map(tuple, np.round(a[0], 9))) == sorted(map(tuple, np.round(b[0], 9))) and a[2].tolist() == b[2].tolist()


def test_repeated_labelled_rows_weigh_as_often_as_they_are(spark):
    docs, labels = corpus(200)
    twice = docs + [(1_000 + i, *rest) for i, *rest in docs]
    both = labels + [(1_000 + i, q, x) for i, q, x in labels]
    frames = [spark.createDataFrame(d, DOCS) for d in (docs, twice)], [spark.createDataFrame(x, LABELS) for x in (labels, both)]
    a, b = quality.train(frames[0][0], frames[1][0]), quality.train(frames[0][1], frames[1][1])
    assert [x.tolist() for x in a.text.edges] == [x.tolist() for x in b.text.edges]
    assert np.sign(a.platt[:, 0]).tolist() == np.sign(b.platt[:, 0]).tolist() and np.abs(b.text_w).max() >= np.abs(a.text_w).max()
