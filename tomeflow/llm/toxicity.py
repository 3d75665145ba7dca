"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's severity is a grade from 0 to `GRADES` - 1. The model is P(grade > k) = sigmoid(w.x - t_k) with one weight
vector for all ordered thresholds t_1 < t_2 < ..., so expected severity is the sum of these probabilities. x marks which
features of a vocabulary the text holds, however often and however long it is: one slur in a long text is still one.
Features are words and, for inflected and compounded forms, their first bytes.

The labels say toxic or not. The severity of toxic texts comes from the features themselves, on held-out rows: the rows are dealt to two
halves, a two-grade model of each half scores the other's toxic texts, and their grade is 1, 2 or 3 by the third of
these scores that they are in. The expected severity from which a document counts as toxic is found on held-out rows too: the
value that parts the two classes with the fewest errors, when ordinal models of each half, and of the features that this half
shows, score the other.

Fitting uses about `SAMPLE_ROWS` labelled rows, chosen by a hash of the id (None: all, whose vocabulary columns the driver must hold;
they aren't broadcast then). Of their features those stay that stand in
`LEAST_TEXTS` toxic texts and are more common there by `LEAST_Z` standard errors, `VOCABULARY` at most by that measure; None keeps all
that the other two let pass. Every document is scored.

Defined cases: a null or empty text has no word and gets the base severity; very long texts count whole; labels with a null id or
label, or without a document, are ignored, and so are those of an id that has both; a label that is repeated counts once; of
documents that share a labelled id one, chosen by the texts' hashes, is fitted; features with equal measures are taken by their
bytes; without labels of both kinds nothing is toxic; repeated rows give repeated rows, with equal severities; an empty table gives an empty one;
extra columns are ignored (or kept, by `with_severity`), clashing names too.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name, hash_sample, one_document, one_label, with_column, written

SAMPLE_ROWS = 20_000
VOCABULARY = 2_048
GRADES = 4
#: Where held-out rows can't tell.
CUT = 0.5
#: A feature is in the vocabulary only if so many toxic texts have it, and by so many standard errors more often than clean ones.
LEAST_TEXTS, LEAST_Z = 5, 5.0
#: Lengths, in bytes, of the beginnings of words that are features too.
PREFIXES = (3, 4, 5, 6, 7)
#: Two words or more that begin with the same so many bytes are one more feature: families whose members are rare.
FAMILY = 6
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """Runs of letters, lower-cased."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


def features(found: set[bytes]) -> set[bytes]:
    families = Counter([w[:FAMILY] for w in found if len(w) > FAMILY])
    return found.union(*({w[:k] + b"*" for w in found if len(w) > k} for k in PREFIXES), {p + b"**" for p, n in families.items() if n > 1})


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def severities(self, texts: list[str | None]) -> np.ndarray:
        find, w = self.vocabulary, self.weights
        z = np.array([sum(w[find[x]] for x in features(words(t)) & find.keys()) for t in texts], float)
        return _above(z, self.thresholds).sum(axis=1)


def _above(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_words: int, weight: np.ndarray | None = None, grades: int = GRADES, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the (row, column) pairs that are set, and the rows' weights. Thresholds are a first one and
    positive gaps."""
    n = len(grade)
    share = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    w, first, gaps = np.zeros(n_words), np.zeros(1), np.zeros(grades - 2)
    params = [w, first, gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        t = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, w[cols], n)
        c = np.hstack([np.ones((n, 1)), _above(z, t), np.zeros((n, 1))])  # P(grade >= k)
        p = np.maximum(c[np.arange(n), grade] - c[np.arange(n), grade + 1], 1e-9)
        slope = c * (1 - c)  # of each sigmoid; none at both ends
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        dz = -(up - down) * share
        dt = np.zeros(grades + 1)
        np.add.at(dt, grade, up * share)
        np.add.at(dt, grade + 1, -down * share)
        dt = dt[1:grades]
        grads = [np.bincount(cols, dz[rows], n_words) + decay * w, np.array([dt.sum()]), np.exp(gaps) * np.cumsum(dt[::-1])[::-1][1:]]
        for i, (x, g) in enumerate(zip(params, grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w, first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


@dataclass
class Rows:
    """Different rows of features: the columns that are set, whether toxic, how many texts are so, and which half they are in."""

    at: list[tuple[int, ...]]
    toxic: np.ndarray
    n: np.ndarray
    half: np.ndarray

    def pick(self, half: int) -> Rows:
        some = self.half == half
        return Rows([self.at[i] for i in np.flatnonzero(some)], self.toxic[some], self.n[some], self.half[some])

    def fitted(self, grade: np.ndarray, allowed: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights, zero for columns that aren't allowed, and thresholds."""
        at = [[c for c in x if allowed[c]] for x in self.at]
        rows, cols = np.repeat(np.arange(len(at)), [len(x) for x in at]), np.array([c for x in at for c in x], np.int64)
        return fit(rows, cols, grade, len(allowed), self.n, grades)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.array([w[list(x)].sum() for x in self.at], float)

    def held_out(self, grade: np.ndarray, allowed: list[np.ndarray], grades: int) -> np.ndarray:
        """Each row's log-odds of any toxicity by the model of the other half, and of the features that the other half shows; nan
        where that has one class only."""
        odds = np.full(len(self.at), np.nan)
        for half in (0, 1):
            own, others = self.pick(half), self.half != half
            if own.toxic.any() and not own.toxic.all():
                w, t = own.fitted(grade[~others], allowed[half], grades)
                odds[others] = self.pick(1 - half).scores(w) - t[0]
        return odds


def grades_of(rows: Rows, allowed: list[np.ndarray]) -> np.ndarray:
    """0 for clean rows; for toxic ones 1 to GRADES - 1 by the part of all held-out scores of toxic texts that theirs is in."""
    score = np.nan_to_num(rows.held_out(rows.toxic.astype(int), allowed, 2))
    grade = rows.toxic.astype(int)
    order = np.argsort(score[rows.toxic], kind="stable")
    sorted_, many = score[rows.toxic][order], np.cumsum(rows.n[rows.toxic][order])
    for k in range(1, GRADES - 1):
        if len(many):
            edge = sorted_[np.searchsorted(many, many[-1] * k / (GRADES - 1))]
            grade += rows.toxic & (score > edge)
    return grade


def cut_of(rows: Rows, grade: np.ndarray, allowed: list[np.ndarray], thresholds: np.ndarray) -> float:
    """The severity that parts the classes on held-out rows with the fewest errors, in the middle of the widest gap that does; gaps are
    those of the log-odds of any toxicity, in which models of different rows agree."""
    odds = rows.held_out(grade, allowed, GRADES)
    known = ~np.isnan(odds)
    toxic, n, odds = rows.toxic[known], rows.n[known], odds[known]
    if not toxic.any() or toxic.all():
        return CUT
    order = np.argsort(odds, kind="stable")
    odds, toxic, n = odds[order], toxic[order], n[order]
    missed, spared = np.cumsum(n * toxic), np.cumsum(n * ~toxic)
    wrong = np.round(missed + spared[-1] - spared, 6)  # where all up to here count as clean
    gaps = np.append(np.diff(odds), 0.0)
    wrong[gaps <= 1e-9] = np.inf
    if not np.isfinite(wrong).any():
        return CUT
    best = np.flatnonzero(wrong == wrong.min())
    i = best[np.argmax(gaps[best])]
    middle = (odds[i] + odds[i + 1]) / 2
    return float(_above(np.array([middle + thresholds[0]]), thresholds).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = SAMPLE_ROWS, vocabulary_size: int | None = VOCABULARY, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z) -> Model:
    sample = hash_sample(one_label(labels, "toxic", "toxic"), ["id"], sample_rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(words(t)) for t in b.column(1).to_pylist()]
        half = [xxhash.xxh64_intdigest(b" ".join(w)) & 1 for w in found]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(half, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["toxic", "half", "words"])

    texts = one_document(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sample, sample_rows is not None).select("toxic", "text")
    rows = written(arrow_map(texts, run, "toxic long, half long, words array<binary>"), "toxic-words")
    kinds = {(int(r.toxic), int(r.half)): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    count = lambda toxic, *halves: sum(kinds.get((toxic, h), 0) for h in halves)
    if not count(1, 0, 1) or not count(0, 0, 1):
        return Model({}, np.zeros(0), np.full(GRADES - 1, 40.0), CUT)

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(features(set(ws))) for ws in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["toxic", "half", "words"])

    each = arrow_map(rows, spread, "toxic long, half long, words array<binary>").select("toxic", "half", F.explode("words").alias("word"))
    of = lambda toxic, half: F.count_if((F.col("toxic") == toxic) & (F.col("half") == half)).alias(f"n{toxic}{half}")
    counts = each.groupBy("word").agg(*(of(t, h) for t in (0, 1) for h in (0, 1)))
    measures = []
    for halves in ((0, 1), (0,), (1,)):  # of all rows, and of each half
        n = [max(1, count(k, *halves)) for k in (0, 1)]
        c, t = (sum((F.col(f"n{k}{h}") for h in halves), F.lit(0)) for k in (0, 1))
        mean = (t + c) / sum(n)
        z = F.round((t / n[1] - c / n[0]) / F.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]) + 1e-12), 9)
        measures.append(F.when((t >= least_texts) & (z >= least_z), z))
    rated = written(counts.select("word", *(m.alias(f"z{i}") for i, m in enumerate(measures))).where("z0 IS NOT NULL OR z1 IS NOT NULL OR z2 IS NOT NULL"), "toxic-rated")
    # The words of a bounded number of texts, whatever the table's size.
    chosen = []
    for i in range(3):
        some = rated.where(f"z{i} IS NOT NULL").orderBy(F.desc(f"z{i}"), "word").select("word")
        chosen.append([bytes(r.word) for r in (some if vocabulary_size is None else some.limit(vocabulary_size)).collect()])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for some in chosen for w in some))}
    allowed = [np.isin(np.arange(len(vocabulary)), [vocabulary[w] for w in some]) for some in chosen]

    def pick(b: pa.RecordBatch) -> pa.RecordBatch:
        at = [sorted(vocabulary[f] for f in features(set(ws)) & vocabulary.keys()) for ws in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32()))], ["toxic", "half", "at"])

    picked = arrow_map(rows, pick, "toxic long, half long, at array<int>").groupBy("toxic", "half", "at").agg(F.count("*").alias("n"))
    data = sorted((int(r.toxic), int(r.half), tuple(r["at"]), int(r.n)) for r in picked.collect())
    found = Rows([row[2] for row in data], *(np.array([row[i] for row in data], kind) for i, kind in ((0, bool), (3, float), (1, int))))
    grade = grades_of(found, allowed[1:])
    w, t = found.fitted(grade, allowed[0], GRADES)
    return Model(vocabulary, w, t, cut_of(found, grade, allowed[1:], t))


def with_severity(docs: DataFrame, model: Model, text_col: str = "text", name: str = "severity") -> tuple[DataFrame, str]:
    name = free_name(docs, name)
    return with_column(docs, [text_col], lambda t: pa.array(np.round(model.severities(t.to_pylist()), 6), pa.float64()), name, "double"), name


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), toxic."""
    model = train(docs, labels)
    out, name = with_severity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", F.col(name).alias("severity"), (F.col(name) >= model.cut).alias("toxic"))
