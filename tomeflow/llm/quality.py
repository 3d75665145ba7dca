"""Document quality by co-training two views.

The text view sees `TEXT_FEATURES` numbers of the content (shares of kinds of characters, lengths, repetition); the page
view sees the metadata only: source, language and length. Each is an additive logistic model over quantile bins (or hash
buckets) of its features. From the labelled sample both views are fitted; then, for `ROUNDS` rounds, each labels the
documents of all unlabelled ones of which it is surest, in the classes' known proportion, and they become training rows of
the other. Each view's log-odds are then calibrated on a fifth of the labels, kept out of the fit (Platt scaling), and
both are combined by weights that are fitted on the same fifth. Every document is scored.

Fitting uses about `SAMPLE_ROWS` labelled rows, chosen by a hash; what reaches the driver of each is a fixed number of numbers, and
rows with the same numbers are one with a weight. A bound of None takes all rows, for labels that the driver can hold as numbers;
nothing is broadcast then. The unlabelled documents have no bound: their numbers are a table in the shared folder, bins come from
histograms over all of it, and of each round only the surest `PER_ROUND` rows reach the driver. There, documents with the same
numbers are one row, so that a large group of copies is one pseudo-label and not all of a round.

Defined cases: a null or empty text has zero features; very long texts count whole; a null source, language or length is a bucket of
its own; labels with a null id or label, or without a document, are ignored, and so are those of an id that has both; of documents
that share a labelled id one, chosen by their hashes, is fitted; equal scores in a round are taken by the rows' order, which
their numbers give; without labels of both classes every document scores the share of good labels, or a half without any; repeated
rows give repeated rows, with equal scores; an empty table gives an empty one; extra columns, with whatever names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, hash_sample, one_document, one_label, written

SAMPLE_ROWS = 20_000
#: Cells of the histograms from which a table's bins are made.
CELLS = 4_096
ROUNDS = 5
#: Pseudo-labels that a view gives in a round, and the least probability of each.
PER_ROUND, SURE = 500, 0.95
#: Bins end at these quantiles; junk is rare, so they are narrow at both ends.
QUANTILES = np.array([0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99])
SOURCE_BUCKETS, LANG_BUCKETS = 256, 32
KEEP = 0.5
TEXT_FEATURES = 15

_CLASSES = np.zeros((256, 9), np.float64)  # symbols, !, |, upper, lower, digits, beyond ASCII, white space, stops
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c] = [_ch in "#$%&*@^~\\", _ch == "!", _ch == "|", 65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, _c >= 128, _ch in " \t\n\r", _ch in ".,;:?"]


def text_features(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(TEXT_FEATURES)
    raw = text.encode("utf-8", "replace")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    w = raw.split()
    n = max(1, len(w))
    lines = raw.split(b"\n")
    top = Counter(w).most_common(1)[0][1] / n if w else 0.0
    again = sum(map(eq, w, w[1:])) / n
    return np.array([*shares, again, np.log1p(len(w)), sum(map(len, w)) / n, top if n > 20 else 0.0, len(set(w)) / n if n > 20 else 1.0, 1 - len(set(lines)) / len(lines)])


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, float]:
    bucket = lambda x, n: n if x is None else xxhash.xxh64_intdigest(x.encode()) % n
    return bucket(source, SOURCE_BUCKETS), bucket(lang, LANG_BUCKETS), -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))


class Binner:
    """One-hot columns: quantile bins of numbers, and given buckets."""

    def __init__(self, edges: list[np.ndarray], buckets: tuple[int, ...] = ()):
        self.edges, self.buckets = edges, buckets
        sizes = [len(QUANTILES) + 1] * len(self.edges) + [b + 1 for b in buckets]
        self.offsets = np.cumsum([0, *sizes])

    @property
    def width(self) -> int:
        return int(self.offsets[-1])

    def __call__(self, numbers: np.ndarray, cats: np.ndarray | None = None) -> np.ndarray:
        """Column indices, one for each feature."""
        cols = [np.searchsorted(e, numbers[:, i], side="right") + self.offsets[i] for i, e in enumerate(self.edges)]
        k = len(self.edges)
        if cats is not None:
            cols += [cats[:, i] + self.offsets[k + i] for i in range(len(self.buckets))]
        return np.stack(cols, axis=1).astype(np.int64) if cols else np.zeros((len(numbers), 0), np.int64)


def logistic(cols: np.ndarray, y: np.ndarray, n: np.ndarray, binner: Binner, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton's method for one-hot columns and a bias (last weight); n: how often each row counts. The penalty is on the steps from a number's bin to the
    next, so that a rare bin leans on its neighbours."""
    width, numbers = binner.width, [slice(a, z) for a, z in zip(binner.offsets, binner.offsets[1:], strict=False)][: len(binner.edges)]
    w = np.zeros(width + 1)
    x = np.zeros((len(y), width + 1))
    np.put_along_axis(x, cols, 1.0, axis=1)
    for s in numbers:
        x[:, s] = np.cumsum(x[:, s][:, ::-1], axis=1)[:, ::-1]
    x[:, -1] = 1.0
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = n * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    for s in numbers:
        w[s] = np.cumsum(w[s])
    return w


def log_odds(cols: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[cols].sum(axis=1) + w[-1]


def dense_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = n * np.maximum(p * (1 - p), 1e-6)
        w += np.clip(np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w), -2, 2)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    text: Binner
    page: Binner
    text_w: np.ndarray
    page_w: np.ndarray
    platt: np.ndarray  # view x (slope, shift)
    mix: np.ndarray  # weights of both calibrated log-odds, and a shift

    def views(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of both views."""
        raw = np.stack([log_odds(self.text(t), self.text_w), log_odds(self.page(p[:, 2:3], p[:, :2].astype(np.int64)), self.page_w)], axis=1)
        return raw * self.platt[:, 0] + self.platt[:, 1]

    def score(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return sigmoid(self.views(t, p) @ self.mix[:2] + self.mix[2])


def _cut(binner: Binner, v: int, t: np.ndarray, p: np.ndarray) -> np.ndarray:
    return binner(p[:, 2:3], p[:, :2].astype(np.int64)) if v else binner(t)


class Held:
    """Unlabelled rows that are in memory."""

    def __init__(self, t: np.ndarray, p: np.ndarray):
        self.t, self.p, self.left = t, p, np.ones(len(t), bool)

    def edges(self, t: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        numbers = np.hstack([np.vstack([t, self.t]), np.vstack([p, self.p])[:, 2:3]])
        return [np.unique(np.quantile(x, QUANTILES)) if len(x) else np.zeros(0) for x in numbers.T]

    def surest(self, v: int, binner: Binner, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(t, p, label) of rows of which a view is surest, at most low bad and high good ones. They are taken out."""
        rows = np.flatnonzero(self.left)
        q = sigmoid(log_odds(_cut(binner, v, self.t[rows], self.p[rows]), w))
        order = np.argsort(q, kind="stable")
        bad, good = order[:low], order[::-1][:high]
        bad, good = rows[bad[q[bad] <= 1 - SURE]], rows[good[q[good] >= SURE]]
        new = np.concatenate([bad, good])
        self.left[new] = False
        return self.t[new], self.p[new], np.concatenate([np.zeros(len(bad)), np.ones(len(good))])


class Table:
    """Unlabelled rows (t, p) of a table of any size, each once; every(t, p, n) has the labelled ones too, for the bins."""

    def __init__(self, rows: DataFrame, every: DataFrame):
        self.rows, self.every, self.taken = rows, every, set()

    def edges(self, t: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        flat = self.every.select(F.concat("t", F.array(F.col("p")[2])).alias("x"), "n")
        one = lambda i: F.col("x")[i]
        ends = flat.agg(*(f(one(i)).alias(f"{k}{i}") for i in range(TEXT_FEATURES + 1) for k, f in (("a", F.min), ("z", F.max)))).first()
        if ends.a0 is None:
            return [np.zeros(0)] * (TEXT_FEATURES + 1)
        low, high = (np.array([ends[f"{k}{i}"] for i in range(TEXT_FEATURES + 1)]) for k in "az")
        width = np.where(high > low, (high - low) / CELLS, 1.0)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x, n = np.array(b.column(0).to_pylist()).reshape(-1, TEXT_FEATURES + 1), b.column(1).to_numpy()
            cell = np.clip((x - low) / width, 0, CELLS - 1).astype(np.int64) + CELLS * np.arange(TEXT_FEATURES + 1)
            total = np.bincount(cell.ravel(), np.repeat(n, TEXT_FEATURES + 1))
            known = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known].astype(np.int64))], ["cell", "n"])

        counts = np.zeros(CELLS * (TEXT_FEATURES + 1))
        for r in arrow_map(flat, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a fixed number of cells
            counts[r.cell] = r.n
        below = counts.reshape(-1, CELLS).cumsum(axis=1)
        at = [np.unique(np.searchsorted(x, QUANTILES * x[-1])) for x in below]
        # An edge is the end of the cell in which the quantile lies, so that values of one cell stay together.
        return [low[i] + width[i] * (np.minimum(k, CELLS - 1) + 1) for i, k in enumerate(at)]

    def surest(self, v: int, binner: Binner, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        taken = self.taken

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            t, p = np.array(b.column(0).to_pylist()).reshape(-1, TEXT_FEATURES), np.array(b.column(1).to_pylist()).reshape(-1, 3)
            q = sigmoid(log_odds(_cut(binner, v, t, p), w))
            keep = (q <= 1 - SURE) | (q >= SURE)
            keep[keep] = [(*map(tuple, x),) not in taken for x in zip(t[keep].tolist(), p[keep].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([*(c.filter(pa.array(keep)) for c in b.columns), pa.array(q[keep])], ["t", "p", "q"])

        sure = arrow_map(self.rows, run, "t array<double>, p array<double>, q double")
        bad = sure.where(F.col("q") <= 1 - SURE).orderBy("q", "t", "p").limit(low).collect() if low else []
        good = sure.where(F.col("q") >= SURE).orderBy(F.desc("q"), "t", "p").limit(high).collect() if high else []
        self.taken = taken | {(tuple(r.t), tuple(r.p)) for r in (*bad, *good)}
        t, p = np.array([r.t for r in (*bad, *good)]).reshape(-1, TEXT_FEATURES), np.array([r.p for r in (*bad, *good)]).reshape(-1, 3)
        return t, p, np.concatenate([np.zeros(len(bad)), np.ones(len(good))])


def co_train(t: np.ndarray, p: np.ndarray, y: np.ndarray, pool: Held | Table, rounds: int = ROUNDS, n: np.ndarray | None = None) -> Model:
    """y: 1 good, 0 bad; n: how often each row counts."""
    n = np.ones(len(y)) if n is None else n
    edges = pool.edges(t, p)
    binners = Binner(edges[:-1]), Binner(edges[-1:], (SOURCE_BUCKETS, LANG_BUCKETS))
    if not len(y) or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(*binners, *(np.zeros(b.width + 1) for b in binners), np.ones((2, 2)) * [1, 0], np.array([0, 0, np.log(prior / (1 - prior))]))
    held = np.arange(len(y)) % 5 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    rows: list[list[tuple[np.ndarray, ...]]] = [[(t[~held], p[~held], y[~held], n[~held])] for _ in (0, 1)]
    good = np.average(y[~held], weights=n[~held])

    def fitted(v: int) -> np.ndarray:
        t_, p_, y_, n_ = (np.concatenate(x) for x in zip(*rows[v], strict=True))
        return logistic(_cut(binners[v], v, t_, p_), y_, n_, binners[v])

    for _ in range(rounds):
        for v in (0, 1):
            new = pool.surest(v, binners[v], fitted(v), round(PER_ROUND * (1 - good)), round(PER_ROUND * good))
            rows[1 - v].append((*new, np.ones(len(new[2]))))
    ws = [fitted(0), fitted(1)]
    test = held if held.any() else np.ones(len(y), bool)
    raw = [log_odds(_cut(binners[v], v, t[test], p[test]), ws[v]) for v in (0, 1)]
    platt = np.array([dense_logistic(r[:, None], y[test], n[test]) for r in raw])
    model = Model(*binners, *ws, platt, np.array([1.0, 1.0, 0.0]))
    model.mix = dense_logistic(model.views(t[test], p[test]), y[test], n[test])
    return model


_ROW = "y long, t array<double>, p array<double>"


def _numbers(df: DataFrame) -> DataFrame:
    """y, t, p from y, text, source, lang, n_chars."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = [text_features(x).tolist() for x in b.column(1).to_pylist()]
        p = [list(map(float, page_features(*x))) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.list_(pa.float64())), pa.array(p, pa.list_(pa.float64()))], ["y", "t", "p"])

    return arrow_map(df, run, _ROW)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int | None = SAMPLE_ROWS) -> Model:
    sample = hash_sample(one_label(labels, "quality", "y"), ["id"], sample_rows)
    parts = docs.select(F.col("doc_id").alias("id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    order = ["y", "text", "source", "lang", "n_chars"]
    count = lambda rows: rows.groupBy("y", "t", "p").agg(F.count("*").alias("n"))
    labelled = sorted((tuple(r.t), tuple(r.p), r.y, r.n) for r in count(_numbers(one_document(parts, sample, sample_rows is not None).select(order))).collect())
    known = sample.select("id") if sample_rows is None else F.broadcast(sample.select("id"))
    # y of all rows here: whether the id is one of the sample.
    marked = parts.join(known.withColumn("y", F.lit(1).cast("long")), "id", "left").fillna(0, "y")
    every = written(count(_numbers(marked.select(order))), "quality-numbers")
    # Order by a hash of the row, so that the held-out fifth is like the rest.
    labelled.sort(key=lambda r: xxhash.xxh64_intdigest(repr(r[:3])))
    t, p = np.array([r[0] for r in labelled]).reshape(-1, TEXT_FEATURES), np.array([r[1] for r in labelled]).reshape(-1, 3)
    y, n = (np.array([r[k] for r in labelled], float) for k in (2, 3))
    model = co_train(t, p, y, Table(every.where("y = 0").select("t", "p"), every), n=n)
    discard(every)
    return model


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, p_text, p_page (calibrated views), score (probability of good quality), keep."""
    model = model or train(docs, labels)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        t = np.array([text_features(x) for x in b.column(1).to_pylist()]).reshape(n, TEXT_FEATURES)
        p = np.array([page_features(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)], float).reshape(n, 3)
        views, s = sigmoid(model.views(t, p)), model.score(t, p)
        out = [np.round(x, 6) for x in (views[:, 0], views[:, 1], s)]
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out), pa.array(s >= KEEP)], ["doc_id", "p_text", "p_page", "score", "keep"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return arrow_map(src, run, "doc_id long, p_text double, p_page double, score double, keep boolean")
