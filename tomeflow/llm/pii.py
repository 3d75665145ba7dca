"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are the leftmost non-overlapping matches of one pattern for each kind, without those that fail the kind's test.
The field adds spans, mostly repeats in another notation that no pattern covers. Its nodes are the white-space tokens that
hold a digit or an @ (all others are surely not of these kinds); labels are none, email, ip, card, phone. Node potentials come
from the token's shape and its neighbours' shapes, chain potentials link tokens that stand side by side, and skip potentials
link all tokens of a document that have something in common: their digits, their last seven digits, an address's local part, the
same letters, or, for a run of tokens, the digits of a base span. Each such group is a star around a node of its own, so that a
label reaches every member in two steps, however many there are and however far away. Tokens of base spans have their
label for certain. Loopy sum-product message passing runs until a document's messages change by less than `TOLERANCE` (or
`ROUNDS` rounds, where they don't settle); runs of tokens with one label at `LEAST` or more become spans where no base span is.

Weights are fitted by pseudo-likelihood. What the patterns cover is evidence, not an example; the examples are all other
tokens (none) and, after each document's text, a copy of each base span without the cues of its pattern - no plus sign,
brackets, dots or check of its digits - with that span's label, and beside it one with other digits, labelled none. So a shape
alone decides nothing, and the repeat does. The statistics are counts of (shapes, labels) over all documents with
digits; there are less than ten million different ones, whatever the table's size, and thousands as a rule.

Defined cases: null text is empty; without any digit or @ the field has no node; very long texts are searched whole, in time
in proportion to their length; offsets are code points; a null id stays null; repeated rows give repeated rows, with equal spans; spans
that begin at one place are listed by their end; extra columns are ignored (or kept, by `mask`), clashing names too; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name, with_column

KINDS = ("email", "ip", "card", "phone")
NONE = 0
K = len(KINDS) + 1
ROUNDS = 500
TOLERANCE = 1e-6
LEAST = 0.9
#: The potential of a base span's label over each other one.
CERTAIN = 30.0
#: Digits by which local and international forms of a phone number are alike, and of the longest phone and card number.
TAIL, LONGEST_PHONE, LONGEST = 7, 15, 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match that fails at a run's first digit fails at all others
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Looks left and right of each @: linear in the text, however long its words are."""
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(t, at + 1)):
            last = m.end()
            out.append((s, last))
        at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[list[tuple[int, int]]]:
    """For each kind its spans (code points, end exclusive)."""
    if not _ANY.search(t):
        return [[], [], [], []]
    ips = [m.span() for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    cards, phones = [], []
    for m in _CARD.finditer(t):
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            cards.append(m.span())
    if "+" in t:
        phones = [m.span() for m in _PHONE.finditer(t) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return [emails(t) if "@" in t else [], ips, cards, phones]


# ---- the field --------------------------------------------------------------------------------------------------

_EDGES = "\"'`.,;:!?#$%&*|<>[]{}=~^/\\_…»«“”‘’"
_SHAPES = [
    re.compile(p)
    for p in (
        r"[^@\s]+@[^@\s]+\.[^@\s]+",
        r".*@.*",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
        r"[0-9]+(?:\.[0-9]+)+",
        r"\+[0-9]+",
        r"\+[0-9().-]+",
        r"\([0-9]+\)",
        r"[0-9]{1,4}(?:[.-][0-9]{1,4})+",
        r"[0-9]{16,19}",
        r"[0-9]{8,15}",
        r"[0-9]{5,7}",
        r"[0-9]{4}",
        r"[0-9]{1,3}",
        r"[0-9-]+",
        r"[0-9a-fA-F-]+",
    )
]
SHAPES = len(_SHAPES) + 1
NO_SHAPE = SHAPES


def _shape(core: str) -> int:
    return next((i for i, p in enumerate(_SHAPES) if p.fullmatch(core)), SHAPES - 1)


@dataclass
class Graph:
    """Nodes of one document: core spans, shapes of token and neighbours, labels of base spans (else none), edges of the chain,
    and of the stars: (star, member)."""

    spans: list[tuple[int, int]]
    shapes: np.ndarray  # n x 3: own, before, after
    known: np.ndarray
    chain: list[tuple[int, int]]
    stars: int
    skip: list[tuple[int, int]]


def graph(t: str, base: list[list[tuple[int, int]]] | None = None) -> Graph | None:
    if not _ANY.search(t):
        return None
    base = base_spans(t) if base is None else base
    spans, own, chain, numbers, names = [], [], [], [], []
    before = None
    for i, m in enumerate(_TOKEN.finditer(t)):
        token = m.group()
        core = token.strip(_EDGES) or token
        start = m.start() + token.find(core)
        spans.append((start, start + len(core)))
        own.append(_shape(core))
        if before is not None and t[before : m.start()].isspace():
            chain.append((i - 1, i))
        before = m.end()
        numbers.append("" if "@" in core else "".join(_DIGITS.findall(core)))
        names.append(core.lower().rpartition("@")[0] + "@" if "@" in core else core.lower())
    known = _labels(spans, base)
    shapes = np.full((len(own), 3), NO_SHAPE, np.int64)
    shapes[:, 0] = own
    for a, b in chain:
        shapes[b, 1], shapes[a, 2] = own[a], own[b]
    stars = _groups(t, base, spans, chain, numbers, names)
    return Graph(spans, shapes, known, chain, len(stars), [(k, i) for k, members in enumerate(stars) for i in members])


def _groups(t: str, base: list[list[tuple[int, int]]], spans: list[tuple[int, int]], chain: list[tuple[int, int]], numbers: list[str], names: list[str]) -> list[list[int]]:
    """Tokens that have something in common; groups of two or more."""
    groups: dict[tuple[str, str], dict[int, None]] = {}
    forms: dict[str, set[str]] = {}  # of a tail, the numbers that end so

    def put(kind: str, key: str, members: range, whole: str = "") -> None:
        groups.setdefault((kind, key), {}).update(dict.fromkeys(members))
        if kind == "tail":
            forms.setdefault(key, set()).add(whole)

    whole, tails = set(), set()
    for kind in range(1, len(KINDS)):
        at = 0
        for a, z in base[kind]:
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            to = at
            while to < len(spans) and spans[to][0] < z:
                to += 1
            d = "".join(_DIGITS.findall(t[a:z]))
            whole.add(d)
            put("number", d, range(at, to))
            if KINDS[kind] == "phone":
                tails.add(d[-TAIL:])
                put("tail", d[-TAIL:], range(at, to), d)
    for i, (d, name) in enumerate(zip(numbers, names, strict=True)):
        put(*(("number", d) if len(d) >= 4 else ("name", name)), range(i, i + 1))
        if TAIL <= len(d) <= LONGEST_PHONE:
            put("tail", d[-TAIL:], range(i, i + 1), d)
    beside = {b for _, b in chain}
    for i in range(len(spans)) if whole else ():  # runs of tokens that are a base span's digits together
        d, j = numbers[i], i + 1
        while d and j in beside and numbers[j] and len(d) + len(numbers[j]) <= LONGEST:
            d, j = d + numbers[j], j + 1
            if d in whole:
                put("number", d, range(i, j))
            if TAIL <= len(d) <= LONGEST_PHONE and d[-TAIL:] in tails:
                put("tail", d[-TAIL:], range(i, j), d)
    return [list(m) for (kind, key), m in groups.items() if len(m) > 1 and (kind != "tail" or len(forms[key]) > 1)]


def _labels(spans: list[tuple[int, int]], base: list[list[tuple[int, int]]]) -> np.ndarray:
    """The kind of the base span that a token touches, else none; the first kind where they overlap."""
    y = np.zeros(len(spans), np.int64)
    for kind in reversed(range(len(KINDS))):
        found = base[kind]
        at = 0
        for i, (a, z) in enumerate(spans):
            while at < len(found) and found[at][1] <= a:
                at += 1
            if at < len(found) and found[at][0] < z:
                y[i] = kind + 1
    return y


@dataclass
class Weights:
    node: np.ndarray  # 3 x (SHAPES + 1) x K
    bias: np.ndarray  # K
    chain: np.ndarray  # K x K, before -> after
    skip: np.ndarray  # K x K, star -> member


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> Weights:
    """rows: own, before and after shape; label; label before and after (K: none); labels of up to three stars."""
    w = Weights(np.zeros((3, SHAPES + 1, K)), np.zeros(K), np.zeros((K, K)), np.zeros((K, K)))
    if not len(rows):
        w.bias[NONE] = 5.0
        return w
    shapes, y, left, right, stars = rows[:, :3], rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6:]
    n = counts / counts.sum()
    target = np.eye(K)[y]
    params = [w.node, w.bias, w.chain, w.skip]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pad = lambda x: np.vstack([x, np.zeros(K)])
        z = w.bias + sum(w.node[j, shapes[:, j]] for j in range(3)) + pad(w.chain)[left] + pad(w.chain.T)[right] + pad(w.skip)[stars].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * n[:, None]
        grads = [np.zeros_like(x) for x in params]
        for j in range(3):
            np.add.at(grads[0][j], shapes[:, j], g)
        grads[1] = g.sum(axis=0)
        c, r, s = np.zeros((K + 1, K)), np.zeros((K + 1, K)), np.zeros((K + 1, K))
        np.add.at(c, left, g)
        np.add.at(r, right, g)
        for j in range(STARS):
            np.add.at(s, stars[:, j], g)
        grads[2] = c[:K] + r[:K].T
        grads[3] = s[:K]
        for i, (x, d) in enumerate(zip(params, grads, strict=True)):
            d = d + decay * x
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            x -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return w


def marginals(node: np.ndarray, u: np.ndarray, v: np.ndarray, pair: np.ndarray, of: np.ndarray | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Loopy sum-product in logarithms, damped by half. node: n x K; edges u -> v with pair: e x K x K; of: the document of each
    edge. A document whose messages have settled takes no further part, so it gets the same result in any company."""
    belief = node.copy()
    if len(u):
        src, dst = np.concatenate([u, v]), np.concatenate([v, u])
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(u), 2 * len(u)), np.arange(len(u))])
        of = np.zeros(len(src), np.int64) if of is None else np.concatenate([of, of])
        message = np.zeros((len(src), K))
        live = np.arange(len(src))
        for _ in range(rounds):
            total = node.copy()
            np.add.at(total, dst[live], message[live])  # of the documents that are live, all edges are
            out = np.logaddexp.reduce((total[src[live]] - message[back[live]])[:, :, None] + pot[live], axis=1)
            out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
            change = np.zeros(of.max() + 1)
            np.maximum.at(change, of[live], np.abs(out - message[live]).max(axis=1))
            message[live] = 0.5 * message[live] + 0.5 * out
            live = live[change[of[live]] > tolerance]
            if not len(live):
                break
        np.add.at(belief, dst, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _infer(graphs: list[Graph], w: Weights) -> np.ndarray:
    """Marginals of the nodes of several documents at once; they share no edge."""
    shapes = np.concatenate([g.shapes for g in graphs])
    known = np.concatenate([g.known for g in graphs])
    n = len(shapes)
    node = w.bias + sum(w.node[j, shapes[:, j]] for j in range(3))
    sure = np.flatnonzero(known)
    node[sure] = 0.0
    node[sure, known[sure]] = CERTAIN
    chain, skip, of_chain, of_skip, at, star = [], [], [], [], 0, n
    for k, g in enumerate(graphs):
        chain += [(a + at, b + at) for a, b in g.chain]
        skip += [(s + star, i + at) for s, i in g.skip]
        of_chain += [k] * len(g.chain)
        of_skip += [k] * len(g.skip)
        at, star = at + len(g.spans), star + g.stars
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.broadcast_to(w.chain, (len(chain), K, K)), np.broadcast_to(w.skip, (len(skip), K, K))])
    return marginals(np.vstack([node, np.zeros((star - n, K))]), edges[:, 0], edges[:, 1], pair, np.array(of_chain + of_skip, np.int64))[:n]


def added_spans(g: Graph, p: np.ndarray, base: list[list[tuple[int, int]]], least: float = LEAST) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    label = np.where((p.max(axis=1) >= least) & (g.known == NONE), p.argmax(axis=1), NONE)
    if not label.any():
        return out
    beside = {b for _, b in g.chain}
    runs: list[tuple[int, int, int]] = []
    for i, (a, z) in enumerate(g.spans):
        if not label[i]:
            continue
        if runs and i in beside and label[i - 1] == label[i] and KINDS[label[i] - 1] in ("card", "phone"):
            runs[-1] = (runs[-1][0], z, int(label[i]))
        else:
            runs.append((a, z, int(label[i])))
    taken = sorted(s for spans in base for s in spans)
    at = 0
    for a, z, k in runs:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(s < z and e > a for s, e in taken[max(0, at - 4) : at + 4]):
            out[k - 1].append((a, z))
    return out


def find(texts: list[str | None], w: Weights) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """(base spans, added spans) by kind, for each text."""
    base, graphs = [], []
    for t in texts:
        base.append(base_spans(t or ""))
        graphs.append(graph(t or "", base[-1]))
    live = [g for g in graphs if g is not None and g.spans]
    p = _infer(live, w) if live else None
    out, at = [], 0
    for b, g in zip(base, graphs, strict=True):
        added: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        if g is not None and g.spans:
            added = added_spans(g, p[at : at + len(g.spans)], b)
            at += len(g.spans)
        out.append((b, added))
    return out


#: Stars that a token's statistics tell apart.
STARS = 3
_COLUMNS = ("own", "before", "after", "y", "y_before", "y_after", *(f"star{i}" for i in range(STARS)))
_OTHER = str.maketrans("0123456789", "3456789012")


def without_cues(kind: str, span: str) -> str:
    """A base span in a notation that its pattern doesn't cover; which one, its hash decides."""
    digits = "".join(_DIGITS.findall(span))
    groups = re.findall("[0-9]+", span)
    turn = xxhash.xxh64_intdigest(span.encode())
    if kind == "email":
        local, _, domain = span.partition("@")
        return f"{local}@{domain.partition('.')[0]}"
    if kind == "ip":
        return ("-", "[.]", ":")[turn % 3].join(groups)
    if kind == "card":
        return ("." if turn % 2 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = groups[1:] if len("".join(groups[1:])) >= TAIL else groups
    return (digits, digits[-TAIL:], digits[-10:], *(by.join(g) for by in (".", " ", "/") for g in (groups, local)))[turn % 9]


def examples(t: str) -> tuple[Graph | None, np.ndarray]:
    """The graph of a text and, behind it, of its base spans without their cues, each beside one of other digits; labels."""
    more, at = [t], len(t)
    gold: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for kind, found in zip(KINDS, base_spans(t), strict=True):
        for a, z in found:
            plain = without_cues(kind, t[a:z])
            other = plain.translate(_OTHER) if kind != "email" else plain[::-1].partition("@")[2] + "@" + plain.partition("@")[2]
            gold[KINDS.index(kind)].append((at + 3, at + 3 + len(plain)))
            more.append(f"\nx {plain} x {other} x")
            at += len(more[-1])
    whole = "".join(more)
    base = base_spans(whole)
    g = graph(whole, base)
    return g, (np.zeros(0, np.int64) if g is None else np.where(g.known > 0, g.known, _labels(g.spans, gold)))


def _statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    rows: dict[tuple[int, ...], int] = {}
    for t in b.column(0).to_pylist():
        g, y = examples(t or "")
        if g is None or not g.spans:
            continue
        left, right = np.full(len(y), K), np.full(len(y), K)
        for a, z in g.chain:
            left[z], right[a] = y[a], y[z]
        star = np.zeros(g.stars, np.int64)  # what base spans say of each
        for s, i in g.skip:
            star[s] = star[s] or g.known[i]
        near: list[list[int]] = [[] for _ in y]
        for s, i in g.skip:
            near[i].append(int(star[s]))
        for i in np.flatnonzero(g.known == NONE):
            key = (*map(int, g.shapes[i]), int(y[i]), int(left[i]), int(right[i]), *(sorted(near[i], reverse=True)[:STARS] + [K] * STARS)[:STARS])
            rows[key] = rows.get(key, 0) + 1
    n = len(_COLUMNS)
    data = np.array([(*k, c) for k, c in sorted(rows.items())], np.int64).reshape(-1, n + 1)
    return pa.RecordBatch.from_arrays([pa.array(data[:, i]) for i in range(n + 1)], [*_COLUMNS, "n"])


def train(docs: DataFrame, text_col: str = "text") -> Weights:
    texts = docs.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    stats = arrow_map(texts, _statistics, ", ".join(f"{c} long" for c in (*_COLUMNS, "n")))
    rows = sorted(tuple(r) for r in stats.groupBy(*_COLUMNS).agg(F.sum("n").alias("n")).collect())
    data = np.array(rows, np.int64).reshape(-1, len(_COLUMNS) + 1)
    return fit(data[:, :-1], data[:, -1].astype(float))


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, found in zip(KINDS, spans, strict=True) for a, z in sorted(found))


def detect(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    w = weights or train(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = find(b.column(1).to_pylist(), w)
        columns = [b.column(0), *(pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(len(KINDS)))]
        columns.append(pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string()))
        columns.append(pa.array([_listed([x + y for x, y in zip(base, added, strict=True)]) for base, added in found], pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(src, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(t: str | None, base: list[list[tuple[int, int]]], added: list[list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the union goes, named by the first."""
    spans = sorted((a, z, k) for group in (base, added) for k, found in zip(KINDS, group, strict=True) for a, z in found)
    if not t or not spans:
        return t
    out, at, end = [], 0, 0
    for a, z, k in spans:
        if a >= end:
            out += [t[at:a] if a > at else "", f"[{k.upper()}]"]
        end = max(end, z)
        at = end
    return "".join([*out, t[at:]])


def mask(docs: DataFrame, text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """docs with all spans of the text column replaced, all columns kept in their order."""
    w = weights or train(docs, text_col)
    name = free_name(docs, "masked")

    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        return pa.array([masked(t, *f) for t, f in zip(values, find(values, w), strict=True)], pa.string())

    out = with_column(docs, [text_col], run, name, "string")
    return out.select(*[F.col(name).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
