import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tomeflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.findall("[0-9]", s)


def brute_luhn(ds):
    total = 0
    for i, d in enumerate(int(x) for x in reversed(ds)):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute(t):
    t = t or ""
    return [
        [m.span() for m in EMAIL.finditer(t)],
        [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and brute_luhn(digits(m.group()))],
        [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15],
    ]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1234567.@ -+()%é\n0😀") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("4111 1111-1111 1111", "x@y", "a@b.c", "1.2.3.4.5.6.7.8", "0000255.1.1.1", "256.1.1.1", "+1 (017) 555-7713", "@@a@b.c@d.e"):
        assert pii.base_spans(t) == brute(t), t


def test_long_words_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "a." * 100_000 + "@", "1." * 100_000, "+1" * 50_000, "9 " * 100_000):
        pii.base_spans(t)
        pii.graph(t)


def test_messages_are_exact_on_trees():
    """Against all labellings of a small tree."""
    rng = np.random.default_rng(0)
    node, edges = rng.normal(size=(4, pii.K)), [(0, 1), (1, 2), (1, 3)]
    pair = rng.normal(size=(3, pii.K, pii.K))
    want = np.zeros((4, pii.K))
    for y in itertools.product(range(pii.K), repeat=4):
        s = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(pair[e][y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(4):
            want[i, y[i]] += s
    want /= want.sum(axis=1, keepdims=True)
    got = pii.marginals(node, np.array([0, 1, 1]), np.array([1, 2, 3]), pair, rounds=60)
    assert np.abs(got - want).max() < 1e-6


def test_repeats_share_a_label():
    """A token that looks like nothing on its own takes the label of its recognised repeat."""
    w = pii.Weights(np.zeros((3, pii.SHAPES + 1, pii.K)), np.zeros(pii.K), np.zeros((pii.K, pii.K)), np.eye(pii.K) * 6)
    w.node[1, 0, 4] = 6.0  # right after an e-mail address a token is a phone, for this test
    t = "me@x.yz 5557713 and much later 5557713 and 1234567"
    (base, added), = pii.find([t], w)
    assert base[0] == [(0, 7)] and added[3] == [(8, 15), (31, 38)]
    far = "me@x.yz 5557713 " + "and 5557713 " * 500
    (_, added), = pii.find([far], w)
    assert len(added[3]) == 501


def test_edges_stay_linear_in_a_hot_group():
    g = pii.graph("5557713 x " * 5_000)
    assert len(g.spans) == 5_000 and len(g.skip) == 5_000 and g.stars == 1 and not g.chain


VARIANTS = [
    ("call +44 20 7946 0958 now", "442079460958", 3),
    ("call +1 (017) 555-7713 now", "017.555.7713", 3),
    ("call +1 (017) 555-7713 now", "1 017 555 7713", 3),
    ("pay 4111111111111111 now", "4111.1111.1111.1111", 2),
    ("pay 4111 1111 1111 1111 now", "4111/1111/1111/1111", 2),
    ("host 10.20.30.40 is up", "10-20-30-40", 1),
    ("host 10.20.30.40 is up", "10[.]20[.]30[.]40", 1),
    ("mail joe.7@x.example.com", "joe.7@x", 0),
]


def planted(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        filler = " ".join(rng.choice(("word", "text", f"{d(3)}", f"{d(10)}", f"{d(4)}.{d(4)}", "so")) for _ in range(30))
        out.append(f"{filler} +1 ({d(3)}) {d(3)}-{d(4)} {filler} 10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.1 {filler} a{d(2)}@m{d(1)}.example.com {filler}")
    return out


def trained(texts):
    import pyarrow as pa

    b = pii._statistics(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]))
    data = np.array([c.to_numpy() for c in b.columns]).T
    return pii.fit(data[:, :-1], data[:, -1].astype(float))


def test_skip_potentials_find_repeats_in_other_notations():
    texts = planted() + [f"{a} x" for a, _, _ in VARIANTS] * 20
    w = trained(texts)
    blind = pii.Weights(w.node, w.bias, w.chain, np.zeros_like(w.skip))
    hits = without = 0
    for first, again, kind in VARIANTS:
        t = f"{first} " + "and so on " * 200 + again + " end"
        at = t.rindex(again)
        for weights in (w, blind):
            (base, added), = pii.find([t], weights)
            assert base == brute(t)
            found = {i for a, z in added[kind] for i in range(a, z)} & set(range(at, at + len(again)))
            if weights is w:
                hits += len(found) > len(again) // 2
            else:
                without += bool(found)
    assert hits == len(VARIANTS) and without == 0


def test_held_out_precision_and_recall_of_added_spans():
    w = trained(planted() + [f"{a} x" for a, _, _ in VARIANTS] * 20)
    hit = miss = wrong = 0
    for t in planted(200, seed=8):
        g, y = pii.examples(t)
        p = pii._infer([g], w)
        got = np.where(p.max(axis=1) >= pii.LEAST, p.argmax(axis=1), 0)
        free = g.known == 0
        hit += ((got == y) & (y > 0) & free).sum()
        miss += ((got != y) & (y > 0) & free).sum()
        wrong += ((got != y) & (got > 0) & free).sum()
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.98


def test_a_document_gets_the_same_spans_in_any_company():
    texts = planted(60, seed=4) + [f"{a} and {b}" for a, b, _ in VARIANTS]
    w = trained(texts)
    assert pii.find(texts, w) == [pii.find([t], w)[0] for t in texts]
    graphs = [pii.graph(t) for t in texts]
    alone = [pii._infer([g], w) for g in graphs]
    assert np.abs(np.concatenate(alone) - pii._infer(graphs, w)).max() < 1e-9


def test_long_tokens_have_their_shape():
    assert pii._shape("a" * 500 + "@" + "b" * 500 + ".example.com") == 0
    assert pii._shape("1" * 400) != pii._shape("x" * 400)


def test_detect_and_mask(spark):
    docs = [(i, f"mail me.{i}@mail.example.com or call +1 (017) 555-77{i:02d} from 10.0.0.{i}") for i in range(30)]
    docs += [(40, None), (41, ""), (42, "no data"), (None, "a@b.cd"), (0, docs[0][1]), (43, "😀 a@b.cd"), (44, "pay 4111111111111111 now")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("masked", F.lit("clash")).withColumn("T", F.lit(1))
    rows = pii.detect(df).collect()
    assert len(rows) == len(docs)
    texts = dict((i, t) for i, t in docs)
    for r in rows:
        b = brute(texts[r.doc_id])
        listed = [f"{k}:{a}:{z}" for k, found in zip(pii.KINDS, b, strict=True) for a, z in found]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in b]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))
    masked = pii.mask(df)
    assert masked.columns == df.columns
    out = {r.doc_id: r.text for r in masked.collect()}
    assert out[1] == "mail [EMAIL] or call [PHONE] from [IP]" and out[40] is None and out[41] == "" and out[43] == "😀 [EMAIL]" and out[44] == "pay [CARD] now"
    assert pii.detect(df.limit(0)).count() == 0


def test_same_weights_on_every_run(spark):
    df = spark.createDataFrame([(i, f"x {i}.1.1.1 +1 555 0000{i} {i}@a.bc") for i in range(50)], "doc_id long, text string")
    a, b = pii.train(df), pii.train(df.repartition(7))
    assert all((x == y).all() for x, y in ((a.node, b.node), (a.bias, b.bias), (a.chain, b.chain), (a.skip, b.skip)))
