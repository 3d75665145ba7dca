import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import Row

from tomeflow.llm import pieces, registry

FOLDER = "/root/testdata/sf0.001"
try:
    MODEL = pieces.model_file()
except FileNotFoundError:
    MODEL = None
pytestmark = pytest.mark.skipif(MODEL is None, reason="no public tokenizers here")


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return pieces.Codec(f.read())


EDGES = ["", " ", "  ", "   a", "a ", "a  ", "▁", " ▁", "a▁b", "\n", " \n ", "\0", "a\0b  c", "<s>hi</s><0x0A>", "é😀梦", "é", "\t x", "a" * 3000, "ab " * 2000, " " * 100, "x" * 49 + "y" * 50]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    letters = " ▁ab\n\tthein\0é😀梦́<>s/0x" + "".join(chr(rng.randrange(32, 0x3000)) for _ in range(60))
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_encoding_equals_the_library_on_whole_texts(codec):
    texts = EDGES + random_texts(4000)
    assert [x.tolist() for x in codec.encode(texts)] == codec.library.encode(texts)


def test_one_agenda_equals_agendas_together(codec):
    texts = [t.replace(" ", pieces.SPACE) for t in random_texts(300, 9) if 1 < len(t) <= pieces.TOGETHER]
    v = codec.vocabulary
    for t in texts:
        one = [v.ids.get(s, -1 - ord(s[0])) for s in pieces.merged(t, v.late)]
        (together,), _ = codec.agendas.run([t])
        assert np.frombuffer(together, "<i4").tolist() == one


def test_decoding_equals_the_library_on_any_ids(codec):
    rng = random.Random(7)
    ids = [np.array([rng.choice([rng.randrange(259), rng.randrange(32000)]) for _ in range(rng.randint(0, 20))], np.int32) for _ in range(3000)]
    assert codec.decode(ids) == codec.library.decode([i.tolist() for i in ids])


def test_round_trip(codec):
    texts = EDGES + random_texts(500, 11)
    assert codec.decode(codec.encode(texts)) == [t.replace("▁", " ") for t in texts]


def test_a_small_memory_changes_nothing(codec):
    with open(MODEL, "rb") as f:
        small = pieces.Codec(f.read(), kept_chunks=10)
    texts = random_texts(200, 13)
    assert [x.tolist() for t in texts for x in small.encode([t])] == [x.tolist() for x in codec.encode(texts)]


def test_a_difference_from_the_library_is_an_error(codec):
    with open(MODEL, "rb") as f:
        wrong = pieces.Codec(f.read())
    late = wrong.agendas.late
    wrong.agendas.late = np.where(late < wrong.agendas.NEVER, -late, late)
    with pytest.raises(ValueError, match="library encodes"):
        wrong.encode(["an understanding"])


def test_other_vocabularies_are_refused():
    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + (bytes([len(payload)]) + payload if kind == 2 else payload)

    piece = field(1, 2, field(1, 2, "a▁b".encode()))
    with pytest.raises(ValueError, match="merge type.*after another character"):
        pieces.Vocabulary.read(piece + field(2, 2, field(3, 0, b"\x01")))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_equals_the_library(spark, codec):
    got = {r.doc_id: r for r in registry.op11_pieces(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = codec.library.encode(d.text)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids)))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    rows = sorted(pieces.round_trip(docs).collect(), key=str)
    assert [(r.doc_id, r.decoded) for r in rows if r.doc_id in (1, 2)] == [(1, ""), (2, "")]
    assert sum(r.decoded == "a b" for r in rows) == 3
    assert [r.ids for r in rows if r.doc_id == 1] == [[]]
    both = pieces.encode(docs)
    assert both.columns == ["doc_id", "text", "ids", "_ids"]
    assert {Row(text=r.text, back=r.back) for r in pieces.decode(both, "_ids", "back").select("text", "back").collect()} == {Row(text=None, back=""), Row(text="a b", back="a b"), Row(text="", back="")}
    assert pieces.digest(pieces.round_trip(docs.limit(0))).collect() == []
    none = pieces.digest(pieces.round_trip(docs.where("doc_id = 1"))).first()
    assert (none.n_tokens, none.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
