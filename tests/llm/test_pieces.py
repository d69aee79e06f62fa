import os
import random
from array import array
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import pieces
from tests.llm.helpers import ODD, prose

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="model file is not here")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def ids(data):
    a = array("i")
    a.frombytes(data)
    return a


def reference(vocabulary):
    """The library's own Viterbi search over the same pieces and costs."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.piece in vocabulary.cost and p.type in (1, 4):
            p.score, p.type = -vocabulary.cost[p.piece], 1
    return SentencePieceProcessor(model_proto=m.SerializeToString())


def test_against_library(vocabulary):
    rng = random.Random(1)
    sp, e = reference(vocabulary), pieces.Encoder(vocabulary)
    texts = [prose(rng, 60, "etaoinsdhrü,.é") for _ in range(40)] + ["日本語 text\n\n\tmore   spaces ", "ab" * 100, "🙂 x", ""]
    assert [list(ids(e.encode(t))) for t in texts] == [sp.encode(t) for t in texts]


def test_stream_in_chunks(vocabulary):
    """However a text is cut, the stream commits what a search over the whole text finds."""
    rng = random.Random(2)
    e = pieces.Encoder(vocabulary)
    for t in [prose(rng, 30) for _ in range(10)] + ["anticonstitutionnellement" * 40]:
        shown = pieces.SPACE + t.replace(" ", pieces.SPACE)
        s = pieces.Stream(vocabulary)
        at = 0
        while at < len(shown):
            n = rng.randrange(1, 9)
            s.feed(shown[at : at + n])
            at += n
        assert s.longest < 6 * vocabulary.max_piece
        assert list(s.close()) == list(ids(e.encode(t)))


def test_table_of_windows_is_bounded(vocabulary, monkeypatch):
    """Ids do not depend on what the table holds, and its size stays below its bound."""
    rng = random.Random(3)
    texts = [prose(rng, 40, "etaoin shrdlu") for _ in range(30)]
    want = [pieces.Encoder(vocabulary).encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_BYTES", 4000)
    e = pieces.Encoder(vocabulary)
    for t, x in zip(texts, want, strict=True):
        assert e.encode(t) == x
        assert sum(200 + 4 * len(s) + len(i) for d in (e.windows, e.windows.old) for s, i in d.items()) <= 4000 + 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_real_texts(vocabulary):
    """Ids of whole documents equal the library's; unbroken streams commit within a short window."""
    import duckdb

    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()
    sp, e = reference(vocabulary), pieces.Encoder(vocabulary)
    texts = [t for (t,) in rows if pieces.SPACE not in t]
    for t in texts:
        assert list(ids(e.encode(t))) == sp.encode(t)
    s = pieces.Stream(vocabulary)
    for t in texts[::10]:
        s.feed(pieces.SPACE + t.replace(" ", pieces.SPACE))
        assert list(s.close()) == sp.encode(t)
    assert s.longest < 8 * vocabulary.max_piece


@cache
def loaded():
    return pieces.Encoder(pieces.Vocabulary.load())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    e = loaded()
    assert e.decode(ids(e.encode(text))) == text


def test_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x"), (1, "", "x")]
    got = pieces.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (0, 1)] == [0, 0, 0]
    assert pieces.encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
