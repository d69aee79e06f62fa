"""Texts longer than the pieces and batches that the operators work in, at the registered sizes."""

import hashlib
import random
from array import array

import numpy as np
import pytest

from presswork.llm import chat, html, langid, mixing, neardup, pieces, quality, suffixes
from tests.llm.helpers import prose, words
from tests.llm.test_pieces import reference

SIZE = 2 << 20


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    block = [prose(rng, 60) for _ in range(400)]
    long = " ".join(f"{rng.choice(block)} {k}" for k in range(SIZE // 330))
    assert len(long) > 1.2 * suffixes.PIECE
    return long, prose(rng, 400)


@pytest.fixture(scope="module")
def docs(spark, texts):
    long, short = texts
    cut = suffixes.PIECE - 500
    passage = long[cut : cut + 1000]  # over the border of two pieces
    rows = [(1, long), (2, short), (3, long + " tail"), (4, short[:600] + passage + short[600:]), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got[1] == got[3] == 1 and got[2] == 2 and got[5] == 5


def test_suffixes(spark, texts):
    long, short = texts
    fresh = prose(random.Random(22), SIZE // 6)[: SIZE + 5000]
    cut = suffixes.PIECE - 300
    rows = [(1, fresh), (2, short + fresh[cut : cut + 700] + short[::-1])]
    got = {r["doc_id"]: r for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (700, 1, 700)
    assert got[1]["kept_sha256"] == hashlib.sha256((fresh[:cut] + fresh[cut + 700 :]).encode()).hexdigest()


def test_pieces(texts):
    e = pieces.Encoder(pieces.Vocabulary.load())
    ids = array("i")
    ids.frombytes(e.encode(texts[0]))
    assert e.decode(ids) == texts[0]
    # Unbroken words: costs are kept for a window only, whether paths meet soon or (pairs of letters) hardly ever.
    sp = reference(e.v)
    for letters in ("etaoinshrdlu", "abcdefghij", "x"):
        word = "".join(random.Random(23).choice(letters) for _ in range(40_000))
        s = pieces.Stream(e.v)
        s.feed(pieces.SPACE + word)
        assert len(s.best) <= pieces.CHUNK + 2 * e.v.max_piece
        assert list(s.close()) == sp.encode(word)


def test_language(texts):
    rng = random.Random(24)
    trees = langid.ContextTrees({"a": [texts[0][:20_000].encode()], "b": ["".join(rng.choice("xyzuvw ") for _ in range(20_000)).encode()]})
    data = np.frombuffer(texts[0].encode(), np.uint8)
    assert trees.predict(texts[0], data) == ("a", 1.0)
    assert trees.code_lengths(data) == pytest.approx(trees.code_lengths(data, piece=1 << 22), rel=1e-10)


def test_counts(spark, docs, texts):
    n = {1: len(words(texts[0])), 2: len(words(texts[1])), 5: 0}
    got = {r["doc_id"]: r["n_words"] for r in quality.quality_rules(docs, keep_text=False).collect()}
    assert {k: got[k] for k in n} == n
    sized = {r["doc_id"]: r["size"] for r in mixing.mixed(docs.selectExpr("*", "'s' as source"), keep_text=False).collect()}
    assert {k: sized[k] for k in n} == n


def test_page_and_turns(spark, texts):
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{texts[0][k : k + 5000]}</p>" for k in range(0, len(texts[0]), 5000)) + "</article>"
    got = html.main_text(spark.createDataFrame([(1, "http://a/", page)], "page_id bigint, url string, html string")).first()
    want = " ".join(" ".join(texts[0][k : k + 5000].split()) for k in range(0, len(texts[0]), 5000))
    assert got["text"] == want
    turns = spark.createDataFrame([(1, 0, "user", texts[1]), (1, 1, "assistant", texts[0])], "conv_id bigint, turn bigint, role string, text string")
    got = chat.read_back(chat.chat_windows(turns)).first()
    assert got["loss_chars"] == len(texts[0]) and got["loss_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()
