import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import langid
from tests.llm.helpers import ODD

SYLLABLES = {"en": ["the", "ing", "er", "th", "and"], "de": ["sch", "ung", "der", "ä", "ein"], "fr": ["eau", "é", "que", "ment", "les"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(k, lang := rng.choice(list(SYLLABLES)), text(rng, lang, rng.randrange(6, 60))) for k in range(400)]
    rows += [(1000 + k, None, t) for k, t in enumerate(ODD)] + [(None, "en", "the thing"), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, lang string, text string, score int")
    trees = langid.train(df, per_lang=60)
    assert trees.langs == ["de", "en", "fr"]
    got = langid.predict_language(df.select("doc_id", "text", "score"), trees).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["held"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if truth[r["doc_id"]]:
            assert r["lang_pred"] == truth[r["doc_id"]]
    odd = {r["doc_id"] - 1000: r["lang_pred"] for r in got if (r["doc_id"] or 0) >= 1000}
    for k, t in enumerate(ODD):
        assert (odd[k] == "und") == (t is None or not any(c.isalpha() for c in t))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "some text")], "doc_id bigint, lang string, text string")
    trees = langid.train(df)
    assert [(r["lang_pred"], r["score"]) for r in langid.predict_language(df, trees).collect()] == [("und", 0.0)]
    assert langid.predict_language(df.limit(0), trees).collect() == []


def slow_bits(texts, data, order):
    """Code length byte by byte, straight from the counts of one language."""
    counts = {}
    for t in texts:
        x = [langid.START] * order + list(t)
        for i in range(order, len(x)):
            for n in range(order + 1):
                c = counts.setdefault(tuple(x[i - n : i]), {})
                c[x[i]] = c.get(x[i], 0) + 1

    def p(context, symbol):
        shorter = p(context[1:], symbol) if context else 1 / 256
        seen = counts.get(context, {})
        n, t = sum(seen.values()), len(seen)
        return shorter if not n else seen[symbol] / (n + t) if symbol in seen else t / (n + t) * shorter

    s = [langid.START] * order + list(data)
    return sum(-math.log2(p(tuple(s[i - order : i]), s[i])) for i in range(order, len(s)))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths(order):
    """Exact over all 256 byte values, also those that training never saw, and piece by piece."""
    rng = random.Random(1)
    texts = {lang: [text(rng, lang, 40).encode() for _ in range(5)] for lang in SYLLABLES}
    texts["wide"] = ["".join(chr(rng.randrange(0x80, 0x9FFF)) for _ in range(300)).encode() for _ in range(3)]
    trees = langid.ContextTrees(texts, order)
    for t in (text(rng, "fr", 30), "zzz QQQ the", "é", "漢字仮名交じり文 \x00\x01🙂", "a"):
        data = np.frombuffer(t.encode(), np.uint8)
        want = [slow_bits(texts[lang], t.encode(), order) for lang in trees.langs]
        assert trees.code_lengths(data) == pytest.approx(want, rel=1e-9)
        assert trees.code_lengths(data, piece=7) == pytest.approx(want, rel=1e-9)


def test_letters_ties_and_long_texts(spark):
    """Digits in a circle are no letters; equal languages go by code point; a long text counts to its end."""
    rng = random.Random(3)
    same = [text(rng, "en", 30) for _ in range(4)]
    trees = langid.ContextTrees({"b": [t.encode() for t in same], "a": [t.encode() for t in same]})
    rows = [(1, "²½①"), (2, "the"), (3, "1 2 3 !")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_language(spark.createDataFrame(rows, "doc_id bigint, text string"), trees).collect()}
    assert got == {1: ("und", 0.0), 2: ("a", 0.5), 3: ("und", 0.0)}
    two = langid.ContextTrees({x: [text(rng, x, 200).encode()] for x in ("en", "fr")})
    long = text(rng, "en", 100) + " " + text(rng, "fr", 60_000)
    assert two.predict(long, np.frombuffer(long.encode(), np.uint8))[0] == "fr"


def test_only_long_texts(spark):
    """A language whose texts are all longer than the bound of the sample is learned from their beginnings."""
    rng = random.Random(4)
    rows = [(k, x, text(rng, x, 2000)) for k, x in enumerate(["en", "fr"] * 10)]
    trees = langid.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), per_lang=3, max_bytes=1000)
    assert trees.langs == ["en", "fr"]
