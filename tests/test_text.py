import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.functions import text



def of(one, f, value):
    return one(lambda _: f(F.col("t")), "t string", value)


def test_tokenize(one):
    assert of(one, text.tokenize, "Hello, world! This is a test.") == ["hello", "world", "this", "is", "test"]
    assert of(one, lambda c: text.tokenize(c, 3), "I am a cat") == ["cat"]
    assert of(one, lambda c: text.tokenize(c, 2, True), "The quick brown fox") == ["quick", "brown", "fox"]
    assert of(one, lambda c: text.tokenize(c, 2, False, False), "The Fox") == ["The", "Fox"]
    assert of(one, lambda c: text.tokenize(c, 1), "don't - stop_it café x y") == ["don't", "-", "stop_it", "caf", "x", "y"]
    assert of(one, text.tokenize, None) == []
    assert len(text.STOPWORDS) == 85


def test_sentences(one):
    assert of(one, text.sentences, "Hello. How are you? I am fine!") == ["Hello", "How are you", "I am fine"]
    assert of(one, text.sentences, " a 3.14　.\n..") == ["a 3", "14"]
    assert of(one, text.sentences, "") == []


def test_counts_and_ngrams(one):
    assert of(one, text.word_count, "One two three") == 3
    grams = lambda n: lambda c: text.ngrams(F.split(c, " "), n)
    assert of(one, grams(2), "a b c d") == ["a b", "b c", "c d"]
    assert of(one, grams(5), "a b c d") == []
    assert of(one, grams(4), "a b c d") == ["a b c d"]


def test_english(one):
    assert of(one, text.is_likely_english, "The quick brown fox jumps over the lazy dog") is True
    assert of(one, text.is_likely_english, "uno dos tres") is True
    assert of(one, text.is_likely_english, "uno dos tres cuatro cinco") is False
    assert of(one, text.is_likely_english, "the " + "zz " * 9) is False


def stem_model(w: str) -> str:
    if len(w) < 3:
        return w
    for end, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(end):
            w = w[: len(w) - cut]
            break
    if w.endswith("eed"):
        w = w[:-1] if len(w) > 4 else w
    elif w.endswith("ed"):
        w = w[:-2] if "at" in w or len(w) > 4 else w
    elif w.endswith("ing"):
        w = w[:-3] if len(w) > 5 else w
    return w[:-1] + "i" if re.search("[^aeiou]y$", w) else w


def test_stem(spark, one):
    for word, stem in {"running": "runn", "flies": "fli", "cats": "cat", "agreed": "agree", "is": "is", "at": "at", "feed": "feed", "happy": "happi"}.items():
        assert of(one, text.stem, word) == stem

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text("aeisdgnytz", max_size=7), min_size=1, max_size=60))
    def check(words):
        rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.stem(F.col("t")).alias("s")).collect()
        assert [r["s"] for r in rows] == [stem_model(r["t"]) for r in rows]

    check()


def test_runs_are_what_replacing_and_splitting_gave(spark):
    odd = ["", " ", "A-b_c'd  e", "KKlvİn Été naïve", "a bb\x0bcc\x1fdd ee", "\U0001f600xx\U0001f600", "-- '' __ 9", "x.y,zz;Aa", None, " lead", "trail "]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    for least, lower in ((0, True), (1, True), (2, True), (3, False)):
        t = F.coalesce("text", F.lit(""))
        old = F.split(F.regexp_replace(F.lower(t) if lower else t, r"[^A-Za-z0-9_\s'-]", " "), r"\s+")
        old = F.filter(old, lambda w: F.length(w) >= least)  # noqa: B023
        for row in df.select("text", text.tokenize(F.col("text"), least, False, lower).alias("new"), old.alias("old")).collect():
            assert row["new"] == row["old"], (least, row)


def test_tokens_are_found_by_one_regex_of_named_characters(spark):
    plan = spark.createDataFrame([("a",)], "text string").select(text.tokenize(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_replace" not in plan and "[^" not in plan


def test_stem_column_is_stem(spark):
    words = "classes flies glass cats agreed eed bed hated ing sing running played happy by y ay sky dies is as a ss ed ating yy éy".split()
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("want", text.stem(F.col("w")))
    assert [tuple(r) for r in text.stem_column(df, "w").select("w", "want").collect()] == [(r["want"], r["want"]) for r in df.collect()]


def test_trim_names_every_space_and_searches_nothing(spark):
    from presswork.core.jscompat import _SPACES, JS_SPACE, trim

    assert all(re.fullmatch(JS_SPACE, c) for c in _SPACES)
    texts = [a + b + c for a in ("", " ﻿", _SPACES) for b in ("", "x", "é   x\x1f") for c in ("", "\n　", _SPACES)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace(F.regexp_replace("t", f"^{JS_SPACE}+", ""), rf"{JS_SPACE}+\z", "")
    got = df.select(trim(F.col("t")).alias("new"), old.alias("old"))
    assert "regexp" not in df.select(trim(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["new"] == r["old"] for r in got.collect())
