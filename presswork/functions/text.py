"""Tokens, sentences, n-grams and stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.core.jscompat import let, trim

#: The 85 stop words.
STOPWORDS = tuple(
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need dare ought used this that these those "
    "i you he she it we they what which who whom where when why how all each every both few more most other some such no nor not only own same so than too very s t just don now".split()
)


_DIGITS = "0123456789_"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _runs(text: Column, characters: str, least: int) -> Column:
    """The runs of ``characters`` that are ``least`` long.

    Every character is named: Java's engine looks them up in one table of bits, where
    ranges and negations are a chain of calls for each character of the text.
    """
    if least < 1:  # an empty one stands where a text begins or ends with other characters
        return F.split(text, f"[^{characters}]+")
    return F.regexp_extract_all(text, F.lit(f"[{characters}]{{{least},}}+"), F.lit(0))


def stopword_array() -> Column:
    return F.array(*(F.lit(w) for w in STOPWORDS))


def tokenize(text: Column, min_length: int = 2, remove_stopwords: bool = False, lowercase: bool = True) -> Column:
    """Words of ASCII letters, digits, ``_ ' -``; anything else separates. Null text: none."""
    t = F.coalesce(text, F.lit(""))
    letters = _LOWER if lowercase else _LOWER + _LOWER.upper()
    words = _runs(F.lower(t) if lowercase else t, letters + _DIGITS + r"'\-", min_length)
    if not remove_stopwords:
        return words
    return F.filter(words, lambda w: ~(w if lowercase else F.lower(w)).isin(*STOPWORDS))


def hash_tokens(text: Column) -> Column:
    """Tokens of the fingerprint: ``'`` and ``-`` separate too, two characters at least."""
    return _runs(F.lower(F.coalesce(text, F.lit(""))), _LOWER + _DIGITS, 2)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), trim), lambda s: F.length(s) > 0)


def word_count(text: Column) -> Column:
    return F.size(tokenize(text, 1)).cast("bigint")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by a space; none if there are fewer."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))))


def is_likely_english(text: Column) -> Column:
    """More than a tenth of the tokens are stop words; short texts pass."""

    def share(t: Column) -> Column:
        return F.when(F.size(t) < 5, F.lit(True)).otherwise(F.size(F.filter(t, lambda w: w.isin(*STOPWORDS))) / F.size(t) > 0.1)

    return let(tokenize(text), share)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1)).otherwise(w)


def _ending(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(w.endswith("eed"), F.when(n > 4, _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed"), F.when(w.contains("at") | (n > 4), _cut(w, 2)).otherwise(w))
        .when(w.endswith("ing"), F.when(n > 5, _cut(w, 3)).otherwise(w))
        .otherwise(w)
    )


def _final(w: Column) -> Column:
    consonant = (F.length(w) > 1) & ~F.substring(w, -2, 1).isin(*"aeiou")
    return F.when(w.endswith("y") & consonant, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def stem(word: Column) -> Column:
    """Three chained suffix steps; words under three characters stay."""
    return F.when(F.length(word) < 3, word).otherwise(let(let(_plural(word), _ending), _final))


def stem_column(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the words of column ``name`` stemmed as by :func:`stem`, one projection a step."""
    short = F.length(name) < 3
    df = df.withColumn("__short", short).withColumn(name, F.when(F.col("__short"), F.col(name)).otherwise(_plural(F.col(name))))
    for step in (_ending, _final):
        df = df.withColumn(name, F.when(F.col("__short"), F.col(name)).otherwise(step(F.col(name))))
    return df.drop("__short")
