"""Lexicon sentiment with negation and amplification, as one fold over the tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.core.jscompat import let, round2
from presswork.functions.text import tokenize

#: Scores, negators and amplifiers.
LEXICON = {
    "good": 3, "great": 4, "excellent": 5, "amazing": 5, "wonderful": 4, "happy": 3, "love": 3, "best": 4, "fantastic": 4, "awesome": 4, "positive": 2, "success": 3, "win": 3, "winning": 3,
    "winner": 3, "beautiful": 3, "perfect": 4, "outstanding": 4, "brilliant": 4,
    "bad": -3, "terrible": -4, "awful": -4, "horrible": -4, "worst": -4, "hate": -4, "sad": -2, "angry": -3, "fail": -3, "failure": -3, "negative": -2, "wrong": -2, "problem": -2, "crisis": -3,
    "disaster": -4, "ugly": -2, "poor": -2, "broken": -2, "killed": -3, "death": -2, "attack": -3, "war": -3, "terror": -4, "violence": -3,
}
NEGATORS = ("not", "no", "never", "neither", "n't", "none", "nobody", "nothing")
AMPLIFIERS = {"very": 1.5, "really": 1.3, "extremely": 2.0, "absolutely": 1.8, "incredibly": 1.7, "completely": 1.5, "totally": 1.4}


def default_lexicon() -> dict[str, int]:
    return dict(LEXICON)


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def analyze(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Struct score, normalizedScore, confidence, label, wordCount, sentimentWords.

    A modifier acts on the next word that is no modifier, whatever that word is; it never
    scores itself. The word tables are real maps, so no word is special.
    """
    scores, amplifiers = _map(LEXICON if lexicon is None else lexicon), _map(AMPLIFIERS)
    d = F.lit(0.0)
    start = F.struct(d.alias("total"), F.lit(0).cast("bigint").alias("hits"), F.lit(False).alias("neg"), F.lit(1.0).alias("amp"))

    def step(a: Column, w: Column) -> Column:
        negates, louder, score = w.isin(*NEGATORS), F.element_at(amplifiers, w), F.element_at(scores, w)
        plain = ~negates & louder.isNull()
        hit = plain & score.isNotNull()
        adjusted = score * a["amp"]
        return F.struct(
            F.when(hit, a["total"] + F.when(a["neg"], -adjusted).otherwise(adjusted)).otherwise(a["total"]).alias("total"),
            F.when(hit, a["hits"] + 1).otherwise(a["hits"]).alias("hits"),
            F.when(negates, F.lit(True)).when(plain, F.lit(False)).otherwise(a["neg"]).alias("neg"),
            F.when(plain, F.lit(1.0)).when(~negates, louder).otherwise(a["amp"]).alias("amp"),
        )

    def result(x: Column) -> Column:
        s, n = x["s"], x["n"].cast("bigint")
        normal = F.when(s["hits"] > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["total"] / (s["hits"] * 3)))).otherwise(d)
        sure = F.when(n > 0, F.least(F.lit(1.0), s["hits"] / n * 2)).otherwise(d)
        label = F.when(normal > 0.1, "positive").when(normal < -0.1, "negative").otherwise("neutral")
        return F.struct(
            round2(s["total"]).alias("score"), round2(normal).alias("normalizedScore"), round2(sure).alias("confidence"), label.alias("label"), n.alias("wordCount"), s["hits"].alias("sentimentWords")
        )

    return let(let(tokenize(text, 1), lambda t: F.struct(F.aggregate(t, start, step).alias("s"), F.size(t).alias("n"))), result)


def compare(a: Column, b: Column) -> Column:
    """Struct aScore, bScore, difference, agreementLabel of two results of :func:`analyze`."""
    same = (a["label"] == b["label"]) | (a["label"] == "neutral") | (b["label"] == "neutral")
    x, y = a["normalizedScore"], b["normalizedScore"]
    return F.struct(x.alias("aScore"), y.alias("bScore"), F.abs(x - y).alias("difference"), F.when(same, "agree").otherwise("disagree").alias("agreementLabel"))
