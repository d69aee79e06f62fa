"""Quality rules under weak supervision, in DataFrame functions only.

Each rule reads a few row-local measures and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the table of vote patterns estimates how accurate each
rule is; a document's posterior probability of being good then replaces the usual
"all rules must pass". The pattern table has at most ``3 ** len(RULES)`` rows whatever
the size of the corpus, so it is the only thing that reaches the driver.

Defined cases: null or empty text has no words, fails the base rules and is not kept;
repeated rows are judged row by row; an empty table gives an empty result; an input
column with the name of a computed one is replaced by it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import WORD_GAP, let, materialise, words

#: Characters that count as symbols (a fixed value).
SYMBOLS = "#*$%&|<>"


def repeat_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``tokens``.

    Windows are first matched by 32 hash bits packed over the position and sorted as
    plain longs; those that share a hash are then compared word by word, so the count
    is exact.
    """

    def neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(
            s,
            lambda x, i: F.coalesce(same(F.get(s, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, i + 1), x), F.lit(False)),
        )

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def exact(w: Column, packed: Column) -> Column:
        at = F.transform(packed, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        spelled = F.sort_array(
            F.transform(at, lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))
        )
        true = let(spelled, lambda s: neighbours(s, lambda y, x: (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["c"] == x["c"])))
        return let(F.sort_array(F.transform(true, lambda x: x["p"].cast("bigint"))), covered)

    def windows(h: Column) -> Column:
        low = F.lit((1 << 32) - 1)
        return F.transform(
            F.slice(h, 1, F.size(h) - 2),
            lambda x, i: F.shiftleft(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(low), 31).bitwiseOR(i.cast("bigint")),
        )

    def of(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        shared = let(F.sort_array(let(hashed, windows)), lambda s: neighbours(s, lambda y, x: F.shiftright(y, 31) == F.shiftright(x, 31)))
        return let(shared, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("bigint")).otherwise(exact(w, c)))

    return let(tokens, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(of(w)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the row-local measures; no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    of_lines = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    of_words = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
    return (
        docs.withColumns({"__lines": of_lines, "__words": of_words})
        .withColumns({
            "n_words": long(F.col("__words.n")),
            "word_chars": long(F.length(F.regexp_replace(t, WORD_GAP, ""))),
            "n_symbols": long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
            "n_dup_lines": long(F.col("__lines.dup")),
            "n_repeat_words": long(F.col("__words.rep")),
            "n_lines": long(F.col("__lines.n")),
            "n_stops": long(F.length(t) - F.length(F.translate(t, ".!?", ""))),
            "n_bars": long(F.length(t) - F.length(F.translate(t, "|\t", ""))),
            "n_upper": long(F.regexp_count(t, F.lit(r"\p{Lu}"))),
        })
        .drop("__lines", "__words")
    )


#: Each rule: when it votes good and when bad, as conditions that any SQL engine reads; all
#: in exact whole numbers. A bad vote goes first; otherwise the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "mean_word": ("10 * word_chars >= 35 * n_words and word_chars <= 6 * n_words", "word_chars < 3 * n_words or 2 * word_chars > 15 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "tables": ("100 * n_bars <= n_words", "20 * n_bars > n_words"),
    "shouting": ("10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    "dup_lines": ("20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("5 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "sentences": ("60 * n_stops >= n_words and 2 * n_stops <= n_words", "5 * n_stops > 4 * n_words or 300 * n_stops < n_words"),
    "line_length": ("n_words >= 5 * n_lines and n_words <= 200 * n_lines", "n_words < 3 * n_lines or n_words > 1000 * n_lines"),
}


def rules() -> dict[str, Column]:
    """Name of each rule and its vote."""
    return {k: F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)).cast("int") for k, (good, bad) in RULES.items()}


#: What a rule is expected to say about a document of either class before any is seen:
#: a bad vote is rare on good documents. The weight is a share of the corpus, so the
#: estimate is the same at every size.
EXPECTED = {"good": {1: 0.90, 0: 0.09, -1: 0.01}, "bad": {1: 0.45, 0: 0.20, -1: 0.35}}
EXPECTED_WEIGHT = 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> Callable[[tuple[int, ...]], float]:
    """Two-class expectation-maximisation over (votes, how often) rows.

    The first posteriors come from the number of bad votes; every later round estimates
    P(vote | class) of each rule and the class prior, drawn towards ``EXPECTED`` so that
    the classes keep their meaning. Returns the posterior probability of the good class
    for a vote pattern.
    """
    patterns = sorted(patterns)
    total = float(sum(n for _, n in patterns))
    if not total:
        return lambda votes: 0.5
    m, pull = len(patterns[0][0]), EXPECTED_WEIGHT * total
    post = {v: (0.95, 0.2, 0.05)[min(2, sum(x < 0 for x in v))] for v, _ in patterns}
    model: tuple = ()

    def posterior(votes: tuple[int, ...]) -> float:
        pi, good, bad = model
        odds = math.log(pi / (1 - pi)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def estimate(of: dict[tuple[int, ...], float], kind: str) -> list[dict[int, float]]:
        mass = math.fsum(n * of[v] for v, n in patterns)
        return [
            {x: (pull * EXPECTED[kind][x] + math.fsum(n * of[v] for v, n in patterns if v[j] == x)) / (pull + mass) for x in (-1, 0, 1)}
            for j in range(m)
        ]

    for _ in range(rounds):
        pi = (math.fsum(n * post[v] for v, n in patterns) + 0.9 * pull) / (total + pull)
        model = (pi, estimate(post, "good"), estimate({v: 1 - p for v, p in post.items()}, "bad"))
        new = {v: posterior(v) for v, _ in patterns}
        moved = max(abs(new[v] - post[v]) for v in new)
        post = new
        if moved < 1e-9:
            break
    return posterior


def quality_rules(docs: DataFrame, text: str = "text", keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """``docs`` with measures, votes, ``base_failed``, ``p_quality`` and ``kept``.

    The measures are written once to the shared folder: the vote patterns and the
    result both read that table, so each text is scanned once. ``keep_text=False``
    leaves the text out of that table and of the result.
    """
    votes = rules()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = measured(docs, text)
    if not keep_text:
        m = m.drop(text)
    m = m.withColumn("base_failed", base).withColumns({f"vote_{k}": v for k, v in votes.items()})
    m = materialise(m, "quality")
    names = [f"vote_{k}" for k in votes]
    counted = m.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("__n")).collect()
    posterior = fit([(tuple(r[c] for c in names), r["__n"]) for r in counted])
    # Votes plus one as base-3 digits index one literal array of posteriors.
    table = [posterior(v[::-1]) for v in itertools.product((-1, 0, 1), repeat=len(names))]
    index = sum(((F.col(c) + 1) * 3**j for j, c in enumerate(names)), F.lit(0))
    p = F.when(F.col("n_words") > 0, F.get(F.lit(table), index)).otherwise(F.lit(0.0))
    return m.withColumn("p_quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))
