import random
from collections import Counter

from presswork.llm import quality
from tests.llm.helpers import ODD, prose, words


def model(text):
    w = words(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(tri)
    covered = {k + j for k, t in enumerate(tri) if c[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def corpus():
    rng = random.Random(3)
    good = [(k, ". ".join(prose(rng, 12) for _ in range(12)) + ".") for k in range(150)]
    bad = [(1000 + k, " ".join(w.upper() + "***" for w in prose(rng, 90).split())) for k in range(15)]
    loops = [(2000 + k, " ".join(rng.choice(["a b c", "d e f"]) for _ in range(40))) for k in range(5)]
    odd = [(3000 + k, t) for k, t in enumerate(ODD)]
    return good + bad + loops + odd + [good[0], (None, "no id here"), (4000, "w " * 70 + "\nq q q w w q")]


def test_measures_and_verdict(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, n_words string, other int")
    got = quality.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        m = model(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m, r["text"]
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["p_quality"] <= 1
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(150)) <= kept and not kept & set(range(1000, 1015))


def test_empty(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_estimation():
    """Two independent good rules and one coin: the coin is learned to say nothing."""
    rng = random.Random(1)
    rows = Counter()
    for _ in range(4000):
        y = rng.random() < 0.8
        vote = lambda right: (1 if y else -1) if rng.random() < right else (0 if rng.random() < 0.5 else (-1 if y else 1))  # noqa: B023, E731
        rows[(vote(0.95), vote(0.9), vote(0.9), rng.choice((-1, 0, 1)))] += 1
    p = quality.fit(list(rows.items()))
    assert p((1, 1, 1, -1)) > 0.95 and p((-1, -1, -1, 1)) < 0.05
    assert abs(p((1, 1, -1, 1)) - p((1, 1, -1, -1))) < 0.2
