import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from presswork.llm import neardup, suffixes
from presswork.llm.components import components
from tests.llm.helpers import ODD, prose, words


def sets(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(x, y):
    return len(x & y) / len(x | y)


def classes(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    have = defaultdict(list)
    for i, t in rows:
        if i is not None and sets(t):
            have[i].append(sets(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(jaccard(x, y) >= 0.8 for x in have[a] for y in have[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(11)
    rows, k = [], 0
    for _ in range(12):
        base = prose(rng, rng.randrange(40, 200)).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((k, rng.choice([" ", "\n"]).join(w)))
            k += 1
    rows += [(500 + j, t) for j, t in enumerate(ODD)] + [(600, "one  two"), (601, "one two"), (602, "x" * 5000)]
    return [*rows, rows[0], (None, rows[0][1])]


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, class_id double")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got.pop(None) is None  # a row without an id is in the result and has no class
    assert got == classes(rows)
    kept = neardup.deduplicated(df).collect()
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == set(got.values())


def test_large_family(spark, monkeypatch):
    """A family whose members hang together by chains only, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(2)
    w = prose(rng, 100).split()
    rows = []
    for k in range(40):
        rows.append((k, " ".join(w)))
        w[(k * 2) % 100] = prose(rng, 1)
        if k % 13 == 12:
            for j in range(12):
                w[(j * 8 + k) % 100] = prose(rng, 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == classes(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(df).collect() == [] and neardup.deduplicated(df).collect() == []


def test_signatures_follow_weights():
    """Coordinates agree as often as the weighted Jaccard similarity says, also for fractions."""
    rng = np.random.default_rng(4)
    hits, k, rounds = 0, 100, 40
    for _ in range(rounds):
        e = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        x, y = rng.uniform(0.1, 3, 60), rng.uniform(0.1, 3, 60)
        sig = neardup.dart_minhash(np.repeat([0, 1], 60), np.concatenate([e, e]), np.concatenate([x, y]), 2, k)
        hits += (sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs(hits / rounds) < 0.03


def test_shingles_match_words():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (0, 1, 3, 5, 6, 40)] + [t or "" for t in ODD]
    (i, j, data, offsets), = neardup.slices(pa.array(texts))
    doc, h, n = neardup.shingles(data, offsets)
    for k, t in enumerate(texts):
        assert (doc == k).sum() == len(sets(t)), t
        assert n[doc == k].sum() == (max(1, len(words(t)) - 4) if words(t) else 0)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_repeated_rows_stay_once(spark):
    """Row counts: a row that repeats id and words goes, rows of one id with other words stay."""
    rng = random.Random(13)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(1, a), (1, a), (1, a.replace(" ", "\n")), (2, b), (3, a), (3, a), (4, None), (4, ""), (5, b + " tail"), (6, c), (6, b[::-1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], " ".join(words(r["text"]))) for r in kept.collect())) == sorted([(1, a), (2, b), (4, ""), (6, c), (6, b[::-1])])
    nulls = spark.createDataFrame([(None, a), (None, a), (7, c)], "doc_id bigint, text string")
    assert neardup.deduplicated(nulls).count() == 3


def test_two_texts_under_one_id(spark):
    """A text goes if it is a copy, whatever else stands under its id; near copies under one id are one class."""
    rng = random.Random(16)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(1, a), (5, a + " tail"), (5, b), (6, c), (6, c + " tail"), (None, a), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = neardup.deduplicated(df).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] in (1, 5)) == sorted([a, b])
    assert [r["doc_id"] for r in kept].count(6) == 1 and [r["doc_id"] for r in kept].count(None) == 2
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (5, 1), (5, 5), (6, 6), (None, None), (None, None)], key=str)


def test_bucket_of_chains(spark, monkeypatch):
    """Groups that meet in buckets without their centres linking, over several blocks, weighted too."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(17)
    base = prose(rng, 60).split()
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = prose(rng, 1)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, weighted=True).collect()} == classes(rows)


def test_repeated_document_survives_the_cuts(spark):
    """What the near-dedup leaves of a repeated document of 400 bytes or more is not cut to nothing."""
    t = prose(random.Random(14), 150)
    df = spark.createDataFrame([(1, t), (1, t), (2, prose(random.Random(15), 150))], "doc_id bigint, text string")
    out = suffixes.deduplicated(neardup.deduplicated(df), length=400).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2] and {r["text"] for r in out if r["doc_id"] == 1} == {t}
